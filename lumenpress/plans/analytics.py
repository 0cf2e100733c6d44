"""Registered queries of the engagement analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables as T
from ..operators import analytics as A
from .registry import query

_RECENT = f"TIMESTAMP '{T.AS_OF}'"
_W = f"sum({T.TENTHS_SQL}) / 10"


@query("a01_daily_active_users", T.sql("SELECT cast(created_at AS date) AS day, count(DISTINCT user_id) AS active_users FROM user_events GROUP BY 1", "user_events"))
def a01(spark: SparkSession, sf: str) -> DataFrame:
    return A.daily_active_users(T.user_events(spark, sf))


@query(
    "a02_top_articles",
    T.sql(
        f"""SELECT article_id, title, s.name AS source, view_count, read_count, bookmark_count, e.share_count, view_events, engagement_score
        FROM (SELECT article_id, count(*) FILTER (event_type = 'READ') AS read_count, count(*) FILTER (event_type = 'BOOKMARKED') AS bookmark_count,
          count(*) FILTER (event_type = 'SHARED') AS share_count, count(*) FILTER (event_type = 'VIEWED') AS view_events, {_W} AS engagement_score
          FROM user_events WHERE created_at >= {_RECENT} - INTERVAL 7 DAYS GROUP BY 1) e
        JOIN articles a ON a.id = e.article_id AND NOT a.is_duplicate LEFT JOIN sources s ON s.id = a.source_id
        ORDER BY engagement_score DESC, view_count DESC, published_at DESC, a.id LIMIT 20""",
        "articles",
        "sources",
        "user_events",
    ),
)
def a02(spark: SparkSession, sf: str) -> DataFrame:
    events = A.since(T.user_events(spark, sf), T.as_of(), 7)
    return A.top_articles(T.articles(spark, sf), events, T.sources(spark, sf))


@query(
    "a03_weighted_engagement",
    T.sql(
        f"""SELECT article_id, count(*) FILTER (event_type = 'READ') AS read_count, count(*) FILTER (event_type = 'BOOKMARKED') AS bookmark_count,
        count(*) FILTER (event_type = 'SHARED') AS share_count, count(*) FILTER (event_type = 'VIEWED') AS view_events, {_W} AS engagement_score FROM user_events GROUP BY 1""",
        "user_events",
    ),
)
def a03(spark: SparkSession, sf: str) -> DataFrame:
    return A.article_engagement(T.user_events(spark, sf))


def _mean(x: str, places: int = 2) -> str:
    return f"round(sum(cast(round({x} * 10000) AS bigint)) / count({x}) / 10000, {places})"


@query(
    "a04_category_reads",
    T.sql(
        f"""SELECT c.id AS category_id, c.name AS category_name, count(*) FILTER (event_type = 'READ') AS read_count, count(DISTINCT user_id) AS unique_users,
        {_mean("duration_seconds")} AS avg_duration_seconds, {_mean("scroll_percent")} AS avg_scroll_percent, {_W} AS engagement_score
        FROM categories c JOIN article_categories ac ON ac.category_id = c.id JOIN articles a ON a.id = ac.article_id JOIN user_events e ON e.article_id = a.id
        WHERE e.created_at >= {_RECENT} - INTERVAL 30 DAYS AND event_type IN ('READ', 'BOOKMARKED', 'SHARED') AND NOT a.is_duplicate GROUP BY 1, 2""",
        "categories",
        "article_categories",
        "articles",
        "user_events",
    ),
)
def a04(spark: SparkSession, sf: str) -> DataFrame:
    events = A.since(T.user_events(spark, sf), T.as_of(), 30)
    return A.category_reads(T.article_categories(spark, sf), T.categories(spark), T.articles(spark, sf), events)


@query(
    "a05_user_summary",
    T.sql(
        f"""SELECT user_id, count(*) AS total_events, count(*) FILTER (event_type = 'READ') AS read_count, count(*) FILTER (event_type = 'BOOKMARKED') AS bookmark_count,
        count(*) FILTER (event_type = 'SHARED') AS share_count, {_mean("duration_seconds")} AS avg_duration_seconds, max(created_at) AS last_active_at FROM user_events GROUP BY 1""",
        "user_events",
    ),
)
def a05(spark: SparkSession, sf: str) -> DataFrame:
    return A.user_summary(T.user_events(spark, sf))


@query(
    "a05_favourite_categories",
    T.sql(
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY engagement_score DESC, category_id) AS rank
        FROM (SELECT user_id, category_id, {_W} AS engagement_score, count(*) AS event_count FROM user_events JOIN article_categories USING (article_id) GROUP BY 1, 2)) WHERE rank <= 10""",
        "article_categories",
        "user_events",
    ),
)
def a05_favourites(spark: SparkSession, sf: str) -> DataFrame:
    return A.favourite_categories(T.user_events(spark, sf), T.article_categories(spark, sf))


@query(
    "a06_source_performance",
    T.sql(
        f"""SELECT s.id AS source_id, s.name AS source_name, coalesce(article_count, 0) AS article_count, coalesce(total_views, 0) AS total_views, coalesce(engagement_score, 0) AS engagement_score
        FROM sources s LEFT JOIN (SELECT source_id, count(DISTINCT id) AS article_count, sum(view_count) AS total_views FROM articles WHERE NOT is_duplicate GROUP BY 1) a ON a.source_id = s.id
        LEFT JOIN (SELECT source_id, {_W} AS engagement_score FROM user_events e JOIN articles a ON a.id = e.article_id WHERE e.created_at >= {_RECENT} - INTERVAL 30 DAYS AND NOT is_duplicate GROUP BY 1) e ON e.source_id = s.id""",
        "sources",
        "articles",
        "user_events",
    ),
)
def a06(spark: SparkSession, sf: str) -> DataFrame:
    events = T.user_events(spark, sf)
    return A.source_performance(T.sources(spark, sf), T.articles(spark, sf), events, A.since(events, T.as_of(), 30))


@query(
    "a07_overview",
    T.sql(
        f"""SELECT (SELECT count(DISTINCT user_id) FROM user_events) AS total_users, (SELECT count(*) FROM articles) AS total_articles, (SELECT count(*) FROM user_events) AS total_events,
        (SELECT count(*) FROM bookmarks) AS total_bookmarks, (SELECT count(DISTINCT user_id) FROM user_events WHERE created_at >= {_RECENT} - INTERVAL 7 DAYS) AS active_users_7d""",
        "articles",
        "user_events",
        "bookmarks",
    ),
)
def a07(spark: SparkSession, sf: str) -> DataFrame:
    e = T.user_events(spark, sf)
    recent = F.col("created_at") >= T.as_of() - F.expr("INTERVAL 7 DAYS")
    counts = e.agg(F.count_distinct("user_id").alias("total_users"), F.count(F.lit(1)).alias("total_events"), F.count_distinct(F.when(recent, F.col("user_id"))).alias("active_users_7d"))
    total = lambda d: d.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.withColumns({"total_articles": total(T.articles(spark, sf)), "total_bookmarks": total(T.bookmarks(spark, sf))})


@query(
    "a08_article_stats",
    T.sql("SELECT article_id, event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM user_events GROUP BY 1, 2", "user_events"),
)
def a08(spark: SparkSession, sf: str) -> DataFrame:
    return T.user_events(spark, sf).groupBy("article_id", "event_type").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"))


_RATING = f"""SELECT *, round({T.TENTHS_SQL} / 10 * coalesce(least(greatest(scroll_percent, 0) / 100, 1), CASE event_type WHEN 'VIEWED' THEN 0.1 WHEN 'READ' THEN 0.8 WHEN 'BOOKMARKED' THEN 1 WHEN 'SHARED' THEN 1 ELSE 0 END), 6) AS rating FROM user_events"""


@query(
    "a09_ratings_matrix",
    T.sql("SELECT user_id, article_id, max(rating) AS rating, count(*) AS events, max(created_at) AS last_event FROM rated GROUP BY 1, 2", "user_events", rated=_RATING),
)
def a09(spark: SparkSession, sf: str) -> DataFrame:
    return A.ratings(T.user_events(spark, sf)).drop("strongest")


@query(
    "a10_strongest_event",
    T.sql("SELECT user_id, article_id, rating, event_type AS strongest FROM (SELECT *, row_number() OVER (PARTITION BY user_id, article_id ORDER BY rating DESC, event_id) AS n FROM rated) WHERE n = 1", "user_events", rated=_RATING),
)
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return A.ratings(T.user_events(spark, sf)).select("user_id", "article_id", "rating", "strongest")


@query(
    "a11_daily_active_users_filled",
    T.sql(
        """SELECT cast(day AS date) AS day, coalesce(active_users, 0) AS active_users FROM (SELECT unnest(generate_series(min(cast(created_at AS date)), max(cast(created_at AS date)), INTERVAL 1 DAY)) AS day FROM user_events) d
        LEFT JOIN (SELECT cast(created_at AS date) AS day, count(DISTINCT user_id) AS active_users FROM user_events GROUP BY 1) e USING (day)""",
        "user_events",
    ),
)
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return A.daily_active_users_filled(T.user_events(spark, sf))


@query(
    "a12_top_news",
    T.sql(
        """SELECT a.id AS news_id, coalesce(reads, view_count) AS read_count, coalesce(shares, share_count) AS share_count, coalesce(cast(round(seconds / nullif(timed, 0)) AS bigint), 0) AS average_reading_seconds
        FROM articles a LEFT JOIN (SELECT news_id, count(*) FILTER (interaction_type <> 'share') AS reads, count(*) FILTER (interaction_type = 'share') AS shares,
          sum(cast(duration_seconds AS bigint)) FILTER (interaction_type = 'read') AS seconds, count(*) FILTER (interaction_type = 'read') AS timed
          FROM interactions WHERE interaction_type IN ('view', 'click', 'read', 'search_click', 'recommendation_click', 'share') GROUP BY 1) i ON i.news_id = a.id
        ORDER BY read_count DESC, share_count DESC, news_id LIMIT 25""",
        "articles",
        "interactions",
    ),
)
def a12(spark: SparkSession, sf: str) -> DataFrame:
    """Top news; articles nobody touched in the range count with their lifetime numbers."""
    i = T.interactions(spark, sf).filter(F.col("interaction_type").isin("view", "click", "read", "search_click", "recommendation_click", "share"))
    share, read = F.col("interaction_type") == "share", F.col("interaction_type") == "read"
    i = i.groupBy("news_id").agg(A.count_if(~share).alias("reads"), A.count_if(share).alias("shares"), F.sum(F.when(read, F.round("duration_seconds").cast("long"))).alias("seconds"), A.count_if(read).alias("timed"))
    d = T.articles(spark, sf).select("id", "view_count", F.col("share_count").alias("lifetime_shares")).join(i, F.col("id") == F.col("news_id"), "left")
    mean = F.coalesce(F.round(F.col("seconds") / F.nullif("timed", F.lit(0))).cast("long"), F.lit(0))
    d = d.select(F.col("id").alias("news_id"), F.coalesce("reads", "view_count").alias("read_count"), F.coalesce("shares", "lifetime_shares").alias("share_count"), mean.alias("average_reading_seconds"))
    return d.orderBy(F.desc("read_count"), F.desc("share_count"), "news_id").limit(25)


@query(
    "a13_category_traffic",
    T.sql(
        """SELECT category_id, views, reading_time_seconds, round(views * 100 / sum(views) OVER (), 2) AS percentage, title AS top_news_title
        FROM (SELECT category_id, count(*) AS views, sum(cast(round(duration_seconds) AS bigint)) AS reading_time_seconds FROM r GROUP BY 1)
        JOIN (SELECT category_id, title, row_number() OVER (PARTITION BY category_id ORDER BY count(*) DESC, title) AS n FROM r GROUP BY 1, 2) USING (category_id) WHERE n = 1""",
        "articles",
        "interactions",
        r="SELECT i.*, category_id, title FROM interactions i JOIN articles a ON a.id = i.news_id WHERE interaction_type IN ('view', 'click', 'read', 'search_click', 'recommendation_click')",
    ),
)
def a13(spark: SparkSession, sf: str) -> DataFrame:
    """Per category: views, reading time, share of all views, and the most viewed title."""
    i = T.interactions(spark, sf).filter(F.col("interaction_type").isin("view", "click", "read", "search_click", "recommendation_click"))
    i = i.join(T.articles(spark, sf).select(F.col("id").alias("news_id"), "category_id", "title"), "news_id")
    per_title = i.groupBy("category_id", "title").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("duration_seconds").cast("long")).alias("s"))
    # the title with the most views; the first by name where equal
    d = per_title.groupBy("category_id").agg(F.sum("n").alias("views"), F.sum("s").alias("reading_time_seconds"), F.min(F.struct(-F.col("n"), "title"))["title"].alias("top_news_title"))
    return d.withColumn("percentage", F.round(F.col("views") * 100 / F.sum("views").over(Window.partitionBy()), 2))


@query(
    "a14_report_summary",
    T.sql(
        """SELECT count(DISTINCT user_id) AS active_users_in_range, count(*) AS total_interactions, count(*) FILTER (interaction_type IN ('view', 'click', 'read', 'search_click', 'recommendation_click')) AS total_reads,
        count(*) FILTER (interaction_type = 'share') AS total_shares, cast(round(sum(cast(round(duration_seconds) AS bigint)) FILTER (interaction_type = 'read') / count(*) FILTER (interaction_type = 'read')) AS bigint) AS average_reading_seconds FROM interactions""",
        "interactions",
    ),
)
def a14(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("interaction_type")
    read = kind == "read"
    return T.interactions(spark, sf).agg(
        F.count_distinct("user_id").alias("active_users_in_range"),
        F.count(F.lit(1)).alias("total_interactions"),
        A.count_if(kind.isin("view", "click", "read", "search_click", "recommendation_click")).alias("total_reads"),
        A.count_if(kind == "share").alias("total_shares"),
        F.round(F.sum(F.when(read, F.round("duration_seconds").cast("long"))) / A.count_if(read)).cast("long").alias("average_reading_seconds"),
    )


@query(
    "a15_user_dashboard",
    T.sql(
        f"""SELECT user_id, count(DISTINCT news_id) FILTER (interaction_type IN ('view', 'read', 'click', 'search_click')) AS articles_read, sum(cast(round(duration_seconds) AS bigint)) AS total_seconds,
        coalesce(sum(cast(round(duration_seconds) AS bigint)) FILTER (created_at >= {_RECENT} - INTERVAL 7 DAYS), 0) AS week_seconds,
        round(count(*) FILTER (interaction_type IN ('click', 'search_click')) * 100 / count(*), 2) AS click_percent FROM interactions GROUP BY 1""",
        "interactions",
    ),
)
def a15(spark: SparkSession, sf: str) -> DataFrame:
    kind, seconds = F.col("interaction_type"), F.round("duration_seconds").cast("long")
    recent = F.col("created_at") >= T.as_of() - F.expr("INTERVAL 7 DAYS")
    return T.interactions(spark, sf).groupBy("user_id").agg(
        F.count_distinct(F.when(kind.isin("view", "read", "click", "search_click"), F.col("news_id"))).alias("articles_read"),
        F.sum(seconds).alias("total_seconds"),
        F.coalesce(F.sum(F.when(recent, seconds)), F.lit(0)).alias("week_seconds"),
        F.round(A.count_if(kind.isin("click", "search_click")) * 100 / F.count(F.lit(1)), 2).alias("click_percent"),
    )


_WEIGHT = """CASE WHEN interaction_type = 'read' THEN (CASE WHEN duration_seconds < 5 THEN 1.0 ELSE 3.0 END) + (CASE WHEN duration_seconds >= 30 THEN 2 ELSE 0 END) + (CASE WHEN duration_seconds >= 60 THEN 3 ELSE 0 END) + (CASE WHEN duration_seconds >= 180 THEN 4 ELSE 0 END)
  WHEN interaction_type = 'save' THEN 6 WHEN interaction_type = 'share' THEN 5 WHEN interaction_type = 'search_click' THEN 3 ELSE 1 END"""
_DECAY = f"(1 / (1 + greatest(0, (epoch_us({_RECENT}) - epoch_us(created_at)) / 86400e6) * 0.05))"


@query(
    "a16_profile_category_scores",
    T.sql(
        f"""SELECT user_id, category_id, round(sum(cast(round({_WEIGHT}::double * {_DECAY} * 1000000) AS bigint)) / 1000000, 2) AS score
        FROM interactions i JOIN articles a ON a.id = i.news_id GROUP BY 1, 2""",
        "articles",
        "interactions",
    ),
)
def a16(spark: SparkSession, sf: str) -> DataFrame:
    """Decayed weight of each user's interactions by category."""
    w = F.round(A.interaction_weight() * A.decay(T.as_of()) * 1_000_000).cast("long")
    d = T.interactions(spark, sf).join(T.articles(spark, sf).select(F.col("id").alias("news_id"), "category_id"), "news_id")
    return d.groupBy("user_id", "category_id").agg(F.round(F.sum(w) / 1_000_000, 2).alias("score"))


@query(
    "a17_recent_interactions",
    T.sql(
        f"""SELECT news_id, count(*) FILTER (interaction_type = 'view') AS views, count(*) FILTER (interaction_type = 'share') AS shares, count(*) FILTER (interaction_type = 'search_click') AS search_clicks
        FROM interactions WHERE created_at >= {_RECENT} - INTERVAL 72 HOURS GROUP BY 1""",
        "interactions",
    ),
)
def a17(spark: SparkSession, sf: str) -> DataFrame:
    """Interactions per article in the hours before as_of (the data end a day before it, hence 72)."""
    i = T.interactions(spark, sf).filter(F.col("created_at") >= T.as_of() - F.expr("INTERVAL 72 HOURS"))
    return i.groupBy("news_id").agg(*(A.count_if(F.col("interaction_type") == k).alias(n) for n, k in (("views", "view"), ("shares", "share"), ("search_clicks", "search_click"))))


@query("a18_category_stats", T.sql("SELECT category_id, count(*) AS articles, count(*) FILTER (confidence >= 0.55) AS reliable FROM article_categories GROUP BY 1", "article_categories"))
def a18(spark: SparkSession, sf: str) -> DataFrame:
    return T.article_categories(spark, sf).groupBy("category_id").agg(F.count(F.lit(1)).alias("articles"), A.count_if(F.col("confidence") >= 0.55).alias("reliable"))


@query("a19_articles_by_category", T.sql("SELECT category_id, id, count(*) OVER (PARTITION BY category_id) AS n FROM articles", "articles"))
def a19(spark: SparkSession, sf: str) -> DataFrame:
    """The articles of each category as rows, with the category's size; sizes are counted first and joined, so no group meets in a task."""
    a = T.articles(spark, sf).select("category_id", "id")
    return a.join(a.groupBy("category_id").agg(F.count(F.lit(1)).alias("n")), "category_id")


@query("a20_articles_by_label", T.sql("SELECT category_id AS label, count(*) AS articles, min(article_id) AS first_article FROM article_categories GROUP BY 1", "article_categories"))
def a20(spark: SparkSession, sf: str) -> DataFrame:
    return T.article_categories(spark, sf).groupBy(F.col("category_id").alias("label")).agg(F.count(F.lit(1)).alias("articles"), F.min("article_id").alias("first_article"))


@query(
    "a21_multilabel_stats",
    T.sql("SELECT c.name AS label, count(ac.article_id) AS articles, count(*) FILTER (confidence >= 0.8) AS confident FROM categories c LEFT JOIN article_categories ac ON ac.category_id = c.id GROUP BY 1", "categories", "article_categories"),
)
def a21(spark: SparkSession, sf: str) -> DataFrame:
    """Articles per label, labels without any included."""
    d = T.categories(spark).join(T.article_categories(spark, sf), F.col("id") == F.col("category_id"), "left")
    return d.groupBy(F.col("name").alias("label")).agg(F.count("article_id").alias("articles"), A.count_if(F.col("confidence") >= 0.8).alias("confident"))


@query("a22_usage_by_day", T.sql("SELECT cast(created_at AS date) AS day, event_type, count(*) AS calls, cast(sum(cast(round(duration_seconds) AS bigint)) AS bigint) AS seconds FROM user_events GROUP BY 1, 2", "user_events"))
def a22(spark: SparkSession, sf: str) -> DataFrame:
    return T.user_events(spark, sf).groupBy(F.to_date("created_at").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.round("duration_seconds").cast("long")).alias("seconds"))


@query("a23_dedupe_stats", "SELECT count(*) AS raw, count(DISTINCT sha256(text)) AS clusters, count(*) - count(DISTINCT sha256(text)) AS merged, round(count(*) / count(DISTINCT sha256(text)), 4) AS average_size FROM documents")
def a23(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, groups of equal texts, and their mean size."""
    d = T.raw(spark, sf, "documents").agg(F.count(F.lit(1)).alias("raw"), F.count_distinct(F.sha2("text", 256)).alias("clusters"))
    return d.withColumns({"merged": F.col("raw") - F.col("clusters"), "average_size": F.round(F.col("raw") / F.col("clusters"), 4)})


_QUEUE = "SELECT doc_id, CASE WHEN toxic = 1 AND quality = 0 THEN 'REJECTED' WHEN toxic = 1 THEN 'PENDING' ELSE 'APPROVED' END AS status, (doc_id % 100) / 100 AS confidence FROM labels"


def _queue(spark: SparkSession, sf: str) -> DataFrame:
    toxic = F.col("toxic") == 1
    status = F.when(toxic & (F.col("quality") == 0), "REJECTED").when(toxic, "PENDING").otherwise("APPROVED")
    return T.raw(spark, sf, "labels").select("doc_id", status.alias("status"), (F.col("doc_id") % 100 / 100).alias("confidence"))


@query("a24_moderation_summary", T.sql("SELECT status, count(*) AS items, round(sum(cast(round(confidence * 100) AS bigint)) / count(*) / 100, 4) AS average_confidence FROM q GROUP BY 1", q=_QUEUE))
def a24(spark: SparkSession, sf: str) -> DataFrame:
    return _queue(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum(F.round(F.col("confidence") * 100).cast("long")) / F.count(F.lit(1)) / 100, 4).alias("average_confidence"))


@query("a25_moderation_counters", T.sql("SELECT count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status <> 'PENDING') AS reviewed, count(*) AS total FROM q", q=_QUEUE))
def a25(spark: SparkSession, sf: str) -> DataFrame:
    return _queue(spark, sf).agg(A.count_if(F.col("status") == "PENDING").alias("pending"), A.count_if(F.col("status") != "PENDING").alias("reviewed"), F.count(F.lit(1)).alias("total"))


_CORRECTIONS = """SELECT doc_id AS article_id, doc_id % 5 AS admin_id, [cast(doc_id % 9 AS int)] AS original, [cast((doc_id + quality) % 9 AS int), cast((doc_id * 2) % 9 AS int)] AS corrected,
  1 + (doc_id % 3) / 2 AS weight, toxic = 1 AS is_verified, CASE WHEN doc_id % 4 = 0 THEN 'pending' ELSE 'processed' END AS status,
  TIMESTAMP '2024-01-31 00:00:00' - to_hours(cast(doc_id % 200 AS int)) AS corrected_at FROM labels"""


def corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Label corrections by administrators, made from the labels table."""
    i = F.col("doc_id")
    when = F.timestamp_seconds(F.unix_timestamp(T.as_of()) - i % 200 * 3600)
    return T.raw(spark, sf, "labels").select(
        i.alias("article_id"),
        (i % 5).alias("admin_id"),
        F.array((i % 9).cast("int")).alias("original"),
        F.array(((i + F.col("quality")) % 9).cast("int"), (i * 2 % 9).cast("int")).alias("corrected"),
        (1 + i % 3 / 2).alias("weight"),
        (F.col("toxic") == 1).alias("is_verified"),
        F.when(i % 4 == 0, "pending").otherwise("processed").alias("status"),
        when.alias("corrected_at"),
    )


@query(
    "a26_confusion_matrix",
    T.sql("SELECT o AS original_label, n AS corrected_label, count(*) AS corrections FROM (SELECT unnest(original) AS o, corrected FROM c), unnest(corrected) AS t(n) WHERE o <> n GROUP BY 1, 2", c=_CORRECTIONS),
)
def a26(spark: SparkSession, sf: str) -> DataFrame:
    """How often one label was corrected to another."""
    d = corrections(spark, sf).select(F.explode("original").alias("original_label"), "corrected").select("original_label", F.explode("corrected").alias("corrected_label"))
    return d.filter("original_label <> corrected_label").groupBy("original_label", "corrected_label").agg(F.count(F.lit(1)).alias("corrections"))


@query(
    "a26_agreement",
    T.sql("SELECT count(*) AS corrections, round(avg(CASE WHEN list_has_any(original, corrected) THEN 1 ELSE 0 END), 4) AS agreement, round((avg(CASE WHEN list_has_any(original, corrected) THEN 1 ELSE 0 END) - 1 / 9) / (1 - 1 / 9), 4) AS approx_kappa FROM c", c=_CORRECTIONS),
)
def a26_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement and an approximate kappa with an expected agreement of one ninth."""
    rate = F.avg(F.when(F.arrays_overlap("original", "corrected"), 1).otherwise(0))
    return corrections(spark, sf).agg(F.count(F.lit(1)).alias("corrections"), F.round(rate, 4).alias("agreement"), F.round((rate - F.lit(1 / 9)) / F.lit(1 - 1 / 9), 4).alias("approx_kappa"))


@query("a27_admin_stats", T.sql("SELECT admin_id, count(*) AS corrections, count(*) FILTER (is_verified) AS verified, max(corrected_at) AS last_correction FROM c GROUP BY 1", c=_CORRECTIONS))
def a27(spark: SparkSession, sf: str) -> DataFrame:
    return corrections(spark, sf).groupBy("admin_id").agg(F.count(F.lit(1)).alias("corrections"), A.count_if(F.col("is_verified")).alias("verified"), F.max("corrected_at").alias("last_correction"))


@query("a28_feedback_queue", T.sql("SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (is_verified) AS verified FROM c", c=_CORRECTIONS))
def a28(spark: SparkSession, sf: str) -> DataFrame:
    return corrections(spark, sf).agg(A.count_if(F.col("status") == "pending").alias("pending"), A.count_if(F.col("status") == "processed").alias("processed"), A.count_if(F.col("is_verified")).alias("verified"))


@query("a29_top_sources", "SELECT source, count(*) AS articles FROM documents GROUP BY 1 ORDER BY articles DESC, source LIMIT 12")
def a29(spark: SparkSession, sf: str) -> DataFrame:
    return T.raw(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("articles")).orderBy(F.desc("articles"), "source").limit(12)


@query(
    "a30_category_distribution",
    T.sql("SELECT c.name AS category, count(a.id) AS articles, count(*) FILTER (a.published_at >= TIMESTAMP '2024-01-30 00:00:00') AS today FROM categories c LEFT JOIN articles a ON a.category_id = c.id GROUP BY 1", "categories", "articles"),
)
def a30(spark: SparkSession, sf: str) -> DataFrame:
    d = T.categories(spark).withColumnRenamed("id", "cid").join(T.articles(spark, sf), F.col("cid") == F.col("category_id"), "left")
    today = F.col("published_at") >= T.as_of() - F.expr("INTERVAL 1 DAY")
    return d.groupBy(F.col("name").alias("category")).agg(F.count("id").alias("articles"), A.count_if(today).alias("today"))


@query(
    "a31_week_activity",
    T.sql(
        """SELECT d.day, count(event_id) FILTER (event_type = 'READ') AS reads, count(DISTINCT user_id) AS active_users FROM (SELECT cast(unnest(generate_series(DATE '2024-01-25', DATE '2024-01-31', INTERVAL 1 DAY)) AS date) AS day) d
        LEFT JOIN user_events e ON cast(e.created_at AS date) = d.day GROUP BY 1""",
        "user_events",
    ),
)
def a31(spark: SparkSession, sf: str) -> DataFrame:
    """Reads and active users of the seven days up to as_of, days without events included."""
    days = spark.range(1).select(F.explode(F.sequence(F.date_sub(T.as_of(), 6), F.to_date(T.as_of()))).alias("day"))
    e = A.since(T.user_events(spark, sf), F.date_trunc("day", T.as_of()), 6).groupBy(F.to_date("created_at").alias("day"))
    return days.join(e.agg(A.count_if(F.col("event_type") == "READ").alias("reads"), F.count_distinct("user_id").alias("active_users")), "day", "left").fillna(0)


@query("a32_notification_summary", T.sql("SELECT count(*) AS total, count(*) FILTER (event_type = 'VIEWED') AS pending, count(*) FILTER (event_type = 'READ') AS sent, count(*) FILTER (event_type = 'SKIPPED') AS failed FROM user_events", "user_events"))
def a32(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by state; views stand for pending, reads for sent, skips for failed notifications."""
    kind = F.col("event_type")
    return T.user_events(spark, sf).agg(F.count(F.lit(1)).alias("total"), A.count_if(kind == "VIEWED").alias("pending"), A.count_if(kind == "READ").alias("sent"), A.count_if(kind == "SKIPPED").alias("failed"))


_TABLES = ("documents", "events", "pages", "labels", "conversations", "customer", "orders")


@query("a34_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _TABLES))
def a34(spark: SparkSession, sf: str) -> DataFrame:
    counts = [T.raw(spark, sf, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n") for t in _TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("a35_event_source_summary", "SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1")
def a35(spark: SparkSession, sf: str) -> DataFrame:
    return T.raw(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query("a36_label_counts", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def a36(spark: SparkSession, sf: str) -> DataFrame:
    return T.raw(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a37_reading_profile",
    T.sql("SELECT user_id, category_id, count(*) AS reads, max(count(*)) OVER (PARTITION BY user_id) AS most FROM user_events e JOIN articles a ON a.id = e.article_id WHERE event_type = 'READ' GROUP BY 1, 2", "articles", "user_events"),
)
def a37(spark: SparkSession, sf: str) -> DataFrame:
    d = T.user_events(spark, sf).filter("event_type = 'READ'").join(T.articles(spark, sf).select(F.col("id").alias("article_id"), "category_id"), "article_id")
    d = d.groupBy("user_id", "category_id").agg(F.count(F.lit(1)).alias("reads"))
    return d.withColumn("most", F.max("reads").over(Window.partitionBy("user_id")))


@query(
    "a38_topic_trend",
    T.sql("SELECT ac.category_id AS topic, sum(cast(round(confidence * 100) AS bigint) * view_count) / 100 AS score, count(*) AS articles FROM articles a JOIN article_categories ac ON ac.article_id = a.id GROUP BY 1", "articles", "article_categories"),
)
def a38(spark: SparkSession, sf: str) -> DataFrame:
    """Views weighted by how much an article belongs to a topic."""
    d = T.article_categories(spark, sf).join(T.articles(spark, sf).select(F.col("id").alias("article_id"), "view_count"), "article_id")
    return d.groupBy(F.col("category_id").alias("topic")).agg((F.sum(F.round(F.col("confidence") * 100).cast("long") * F.col("view_count")) / 100).alias("score"), F.count(F.lit(1)).alias("articles"))


@query("a39_filtered_count", T.sql("SELECT count(*) AS total FROM (SELECT DISTINCT id FROM articles a JOIN article_categories c ON c.article_id = a.id WHERE NOT is_duplicate AND language = 'en' AND c.category_id IN (1, 4))", "articles", "article_categories"))
def a39(spark: SparkSession, sf: str) -> DataFrame:
    a = T.articles(spark, sf).filter((~F.col("is_duplicate")) & (F.col("language") == "en"))
    c = T.article_categories(spark, sf).filter(F.col("category_id").isin(1, 4))
    return a.join(c, F.col("id") == F.col("article_id"), "left_semi").agg(F.count(F.lit(1)).alias("total"))


@query("a40_price_range", "SELECT o_custkey, min(o_totalprice) AS price_min, max(o_totalprice) AS price_max, max(o_orderdate) AS latest FROM orders GROUP BY 1")
def a40(spark: SparkSession, sf: str) -> DataFrame:
    return T.raw(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("price_min"), F.max("o_totalprice").alias("price_max"), F.max("o_orderdate").alias("latest"))
