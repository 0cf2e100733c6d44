"""Registered queries of projections, filters, joins, windows, sorts and set operations on articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import scoring as S
from ..functions import text as X
from ..operators import analytics as A
from ..operators import relational as R
from . import sqltext as Q
from .registry import query

_NOW = f"TIMESTAMP '{T.AS_OF}'"
_HOURS = f"greatest(0, (epoch_us({_NOW}) - epoch_us(published_at)) / 3600e6)"


def ladder_sql(name: str) -> str:
    steps, older, missing = S.LADDERS[name]
    return f"CASE WHEN published_at IS NULL THEN {missing} " + " ".join(f"WHEN {_HOURS} <= {h} THEN {s}" for h, s in steps) + f" ELSE {older} END"


@query("f01_filter_articles", T.sql("SELECT DISTINCT id, title, source_id, language FROM articles a JOIN article_categories c ON c.article_id = a.id WHERE NOT is_duplicate AND c.category_id = 3 AND source_id IN (0, 1, 2, 3, 4, 5) AND published_at >= TIMESTAMP '2024-01-05 00:00:00' AND published_at <= TIMESTAMP '2024-01-25 00:00:00' AND language = 'en'", "articles", "article_categories"))
def f01(spark: SparkSession, sf: str) -> DataFrame:
    d = R.filter_articles(T.articles(spark, sf), T.article_categories(spark, sf), categories=[3], sources=[0, 1, 2, 3, 4, 5], start="2024-01-05 00:00:00", end="2024-01-25 00:00:00", language="en")
    return d.select("id", "title", "source_id", "language")


@query(
    "f02_advanced_filter",
    T.sql("SELECT id, view_count FROM articles a WHERE NOT is_duplicate AND id IN (SELECT article_id FROM article_categories WHERE category_id IN (1, 2, 5)) AND id IN (SELECT article_id FROM bookmarks)", "articles", "article_categories", "bookmarks"),
)
def f02(spark: SparkSession, sf: str) -> DataFrame:
    d = R.filter_articles(T.articles(spark, sf), T.article_categories(spark, sf), categories=[1, 2, 5])
    return d.join(T.bookmarks(spark, sf).select(F.col("article_id").alias("id")), "id", "left_semi").select("id", "view_count")


@query("f03_resolved_language", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'de' END, CASE WHEN c_nationkey % 2 = 0 THEN 'en' END, 'tr') AS language FROM customer")
def f03(spark: SparkSession, sf: str) -> DataFrame:
    """The asked language, else the user's, else the default."""
    d = T.raw(spark, sf, "customer")
    return d.select("c_custkey", F.coalesce(F.when(F.col("c_custkey") % 3 == 0, "de"), F.when(F.col("c_nationkey") % 2 == 0, "en"), F.lit("tr")).alias("language"))


@query("f04_language_feed", T.sql("SELECT id, title, published_at FROM articles WHERE language = 'fr' AND NOT is_duplicate ORDER BY published_at DESC, id LIMIT 50", "articles"))
def f04(spark: SparkSession, sf: str) -> DataFrame:
    d = T.articles(spark, sf).filter("language = 'fr' and not is_duplicate")
    return d.orderBy(F.desc("published_at"), "id").limit(50).select("id", "title", "published_at")


@query("f05_trending_category", T.sql("SELECT id FROM articles WHERE view_count >= 900 OR share_count >= 85 OR view_count / 997 >= 0.95", "articles"))
def f05(spark: SparkSession, sf: str) -> DataFrame:
    """The special category of what is trending, prominent or important."""
    return T.articles(spark, sf).filter((F.col("view_count") >= 900) | (F.col("share_count") >= 85) | (F.col("view_count") / 997 >= 0.95)).select("id")


@query("f06_source_match", T.sql(f"SELECT id, source_name FROM articles WHERE {Q.search_normal('source_name')} IN ('src1', 'src12')", "articles"))
def f06(spark: SparkSession, sf: str) -> DataFrame:
    return T.articles(spark, sf).filter(X.search_normal(F.col("source_name")).isin("src1", "src12")).select("id", "source_name")


@query(
    "f07_date_presets",
    T.sql(
        f"""SELECT 'today' AS preset, count(*) AS n FROM articles WHERE published_at >= date_trunc('day', {_NOW} - INTERVAL 1 HOUR) AND published_at < {_NOW}
        UNION ALL SELECT 'this_week', count(*) FROM articles WHERE published_at >= date_trunc('week', {_NOW} - INTERVAL 1 HOUR) AND published_at < {_NOW}
        UNION ALL SELECT 'this_month', count(*) FROM articles WHERE published_at >= date_trunc('month', {_NOW} - INTERVAL 1 HOUR) AND published_at < {_NOW}""",
        "articles",
    ),
)
def f07(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of today, this week (from Monday) and this month, seen from an hour before as_of."""
    now = T.as_of() - F.expr("INTERVAL 1 HOUR")
    flags = {"today": "day", "this_week": "week", "this_month": "month"}
    a = T.articles(spark, sf).filter(F.col("published_at") < T.as_of())
    counts = a.agg(*(A.count_if(F.col("published_at") >= F.date_trunc(unit, now)).alias(name) for name, unit in flags.items()))
    return counts.unpivot([], list(flags), "preset", "n")


@query("f08_event_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND p_size BETWEEN 10 AND 30 AND contains(lower(p_type), 'e')")
def f08(spark: SparkSession, sf: str) -> DataFrame:
    """Conjunction of contains predicates and a range."""
    d = T.raw(spark, sf, "part")
    return d.filter(F.lower("p_name").contains("a") & F.col("p_size").between(10, 30) & F.lower("p_type").contains("e")).select("p_partkey", "p_name")


@query(
    "f09_event_presets",
    """SELECT 'tomorrow' AS preset, count(*) AS n FROM events WHERE ts >= DATE '2024-01-10' + INTERVAL 1 DAY AND ts < DATE '2024-01-10' + INTERVAL 2 DAYS
    UNION ALL SELECT 'week', count(*) FROM events WHERE ts >= DATE '2024-01-10' AND ts < DATE '2024-01-10' + INTERVAL 7 DAYS
    UNION ALL SELECT 'weekend', count(*) FROM events WHERE ts >= DATE '2024-01-13' AND ts < DATE '2024-01-15'
    UNION ALL SELECT 'month', count(*) FROM events WHERE ts >= DATE '2024-01-10' AND ts < DATE '2024-01-10' + INTERVAL 1 MONTH""",
)
def f09(spark: SparkSession, sf: str) -> DataFrame:
    """Events of tomorrow, the next seven days, the coming weekend and the next month, seen from 10 January."""
    day = F.lit("2024-01-10").cast("date")
    weekend = F.next_day(day, "Sat")
    spans = {"tomorrow": (F.date_add(day, 1), F.date_add(day, 2)), "week": (day, F.date_add(day, 7)), "weekend": (weekend, F.date_add(weekend, 2)), "month": (day, F.add_months(day, 1))}
    ts = F.col("ts")
    counts = T.raw(spark, sf, "events").agg(*(A.count_if((ts >= a) & (ts < b)).alias(k) for k, (a, b) in spans.items()))
    return counts.unpivot([], list(spans), "preset", "n")


@query("f10_region_match", "SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = (SELECT min(r_name) FROM region)")
def f10(spark: SparkSession, sf: str) -> DataFrame:
    first = T.raw(spark, sf, "region").agg(F.min("r_name").alias("r")).scalar()
    r = T.raw(spark, sf, "region").filter(F.col("r_name") == first)
    n = T.raw(spark, sf, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return T.raw(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")


@query("f13_category_with_fallback", T.sql("SELECT id FROM (SELECT id, published_at, is_match, bool_or(is_match) OVER () AS found FROM (SELECT id, published_at, view_count > 2000 AS is_match FROM articles)) WHERE is_match OR NOT found ORDER BY published_at DESC, id LIMIT 30", "articles"))
def f13(spark: SparkSession, sf: str) -> DataFrame:
    """Trending articles, or the newest ones where nothing trends."""
    a = T.articles(spark, sf)
    hot = a.filter("view_count > 2000")
    none = hot.limit(1).agg((F.count(F.lit(1)) == 0).alias("none")).scalar()
    return hot.unionByName(a.filter(none)).orderBy(F.desc("published_at"), "id").limit(30).select("id")


@query("f17_admin_articles", T.sql("SELECT a.id, a.title, s.name AS source, s.trust_score FROM articles a LEFT JOIN sources s ON s.id = a.source_id WHERE NOT is_duplicate ORDER BY a.published_at DESC, a.id LIMIT 20 OFFSET 40", "articles", "sources"))
def f17(spark: SparkSession, sf: str) -> DataFrame:
    s = T.sources(spark, sf).select(F.col("id").alias("source_id"), F.col("name").alias("source"), "trust_score")
    d = T.articles(spark, sf).filter("not is_duplicate").join(s, "source_id", "left")
    return R.page(d.orderBy(F.desc("published_at"), "id"), 3, 20).select("id", "title", "source", "trust_score")


@query("f18_retention", T.sql(f"SELECT id FROM articles WHERE published_at IS NULL OR published_at > {_NOW} - INTERVAL 2 DAYS", "articles"))
def f18(spark: SparkSession, sf: str) -> DataFrame:
    d = T.articles(spark, sf)
    return d.filter(F.col("published_at").isNull() | (F.col("published_at") > T.as_of() - F.expr("INTERVAL 2 DAYS"))).select("id")


@query("f20_compact_payload", T.sql("SELECT id, CASE WHEN length(content) <= 650 THEN content ELSE regexp_replace(substr(content, 1, 650), '(?s)\\s+[^\\s]*\\z', '') END AS excerpt FROM articles", "articles"))
def f20(spark: SparkSession, sf: str) -> DataFrame:
    """Article texts cut at a word boundary for a feed; the cut is the feature."""
    c = F.col("content")
    return T.articles(spark, sf).select("id", F.when(F.length(c) <= 650, c).otherwise(F.regexp_replace(F.substring(c, 1, 650), r"(?s)\s+[^\s]*\z", "")).alias("excerpt"))


@query("f21_transport_fields", T.sql("SELECT id, coalesce(nullif(title, ''), nullif(summary, ''), 'untitled') AS title, coalesce(nullif(language, ''), 'tr') AS language, coalesce(nullif(view_count, 0), share_count) AS views FROM articles", "articles"))
def f21(spark: SparkSession, sf: str) -> DataFrame:
    """Fields from the first alias that isn't missing; empty text and zero count as missing."""
    first = lambda *cols: F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in cols))
    return T.articles(spark, sf).select("id", F.coalesce(first("title", "summary"), F.lit("untitled")).alias("title"), F.coalesce(first("language"), F.lit("tr")).alias("language"), F.coalesce(F.nullif("view_count", F.lit(0)), "share_count").alias("views"))


@query("f23_feedback_list", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND turn = 0 ORDER BY conv_id, turn LIMIT 50")
def f23(spark: SparkSession, sf: str) -> DataFrame:
    return T.raw(spark, sf, "conversations").filter("role = 'user' and turn = 0").orderBy("conv_id", "turn").limit(50).select("conv_id", "turn", "text")


@query("f24_feed_quality", T.sql("SELECT id FROM articles WHERE length(title) >= 15 AND content <> '' AND NOT regexp_matches(lower(title), '(casino|bahis|bet|viagra|worthless)')", "articles"))
def f24(spark: SparkSession, sf: str) -> DataFrame:
    d = T.articles(spark, sf)
    return d.filter((F.length("title") >= 15) & (F.col("content") != "") & ~F.lower("title").rlike("(casino|bahis|bet|viagra|worthless)")).select("id")


@query("f27_user_search", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '12') AND c_custkey <> 12 ORDER BY c_custkey LIMIT 20")
def f27(spark: SparkSession, sf: str) -> DataFrame:
    return T.raw(spark, sf, "customer").filter(F.lower("c_name").contains("12") & (F.col("c_custkey") != 12)).orderBy("c_custkey").limit(20).select("c_custkey", "c_name")


@query(
    "f30_admin_override",
    T.sql("SELECT a.id, coalesce(o.category_id, a.category_id) AS category_id, CASE WHEN o.featured THEN 100 ELSE view_count / 10 END AS relevance FROM articles a LEFT JOIN (SELECT doc_id, 8 AS category_id, quality = 1 AS featured, toxic = 1 AS hidden FROM labels) o ON o.doc_id = a.id WHERE NOT coalesce(o.hidden, false)", "articles"),
)
def f30(spark: SparkSession, sf: str) -> DataFrame:
    """Corrections by administrators: new category, featured at the top, or hidden."""
    o = T.raw(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit(8).alias("forced"), (F.col("quality") == 1).alias("featured"), (F.col("toxic") == 1).alias("hidden"))
    d = T.articles(spark, sf).join(o, "id", "left").filter(~F.coalesce("hidden", F.lit(False)))
    return d.select("id", F.coalesce("forced", "category_id").alias("category_id"), F.when(F.col("featured"), 100).otherwise(F.col("view_count") / 10).alias("relevance"))


# --- joins


@query("j01_article_source", T.sql("SELECT a.id, s.name, s.trust_score FROM articles a LEFT JOIN sources s ON s.id = a.source_id", "articles", "sources"))
def j01(spark: SparkSession, sf: str) -> DataFrame:
    s = T.sources(spark, sf).withColumnRenamed("id", "source_id")
    return T.articles(spark, sf).join(s, "source_id", "left").select("id", "name", "trust_score")


@query("j04_star", T.sql("SELECT c.name, count(*) AS events, count(DISTINCT a.id) AS articles FROM categories c JOIN article_categories ac ON ac.category_id = c.id JOIN articles a ON a.id = ac.article_id JOIN user_events e ON e.article_id = a.id GROUP BY 1", "categories", "article_categories", "articles", "user_events"))
def j04(spark: SparkSession, sf: str) -> DataFrame:
    e = T.user_events(spark, sf).groupBy("article_id").agg(F.count(F.lit(1)).alias("n"))  # before the join: the bridge multiplies rows
    a = T.articles(spark, sf).select(F.col("id").alias("article_id"))
    d = e.join(a, "article_id", "left_semi").join(T.article_categories(spark, sf).select("article_id", "category_id"), "article_id")
    d = d.join(T.categories(spark).withColumnRenamed("id", "category_id"), "category_id")
    return d.groupBy("name").agg(F.sum("n").alias("events"), F.count_distinct("article_id").alias("articles"))


@query("j07_uncategorised", T.sql("SELECT id FROM articles a WHERE NOT EXISTS (SELECT 1 FROM article_categories c WHERE c.article_id = a.id AND confidence >= 0.9)", "articles", "article_categories"))
def j07(spark: SparkSession, sf: str) -> DataFrame:
    sure = T.article_categories(spark, sf).filter("confidence >= 0.9").select(F.col("article_id").alias("id"))
    return T.articles(spark, sf).join(sure, "id", "left_anti").select("id")


@query("j08_moderation_queue", T.sql("SELECT l.doc_id, a.title, c.name AS category FROM labels l JOIN articles a ON a.id = l.doc_id JOIN categories c ON c.id = a.category_id WHERE l.toxic = 1", "articles", "categories"))
def j08(spark: SparkSession, sf: str) -> DataFrame:
    l = T.raw(spark, sf, "labels").filter("toxic = 1").withColumnRenamed("doc_id", "id")  # noqa: E741
    c = T.categories(spark).select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return l.join(T.articles(spark, sf), "id").join(c, "category_id").select(F.col("id").alias("doc_id"), "title", "category")


@query("j10_bookmarked_articles", T.sql("SELECT user_id, a.id, a.title FROM bookmarks b JOIN articles a ON a.id = b.article_id WHERE NOT is_duplicate ORDER BY b.created_at DESC, user_id, a.id LIMIT 20 OFFSET 20", "articles", "bookmarks"))
def j10(spark: SparkSession, sf: str) -> DataFrame:
    d = T.bookmarks(spark, sf).join(T.articles(spark, sf).filter("not is_duplicate").withColumnRenamed("id", "article_id"), "article_id")
    return R.page(d.orderBy(F.desc("created_at"), "user_id", "article_id"), 2, 20).select("user_id", F.col("article_id").alias("id"), "title")


@query("j11_training_pairs", T.sql("SELECT a.id, substr(content, 1, 500) AS text, c.name AS label FROM article_categories ac JOIN articles a ON a.id = ac.article_id JOIN categories c ON c.id = ac.category_id WHERE is_human_label", "articles", "categories", "article_categories"))
def j11(spark: SparkSession, sf: str) -> DataFrame:
    """Articles with their human labels; a training text is the article's beginning."""
    c = T.categories(spark).select(F.col("id").alias("category_id"), F.col("name").alias("label"))
    d = T.article_categories(spark, sf).filter("is_human_label").select(F.col("article_id").alias("id"), F.col("category_id").alias("cid"))
    d = d.join(T.articles(spark, sf), "id").join(c, F.col("cid") == c["category_id"])
    return d.select("id", F.substring("content", 1, 500).alias("text"), "label")


@query("j14_read_decoration", T.sql("SELECT a.id, coalesce(r.n, 0) AS reads, coalesce(b.n, 0) AS bookmarks FROM articles a LEFT JOIN (SELECT article_id, count(*) AS n FROM user_events WHERE event_type = 'READ' GROUP BY 1) r ON r.article_id = a.id LEFT JOIN (SELECT article_id, count(*) AS n FROM bookmarks GROUP BY 1) b ON b.article_id = a.id", "articles", "user_events", "bookmarks"))
def j14(spark: SparkSession, sf: str) -> DataFrame:
    r = T.user_events(spark, sf).filter("event_type = 'READ'").groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias("reads"))
    b = T.bookmarks(spark, sf).groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias("bookmarks"))
    return T.articles(spark, sf).select("id").join(r, "id", "left").join(b, "id", "left").fillna(0)


_READ_BY = "SELECT DISTINCT user_id, article_id FROM user_events WHERE event_type = 'READ'"


@query(
    "j15_exclude_read",
    T.sql(
        "SELECT u.user_id, c.id FROM (SELECT DISTINCT user_id FROM user_events) u, c WHERE (u.user_id, c.id) NOT IN (SELECT user_id, article_id FROM r) OR (SELECT count(*) FROM r JOIN c ON c.id = r.article_id WHERE r.user_id = u.user_id) = (SELECT count(*) FROM c)",
        "articles",
        "user_events",
        r=_READ_BY,
        c="SELECT id FROM articles WHERE id IN (SELECT article_id FROM user_events WHERE event_type = 'SHARED')",
    ),
)
def j15(spark: SparkSession, sf: str) -> DataFrame:
    """Of the articles that somebody shared, those a user hasn't read; all of them if nothing would be left."""
    e = T.user_events(spark, sf)
    read = e.filter("event_type = 'READ'").select("user_id", F.col("article_id").alias("id")).distinct()
    shared = e.filter("event_type = 'SHARED'").select(F.col("article_id").alias("id"))
    candidates = T.articles(spark, sf).join(shared, "id", "left_semi").select("id")
    return R.exclude_read(e.select("user_id").distinct(), candidates, read)


@query("j17_ordered_intersection", T.sql("SELECT id, row_number() OVER (ORDER BY view_count DESC, id) AS place FROM articles WHERE id IN (SELECT article_id FROM article_categories WHERE category_id = 2)", "articles", "article_categories"))
def j17(spark: SparkSession, sf: str) -> DataFrame:
    """The personal order among filtered articles."""
    ids = T.article_categories(spark, sf).filter("category_id = 2").select(F.col("article_id").alias("id"))
    d = T.articles(spark, sf).select("id", "view_count").join(ids, "id", "left_semi")
    return R.ranked(d, "view_count", "place").select("id", "place")


@query("j22_inverted_index", T.sql(f"SELECT token, count(DISTINCT id) AS articles FROM (SELECT id, unnest(list_distinct({Q.dedupe_tokens('title')})) AS token FROM articles) GROUP BY 1 HAVING count(DISTINCT id) >= 2", "articles"))
def j22(spark: SparkSession, sf: str) -> DataFrame:
    """Title tokens with the number of articles that have them."""
    d = T.articles(spark, sf).select("id", F.explode(F.array_distinct(X.dedupe_tokens(F.col("title")))).alias("token"))
    return d.groupBy("token").agg(F.count_distinct("id").alias("articles")).filter("articles >= 2")


@query("j24_reminder_targets", "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, c_custkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 2), customer WHERE c_custkey <= 50")
def j24(spark: SparkSession, sf: str) -> DataFrame:
    """Personal events go to their user, the two global ones to a fixed circle of users."""
    o, c = T.raw(spark, sf, "orders"), T.raw(spark, sf, "customer")
    own = o.filter("o_orderpriority = '1-URGENT'").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    top = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(2).select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(50).cast("long"))).alias("c_custkey"))
    return own.unionByName(top.join(c.select("c_custkey"), "c_custkey", "left_semi").select("o_orderkey", "c_custkey"))


# What each role may do; super_admin may do everything.
ROLES = {"reader": ["read"], "editor": ["read", "write", "reclassify"], "reviewer": ["read", "reclassify", "verify"], "super_admin": []}
PERMISSIONS = ["read", "write", "reclassify", "verify", "manage"]
_ROLE_ROWS = ", ".join(f"('{r}', '{p}')" for r, ps in ROLES.items() for p in ps)


#: Roles of customers by their market segment; the first one has several.
SEGMENT_ROLES = {"AUTOMOBILE": ["super_admin", *list(ROLES)[:1]], "BUILDING": list(ROLES)[:2], "FURNITURE": list(ROLES)[-1:], "MACHINERY": list(ROLES)[1:2]}
_SEGMENT_ROWS = ", ".join(f"('{s}', '{r}')" for s, rs in SEGMENT_ROLES.items() for r in rs)


@query(
    "j25_permissions",
    f"""WITH rp AS (SELECT role, permission FROM (VALUES {_ROLE_ROWS}) AS t(role, permission) UNION SELECT 'super_admin', unnest({PERMISSIONS})), ur AS (SELECT c_custkey AS user_id, role FROM customer JOIN (VALUES {_SEGMENT_ROWS}) AS s(segment, role) ON segment = c_mktsegment)
    SELECT user_id, permission, count(*) AS roles FROM ur JOIN rp USING (role) GROUP BY 1, 2""",
)
def j25(spark: SparkSession, sf: str) -> DataFrame:
    """What each customer may do through the roles held, and how many roles grant it; the highest role has all permissions.

    Users and permissions meet over two bridges, roles of users and permissions of roles, which are small tables of this module.
    """
    granted = spark.createDataFrame([(r, p) for r, ps in {**ROLES, "super_admin": PERMISSIONS}.items() for p in dict.fromkeys(ps)], "role string, permission string")
    held = spark.createDataFrame([(s, r) for s, rs in SEGMENT_ROLES.items() for r in rs], "c_mktsegment string, role string")
    users = T.raw(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment").join(F.broadcast(held), "c_mktsegment")
    return users.join(F.broadcast(granted), "role").groupBy("user_id", "permission").agg(F.count(F.lit(1)).alias("roles"))


@query(
    "j26_click_attribution",
    """SELECT c.event_id, max(v.ts) AS view_ts, arg_max(v.event_id, (v.ts, v.event_id)) AS view_id FROM events c JOIN events v ON v.user_id = c.user_id AND v.event_type = 'view' AND v.ts <= c.ts AND v.ts >= c.ts - INTERVAL 2 DAYS WHERE c.event_type = 'click' GROUP BY 1""",
)
def j26(spark: SparkSession, sf: str) -> DataFrame:
    """As-of join: each click with the same user's latest view of the two days before."""
    return R.last_before(T.raw(spark, sf, "events").filter("event_type = 'click'"), T.raw(spark, sf, "events").filter("event_type = 'view'"), "user_id", "ts", "event_id", hours=48)


# --- windows


@query("w03_normalised_by_max", T.sql("SELECT id, round(view_count * 100 / max(view_count) OVER (), 4) AS views, round(share_count * 100 / max(share_count) OVER (), 4) AS shares FROM articles", "articles"))
def w03(spark: SparkSession, sf: str) -> DataFrame:
    a = T.articles(spark, sf)
    top = lambda c: a.agg(F.max(c).alias("m")).scalar()  # noqa: E731  a scalar, so no row goes to a single task
    return a.select("id", *(F.round(F.col(f"{k[:-1]}_count") * 100 / top(f"{k[:-1]}_count"), 4).alias(k) for k in ("views", "shares")))


@query(
    "w05_running_distinct_sources",
    T.sql("SELECT category_id, day, sum(count(*)) OVER (PARTITION BY category_id ORDER BY day) AS sources_so_far FROM (SELECT category_id, source_name, min(cast(published_at AS date)) AS day FROM articles GROUP BY 1, 2) GROUP BY 1, 2", "articles"),
)
def w05(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct sources so far: each source counts from its first day."""
    first = T.articles(spark, sf).groupBy("category_id", "source_name").agg(F.min(F.to_date("published_at")).alias("day"))
    d = first.groupBy("category_id", "day").agg(F.count(F.lit(1)).alias("n"))
    return d.select("category_id", "day", F.sum("n").over(Window.partitionBy("category_id").orderBy("day")).alias("sources_so_far"))


@query(
    "w06_growth_state",
    T.sql(
        """SELECT category_id, last, previous, CASE WHEN last > previous THEN 'rising' WHEN last < previous THEN 'fading' ELSE 'stable' END AS state
        FROM (SELECT category_id, count(*) FILTER (cast(published_at AS date) >= DATE '2024-01-28') AS last, count(*) FILTER (cast(published_at AS date) >= DATE '2024-01-25' AND cast(published_at AS date) < DATE '2024-01-28') AS previous FROM articles GROUP BY 1)""",
        "articles",
    ),
)
def w06(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date("published_at")
    last, previous = day >= F.lit("2024-01-28").cast("date"), day.between(F.lit("2024-01-25").cast("date"), F.lit("2024-01-27").cast("date"))
    d = T.articles(spark, sf).groupBy("category_id").agg(A.count_if(last).alias("last"), A.count_if(previous).alias("previous"))
    return d.withColumn("state", F.when(F.col("last") > F.col("previous"), "rising").when(F.col("last") < F.col("previous"), "fading").otherwise("stable"))


@query("w07_first_seen", T.sql("SELECT category_id, language, min(published_at) AS first_seen, arg_min(id, (published_at, id)) AS first_id FROM articles GROUP BY 1, 2", "articles"))
def w07(spark: SparkSession, sf: str) -> DataFrame:
    """Where a topic appeared first: per topic and language the earliest article."""
    return T.articles(spark, sf).groupBy("category_id", "language").agg(F.min("published_at").alias("first_seen"), F.min(F.struct("published_at", "id"))["id"].alias("first_id"))


@query("w08_regional_cap", T.sql("SELECT id, language, n FROM (SELECT id, language, row_number() OVER (PARTITION BY language ORDER BY published_at DESC, id) AS n FROM articles) WHERE n <= 18", "articles"))
def w08(spark: SparkSession, sf: str) -> DataFrame:
    """The newest articles of each region, up to a cap of max(15, limit / 9 + 5) for a limit of 120."""
    cap = max(15, 120 // 9 + 5)
    return R.top_per_group(T.articles(spark, sf), ["language"], [F.desc("published_at"), F.col("id")], cap, "n").select("id", "language", "n")


@query("w09_latest_by_key", T.sql(f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY {Q.dedupe_normal('title')} ORDER BY published_at DESC, id) AS n FROM articles) WHERE n = 1", "articles"))
def w09(spark: SparkSession, sf: str) -> DataFrame:
    """One article per title, the newest."""
    d = T.articles(spark, sf).select("id", "published_at", X.dedupe_normal(F.col("title")).alias("key"))
    return d.groupBy("key").agg(F.max(F.struct("published_at", (-F.col("id")).alias("back")))["back"].alias("back")).select((-F.col("back")).alias("id"))


@query("w10_best_category", T.sql("SELECT article_id, arg_max(category_id, (confidence, -category_id)) AS category_id, max(confidence) AS confidence FROM article_categories GROUP BY 1", "article_categories"))
def w10(spark: SparkSession, sf: str) -> DataFrame:
    return T.article_categories(spark, sf).groupBy("article_id").agg(F.max_by("category_id", F.struct("confidence", -F.col("category_id"))).alias("category_id"), F.max("confidence").alias("confidence"))


@query("w11_share_of_total", T.sql("SELECT source_name, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 2) AS percent FROM articles GROUP BY 1", "articles"))
def w11(spark: SparkSession, sf: str) -> DataFrame:
    d = T.articles(spark, sf).groupBy("source_name").agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("percent", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 2))


@query("w12_canonical_article", T.sql("SELECT content_hash, id FROM (SELECT sha256(content) AS content_hash, a.id, row_number() OVER (PARTITION BY sha256(content) ORDER BY trust_score DESC, published_at, a.id) AS n FROM articles a JOIN sources s ON s.id = a.source_id) WHERE n = 1", "articles", "sources"))
def w12(spark: SparkSession, sf: str) -> DataFrame:
    """Of equal texts the article with most trust, then the earliest, then the least id."""
    s = T.sources(spark, sf).select(F.col("id").alias("source_id"), "trust_score")
    d = T.articles(spark, sf).join(s, "source_id").withColumn("content_hash", F.sha2("content", 256))
    return d.groupBy("content_hash").agg(F.min(F.struct((-F.col("trust_score")).alias("t"), "published_at", "id"))["id"].alias("id"))


@query("w13_extremes", T.sql("SELECT category_id, arg_max(id, (length(content), -id)) AS most_detailed, arg_min(id, (published_at, id)) AS earliest FROM articles GROUP BY 1", "articles"))
def w13(spark: SparkSession, sf: str) -> DataFrame:
    return T.articles(spark, sf).groupBy("category_id").agg(F.max_by("id", F.struct(F.length("content"), -F.col("id"))).alias("most_detailed"), F.min_by("id", F.struct("published_at", "id")).alias("earliest"))


@query("w14_trend_line", T.sql("SELECT category_id, bucket, sum(count(*)) OVER (PARTITION BY category_id ORDER BY bucket) AS running FROM (SELECT category_id, cast(floor((epoch(published_at) - epoch(TIMESTAMP '2024-01-01 00:00:00')) / 324000) AS bigint) AS bucket FROM articles) GROUP BY 1, 2", "articles"))
def w14(spark: SparkSession, sf: str) -> DataFrame:
    """Articles so far in eight buckets of time."""
    bucket = F.floor((F.unix_timestamp("published_at") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 324000)
    d = T.articles(spark, sf).groupBy("category_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return d.select("category_id", "bucket", F.sum("n").over(Window.partitionBy("category_id").orderBy("bucket")).alias("running"))


@query("w15_every_third", T.sql("SELECT user_id, count(*) AS bonuses FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id, article_id % 9 ORDER BY created_at, event_id) AS n FROM user_events) WHERE n % 3 = 0 GROUP BY 1", "user_events"))
def w15(spark: SparkSession, sf: str) -> DataFrame:
    """A bonus for every third event in the same subject: a third of each count, rounded down."""
    d = T.user_events(spark, sf).groupBy("user_id", (F.col("article_id") % 9).alias("subject")).agg(F.floor(F.count(F.lit(1)) / 3).alias("n"))
    return d.groupBy("user_id").agg(F.sum("n").alias("bonuses")).filter("bonuses > 0")


# --- sorts and pages


@query("o01_search_sorts", T.sql("SELECT * FROM (SELECT 'most_read' AS mode, id, row_number() OVER (ORDER BY view_count DESC, published_at DESC, id) AS place FROM articles UNION ALL SELECT 'most_shared', id, row_number() OVER (ORDER BY share_count DESC, published_at DESC, id) FROM articles UNION ALL SELECT 'newest', id, row_number() OVER (ORDER BY published_at DESC, id) FROM articles) WHERE place <= 20", "articles"))
def o01(spark: SparkSession, sf: str) -> DataFrame:
    """The first page of each sort mode."""
    a = T.articles(spark, sf).select("id", "view_count", "share_count", "published_at")
    out = None
    for mode, keys in {"most_read": ["view_count", "published_at"], "most_shared": ["share_count", "published_at"], "newest": ["published_at"]}.items():
        top = a.orderBy(*(F.desc(k) for k in keys), "id").limit(20)
        d = top.select(F.lit(mode).alias("mode"), "id", F.row_number().over(Window.orderBy(*(F.desc(k) for k in keys), "id")).alias("place"))
        out = d if out is None else out.unionByName(d)
    return out


@query("o04_page_with_total", T.sql("SELECT id, view_count, (SELECT count(*) FROM articles WHERE NOT is_duplicate) AS total FROM articles WHERE NOT is_duplicate ORDER BY view_count DESC, published_at DESC, id LIMIT 20 OFFSET 20", "articles"))
def o04(spark: SparkSession, sf: str) -> DataFrame:
    a = T.articles(spark, sf).filter("not is_duplicate")
    total = a.agg(F.count(F.lit(1)).alias("n")).scalar()
    return R.page(a.orderBy(F.desc("view_count"), F.desc("published_at"), "id"), 2, 20).select("id", "view_count", total.alias("total"))


@query("o06_personal_sort", T.sql("SELECT id FROM articles a ORDER BY (category_id IN (2, 4)) DESC, category_id, round(view_count / 997, 2) DESC, published_at DESC, id LIMIT 100", "articles"))
def o06(spark: SparkSession, sf: str) -> DataFrame:
    """Preferred sections first, then section order, confidence to two places, date."""
    d = T.articles(spark, sf)
    return d.orderBy(F.desc(F.col("category_id").isin(2, 4)), "category_id", F.desc(F.round(F.col("view_count") / 997, 2)), F.desc("published_at"), "id").limit(100).select("id")


@query("o10_top_trends", T.sql("SELECT category_id, 30 * count(DISTINCT source_name) + 10 * count(*) + sum(view_count) AS score FROM articles GROUP BY 1 ORDER BY score DESC, category_id LIMIT 8", "articles"))
def o10(spark: SparkSession, sf: str) -> DataFrame:
    d = T.articles(spark, sf).groupBy("category_id").agg((30 * F.count_distinct("source_name") + 10 * F.count(F.lit(1)) + F.sum("view_count")).alias("score"))
    return d.orderBy(F.desc("score"), "category_id").limit(8)


@query("o12_hero_slots", T.sql("SELECT id, view_count FROM (SELECT id, view_count, row_number() OVER (PARTITION BY substr(lower(title), 1, 48) ORDER BY view_count DESC, id) AS n FROM articles) WHERE n = 1 ORDER BY view_count DESC, id LIMIT 12", "articles"))
def o12(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve lead stories with different title beginnings."""
    d = T.articles(spark, sf).groupBy(F.substring(F.lower("title"), 1, 48).alias("start")).agg(F.max(F.struct("view_count", (-F.col("id")).alias("back"))).alias("m"))
    return d.select((-F.col("m.back")).alias("id"), F.col("m.view_count").alias("view_count")).orderBy(F.desc("view_count"), "id").limit(12)


@query("o14_suggestions", T.sql(f"SELECT value, sum(weight) AS weight FROM (SELECT unnest({Q.search_tokens('title')}) AS value, 2.0::double AS weight FROM articles UNION ALL SELECT source_name, 1.5 FROM articles) WHERE contains(value, 'th') AND length(value) <= 80 GROUP BY 1 ORDER BY weight DESC, value LIMIT 8", "articles"))
def o14(spark: SparkSession, sf: str) -> DataFrame:
    a = T.articles(spark, sf)
    d = a.select(F.explode(X.search_tokens(F.col("title"))).alias("value"), F.lit(2.0).alias("weight")).unionByName(a.select(F.col("source_name").alias("value"), F.lit(1.5).alias("weight")))
    d = d.filter(F.col("value").contains("th") & (F.length("value") <= 80)).groupBy("value").agg(F.sum("weight").alias("weight"))
    return d.orderBy(F.desc("weight"), "value").limit(8)


# --- set operations


@query("u01_pool_union", T.sql("SELECT id, pool FROM (SELECT id, pool, row_number() OVER (PARTITION BY id ORDER BY pool DESC) AS n FROM (SELECT id, 1 AS pool FROM articles UNION ALL SELECT id, 2 FROM articles WHERE id % 3 = 0 UNION ALL SELECT id, 3 FROM articles WHERE id % 5 = 0)) WHERE n = 1", "articles"))
def u01(spark: SparkSession, sf: str) -> DataFrame:
    """Pools united by id; the later pool wins."""
    a = T.articles(spark, sf).select("id")
    pools = [a, a.filter("id % 3 = 0"), a.filter("id % 5 = 0")]
    d = pools[0].withColumn("pool", F.lit(1))
    for k, p in enumerate(pools[1:], 2):
        d = d.unionByName(p.withColumn("pool", F.lit(k)))
    return d.groupBy("id").agg(F.max("pool").alias("pool"))


@query("u02_union_with_precedence", T.sql("SELECT id, 'api' AS origin FROM articles WHERE id % 2 = 0 UNION ALL SELECT id, 'rss' FROM articles WHERE id % 3 = 0 AND id % 2 <> 0 UNION ALL SELECT id, 'db' FROM articles WHERE id % 2 <> 0 AND id % 3 <> 0", "articles"))
def u02(spark: SparkSession, sf: str) -> DataFrame:
    a = T.articles(spark, sf).select("id")
    return R.first_wins([("api", a.filter("id % 2 = 0")), ("rss", a.filter("id % 3 = 0")), ("db", a)], "id")


@query("u03_interaction_union", T.sql("SELECT news_id, user_id, interaction_type FROM interactions UNION ALL SELECT article_id, user_id, lower(event_type) FROM user_events", "interactions", "user_events"))
def u03(spark: SparkSession, sf: str) -> DataFrame:
    e = T.user_events(spark, sf).select(F.col("article_id").alias("news_id"), "user_id", F.lower("event_type").alias("interaction_type"))
    return T.interactions(spark, sf).select("news_id", "user_id", "interaction_type").unionByName(e)


@query("u04_distinct_sources", "SELECT DISTINCT source FROM documents")
def u04(spark: SparkSession, sf: str) -> DataFrame:
    return T.raw(spark, sf, "documents").select("source").distinct()


@query("u06_common_tokens", T.sql(f"SELECT category_id, token FROM (SELECT category_id, source_name, unnest(list_distinct({Q.dedupe_tokens('title')})) AS token FROM articles) GROUP BY 1, 2 HAVING count(DISTINCT source_name) >= 5", "articles"))
def u06(spark: SparkSession, sf: str) -> DataFrame:
    """Title tokens that at least five sources of a category share."""
    d = T.articles(spark, sf).select("category_id", "source_name", F.explode(F.array_distinct(X.dedupe_tokens(F.col("title")))).alias("token"))
    return d.groupBy("category_id", "token").agg(F.count_distinct("source_name").alias("n")).filter("n >= 5").select("category_id", "token")


@query("u09_recent_categories", T.sql("SELECT DISTINCT category_id FROM (SELECT category_id FROM articles ORDER BY published_at DESC, id LIMIT 50)", "articles"))
def u09(spark: SparkSession, sf: str) -> DataFrame:
    return T.articles(spark, sf).orderBy(F.desc("published_at"), "id").limit(50).select("category_id").distinct()


# --- scalar functions


def _texts(spark: SparkSession, sf: str, **columns: Column) -> DataFrame:
    return T.articles(spark, sf).select("id", *(c.alias(k) for k, c in columns.items()))


@query("t01_search_normal", T.sql(f"SELECT id, {Q.search_normal('content')} AS normal FROM articles", "articles"))
def t01(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf, normal=X.search_normal(F.col("content")))


@query("t02_vector_normal", T.sql(f"SELECT id, {Q.vector_normal('content')} AS normal FROM articles", "articles"))
def t02(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf, normal=X.vector_normal(F.col("content")))


@query("t03_dedupe_normal", T.sql(f"SELECT id, {Q.dedupe_normal('content')} AS normal, {Q.title_normal('title')} AS title FROM articles", "articles"))
def t03(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf, normal=X.dedupe_normal(F.col("content")), title=X.title_normal(F.col("title")))


@query("t07_event_normal", T.sql(f"SELECT id, {Q.event_normal('title')} AS normal FROM articles", "articles"))
def t07(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf, normal=X.event_normal(F.col("title")))


@query("t08_canonical_url", f"SELECT page_id, {Q.canonical_url('url')} AS url, {Q.simple_url('url')} AS simple FROM pages")
def t08(spark: SparkSession, sf: str) -> DataFrame:
    return T.raw(spark, sf, "pages").select("page_id", X.canonical_url(F.col("url")).alias("url"), X.simple_url(F.col("url")).alias("simple"))


@query("t12_dedupe_keys", T.sql(f"SELECT id, substr(sha1({Q.title_normal('title')} || '|' || language || '|' || strftime(published_at, '%Y-%m-%d')), 1, 24) AS day_key, sha256({Q.dedupe_normal('content')}) AS content_hash FROM articles", "articles"))
def t12(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat_ws("|", X.title_normal(F.col("title")), "language", F.date_format("published_at", "yyyy-MM-dd"))
    return _texts(spark, sf, day_key=F.substring(F.sha1(key), 1, 24), content_hash=F.sha2(X.dedupe_normal(F.col("content")), 256))


@query("t14_strip_html", f"SELECT page_id, {Q.decode_entities(Q.strip_html('html'))} AS text FROM pages")
def t14(spark: SparkSession, sf: str) -> DataFrame:
    return T.raw(spark, sf, "pages").select("page_id", X.decode_entities(X.strip_html(F.col("html"))).alias("text"))


@query("t17_search_tokens", T.sql(f"SELECT id, {Q.search_tokens('title')} AS tokens FROM articles", "articles"))
def t17(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf, tokens=X.search_tokens(F.col("title")))


@query("t21_token_counts", T.sql(f"SELECT id, len({Q.dedupe_tokens('content')}) AS dedupe_tokens, len({Q.bm25_tokens('content')}) AS bm25_tokens FROM articles", "articles"))
def t21(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf, dedupe_tokens=F.size(X.dedupe_tokens(F.col("content"))), bm25_tokens=F.size(X.bm25_tokens(F.col("content"))))


@query("t22_shingle_counts", T.sql(f"SELECT id, len({Q.word_shingles('t')}) AS shingles FROM (SELECT id, {Q.dedupe_tokens('content')} AS t FROM articles)", "articles"))
def t22(spark: SparkSession, sf: str) -> DataFrame:
    d = _texts(spark, sf, t=X.dedupe_tokens(F.col("content")))
    return d.select("id", F.size(X.word_shingles(F.col("t"))).alias("shingles"))


@query("t24_sentences", T.sql("SELECT id, len(list_filter(string_split_regex(regexp_replace(content, '\\s+', ' ', 'g'), '[.!?] '), lambda s: trim(s) <> '')) AS sentences FROM articles", "articles"))
def t24(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf, sentences=F.size(X.sentences(F.col("content"))))


@query("t26_slug", T.sql(f"SELECT id, {Q.slug('title')} AS slug, CASE WHEN length(title) <= 40 THEN title ELSE rtrim(substr(title, 1, 39)) || '…' END AS short FROM articles", "articles"))
def t26(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf, slug=X.slug(F.col("title")), short=X.shorten(F.col("title"), 40))


@query("t33_citation", T.sql("SELECT a.id, s.name || '. ' || title || '. ' || strftime(published_at, '%Y-%m-%d') || ' [' || CASE WHEN trust_score >= 0.8 THEN 'high' WHEN trust_score >= 0.5 THEN 'medium' ELSE 'low' END || ']' AS citation FROM articles a JOIN sources s ON s.id = a.source_id", "articles", "sources"))
def t33(spark: SparkSession, sf: str) -> DataFrame:
    s = T.sources(spark, sf).select(F.col("id").alias("source_id"), "name", "trust_score")
    d = T.articles(spark, sf).join(s, "source_id")
    text = F.concat("name", F.lit(". "), "title", F.lit(". "), F.date_format("published_at", "yyyy-MM-dd"), F.lit(" ["), X.trust_badge(F.col("trust_score")), F.lit("]"))
    return d.select("id", text.alias("citation"))


@query("t34_relative_time", T.sql(f"SELECT id, CASE WHEN {_HOURS} < 1 THEN 'now' WHEN {_HOURS} < 24 THEN cast(floor({_HOURS}) AS bigint) || ' h' ELSE cast(floor({_HOURS} / 24) AS bigint) || ' d' END AS age FROM articles", "articles"))
def t34(spark: SparkSession, sf: str) -> DataFrame:
    h = S.hours_old(F.col("published_at"), T.as_of())
    return _texts(spark, sf, age=F.when(h < 1, "now").when(h < 24, F.concat(F.floor(h).cast("string"), F.lit(" h"))).otherwise(F.concat(F.floor(h / 24).cast("string"), F.lit(" d"))))


@query("m01_freshness_ladders", T.sql(f"SELECT id, {ladder_sql('search')} AS search, {ladder_sql('recommendation')} AS recommendation, {ladder_sql('feed')} AS feed FROM articles", "articles"))
def m01(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf, **{k: S.freshness(F.col("published_at"), T.as_of(), k) for k in S.LADDERS})


@query("m04_decays", T.sql(f"SELECT id, round(view_count * exp(-0.05 * {_HOURS}), 6) AS trend, round(exp(-0.05 * {_HOURS}), 6) AS recency, round(1 / (1 + 0.05 * {_HOURS} / 24), 6) AS hyperbolic, round(log10(1 + view_count), 6) AS popularity FROM articles", "articles"))
def m04(spark: SparkSession, sf: str) -> DataFrame:
    p, now = F.col("published_at"), T.as_of()
    return _texts(spark, sf, trend=F.round(S.decayed_views(F.col("view_count"), p, now), 6), recency=F.round(S.recency(p, now), 6), hyperbolic=F.round(1 / (1 + 0.05 * S.hours_old(p, now) / 24), 6), popularity=F.round(S.popularity_log(F.col("view_count")), 6))


_M08 = """CASE WHEN interaction_type = 'read' THEN (CASE WHEN duration_seconds < 5 THEN 1.0 ELSE 3.0 END) + (CASE WHEN duration_seconds >= 30 THEN 2 ELSE 0 END) + (CASE WHEN duration_seconds >= 60 THEN 3 ELSE 0 END) + (CASE WHEN duration_seconds >= 180 THEN 4 ELSE 0 END)
  WHEN interaction_type = 'save' THEN 6 WHEN interaction_type = 'share' THEN 5 WHEN interaction_type = 'search_click' THEN 3 ELSE 1 END"""


@query("m08_interaction_weights", T.sql(f"SELECT event_id, cast({_M08} AS double) AS weight FROM interactions", "interactions"))
def m08(spark: SparkSession, sf: str) -> DataFrame:
    return T.interactions(spark, sf).select("event_id", A.interaction_weight().alias("weight"))


@query("m14_quality_scores", T.sql("SELECT a.id, round(30 + trust_score * 100 / 2 + least(25, length(summary) / 12) + least(15, length(title) / 6) + least(12, share_count / 10), 6) AS quality, round(least(0.99, 0.35 + least(0.25, 3 * 0.03) + least(0.2, (view_count % 20) * 0.02) + 0.12), 6) AS importance FROM articles a JOIN sources s ON s.id = a.source_id", "articles", "sources"))
def m14(spark: SparkSession, sf: str) -> DataFrame:
    s = T.sources(spark, sf).select(F.col("id").alias("source_id"), "trust_score")
    d = T.articles(spark, sf).join(s, "source_id")
    quality = S.article_quality(F.lit(True), F.col("trust_score") * 100, F.col("summary"), F.col("title"), F.col("share_count") / 10)
    return d.select("id", F.round(quality, 6).alias("quality"), F.round(S.importance(F.lit(3), F.col("view_count") % 20, F.lit(True)), 6).alias("importance"))


@query("m20_notification_times", "SELECT o_orderkey, o_orderdate - INTERVAL 24 HOURS AS day_before, o_orderdate - INTERVAL 1 HOUR AS hour_before, greatest(o_orderdate - INTERVAL 24 HOURS, TIMESTAMP '1995-01-01 00:00:00') AS remind_at FROM orders")
def m20(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("o_orderdate")
    day = at - F.expr("INTERVAL 24 HOURS")
    return T.raw(spark, sf, "orders").select("o_orderkey", day.alias("day_before"), (at - F.expr("INTERVAL 1 HOUR")).alias("hour_before"), F.greatest(day, F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")).alias("remind_at"))


@query("m21_next_runs", "SELECT o_orderkey, cast(o_orderdate AS date) + 1 AS daily, cast(o_orderdate AS date) + cast((7 - isodow(o_orderdate) + 1) AS int) AS weekly, cast(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS date) AS monthly FROM orders")
def m21(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return T.raw(spark, sf, "orders").select("o_orderkey", F.date_add(day, 1).alias("daily"), F.next_day(day, "Mon").alias("weekly"), F.add_months(F.trunc(day, "month"), 1).alias("monthly"))


@query("m24_price_parse", "SELECT o_orderkey, try_cast(replace(regexp_replace(replace(cast(cast(o_totalprice AS decimal(18, 2)) AS varchar), '.', ',') || ' TL', '[^0-9,]', '', 'g'), ',', '.') AS double) AS price FROM orders")
def m24(spark: SparkSession, sf: str) -> DataFrame:
    """A price back from its text with a decimal comma and a currency."""
    text = F.concat(F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")), F.lit(" TL"))
    return T.raw(spark, sf, "orders").select("o_orderkey", F.replace(F.regexp_replace(text, "[^0-9,]", ""), F.lit(","), F.lit(".")).try_cast("double").alias("price"))


@query("m27_json_fields", "SELECT event_id, cast(props->>'$.k' AS bigint) AS k, round(1 / (1 + exp(-least(greatest(value / 10, -40), 40))), 9) AS sigmoid FROM events")
def m27(spark: SparkSession, sf: str) -> DataFrame:
    d = T.raw(spark, sf, "events").withColumn("p", F.from_json("props", "k bigint"))
    return d.select("event_id", F.col("p.k").alias("k"), F.round(S.sigmoid(F.col("value") / 10), 9).alias("sigmoid"))


@query("m30_hash_distance", T.sql("SELECT id, bit_count(xor(cast('0x' || substr(sha1(title), 1, 15) AS bigint), cast('0x' || substr(sha1(source_name), 1, 15) AS bigint))) AS distance FROM articles", "articles"))
def m30(spark: SparkSession, sf: str) -> DataFrame:
    number = lambda c: F.conv(F.substring(F.sha1(c), 1, 15), 16, 10).cast("bigint")
    return _texts(spark, sf, distance=S.hamming(number(F.col("title")), number(F.col("source_name"))))


@query("m31_token_cost", T.sql("SELECT id, cast(ceil(length(content) / 4) AS bigint) AS tokens, round(ceil(length(content) / 4) * 0.15 / 1000000, 6) AS cost FROM articles", "articles"))
def m31(spark: SparkSession, sf: str) -> DataFrame:
    n, cost = S.tokens_and_cost(F.col("content"), 0.15)
    return _texts(spark, sf, tokens=n, cost=cost)


@query("m33_hashed_users", "SELECT DISTINCT user_id, sha256(cast(user_id AS varchar)) AS hashed FROM events")
def m33(spark: SparkSession, sf: str) -> DataFrame:
    return T.raw(spark, sf, "events").select("user_id").distinct().withColumn("hashed", F.sha2(F.col("user_id").cast("string"), 256))
