"""Engagement analytics: aggregates over reader events, articles, categories and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import tenths


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def since(df: DataFrame, as_of: Column, days: int, column: str = "created_at") -> DataFrame:
    """Rows of the last days before as_of."""
    return df.filter(F.col(column) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def engagement() -> Column:
    """Weighted engagement of events."""
    return (F.sum(tenths()) / 10).cast("double")


def daily_active_users(events: DataFrame) -> DataFrame:
    """Distinct users per day; days without events have no row."""
    return events.groupBy(F.to_date("created_at").alias("day")).agg(F.count_distinct("user_id").alias("active_users"))


def daily_active_users_filled(events: DataFrame) -> DataFrame:
    """Distinct users for every day between the first and the last event, zeros included."""
    span = events.agg(F.min(F.to_date("created_at")).alias("lo"), F.max(F.to_date("created_at")).alias("hi"))
    days = span.filter("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.join(daily_active_users(events), "day", "left").fillna(0, ["active_users"])


def article_engagement(events: DataFrame) -> DataFrame:
    kinds = {"read_count": "READ", "bookmark_count": "BOOKMARKED", "share_count": "SHARED", "view_events": "VIEWED"}
    return events.groupBy("article_id").agg(*(count_if(F.col("event_type") == v).alias(k) for k, v in kinds.items()), engagement().alias("engagement_score"))


def top_articles(articles: DataFrame, events: DataFrame, sources: DataFrame, limit: int = 20) -> DataFrame:
    """Articles that aren't duplicates by weighted engagement, then views, then time, then id."""
    a = articles.filter(~F.col("is_duplicate")).select("id", "title", "view_count", "published_at", "source_id")
    d = a.join(article_engagement(events), F.col("id") == F.col("article_id"))
    d = d.join(sources.select(F.col("id").alias("sid"), F.col("name").alias("source")), F.col("source_id") == F.col("sid"), "left")
    d = d.orderBy(F.desc("engagement_score"), F.desc("view_count"), F.desc("published_at"), "id").limit(limit)
    return d.select("article_id", "title", "source", "view_count", "read_count", "bookmark_count", "share_count", "view_events", "engagement_score")


def category_reads(article_categories: DataFrame, categories: DataFrame, articles: DataFrame, events: DataFrame) -> DataFrame:
    """Per category: reads, readers, mean duration and scroll, engagement; of positive events on articles that aren't duplicates."""
    e = events.filter(F.col("event_type").isin("READ", "BOOKMARKED", "SHARED"))
    ok = articles.filter(~F.col("is_duplicate")).select(F.col("id").alias("aid"))
    d = e.join(ok, F.col("article_id") == F.col("aid"), "left_semi").join(article_categories.select("article_id", "category_id"), "article_id")
    d = d.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name")), "category_id")
    return d.groupBy("category_id", "category_name").agg(
        count_if(F.col("event_type") == "READ").alias("read_count"),
        F.count_distinct("user_id").alias("unique_users"),
        mean(F.col("duration_seconds")).alias("avg_duration_seconds"),
        mean(F.col("scroll_percent")).alias("avg_scroll_percent"),
        engagement().alias("engagement_score"),
    )


def mean(x: Column, places: int = 2) -> Column:
    """Mean of values taken to four places, so that it doesn't depend on the order of rows."""
    return F.round(F.sum(F.round(x * 10000).cast("long")) / F.count(x) / 10000, places)


def user_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        count_if(F.col("event_type") == "READ").alias("read_count"),
        count_if(F.col("event_type") == "BOOKMARKED").alias("bookmark_count"),
        count_if(F.col("event_type") == "SHARED").alias("share_count"),
        mean(F.col("duration_seconds")).alias("avg_duration_seconds"),
        F.max("created_at").alias("last_active_at"),
    )


def favourite_categories(events: DataFrame, article_categories: DataFrame, top: int = 10) -> DataFrame:
    """The top categories of every user by weighted engagement."""
    d = events.join(article_categories.select("article_id", "category_id"), "article_id")
    d = d.groupBy("user_id", "category_id").agg(engagement().alias("engagement_score"), F.count(F.lit(1)).alias("event_count"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("engagement_score"), "category_id"))
    return d.withColumn("rank", rank).filter(F.col("rank") <= top)


def source_performance(sources: DataFrame, articles: DataFrame, events: DataFrame, events_since: DataFrame) -> DataFrame:
    """Sources with article counts, views and engagement; both aggregated before the join."""
    a = articles.filter(~F.col("is_duplicate"))
    counts = a.groupBy("source_id").agg(F.count_distinct("id").alias("article_count"), F.sum("view_count").alias("total_views"))
    weight = events_since.join(a.select(F.col("id").alias("article_id"), "source_id"), "article_id").groupBy("source_id").agg(engagement().alias("engagement_score"))
    d = sources.join(counts.withColumnRenamed("source_id", "id"), "id", "left").join(weight.withColumnRenamed("source_id", "id"), "id", "left")
    return d.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.coalesce("article_count", F.lit(0)).alias("article_count"), F.coalesce("total_views", F.lit(0)).alias("total_views"), F.coalesce("engagement_score", F.lit(0.0)).alias("engagement_score"))


def implicit_rating() -> Column:
    """Event weight times scroll factor, to six places; columns event_type and scroll_percent."""
    fallback = F.when(F.col("event_type") == "VIEWED", 0.1).when(F.col("event_type") == "READ", 0.8).when(F.col("event_type").isin("BOOKMARKED", "SHARED"), 1.0).otherwise(0.0)
    scroll = F.coalesce(F.least(F.greatest(F.col("scroll_percent"), F.lit(0.0)) / 100, F.lit(1.0)), fallback)
    return F.round(tenths() / 10 * scroll, 6)


def ratings(events: DataFrame) -> DataFrame:
    """Each user's strongest rating of each article, with the event that gave it."""
    e = events.withColumn("rating", implicit_rating())
    return e.groupBy("user_id", "article_id").agg(F.max("rating").alias("rating"), F.count(F.lit(1)).alias("events"), F.max("created_at").alias("last_event"), F.max_by("event_type", F.struct("rating", -F.col("event_id"))).alias("strongest"))


def interaction_weight() -> Column:
    """Base weight by kind; reads earn or lose by duration, and the bonuses add up."""
    # Weights by kind.
    base = {"view": 1.0, "click": 2.0, "read": 3.0, "save": 6.0, "unsave": -3.0, "share": 5.0, "category_click": 1.5, "source_click": 1.5, "search_click": 3.0, "recommendation_impression": 0.25, "recommendation_click": 5.0}
    w = F.lit(1.0)
    for k, v in base.items():
        w = F.when(F.col("interaction_type") == k, v).otherwise(w)
    d = F.coalesce(F.col("duration_seconds"), F.lit(0.0))
    read = F.when(d < 5, F.greatest(F.lit(0.5), w - 2)).otherwise(w) + F.when(d >= 30, 2).otherwise(0) + F.when(d >= 60, 3).otherwise(0) + F.when(d >= 180, 4).otherwise(0)
    return F.when(F.col("interaction_type") == "read", read).otherwise(w)


def decay(as_of: Column, column: str = "created_at") -> Column:
    """1 / (1 + 0.05 days)."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(F.col(column).cast("timestamp"))) / 86400e6)
    return 1 / (1 + days * 0.05)
