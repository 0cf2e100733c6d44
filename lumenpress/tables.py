"""The content tables that operators work on, made from the given parquet tables; as DataFrames and as SQL.

Every time-dependent operator takes ``AS_OF`` explicitly, so results don't depend on the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"

# Display names of the nine content categories, in id order.
CATEGORIES = ["Gündem", "Siyaset", "Ekonomi", "Spor", "Teknoloji", "Sağlık", "Bilim", "Dünya", "Yaşam"]
# Weights of reader events, in tenths.
EVENT_TENTHS = {"VIEWED": 3, "READ": 10, "BOOKMARKED": 15, "SHARED": 20, "SKIPPED": 0, "UNBOOKMARKED": 0}


def raw(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def articles(spark: SparkSession, sf: str) -> DataFrame:
    d = raw(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.trim(F.substring(F.substring_index("text", "\n", 1), 1, 80)).alias("title"),
        F.substring("text", 1, 180).alias("summary"),
        F.col("text").alias("content"),
        F.col("lang").alias("language"),
        F.col("source").alias("source_name"),
        F.substring("source", 4, 9).cast("int").alias("source_id"),
        F.timestamp_seconds(F.unix_timestamp(as_of()) - (F.col("doc_id") * 37 % 720) * 3600).alias("published_at"),
        (F.col("n_chars") % 997).alias("view_count"),
        (F.col("n_chars") % 89).alias("share_count"),
        (F.col("doc_id") % 11 == 10).alias("is_duplicate"),
        (F.col("doc_id") % 9).cast("int").alias("category_id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/a/"), F.col("doc_id").cast("string")).alias("url"),
    )


def sources(spark: SparkSession, sf: str) -> DataFrame:
    d = raw(spark, sf, "documents").select("source").distinct()
    number = F.substring("source", 4, 9).cast("int")
    return d.select(number.alias("id"), F.col("source").alias("name"), F.concat(F.lit("https://"), "source", F.lit(".example.org")).alias("base_url"), ((number % 10) / 10).alias("trust_score"))


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CATEGORIES)), "id int, name string")


def article_categories(spark: SparkSession, sf: str) -> DataFrame:
    d = raw(spark, sf, "documents").select("doc_id")
    two = F.array_distinct(F.array((F.col("doc_id") % 9).cast("int"), (F.col("doc_id") * 7 % 9).cast("int")))
    return d.select(F.col("doc_id").alias("article_id"), F.explode(two).alias("category_id"), (F.lit(0.5) + (F.col("doc_id") % 50) / 100).alias("confidence"), (F.col("doc_id") % 4 == 0).alias("is_human_label"))


def normalized_event(kind, duration, scroll):
    """Views and reads that ended at once are skips; long views are reads."""
    quick = kind.isin("VIEWED", "READ") & (duration < 5) & (scroll < 10)
    return F.when(quick, "SKIPPED").when((kind == "VIEWED") & (duration >= 30), "READ").otherwise(kind)


def user_events(spark: SparkSession, sf: str) -> DataFrame:
    d = raw(spark, sf, "events")
    kind = F.when(F.col("event_type") == "view", "VIEWED").when(F.col("event_type") == "click", "READ").when(F.col("event_type") == "signup", "BOOKMARKED").when(F.col("event_type") == "purchase", "SHARED").otherwise("SKIPPED")
    duration = F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(600.0))
    d = d.select("event_id", F.col("user_id"), F.get_json_object("props", "$.k").cast("bigint").alias("article_id"), kind.alias("kind"), duration.alias("duration_seconds"), (F.col("value") % 101).alias("scroll_percent"), F.col("ts").alias("created_at"))
    return d.withColumn("event_type", normalized_event(F.col("kind"), F.col("duration_seconds"), F.col("scroll_percent"))).drop("kind")


def interactions(spark: SparkSession, sf: str) -> DataFrame:
    """Reader interactions of the wider vocabulary (view, click, read, share, save)."""
    d = raw(spark, sf, "events")
    kind = F.when(F.col("event_type") == "view", "view").when(F.col("event_type") == "click", "read").when(F.col("event_type") == "signup", "save").when(F.col("event_type") == "purchase", "share").otherwise("search_click")
    return d.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("news_id"), kind.alias("interaction_type"), F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(600.0)).alias("duration_seconds"), F.col("ts").alias("created_at"))


def bookmarks(spark: SparkSession, sf: str) -> DataFrame:
    return user_events(spark, sf).filter("event_type = 'BOOKMARKED'").groupBy("user_id", "article_id").agg(F.min("created_at").alias("created_at"))


def tenths():
    """The weight of an event in tenths; whole numbers keep sums exact."""
    w = F.lit(0)
    for k, v in EVENT_TENTHS.items():
        w = F.when(F.col("event_type") == k, v).otherwise(w)
    return w.cast("long")


_NAMES = ", ".join(f"({k}, '{v}')" for k, v in enumerate(CATEGORIES))
#: The same tables as common table expressions.
SQL = {
    "articles": f"""SELECT doc_id AS id, trim(substr(split_part(text, chr(10), 1), 1, 80)) AS title, substr(text, 1, 180) AS summary, text AS content,
      lang AS language, source AS source_name, cast(substr(source, 4) AS int) AS source_id,
      TIMESTAMP '{AS_OF}' - to_hours(cast(doc_id * 37 % 720 AS int)) AS published_at, n_chars % 997 AS view_count, n_chars % 89 AS share_count,
      doc_id % 11 = 10 AS is_duplicate, cast(doc_id % 9 AS int) AS category_id, 'https://' || source || '.example.org/a/' || doc_id AS url FROM documents""",
    "sources": "SELECT DISTINCT cast(substr(source, 4) AS int) AS id, source AS name, 'https://' || source || '.example.org' AS base_url, (cast(substr(source, 4) AS int) % 10) / 10 AS trust_score FROM documents",
    "categories": f"SELECT * FROM (VALUES {_NAMES}) AS t(id, name)",
    "article_categories": "SELECT doc_id AS article_id, cast(c AS int) AS category_id, 0.5::double + (doc_id % 50) / 100 AS confidence, doc_id % 4 = 0 AS is_human_label FROM (SELECT doc_id, unnest(list_distinct([doc_id % 9, doc_id * 7 % 9])) AS c FROM documents)",
    "mapped": """SELECT event_id, user_id, cast(props->>'$.k' AS bigint) AS article_id,
      CASE event_type WHEN 'view' THEN 'VIEWED' WHEN 'click' THEN 'READ' WHEN 'signup' THEN 'BOOKMARKED' WHEN 'purchase' THEN 'SHARED' ELSE 'SKIPPED' END AS kind,
      least(greatest(value, 0), 600) AS duration_seconds, value % 101 AS scroll_percent, ts AS created_at FROM events""",
    "user_events": """SELECT event_id, user_id, article_id, duration_seconds, scroll_percent, created_at,
      CASE WHEN kind IN ('VIEWED', 'READ') AND duration_seconds < 5 AND scroll_percent < 10 THEN 'SKIPPED' WHEN kind = 'VIEWED' AND duration_seconds >= 30 THEN 'READ' ELSE kind END AS event_type FROM mapped""",
    "interactions": """SELECT event_id, user_id, cast(props->>'$.k' AS bigint) AS news_id,
      CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'read' WHEN 'signup' THEN 'save' WHEN 'purchase' THEN 'share' ELSE 'search_click' END AS interaction_type,
      least(greatest(value, 0), 600) AS duration_seconds, ts AS created_at FROM events""",
    "bookmarks": "SELECT user_id, article_id, min(created_at) AS created_at FROM user_events WHERE event_type = 'BOOKMARKED' GROUP BY ALL",
}
_NEEDS = {"user_events": ["mapped"], "bookmarks": ["mapped", "user_events"]}
TENTHS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in EVENT_TENTHS.items()) + " ELSE 0 END"


def sql(body: str, *names: str, **more: str) -> str:
    """A query over these tables: body with the named expressions (and more of its own) before it."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*_NEEDS.get(n, []), n] if x not in order]
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{k} AS ({v})" for k, v in more.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
