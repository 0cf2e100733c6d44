"""Registered queries of lists, lookups and pages that screens ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import scoring as S
from ..functions import text as X
from ..operators import analytics as A
from ..operators import relational as R
from . import sqltext as Q
from .registry import query

_NOW = f"TIMESTAMP '{T.AS_OF}'"


@query("f12_trend_filters", T.sql("SELECT category_id, language, min(published_at) AS first_seen, count(*) AS articles FROM articles GROUP BY 1, 2 HAVING min(published_at) BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-02 12:00:00' AND count(*) >= 3", "articles"))
def f12(spark: SparkSession, sf: str) -> DataFrame:
    """Topics first seen within a span, with enough articles."""
    d = T.articles(spark, sf).groupBy("category_id", "language").agg(F.min("published_at").alias("first_seen"), F.count(F.lit(1)).alias("articles"))
    lo, hi = (F.lit(x).cast("timestamp") for x in ("2024-01-01 00:00:00", "2024-01-02 12:00:00"))
    return d.filter(F.col("first_seen").between(lo, hi) & (F.col("articles") >= 3))


@query("f14_article_predicate", T.sql(f"SELECT id FROM articles WHERE contains(lower(content), 'the') AND view_count >= 75 AND category_id IN (0, 2, 4) AND language = 'en' AND NOT is_duplicate AND published_at >= {_NOW} - INTERVAL 14 DAYS", "articles"))
def f14(spark: SparkSession, sf: str) -> DataFrame:
    a = T.articles(spark, sf)
    recent = F.col("published_at") >= T.as_of() - F.expr("INTERVAL 14 DAYS")
    return a.filter("view_count >= 75 and category_id in (0, 2, 4) and language = 'en' and not is_duplicate").filter(recent & F.lower("content").contains("the")).select("id")


@query("f22_display_triplets", T.sql("SELECT id, coalesce(nullif(title, ''), '-') AS original_title, coalesce(nullif(CASE WHEN language = 'en' THEN '' ELSE replace(title, 'e', 'é') END, ''), nullif(title, ''), '-') AS display_title FROM articles", "articles"))
def f22(spark: SparkSession, sf: str) -> DataFrame:
    """Original and displayed title: the translation (here with accents) where there is one."""
    title = F.nullif(F.col("title"), F.lit(""))
    translated = F.when(F.col("language") != "en", F.nullif(F.replace("title", F.lit("e"), F.lit("é")), F.lit("")))
    return T.articles(spark, sf).select("id", F.coalesce(title, F.lit("-")).alias("original_title"), F.coalesce(translated, title, F.lit("-")).alias("display_title"))


@query("f26_inbox", "SELECT conv_id, max(turn) AS last_turn, arg_max(role, turn) AS last_role, count(*) AS messages FROM conversations GROUP BY 1 ORDER BY last_turn DESC, conv_id LIMIT 50")
def f26(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty conversations with most turns, with who spoke last."""
    d = T.raw(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.count(F.lit(1)).alias("messages"))
    return d.orderBy(F.desc("last_turn"), "conv_id").limit(50)


@query("f28_article_sources", T.sql("SELECT a.id, count(DISTINCT b.source_name) AS sources, min(b.id) AS first_article FROM articles a JOIN articles b ON sha256(a.content) = sha256(b.content) GROUP BY 1", "articles"))
def f28(spark: SparkSession, sf: str) -> DataFrame:
    """For every article the sources that carry the same text; itself where no other does."""
    d = T.articles(spark, sf).select("id", "source_name", F.sha2("content", 256).alias("key"))
    return d.join(d.groupBy("key").agg(F.count_distinct("source_name").alias("sources"), F.min("id").alias("first_article")), "key").select("id", "sources", "first_article")


@query("f29_editions", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 3")
def f29(spark: SparkSession, sf: str) -> DataFrame:
    """The three newest editions of every reader."""
    d = R.top_per_group(T.raw(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3)
    return d.select("o_custkey", "o_orderkey", "o_orderdate")


@query("k07_edition_upsert", "SELECT o_custkey, cast(o_orderdate AS date) AS edition_date, max(o_orderkey) AS edition, max(o_totalprice) AS price FROM orders GROUP BY 1, 2")
def k07(spark: SparkSession, sf: str) -> DataFrame:
    """One edition per reader and day: the latest wins."""
    d = T.raw(spark, sf, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("edition_date"))
    return d.agg(F.max("o_orderkey").alias("edition"), F.max("o_totalprice").alias("price"))


@query("k10_keyword_replace", T.sql(f"SELECT DISTINCT id, token FROM (SELECT id, unnest({Q.dedupe_tokens('title')}) AS token FROM articles) WHERE length(token) >= 4", "articles"))
def k10(spark: SparkSession, sf: str) -> DataFrame:
    """The keywords that replace an article's old ones, each once."""
    d = T.articles(spark, sf).select("id", F.explode(F.array_distinct(X.dedupe_tokens(F.col("title")))).alias("token"))
    return d.filter(F.length("token") >= 4)


@query("o11_trend_list", T.sql("SELECT category_id, language, count(DISTINCT source_name) AS sources, count(*) AS articles FROM articles GROUP BY 1, 2 ORDER BY sources DESC, articles DESC, category_id, language LIMIT 20", "articles"))
def o11(spark: SparkSession, sf: str) -> DataFrame:
    d = T.articles(spark, sf).groupBy("category_id", "language").agg(F.count_distinct("source_name").alias("sources"), F.count(F.lit(1)).alias("articles"))
    return d.orderBy(F.desc("sources"), F.desc("articles"), "category_id", "language").limit(20)


@query("t11_stable_keys", T.sql(f"SELECT id, CASE WHEN url <> '' THEN 'url:' || {Q.canonical_url('url')} WHEN title <> '' THEN 'title-source:' || {Q.title_normal('title')} || '|' || source_name ELSE 'title:' END AS key FROM articles", "articles"))
def t11(spark: SparkSession, sf: str) -> DataFrame:
    """The key under which repeated articles are the same: url, else title and source, else title."""
    title = X.title_normal(F.col("title"))
    key = F.when(F.col("url") != "", F.concat(F.lit("url:"), X.canonical_url(F.col("url")))).when(F.col("title") != "", F.concat(F.lit("title-source:"), title, F.lit("|"), "source_name")).otherwise("title:")
    return T.articles(spark, sf).select("id", key.alias("key"))


@query("t16_sanitised_queries", "SELECT conv_id, turn, substr(trim(regexp_replace(regexp_replace(text, '[<>`$\\\\]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 150) AS query FROM conversations WHERE role = 'user'")
def t16(spark: SparkSession, sf: str) -> DataFrame:
    """Search queries made safe; their length is bounded by the search box."""
    return T.raw(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", X.sanitize_query(F.col("text")).alias("query"))


@query("m12_popularity_log", T.sql("SELECT id, round(log10(1 + view_count), 6) AS popularity, round(least(1, greatest(0, view_count / 500)), 6) AS clamped FROM articles", "articles"))
def m12(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("view_count")
    return T.articles(spark, sf).select("id", F.round(S.popularity_log(v), 6).alias("popularity"), F.round(S.clamp01(v / 500), 6).alias("clamped"))


@query("r09_hybrid_cases", T.sql("SELECT a.id, round(CASE WHEN n IS NULL THEN 0.5::double * view_count / 10 + 0.3::double * share_count + 4 WHEN n < 60 THEN 0.7::double * n + 0.15::double * view_count / 10 + 0.15::double * share_count ELSE 0.45::double * n + 0.35::double * n / 2 + 0.1::double * view_count / 10 + 0.1::double * share_count END, 4) AS score FROM articles a LEFT JOIN (SELECT article_id, count(*) AS n FROM user_events GROUP BY 1) e ON e.article_id = a.id", "articles", "user_events"))
def r09(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid scores: without events, with few, and with enough for the collaborative part."""
    e = T.user_events(spark, sf).groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    v, s, n = F.col("view_count"), F.col("share_count"), F.col("n")
    cold = 0.5 * v / 10 + 0.3 * s + 4
    few = 0.7 * n + 0.15 * v / 10 + 0.15 * s
    many = 0.45 * n + 0.35 * n / 2 + 0.1 * v / 10 + 0.1 * s
    return T.articles(spark, sf).join(e, "id", "left").select("id", F.round(F.when(n.isNull(), cold).when(n < 60, few).otherwise(many), 4).alias("score"))


@query("x13_running_counters", "SELECT event_type, day, n, sum(n) OVER (PARTITION BY event_type ORDER BY day) AS total FROM (SELECT event_type, cast(ts AS date) AS day, count(*) AS n FROM events GROUP BY 1, 2)")
def x13(spark: SparkSession, sf: str) -> DataFrame:
    """Counters as they grow: counts per day first, then their running sum."""
    from pyspark.sql import Window

    d = T.raw(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("total", F.sum("n").over(Window.partitionBy("event_type").orderBy("day")))


@query("a31_top_interactions", T.sql(f"SELECT article_id, event_type, count(*) AS n FROM user_events WHERE created_at >= {_NOW} - INTERVAL 7 DAYS GROUP BY 1, 2 ORDER BY n DESC, article_id, event_type LIMIT 10", "user_events"))
def a31_top(spark: SparkSession, sf: str) -> DataFrame:
    d = A.since(T.user_events(spark, sf), T.as_of(), 7).groupBy("article_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return d.orderBy(F.desc("n"), "article_id", "event_type").limit(10)
