"""Registered queries of interest buckets moved by interactions, and carousels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import text as X
from ..operators import interests as I  # noqa: E741
from . import sqltext as Q
from .content import ladder_sql
from .registry import query
from .search import _HOURS

_STATED = [0, 2, 5]


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Views are impressions, reads of half a minute reads, shorter ones and shares clicks, skips dismissals."""
    e, t = T.user_events(spark, sf), F.col("event_type")
    kind = F.when(t == "VIEWED", "impression").when(t == "BOOKMARKED", "bookmark").when(t == "SKIPPED", "dismiss").when((t == "READ") & (F.col("duration_seconds") >= 30), "read").otherwise("click")
    return e.select("event_id", "user_id", "article_id", kind.alias("kind"), "created_at")


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    """Sources stand for subcategories, which the tables lack."""
    a = T.articles(spark, sf)
    return a.select("id", "category_id", F.col("source_name").alias("subject"), "published_at", "language", F.col("share_count").alias("trend"), X.title_normal(F.col("title")).alias("key"))


def _relevance(spark: SparkSession, sf: str) -> DataFrame:
    return I.relevance(_events(spark, sf), _articles(spark, sf), T.as_of(), "es")


def _case(table: dict[str, int]) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 0 END"


_FOLD = "list_reduce(list_prepend(50::bigint, {0}), lambda x, y: least(100, greatest(0, x + y)))"
_INTERESTS = {
    "ie": f"""SELECT e.event_id, user_id, article_id, e.created_at, category_id, source_name AS subject, CASE event_type WHEN 'VIEWED' THEN 'impression' WHEN 'BOOKMARKED' THEN 'bookmark' WHEN 'SKIPPED' THEN 'dismiss' WHEN 'READ' THEN CASE WHEN duration_seconds >= 30 THEN 'read' ELSE 'click' END ELSE 'click' END AS kind
      FROM user_events e JOIN articles a ON a.id = e.article_id""",
    "ic": f"SELECT user_id, category_id, {_FOLD.replace('{0}', f'list({_case(I.CATEGORY)}::bigint ORDER BY created_at, event_id)')} AS category FROM ie GROUP BY 1, 2",
    "ip": "SELECT *, kind IN ('click', 'read', 'bookmark') AND sum(CASE WHEN kind IN ('click', 'read', 'bookmark') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, subject ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING) % 3 = 0 AS bonus FROM ie",
    "iu": f"SELECT user_id, subject, {_FOLD.replace('{0}', f'flatten(list(CASE WHEN bonus THEN [{_case(I.SUBJECT)}::bigint, 3::bigint] ELSE [{_case(I.SUBJECT)}::bigint] END ORDER BY created_at, event_id))')} AS value FROM ip GROUP BY 1, 2",
    "im": f"SELECT user_id, article_id, sum({_case(I.POINTS)})::bigint AS points, bool_or(kind = 'read') AS read FROM ie GROUP BY 1, 2",
    "ix": f"SELECT m.user_id, m.article_id, category, value AS subject, {ladder_sql('feed')} AS recency, greatest(0, least(100, floor((7 * greatest(0, least(100, floor((500 + 6 * points + 5) / 10))) + 170) / 10)))::bigint AS interaction, language, read FROM im m JOIN articles ON id = m.article_id JOIN ic ON ic.user_id = m.user_id AND ic.category_id = articles.category_id JOIN iu ON iu.user_id = m.user_id AND iu.subject = source_name",
    "ir": "SELECT user_id, article_id, category, subject, recency, interaction, greatest(0, least(100, floor((35 * category + 40 * subject + 15 * recency + 10 * interaction + CASE WHEN language = 'es' THEN 1500 ELSE 0 END + 50) / 100)))::bigint AS relevance, read FROM ix",
    "iz": f"""SELECT user_id, article_id, published_at, key, list_filter([CASE WHEN r >= 90 THEN 'very high interest' END, CASE WHEN r >= 75 AND r < 90 THEN 'high interest' END, CASE WHEN category_id IN (0, 2, 5) THEN 'stated interest' END, CASE WHEN h <= 2 THEN 'just published' END, CASE WHEN h > 2 AND h <= 24 THEN 'published today' END, CASE WHEN share_count >= 70 THEN 'high trend' END, CASE WHEN share_count >= 40 AND share_count < 70 THEN 'trend' END], lambda x: x IS NOT NULL)[1:3] AS reasons,
      r + CASE WHEN r >= 90 THEN 100 WHEN r >= 75 THEN 70 ELSE 0 END + CASE WHEN category_id IN (0, 2, 5) THEN 40 ELSE 0 END + CASE WHEN h <= 2 THEN 25 WHEN h <= 24 THEN 15 ELSE 0 END + CASE WHEN share_count >= 70 THEN 20 WHEN share_count >= 40 THEN 10 ELSE 0 END + CASE WHEN read THEN 0 ELSE 10 END + CASE WHEN row_number() OVER (PARTITION BY user_id, key ORDER BY article_id) = 1 THEN 0 ELSE -20 END AS score
      FROM (SELECT ir.*, relevance AS r, published_at, category_id, share_count, {_HOURS} AS h, {Q.title_normal('title')} AS key FROM ir JOIN articles ON id = article_id)""",
}


@query("r26_bucket_relevance", T.sql("SELECT * FROM ir", "articles", "user_events", **_INTERESTS))
def r26(spark: SparkSession, sf: str) -> DataFrame:
    """The relevance to each reader of the articles met, by buckets that all interactions moved in order."""
    return _relevance(spark, sf)


@query("r27_carousels", T.sql("SELECT user_id, article_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, published_at DESC, article_id) AS int) AS place, cast(score AS bigint) AS score, reasons FROM (SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY score DESC, published_at DESC, article_id) AS k FROM iz) WHERE k = 1", "articles", "user_events", **_INTERESTS))
def r27(spark: SparkSession, sf: str) -> DataFrame:
    """Each reader's carousel of articles met, one of each title, with up to three reasons."""
    return I.carousel(_relevance(spark, sf), _articles(spark, sf), _STATED, T.as_of())
