"""Filters, pages, ranks and joins that several queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_articles(articles: DataFrame, article_categories: DataFrame, categories: list[int] | None = None, sources: list[int] | None = None, start: str | None = None, end: str | None = None, language: str | None = None) -> DataFrame:
    """Articles that aren't duplicates and meet every condition given; a condition left out costs nothing."""
    d = articles.filter(~F.col("is_duplicate"))
    if sources:
        d = d.filter(F.col("source_id").isin(sources))
    if start:
        d = d.filter(F.col("published_at") >= F.lit(start).cast("timestamp"))
    if end:
        d = d.filter(F.col("published_at") <= F.lit(end).cast("timestamp"))
    if language:
        d = d.filter(F.col("language") == language)
    if categories:
        own = article_categories.filter(F.col("category_id").isin(categories)).select(F.col("article_id").alias("id"))
        d = d.join(own, "id", "left_semi")
    return d


def page(ordered: DataFrame, number: int, size: int) -> DataFrame:
    """A page of an ordered DataFrame, counted from 1."""
    return ordered.offset((number - 1) * size).limit(size)


def ranked(df: DataFrame, score: str, name: str = "rank", tie: str = "id") -> DataFrame:
    """df with places 1, 2, ... by score, highest first, without sorting everything in one task.

    Rows are ranked within score values; the values' counts, far fewer, give the offsets.
    """
    counts = df.groupBy(score).agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__before", F.sum("__n").over(Window.orderBy(F.desc(score))) - F.col("__n")).drop("__n")
    own = F.row_number().over(Window.partitionBy(score).orderBy(tie))
    return df.withColumn("__own", own).join(counts, score).withColumn(name, F.col("__before") + F.col("__own")).drop("__own", "__before")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark drops the rest before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)


def exclude_read(users: DataFrame, candidates: DataFrame, read: DataFrame) -> DataFrame:
    """For each user the candidates (a short list, column id) not in read (user_id, id); all if nothing would be left."""
    ids = candidates.agg(F.collect_set("id").alias("all")).scalar()
    seen = read.join(candidates, "id", "left_semi").groupBy("user_id").agg(F.collect_set("id").alias("seen"))
    d = users.join(seen, "user_id", "left").withColumn("all", ids)
    left = F.array_except("all", F.coalesce("seen", F.array().cast("array<bigint>")))
    return d.select("user_id", F.explode(F.when(F.size(left) > 0, left).otherwise(F.col("all"))).alias("id"))


def first_wins(pools: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Rows of all pools with their origin; a key in an earlier pool hides it in later ones."""
    d = None
    for k, (name, p) in enumerate(pools):
        p = p.select(key, F.struct(F.lit(k).alias("k"), F.lit(name).alias("origin")).alias("o"))
        d = p if d is None else d.unionByName(p)
    return d.groupBy(key).agg(F.min("o")["origin"].alias("origin"))


def last_before(events: DataFrame, earlier: DataFrame, by: str, at: str, key: str, hours: int) -> DataFrame:
    """As-of join: for each event the last earlier row of the same ``by`` within some hours: (key, view_ts, view_id).

    Both sides are cut into spans of that many hours, and an event meets its own span and the one before: an
    equi-join whose size follows the number of rows in a span, then the latest match.
    """
    span = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / (hours * 3600))
    left = events.select(key, by, F.col(at).alias("__at"), F.explode(F.array(span(at), span(at) - 1)).alias("__span"))
    right = earlier.select(F.col(by).alias("__by"), F.col(at).alias("__then"), F.col(key).alias("__key"), span(at).alias("__own"))
    d = left.join(right, (F.col(by) == F.col("__by")) & (F.col("__span") == F.col("__own")) & (F.col("__then") <= F.col("__at")) & (F.col("__then") >= F.col("__at") - F.expr(f"INTERVAL {hours} HOURS")))
    last = d.groupBy(key).agg(F.max(F.struct("__then", "__key")).alias("m"))
    return last.select(key, F.col("m.__then").alias("view_ts"), F.col("m.__key").alias("view_id"))
