"""Interest buckets that a reader's interactions move up and down within bounds, and scores made of them.

A bucket's value depends on the order of events, as it is clamped after each. A step and any run of steps are of one
form, min(high, max(low, x + shift)), so runs of bounded length are folded apart and then put together: no task or row
holds all events of a reader.

Defined cases: readers and buckets that are null are left out; buckets without events have the start value; events without a
time come first, equal times go by event id; articles without a time have the ladder's value for these; empty tables give
empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..scratch import saved

# Points of interactions in tenths; what they move a category and a finer subject by; the bonus of every third positive one.
POINTS = {"impression": 2, "click": 20, "read": 40, "bookmark": 60, "dismiss": -10}
CATEGORY = {"impression": 0, "click": 1, "read": 3, "bookmark": 4, "dismiss": -1}
SUBJECT = {"impression": 0, "click": 2, "read": 4, "bookmark": 6, "dismiss": -1}
BONUS, EVERY, POSITIVE = 3, 3, ("click", "read", "bookmark")
START, LOW, HIGH = 50, 0, 100
CHUNK = 1000
_FAR = 1 << 40


def points(kind: Column, table: dict[str, int]) -> Column:
    out = F.lit(0)
    for k, v in table.items():
        out = F.when(kind == k, v).otherwise(out)
    return out.cast("long")


def clamped_folds(steps: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """(keys, value) of steps (keys, n, deltas): START moved by all deltas in the order of n (1, 2, ...), kept within LOW and HIGH after each."""
    within = lambda x: F.least(F.lit(HIGH).cast("long"), F.greatest(F.lit(LOW).cast("long"), x))
    run = lambda s, lo, hi: F.struct(s.alias("shift"), lo.alias("low"), hi.alias("high"))
    far = F.lit(_FAR)
    move = lambda r, d: run(r["shift"] + d, within(r["low"] + d), within(r["high"] + d))
    after = lambda r, q: run(r["shift"] + q["shift"], F.least(q["high"], F.greatest(q["low"], r["low"] + q["shift"])), F.least(q["high"], F.greatest(q["low"], r["high"] + q["shift"])))
    none = run(F.lit(0).cast("long"), -far, far)
    one = F.aggregate("deltas", none, move)
    d = steps.select(*keys, (F.col("n") - 1).alias("place"), one.alias("run"))
    while True:
        d = d.groupBy(*keys, F.floor(F.col("place") / chunk).alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "run"))).alias("runs"))  # chunk rows at most
        d = saved(d.select(*keys, F.col("block").alias("place"), F.aggregate("runs", none, lambda r, q: after(r, q["run"])).alias("run")), "folds")
        if not d.filter("place > 0").limit(1).count():
            break
    start = F.lit(START).cast("long")
    return d.select(*keys, F.least(F.col("run.high"), F.greatest(F.col("run.low"), start + F.col("run.shift"))).alias("value"))


def buckets(events: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(user_id, category_id, value) and (user_id, subject, value) of events (event_id, user_id, category_id, subject, kind, created_at)."""
    order = lambda *by: Window.partitionBy("user_id", *by).orderBy(F.asc_nulls_first("created_at"), "event_id")
    e = events.filter("user_id is not null")
    c = e.filter("category_id is not null").select("user_id", "category_id", F.row_number().over(order("category_id")).alias("n"), F.array(points(F.col("kind"), CATEGORY)).alias("deltas"))
    positive = F.col("kind").isin(*POSITIVE)
    so_far = F.sum(positive.cast("long")).over(order("subject").rowsBetween(Window.unboundedPreceding, 0))
    bonus = F.when(positive & (so_far % EVERY == 0), F.array(F.lit(BONUS).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    s = e.filter("subject is not null").select("user_id", "subject", F.row_number().over(order("subject")).alias("n"), F.concat(F.array(points(F.col("kind"), SUBJECT)), bonus).alias("deltas"))
    return clamped_folds(c, ["user_id", "category_id"], chunk), clamped_folds(s, ["user_id", "subject"], chunk)


def _bounded(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x))


def relevance(events: DataFrame, articles: DataFrame, as_of: Column, home: str, chunk: int = CHUNK) -> DataFrame:
    """(user_id, article_id, category, subject, recency, interaction, relevance, read) of the articles (id, category_id, subject, published_at, language) that readers met.

    Relevance is .35 of the category's bucket, .40 of the subject's, .15 of recency, .10 of the reader's interactions with the article, and 15 for the home language.
    """
    a = articles.select(F.col("id").alias("article_id"), "category_id", "subject", "published_at", "language")
    e = saved(events.join(a, "article_id").select("event_id", "user_id", "article_id", "category_id", "subject", "kind", "created_at"), "interest-events")
    by_category, by_subject = buckets(e, chunk)
    met = e.filter("user_id is not null").groupBy("user_id", "article_id").agg(F.sum(points(F.col("kind"), POINTS)).alias("points"), F.max((F.col("kind") == "read").cast("int")).alias("read"))
    d = met.join(a, "article_id").join(by_category.withColumnRenamed("value", "category"), ["user_id", "category_id"], "left").join(by_subject.withColumnRenamed("value", "of_subject"), ["user_id", "subject"], "left")
    behaviour = _bounded(F.floor((500 + 6 * F.col("points") + 5) / 10))
    d = d.withColumns({"category": F.coalesce("category", F.lit(START)), "of_subject": F.coalesce("of_subject", F.lit(START)), "recency": S.freshness(F.col("published_at"), as_of, "feed").cast("long"), "interaction": _bounded(F.floor((7 * behaviour + 165 + 5) / 10))})
    raw = 35 * F.col("category") + 40 * F.col("of_subject") + 15 * F.col("recency") + 10 * F.col("interaction") + F.when(F.col("language") == home, 1500).otherwise(0)
    return d.select("user_id", "article_id", "category", F.col("of_subject").alias("subject"), "recency", "interaction", _bounded(F.floor((raw + 50) / 100)).alias("relevance"), (F.col("read") == 1).alias("read"))


# What a carousel's score adds to relevance.
VERY_HIGH, HIGH_INTEREST, STATED, NEWEST, NEW, HOT, WARM, UNREAD, SEEN = (90, 100), (75, 70), 40, (2, 25), (24, 15), (70, 20), (40, 10), 10, -20


def carousel(relevant: DataFrame, articles: DataFrame, stated: list[int], as_of: Column) -> DataFrame:
    """(user_id, article_id, place, score, reasons) of relevant (user_id, article_id, relevance, read): each reader's articles (id, category_id, published_at, trend, key) ranked, one of each title key.

    Articles come in the order of ids; all of a key but the first lose 20. Of equal scores the newest come first.
    """
    a = articles.select(F.col("id").alias("article_id"), "category_id", "published_at", "trend", "key")
    d = relevant.join(a, "article_id")
    first = F.row_number().over(Window.partitionBy("user_id", "key").orderBy("article_id")) == 1
    hours = S.hours_old(F.col("published_at"), as_of)
    step = lambda x, above, below, up: F.when(x >= above[0] if up else x <= above[0], above[1]).when(x >= below[0] if up else x <= below[0], below[1]).otherwise(0)
    r, t = F.col("relevance"), F.coalesce("trend", F.lit(0))
    named = lambda cond, name: F.when(cond, F.lit(name))
    reasons = F.array_compact(F.array(
        named(r >= 90, "very high interest"), named((r >= 75) & (r < 90), "high interest"), named(F.col("category_id").isin(stated), "stated interest"),
        named(hours <= 2, "just published"), named((hours > 2) & (hours <= 24), "published today"), named(t >= 70, "high trend"), named((t >= 40) & (t < 70), "trend"),
    ))
    score = r + step(r, VERY_HIGH, HIGH_INTEREST, True) + F.when(F.col("category_id").isin(stated), STATED).otherwise(0) + step(hours, NEWEST, NEW, False) + step(t, HOT, WARM, True) + F.when(F.col("read"), 0).otherwise(UNREAD) + F.when(first, 0).otherwise(SEEN)
    order = (F.desc("score"), F.desc_nulls_last("published_at"), F.asc("article_id"))
    d = d.select("user_id", "article_id", "key", "published_at", score.cast("long").alias("score"), F.slice(reasons, 1, 3).alias("reasons"))
    d = d.withColumn("k", F.row_number().over(Window.partitionBy("user_id", "key").orderBy(*order))).filter("k = 1")
    return d.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).select("user_id", "article_id", "place", "score", "reasons")
