"""Interest buckets folded in runs, relevance and carousels, against sequential versions."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from lumenpress.operators import interests as I  # noqa: E741

EVENTS = "event_id long, user_id long, article_id long, kind string, created_at long"
ARTICLES = "id long, category_id int, subject string, published_at long, language string, trend long, key string"
AS_OF = 1_700_000_000


def moved(value, *deltas):
    for d in deltas:
        value = min(100, max(0, value + d))
    return value


@pytest.mark.parametrize("chunk", [2, 3, 1000])
def test_folds_in_runs(spark, chunk):
    rng = random.Random(chunk)
    rows = [(u, n, [rng.choice([-60, -7, 0, 4, 55]) for _ in range(rng.randint(0, 3))]) for u, size in ((1, 40), (2, 1), (3, 9)) for n in range(1, size + 1)]
    d = spark.createDataFrame(rows, "user_id long, n int, deltas array<long>").repartition(5)
    want = {u: moved(50, *(x for v, _, ds in rows if v == u for x in ds)) for u in (1, 2, 3)}
    assert {r.user_id: r.value for r in I.clamped_folds(d, ["user_id"], chunk).collect()} == want


def made(spark, events, articles):
    e = spark.createDataFrame(events, EVENTS).withColumn("created_at", F.timestamp_seconds("created_at"))
    return e, spark.createDataFrame(articles, ARTICLES).withColumn("published_at", F.timestamp_seconds("published_at"))


@pytest.mark.parametrize("chunk", [4, 1000])
def test_relevance_and_carousel(spark, chunk):
    rng = random.Random(7)
    articles = [(k, k % 3 if k != 9 else None, rng.choice(["x", "y", None]), None if k == 8 else AS_OF - 3600 * rng.choice([1, 10, 50, 100, 500, 900]), rng.choice(["es", "en", None]), rng.choice([10, 50, 90, None]), rng.choice(["one", "two", "three", ""])) for k in range(12)]
    events = [(k, rng.choice([1, 1, 1, 2, 3, None]), rng.randint(0, 13), rng.choice([*I.POINTS, "other"]), rng.choice([5, 6, rng.randint(1, 90), None])) for k in range(400)]
    e, a = made(spark, events, articles)
    got = I.relevance(e, a, F.timestamp_seconds(F.lit(AS_OF)), "es", chunk).cache()
    facts = {r[0]: r for r in articles}
    category, subject, count = collections.defaultdict(lambda: 50), collections.defaultdict(lambda: 50), collections.Counter()
    points, read = collections.Counter(), set()
    for _, u, art, kind, _ in sorted(events, key=lambda r: (r[4] is not None, r[4] or 0, r[0])):
        if u is None or art not in facts:
            continue
        c, s = facts[art][1:3]
        category[u, c] = moved(category[u, c], I.CATEGORY.get(kind, 0)) if c is not None else 50
        if s is not None:
            subject[u, s] = moved(subject[u, s], I.SUBJECT.get(kind, 0))
            if kind in I.POSITIVE:
                count[u, s] += 1
                if count[u, s] % 3 == 0:
                    subject[u, s] = moved(subject[u, s], 3)
        points[u, art] += I.POINTS.get(kind, 0)
        if kind == "read":
            read.add((u, art))
    want = {}
    for u, art in points:
        _, c, s, at, lang, _, _ = facts[art]
        age = None if at is None else (AS_OF - at) / 3600
        recency = 45 if age is None else next((v for h, v in ((6, 100), (24, 90), (72, 75), (168, 60), (720, 35)) if age <= h), 20)
        behaviour = min(100, max(0, (500 + 6 * points[u, art] + 5) // 10))
        interaction = min(100, max(0, (7 * behaviour + 170) // 10))
        total = 35 * category[u, c] + 40 * subject[u, s] + 15 * recency + 10 * interaction + 1500 * (lang == "es")
        want[u, art] = (category[u, c], subject[u, s], recency, interaction, min(100, (total + 50) // 100), (u, art) in read)
    assert {(r.user_id, r.article_id): (r.category, r.subject, r.recency, r.interaction, r.relevance, r.read) for r in got.collect()} == want

    seen, scores = set(), collections.defaultdict(list)
    for u, art in sorted(want):
        _, c, _, at, _, trend, key = facts[art]
        r, age, trend = want[u, art][4], None if at is None else (AS_OF - at) / 3600, trend or 0
        score = r + (100 if r >= 90 else 70 if r >= 75 else 0) + 40 * (c in (0, 2)) + (0 if age is None else 25 if age <= 2 else 15 if age <= 24 else 0) + (20 if trend >= 70 else 10 if trend >= 40 else 0) + 10 * ((u, art) not in read) - 20 * ((u, key) in seen)
        seen.add((u, key))
        scores[u].append((-score, -(at or 0), art, key))
    ranked = {}
    for u, rows in scores.items():
        used, place = set(), 0
        for s, _, art, key in sorted(rows):
            if key not in used:
                used.add(key)
                place += 1
                ranked[u, place] = (art, -s)
    rows = I.carousel(got, a, [0, 2], F.timestamp_seconds(F.lit(AS_OF))).collect()
    assert {(r.user_id, r.place): (r.article_id, r.score) for r in rows} == ranked
    assert all(len(r.reasons) <= 3 and len(set(r.reasons)) == len(r.reasons) for r in rows)


def test_empty_tables(spark):
    e, a = made(spark, [], [])
    d = I.relevance(e, a, F.timestamp_seconds(F.lit(AS_OF)), "es")
    assert d.count() == 0 and I.carousel(d, a, [0], F.timestamp_seconds(F.lit(AS_OF))).count() == 0
