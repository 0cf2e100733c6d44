"""Search end to end on literal articles."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenpress.operators import search as V


@pytest.fixture(scope="module")
def articles(spark):
    rows = [(k, f"Faiz kararı {k}" if k % 2 else f"Spor haberi {k}", "Ekonomi" if k % 3 else "Spor", "özet", "içerik", f"Kaynak {k % 2}", None if k == 7 else k, k * 10 % 70, k, float(k % 5)) for k in range(30)]
    d = spark.createDataFrame(rows, "id long, title string, labels string, summary string, content string, source string, day int, view_count long, share_count long, trend_score double")
    return d.withColumn("published_at", F.timestamp_seconds(1_700_000_000 + F.col("day") * 86_400)).drop("day")


def ids(d):
    return [r.id for r in sorted(d.collect(), key=lambda r: r.place)]


def test_pages_of_a_query(articles):
    first, second = V.search(articles, "faiz <karar>", page=1, limit=10), V.search(articles, "faiz <karar>", page=2, limit=10)
    assert ids(first) == [29, 27, 25, 23, 21, 19, 17, 15, 13, 11] and ids(second) == [9, 5, 3, 1, 7]  # undated last
    assert {(r.total, r.has_more) for r in first.collect()} == {(15, True)} and {(r.total, r.has_more) for r in second.collect()} == {(15, False)}
    assert V.search(articles, "faiz", page=9).count() == 0 and V.search(articles, "yokolan").count() == 0


def test_filters_and_sorts(articles):
    assert ids(V.search(articles, limit=3)) == [29, 28, 27]
    assert ids(V.search(articles, category="SPOR", limit=4)) == [27, 24, 21, 18]
    assert ids(V.search(articles, source="kaynak 1", sort="most_shared", limit=2)) == [29, 27]
    assert ids(V.search(articles, sort="trend", limit=2)) == [29, 24] and ids(V.search(articles, sort="most_read", limit=2)) == [27, 20]
    since, until = (F.timestamp_seconds(F.lit(1_700_000_000 + k * 86_400)) for k in (5, 9))
    assert ids(V.search(articles, since=since, until=until)) == [8, 6, 5]
    assert V.search(articles, limit=1000).count() == 30 and V.search(articles.limit(0), "faiz").count() == 0
