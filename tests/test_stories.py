"""Stems, story titles, counted rules and BM25 of pairs against plain versions."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lumenpress.functions import text as X
from lumenpress.operators import classify as C
from lumenpress.operators import search as V


def plain_stem(w: str, suffixes: list[str]) -> str:
    fit = [s for s in suffixes if w.endswith(s) and len(w) - len(s) >= 3]
    return w[: len(w) - len(max(fit, key=len))] if fit else w


@pytest.mark.parametrize("suffixes", [X.RELATED_SUFFIXES, X.STORY_SUFFIXES, X.COMPARISON_SUFFIXES])
def test_stems(spark, suffixes):
    words = ["", "ev", "evde", "evlerinden", "kitapları", "okulun", "ankaradan", "la", "masala", "gününden"]
    d = spark.createDataFrame([(w,) for w in words], "w string")
    assert [tuple(r) for r in d.select("w", X.stem(F.col("w"), suffixes)).collect()] == [(w, plain_stem(w, suffixes)) for w in words]


def test_story_titles(spark):
    d = spark.createDataFrame([("Son Dakika: TCMB kararı!",), ("Video  canlı yayın",), ("videolar",), (None,), ("",)], "t string")
    assert [r[0] for r in d.select(X.story_title(F.col("t"))).collect()] == ["merkez bankasi kararı", "yayın", "videolar", "", ""]


def test_counted_rules(spark):
    rules = C.parse_rules("a: red 1, big cat 1\nb: blue 1\nc: green 1")
    d = spark.createDataFrame([(1, "red red blue blue big cat"), (2, "blue"), (3, "")], "id int, normal string")
    assert [tuple(r) for r in C.counted_rules(d, rules).orderBy("id", "place").collect()] == [(1, "a", 1, 0.73), (1, "b", 2, 0.63)]


def test_pair_bm25(spark):
    docs = {1: ["a", "b", "c"], 2: ["a", "b", "b"], 3: ["d"], 4: []}
    n, mean = 3, 7 / 3
    df = {t: sum(t in d for d in docs.values()) for t in "abcd"}

    def score(query, doc):
        return sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * doc.count(t) * 2.5 / (doc.count(t) + 1.5 * (0.25 + 0.75 * len(doc) / mean)) for t in set(query))

    want = {}
    for a, b in [(1, 2), (1, 3)]:
        x, y = docs[a], docs[b]
        want[a, b] = round(min(1, (score(x, y) + score(y, x)) / 2 / max(score(x, x), score(y, y), 0.001)), 6)
    got = V.pair_bm25(spark.createDataFrame(list(docs.items()), "id int, tokens array<string>"), spark.createDataFrame(list(want), "a int, b int"))
    assert {(r.a, r.b): r.score for r in got.collect()} == want
