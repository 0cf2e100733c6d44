"""Language profiles on held-out texts, content profiles against a plain version, classifier chains on labels that depend on each other."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenpress.operators import language as N
from lumenpress.operators import models as M
from lumenpress.operators import profiles as P


def test_language_of_held_out_texts(spark):
    rng = random.Random(3)
    letters = {"en": "etaoinshr", "tr": "aeıilşğüçn", "de": "enisratdhü", "fr": "esaitnrulé"}
    word = lambda k: "".join(rng.choice(letters[k]) for _ in range(rng.randint(2, 8)))
    text = lambda k, n: " ".join(word(k) if rng.random() > 0.1 else word(rng.choice(list(letters))) for _ in range(n))
    rows = [(i, text(k, rng.randint(8, 60)), k) for i, k in enumerate(rng.choice(list(letters)) for _ in range(600))]
    d = spark.createDataFrame([*rows, (1000, "no label " * 9, None)], "id long, text string, language string")
    known = N.profiles(d.filter("id % 3 <> 0"))
    got = {r.id: r for r in N.detect(d.select("id", "text"), known).collect()}
    for k in letters:
        own = [i for i, _, x in rows if x == k and i % 3 == 0]
        assert sum(got[i].language == k for i in own) >= 0.95 * len(own)
    assert all(0.25 <= r.confidence <= 1 for r in got.values()) and len(got) == 601


def test_texts_without_a_language(spark):
    known = N.profiles(spark.createDataFrame([("ab ab ab ab ab", "x"), ("cd cd cd cd", "y")], "text string, language string"))
    d = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, "1234567890 1234567890"), (5, "ab ab ab ab ab ab ab ab"), (6, "zz zz zz zz zz zz zz zz")], "id long, text string")
    got = {r.id: (r.language, r.confidence) for r in N.detect(d, known).collect()}
    assert {k: v for k, v in got.items() if k != 5} == {k: ("unknown", 0.0) for k in (1, 2, 3, 4, 6)} and got[5][0] == "x"
    none = N.profiles(d.limit(0).select("text", F.lit("x").alias("language")))
    assert {r.language for r in N.detect(d, none).collect()} == {"unknown"}


def plain_vectors(rows):
    counts = {}
    for k, t in rows:
        w = [x for x in re.findall(r"\w+", t.lower()) if len(x) >= 2]
        counts[k] = collections.Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
    df = collections.Counter(t for c in counts.values() for t in c)
    out = {}
    for k, c in counts.items():
        v = {t: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in c.items() if df[t] >= 2}
        size = math.sqrt(sum(x * x for x in v.values()))
        out[k] = {t: x / size for t, x in v.items()}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_content_profiles_equal_the_plain_version(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(P, "READERS", 3)
        monkeypatch.setattr(P, "ARTICLES", 4)
    rng = random.Random(4)
    words = [f"wo{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(3, 20)))) for k in range(60)] + [(90, "unique1 unique2"), (91, "")]
    reads = [(u, a) for u in range(10) for a in rng.sample(range(60), rng.randint(1, 6))] + [(20, 90), (21, 777), (0, 0), (0, 0)]
    v = P.vectors(spark.createDataFrame(rows, "id long, text string"))
    got = P.recommend(v, spark.createDataFrame(reads, "user_id long, article_id long"), top=7).collect()
    vectors = plain_vectors(rows)
    for u in {u for u, _ in reads}:
        seen = {a for x, a in reads if x == u}
        profile = collections.Counter()
        for a in seen:
            for t, w in vectors.get(a, {}).items():
                profile[t] += w
        size = math.sqrt(sum(x * x for x in profile.values())) or 1
        scores = {a: sum(profile[t] * w for t, w in x.items()) / size for a, x in vectors.items() if a not in seen}
        want = sorted((s for s in scores.values() if s > 0.00005), reverse=True)[:7]
        mine = sorted((r for r in got if r.user_id == u), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(want) + 1))
        assert np.allclose([r.score for r in mine], want, atol=2e-4)
        assert all(abs(scores[r.article_id] - r.score) < 2e-4 for r in mine)


def test_vocabulary_is_bounded_and_falls_back(spark):
    rows = [(1, "aa bb aa cc"), (2, "aa dd"), (3, "bb aa")]
    v = {r.id: len(r.places) for r in P.vectors(spark.createDataFrame(rows, "id long, text string"), most=2).collect()}
    assert v == {1: 2, 2: 1, 3: 2}  # aa and bb; "bb aa" is as frequent as bb and later by name
    alone = P.vectors(spark.createDataFrame([(1, "aa bb")], "id long, text string")).first()
    assert len(alone.places) == 3  # no term in two documents: all count
    empty = P.vectors(spark.createDataFrame([], "id long, text string"))
    assert P.recommend(empty, spark.createDataFrame([(1, 1)], "user_id long, article_id long")).count() == 0


def test_chains_use_labels_that_depend_on_each_other(spark):
    """A label that holds where exactly one of two others does: no linear model of words tells it, one of labels does."""
    rng = random.Random(6)
    rows = []
    for k in range(400):
        a, b = k % 2, k // 2 % 2
        some = lambda on, c: [f"{c}{rng.randrange(2)}" for _ in range(3 * on)]
        rows.append((k, [*some(a, "a"), "n0", *some(b, "b"), "n0", *(f"n{rng.randrange(3)}" for _ in range(10))], float(a), float(b), float(a and b), float(a != b)))
    names = ["first", "second", "both", "one"]
    d = spark.createDataFrame(rows, "id long, tokens array<string>, first double, second double, both double, one double")
    train, test = M.held_out(d)
    seeds = tuple(s for s in range(60) if random.Random(s).sample(names, 4)[-1] == "one")[:2]
    model = M.multilabel(train, names, features=1 << 12, seeds=seeds)
    want = {r.id: {n for n in names if r[n] == 1} for r in test.collect()}

    def right(m):
        got = {r.id: {x.label: x.confidence for x in r.labels} for r in m.transform(test).collect()}
        assert set(got) == set(want) and all(c >= 0.4 for x in got.values() for c in x.values())
        return sum(("one" in got[k]) == ("one" in want[k]) for k in want)

    chained, alone = right(model), right(M.MultiLabel(model.base, model.single, [], 0.4))
    assert chained >= 0.9 * len(want) > alone
    assert [order[-1] for order, _ in model.chains] == ["one", "one"]
