"""Held-out accuracy of trained classifiers, stored models, topics, factorisation and the gates of collaborative filtering."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lumenpress.operators import models as M
from lumenpress.operators import recommend as R


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents of two subjects that share half of their words."""
    r = random.Random(5)
    both, own = [f"b{i}" for i in range(40)], {0: [f"x{i}" for i in range(40)], 1: [f"y{i}" for i in range(40)]}
    rows = [(i, [r.choice(both if r.random() < 0.5 else own[i % 2]) for _ in range(30)], float(i % 2)) for i in range(300)]
    return M.held_out(spark.createDataFrame(rows, "id bigint, tokens array<string>, label double").cache())


def accuracy(scored, column):
    return scored.agg(F.avg((F.col(column) == F.col("label")).cast("double"))).first()[0]


def test_held_out_rows_are_split_once(labelled):
    train, test = labelled
    assert train.count() + test.count() == 300 and 30 < test.count() < 90
    assert train.join(test, "id").count() == 0


def test_naive_bayes_is_stored(labelled, tmp_path):
    train, test = labelled
    model = M.naive_bayes(train, 1 << 10)
    first = model.transform(test).select("id", "label", "prediction")
    assert accuracy(first, "prediction") >= 0.95
    again = M.stored(model, str(tmp_path / "model")).transform(test).select("id", "label", "prediction")
    assert sorted(first.collect()) == sorted(again.collect())


def test_calibrated_svc(labelled):
    from pyspark.ml.functions import vector_to_array

    train, test = labelled
    d = M.calibrated_svc(train, 1 << 10).transform(test).withColumn("p", F.array_max(vector_to_array("chances")))
    assert accuracy(d, "calibrated") >= 0.95
    low, high = d.agg(F.min("p"), F.max("p")).first()
    assert 0.5 <= low <= high <= 1


def test_topics_tell_subjects_apart(labelled):
    got = M.topics(labelled[0].select("id", "tokens"), k=2, iterations=15).collect()
    assert {r.topic for r in got} == {0, 1} and all(0 < r.weight < 1 for r in got) and len(got) == 20


def test_factorisation_finds_two_tastes(spark):
    liked = [(u, a, 5.0 if u % 2 == a % 2 else 1.0) for u in range(20) for a in range(20) if (u * 7 + a * 3) % 5]
    d = spark.createDataFrame(liked, "user_id bigint, article_id bigint, rating double")
    unseen = spark.createDataFrame([(u, a) for u in range(20) for a in range(20) if not (u * 7 + a * 3) % 5], "user int, item int")
    got = M.factorise(d, rank=4).transform(unseen).collect()
    assert all((r.prediction > 3) == (r.user % 2 == r.item % 2) for r in got) and len(got) == 80
    assert all(rmse < 1.5 for _, rmse, _ in M.evaluate(d, folds=2, rank=4))


def test_cf_needs_three_articles(spark):
    rows = [(1, 1, 1.0), (1, 2, 1.0), (1, 3, 1.0), (2, 1, 1.0), (2, 4, 2.0), (3, 1, 1.0), (3, 2, 1.0), (3, 5, 1.0)]
    r = spark.createDataFrame(rows, "user_id bigint, article_id bigint, rating double")
    s = R.user_similarities(r)
    assert {x.user_id for x in R.user_cf(r, s, least_items=3).collect()} == {1, 3}
    assert {x.user_id for x in R.user_cf(r, s).collect()} == {1, 2, 3}
