"""Stages and scratch tables of the corpus pipeline."""

from __future__ import annotations

import random
import string

import pytest

import corpus_pipeline as p
from lumenpress import scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 8))) for _ in range(n))


def table(spark, path, seed: int, more=(), schema=SCHEMA):
    rng = random.Random(seed)
    rows = [(k, prose(rng, rng.randint(30, 60)), "en", f"s{k % 2}") for k in range(40)]
    d = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *more) for r in rows], schema)
    d.write.parquet(str(path / "documents.parquet"))
    return spark.read.parquet(str(path / "documents.parquet"))


def test_results_can_be_read_in_any_order(spark, tmp_path):
    docs = table(spark, tmp_path, 1)
    a = p.quality_rules(spark, docs, "")
    b = p.secret_scan(spark, docs, "")
    c = p.near_dedup(spark, a, "")  # chained without writing
    e = p.source_mix(spark, c, "")
    assert (a.count(), b.count(), c.count()) == (40, 40, 40) and e.count() > 0 and a.count() == 40
    assert c.columns == docs.columns


def test_two_pipelines_do_not_meet(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "y").mkdir()
    one, two = table(spark, tmp_path / "x", 1), table(spark, tmp_path / "y", 2)
    a = p.quality_rules(spark, one, "")
    b = p.quality_rules(spark, two, "")
    b.write.parquet(str(tmp_path / "b"))
    c = p.near_dedup(spark, spark.read.parquet(str(tmp_path / "b")), "")
    assert a.count() == 40 and c.count() == 40  # b was written, a wasn't


def test_tables_go_once_the_result_is_written(spark, tmp_path):
    docs = table(spark, tmp_path, 3)
    a = p.quality_rules(spark, docs, "")
    (mark,) = {c.metadata[p._MARK] for c in a.schema}
    assert p._TABLES[mark]
    a.write.parquet(str(tmp_path / "a"))
    p.near_dedup(spark, spark.read.parquet(str(tmp_path / "a")), "")
    assert p._TABLES[mark] == []
    with scratch.recording() as made:
        assert p.run(spark, str(tmp_path)).count() > 0
    assert made


@pytest.mark.parametrize("stage", [f for _, f in p.STAGES], ids=[n for n, _ in p.STAGES])
def test_odd_tables(spark, stage):
    """An empty table, clashing columns, nulls, repeated rows and a very long text."""
    rng = random.Random(5)
    extra = "row string, doc string, at long, base string, kept boolean, comp long, copies int, class_id long, clean string"
    none = spark.createDataFrame([], f"{SCHEMA}, {extra}")
    assert stage(spark, none, "").count() == 0
    more = ("r", "d", 1, "b", True, 2, 3, 4, "c")
    texts = [None, "", " \n", prose(rng, 40), prose(rng, 30_000), "x" * 200_000]
    rows = [(k, t, lang, s, None) for k, t in enumerate(texts) for lang, s in (("en", "s"), (None, None))] + [(None, None, None, None, None)] * 2
    d = spark.createDataFrame([(*r, *more) for r in rows + rows[6:8]], f"{SCHEMA}, {extra}")
    out = stage(spark, d, "")
    got = out.collect()
    if stage is p.best_fit_pack:
        assert sum(r.piece == 0 for r in got) == len(rows) + 2
        return
    assert out.columns == d.columns
    kept = [r.text for r in got]
    if stage is p.quality_rules:
        assert sorted(map(len, kept)) == sorted(len(t) for t in [texts[3]] * 4 + [texts[4]] * 2)
    elif stage is p.near_dedup:
        assert sum(t is None for t in kept) == 4 and len(kept) == 4 + 5  # null texts all stay; "" and " \n" differ, as do all others
    elif stage is p.secret_scan:
        assert len(got) == len(rows) + 2 and all((r.n_chars is None) == (r.text is None) for r in got)
    assert all(r.row == "r" and r.clean == "c" and r.copies == 3 for r in got)
