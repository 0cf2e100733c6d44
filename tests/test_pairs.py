"""Pairs of similar token sets, and what is kept of them, against all pairs."""

from __future__ import annotations

import itertools
import random

from lumenpress.operators import graph as G
from lumenpress.operators import search as V
from lumenpress.plans.catalog import QUERIES


def close(x: set, y: set, least: float) -> bool:
    return bool(x | y) and len(x & y) / len(x | y) >= least


def plain_keeps(docs: dict[int, list[str]], least: float) -> dict[int, tuple]:
    """(kept, by) of every document that is linked to another, one after the other."""
    sets, kept, out, linked = {k: set(v) for k, v in docs.items()}, [], {}, set()
    for a, b in itertools.combinations(sorted(sets), 2):
        if close(sets[a], sets[b], least):
            linked |= {a, b}
    for k in sorted(linked):
        by = next((j for j in kept if close(sets[j], sets[k], least)), None)
        out[k] = (by is None, by)
        if by is None:
            kept.append(k)
    return out


def some_docs() -> dict[int, list[str]]:
    rng = random.Random(3)
    words = [f"w{k}" for k in range(25)]
    docs = {k: rng.choices(words, k=rng.randint(0, 9)) for k in range(250)}
    common = ["press", "release", "of", "the", "day"]
    return docs | {300 + k: rng.sample(common, 5) for k in range(12)} | {400 + k: [*common[:4], f"x{k}"] for k in range(8)}


def test_all_pairs_are_found(spark):
    docs = some_docs()
    d = spark.createDataFrame(list(docs.items()), "id long, tokens array<string>")
    for least in (0.5, 0.8):
        groups, pairs = V.jaccard_links(d, least)
        members = {}
        for r in groups.collect():
            members.setdefault(r.rep, []).append(r.id)
            assert set(docs[r.id]) == set(docs[r.rep])
        found = {p for g in members.values() for p in itertools.combinations(sorted(g), 2)}
        for r in pairs.collect():
            found |= {tuple(sorted(p)) for p in itertools.product(members[r.a], members[r.b])}
        assert found == {(a, b) for a, b in itertools.combinations(sorted(docs), 2) if close(set(docs[a]), set(docs[b]), least)}


def test_first_keeps_of_sets(spark):
    docs = some_docs()
    d = spark.createDataFrame(list(docs.items()), "id long, tokens array<string>")
    got = {r.node: (r.kept, r.by) for r in G.first_keeps_sets(*V.jaccard_links(d, 0.5)).collect()}
    assert got == plain_keeps(docs, 0.5)


def test_large_groups_of_equal_titles(spark, tmp_path):
    rows = [(k, "Breaking news from the harbour today\n" + f"text {k}", "en", "src1", 9) for k in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.node: (r.kept, r.by) for r in QUERIES["d09_first_keeps"](spark, str(tmp_path)).collect()}
    assert got == {k: (k == 0, None if k == 0 else 0) for k in range(9)}
