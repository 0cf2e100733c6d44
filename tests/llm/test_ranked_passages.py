"""Ranked search, hard negatives and repeated passages against plain versions, and on odd tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenpress.llm import negatives, passages, ranked

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that the operators use inside.
CLASH = "row string, at long, n long, terms string, rows long, block long, part int, rank long, score long, key string, no long, spans long, n_words string"
EXTRA = ("r", 1, 2, "t", 3, 4, 5, 6, 7, "k", 8, 9, "w")
DOCS = f"doc_id long, text string, {CLASH}"


def docs(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS)


def corpus(seed: int = 5) -> list[tuple]:
    """Ordinary documents, copies, repeated rows, shared passages, periodic and odd texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeGHé") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = prose(60)
    rows = [(k, " ".join(prose(rng.randint(1, 150)))) for k in range(1, 50)]
    for k in range(60, 75):  # a passage, whole or in part, at any place
        a = rng.randint(0, 35)
        rows.append((k, "\n".join([*prose(rng.randint(0, 40)), *shared[a : a + rng.randint(15, 60)], *prose(rng.randint(0, 40))])))
    rows += [(80 + k, rows[0][1]) for k in range(4)] + [(0, rows[3][1])]
    rows += [(90, "x " * 500), (91, "y x " * 300), (92, "x " * 19), (93, "x " * 20), (94, None), (95, ""), (96, " \t\n"), (None, rows[5][1]), (None, None), (97, "wörd\x00 🙂 a-B_c " * 30)]
    rows += [rows[7], rows[7], (8, " ".join(shared))]  # repeated rows, a repeated key
    rng.shuffle(rows)
    return rows


# --- ranked search


def plain_rank(rows, items, top=20):
    terms = lambda t: [x.translate(LOWER) for x in TERM.findall(t or "")]
    held = [(k, collections.Counter(terms(t))) for k, t in rows]
    sizes = [sum(c.values()) for _, c in held]
    total, words = sum(n > 0 for n in sizes), sum(sizes)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked, scored = collections.Counter(terms(text)), []
        for (k, c), n in zip(held, sizes, strict=True):
            m = 100 - 25 + (25 * n * total) // max(words, 1)
            s = sum(q * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if c[t])
            if s > 0:
                scored.append((-s, k is None, k or 0, k))
        out += [(item, r, k, -s) for r, (s, _, _, k) in enumerate(sorted(scored)[:top], 1)]
    return collections.Counter(out)


@pytest.mark.parametrize("block", [200_000, 20])
def test_ranked_search_equals_the_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(ranked, "BLOCK_TERMS", block)
    monkeypatch.setattr(ranked, "SLICE", 500)
    rows = corpus()
    rng = random.Random(9)
    texts = [r[1] for r in rows if r[1] and r[1].strip()]
    items = [(k, rng.choice(texts)[: rng.randint(1, 200)]) for k in range(12)]
    items += [(20, None), (21, ""), (22, "nowhere"), (23, "x X x y"), (None, "x a"), (3, items[3][1]), (24, items[0][1] + " nowhere")]
    asked = spark.createDataFrame([(*r, *EXTRA) for r in items], f"item_id long, text string, {CLASH}")
    got = ranked.rank(docs(spark, rows), asked, carry=["item_id", "at"])
    assert got.columns == ["item_id", "at", "rank", "key", "score"]
    assert collections.Counter((r.item_id, r["rank"], r.key, r.score) for r in got.collect()) == plain_rank(rows, items)


def test_ranked_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.rank(docs(spark, []), items).count() == 0
    assert ranked.rank(docs(spark, [(1, "a")]), items.limit(0)).count() == 0
    assert ranked.rank(docs(spark, [(1, None), (2, "")]), items).count() == 0


def test_accumulate_sums_runs_of_large_keys():
    rng = np.random.default_rng(3)
    start = np.array([0, 2, 3, 6])
    item, times = np.array([0, 70_000, 5, 0, 1, 2_000_000]), np.array([1, 2, 1, 3, 1, 1])
    doc, term, impact = rng.integers(0, 3000, 500), rng.integers(0, 3, 500), rng.integers(1, 10**9, 500)
    plain = collections.Counter()
    for d, t, x in zip(doc, term, impact, strict=True):
        for e in range(start[t], start[t + 1]):
            plain[int(item[e]), int(d)] += int(x) * int(times[e])
    got = ranked.accumulate(doc, term, impact, start, item, times)
    assert {(int(a), int(b)): int(s) for a, b, s in zip(*got, strict=True)} == plain


def test_terms_fold_only_ascii_letters():
    text = "Ünter-WEGS_x9\x00Éİ  z"
    assert [t.decode() for t in ranked.terms(text)] == [t.translate(LOWER) for t in TERM.findall(text)]
    assert ranked.terms(None) == []


# --- hard negatives


def plain_mine(rows, every=100, positives=5, negatives_=10):
    q = [(k, lab, [math.floor(256 * float(x)) for x in v]) for k, lab, v in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for i, (a, lab, v) in enumerate(q):
        if a is None or a % every:
            continue
        scored = [(k, dot(v, w), other == lab) for j, (k, other, w) in enumerate(q) if j != i]
        for p, s, _ in sorted((r for r in scored if r[2]), key=order)[:positives]:
            fits = sorted((r for r in scored if not r[2] and 30 * s <= 100 * r[1] <= 90 * s), key=order)[:negatives_]
            out += [(a, p, rank, k, s, x) for rank, (k, x, _) in enumerate(fits, 1)]
    return collections.Counter(out)


def vectors(seed: int, n: int = 600, width: int = 6) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, width))
    rows = [(k, int(rng.integers(0, 4)), [float(np.float32(x)) for x in centres[rng.integers(0, 8)] + 0.3 * rng.normal(size=width)]) for k in range(n)]
    hot = rows[0][2]
    rows += [(1000 + k, k % 3, hot) for k in range(200)]  # a vector of a quarter of all rows
    rows += [(2000, None, hot), (2100, 1, None), (2200, 1, [1.0, None] + hot[2:]), (2300, 1, [float("nan")] + hot[1:]), (2400, 2, [float("inf")] + hot[1:])]
    rows += [(None, 1, hot), (None, 2, rows[7][2]), (300, 1, rows[300][2]), rows[400], (2500, 1, []), (2600, 2, hot[:3]), (-100, 3, rows[9][2])]
    return rows


VECTORS = "vec_id long, label int, embedding array<float>"


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_equal_the_plain_version(spark, monkeypatch, small):
    if small:  # several blocks of anchors and queries, split lists, lists fitted on a sample
        for name, value in (("ANCHORS", 4), ("LIST_ROWS", 20), ("TOGETHER", 7), ("FIRST", 1)):
            monkeypatch.setattr(negatives, name, value)
        monkeypatch.setattr(negatives.Index.__init__, "__defaults__", (None, 100))
    rows = vectors(1)
    d = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], VECTORS + ", at long, v int, list string")
    got = negatives.mine(d)
    assert collections.Counter(tuple(r) for r in got.collect()) == plain_mine(rows)


def test_hard_negatives_of_large_components_and_empty_tables(spark):
    rows = [(0, 1, [3e5 + 1 / 256, 2e6]), (1, 1, [2e5, 1e6 + 1 / 256]), (2, 2, [1e5, 1e6]), (3, 2, [5.5e4, 7e5]), (4, 2, [0.1, -0.1])]
    assert collections.Counter(tuple(r) for r in negatives.mine(spark.createDataFrame(rows, VECTORS.replace("float", "double"))).collect()) == plain_mine(rows)
    assert negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, 1, [1.0])], VECTORS)).count() == 0  # no anchor
    assert negatives.mine(spark.createDataFrame([(100, 1, [1.0])], VECTORS)).count() == 0  # no positive


def test_lists_outside_bounds_are_skipped(spark, monkeypatch):
    """Well parted clusters: most lists are never scored."""
    rng = np.random.default_rng(2)
    centres = 20 * np.eye(16)
    rows = [(k, k % 2, [float(x) for x in centres[k % 16] + 0.01 * rng.normal(size=16)]) for k in range(800)]
    index = negatives.Index(negatives.quantised(spark.createDataFrame(rows, VECTORS), "embedding", "vec_id", F.col("label")), lists=40)
    packs = index.lists.collect()
    calls = []
    plain = negatives.products
    monkeypatch.setattr(negatives, "products", lambda a, v: calls.append(len(v)) or plain(a, v))
    import pyarrow as pa

    anchor = np.array([[math.floor(256 * x) for x in rows[0][2]]], float)
    big = np.iinfo(np.int64).max
    batch = pa.RecordBatch.from_pylist([r.asDict() | {c: bytes(r[c]) for c in ("ids", "labels", "ats", "vectors")} for r in packs])
    queries = ((anchor, np.array([0]), np.array([-1])), np.array([0]), np.array([-big]), np.array([big]), np.array([-big]))
    list(negatives._visit(index.width, index.centres, index.radii, (*queries[0], *queries[1:]), 5, True, None, iter([batch])))
    assert 0 < sum(calls) < 800 / 4


# --- repeated passages


def plain_repeats(rows, length=20):
    """By (key, digest of words): documents in the order of keys, nulls last."""
    held = [(k, WORD.findall(t or "")) for k, t in rows]
    seen, out = set(), []
    for k, words in sorted(held, key=lambda r: (r[0] is None, r[0] or 0)):
        gone = [False] * len(words)
        for p in range(len(words) - length + 1):
            w = tuple(words[p : p + length])
            if w in seen:
                gone[p : p + length] = [True] * length
            seen.add(w)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((k, len(words), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("small", [False, True])
def test_repeated_passages_equal_the_plain_version(spark, monkeypatch, small):
    # documents of one key and other words have no order by the contract
    rows = [r for r in corpus() if r[0] != 8 and (r[0] is not None or r[1] is None)]
    if small:
        for name, value in (("BLOCK_WORDS", 200), ("BLOCK_DOCS", 5), ("RANGE", 64)):
            monkeypatch.setattr(passages, name, value)
    got = passages.repeats(docs(spark, rows).repartition(5), carry=["doc_id", "text", "block", "n_words"])
    assert got.columns == ["doc_id", "text", "block", "n_words", "n_removed", "kept_sha256", "spans"]
    found = got.collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == plain_repeats(rows)
    for r in found:
        words = WORD.findall(r.text or "")
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        kept = [w for k, w in enumerate(words) if not any(s.start <= k < s.end for s in r.spans)]
        assert hashlib.sha256(" ".join(kept).encode()).hexdigest() == r.kept_sha256


@pytest.mark.parametrize("length", [5, 10, 40])
def test_other_lengths(spark, length):
    rows = [r for r in corpus(6) if r[0] is not None and r[0] != 8]
    got = passages.repeats(docs(spark, rows), carry=["doc_id"], length=length).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_repeats(rows, length)


def test_repeated_keys_and_null_keys_come_in_one_order(spark):
    same = " ".join(map(str, range(40)))
    rows = [(1, same), (1, same + " z"), (None, same), (None, "a"), (1, same)]
    got = passages.repeats(docs(spark, rows), carry=["doc_id", "text"]).collect()
    assert sum(r.n_removed for r in got) == 3 * 40 and sum(r.n_removed == 0 for r in got) == 2
    assert all(r.n_removed == 40 for r in got if r.doc_id is None and r.text != "a")


def test_passages_of_an_empty_table_and_a_wrong_length(spark):
    assert passages.repeats(docs(spark, []), carry=["doc_id"]).collect() == []
    with pytest.raises(ValueError, match="power of two"):
        passages.repeats(docs(spark, []), length=15)


def test_a_text_longer_than_a_block(spark):
    rng = random.Random(4)
    long = [str(rng.randint(0, 10**6)) for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[30_000:30_100])), (3, " ".join(long[::-1]))]
    got = {r.doc_id: r.n_removed for r in passages.repeats(docs(spark, rows), carry=["doc_id"]).collect()}
    assert got == {1: 0, 2: 100, 3: 0}
