"""Batch deduplication against a plain version that compares all pairs."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lumenpress.functions import text as X
from lumenpress.operators import dedupe as D
from lumenpress.operators import search as V

KEPT = "0-9a-zA-ZçğıöşüÇĞİÖŞÜâîûÂÎÛ"


def normal(x):
    x = re.sub("<[^>]*>", " ", x or "").replace("İ", "i").replace("I", "ı").lower()
    return re.sub(f"[^{KEPT}]+", " ", x).strip(" ")


def tokens(x):
    return [w for w in normal(x).split(" ") if len(w) > 1 or re.fullmatch("[0-9]+", w)]


def cosines(docs):
    n, df = len(docs), collections.Counter(w for d in docs.values() for w in set(d))
    out = {}
    for k, d in docs.items():
        v = {w: (1 + math.log(c)) * (math.log((n + 1) / (df[w] + 1)) + 1) for w, c in collections.Counter(d).items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        out[k] = {w: x / size for w, x in v.items()}
    return lambda a, b: sum(x * out[b].get(w, 0) for w, x in out[a].items())


def dice(a, b):
    if not a or not b:
        return 0.0
    x, y = (collections.Counter(t[i : i + 2] for i in range(max(1, len(t) - 1))) for t in (a, b))
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))


def plain_scores(rows):
    """(a, b) -> (score, veto) of all pairs of rows (id, title, summary, content)."""
    whole = {k: f"{t} {s} {c}" for k, t, s, c in rows}
    every = cosines({k: tokens(f"{t} {t} {s} {c}") for k, t, s, c in rows})
    title = cosines({k: tokens(t) for k, t, s, c in rows})
    content = cosines({k: tokens(c or s) for k, t, s, c in rows})
    by = {r[0]: r for r in rows}
    out = {}
    for a in by:
        for b in by:
            if a >= b:
                continue
            x, y = set(tokens(whole[a])), set(tokens(whole[b]))
            lexical = 0.0
            if x and y:
                shared, seq = len(x & y), dice(normal(whole[a]), normal(whole[b]))
                cover, jac = shared / min(len(x), len(y)), shared / len(x | y)
                p, q = set(tokens(by[a][1])), set(tokens(by[b][1]))
                titles = len(p & q) / max(1, min(len(p), len(q)))
                more = max(0, seq - 0.45) * 0.08
                if cover >= 0.84:
                    lexical = min(0.97, 0.86 + (cover - 0.84) * 0.45 + more)
                elif cover >= 0.68 and titles >= 0.45:
                    lexical = min(0.93, 0.85 + (cover - 0.68) * 0.3 + more)
                else:
                    lexical = 0.52 * cover + 0.28 * seq + 0.2 * jac
            score = max(every(a, b), 0.28 * title(a, b) + 0.72 * content(a, b), lexical)
            veto = normal(by[a][1]) == normal(by[b][1]) and min(len(tokens(by[k][3] or by[k][2])) for k in (a, b)) >= 8 and content(a, b) < 0.55
            out[a, b] = (min(score, 0.84) if veto else min(score, 1.0), veto)
    return out


def some_articles():
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    rows, k = [], 0
    for _ in range(12):
        title, body = text(6), text(60).split()
        for j in range(rng.randint(1, 5)):
            own = list(body)
            for _ in range(j):
                own[rng.randrange(60)] = rng.choice(words)
            rows.append((k, title, " ".join(own[:10]), " ".join(own)))
            k += 1
    rows += [(100, "daily briefing of today", "", text(40)), (101, "Daily briefing of today", "", text(40)), (102, "daily briefing of today", "", "")]
    rows += [(103, "", "", ""), (104, "", "", "")]
    return rows


def test_scores_of_all_pairs(spark):
    rows = some_articles()
    want = plain_scores(rows)
    a = spark.createDataFrame(rows, "id long, title string, summary string, content string")
    pairs = spark.createDataFrame(sorted(want), "a long, b long")
    got = {(r.a, r.b): (r.score, r.veto) for r in D.similarities(a, pairs).collect()}
    assert set(got) == set(want) and got[100, 101][1]
    assert all(abs(got[k][0] - want[k][0]) < 1e-3 and got[k][1] == want[k][1] for k in want)


@pytest.mark.parametrize("banded", [False, True])
def test_clusters_equal_all_pairs(spark, monkeypatch, banded):
    """A small batch against all its pairs; as a large one, against all pairs that share a band, in blocks of a few."""
    rows = some_articles()
    want = plain_scores(rows)
    if banded:
        monkeypatch.setattr(D, "PAIRWISE", 0)
        monkeypatch.setattr(D, "BLOCK", 3)
        monkeypatch.setattr(D, "ROUNDS", 1)
        d = spark.createDataFrame([(k, f"{t} {s} {c}") for k, t, s, c in rows], "id long, x string").select("id", X.word_shingles(X.dedupe_tokens(F.col("x"))).alias("s")).filter(F.size("s") > 0)
        bands = {r.id: set(r.b) for r in d.select("id", D.signature_bands(F.col("s")).alias("b")).collect()}
        met = {p for p in want if bands.get(p[0], set()) & bands.get(p[1], set())}
    else:
        met = set(want)
    comp = {r[0]: r[0] for r in rows}
    content = {}
    for k, _, _, c in rows:
        if normal(c):
            content.setdefault(hashlib.sha256(normal(c).encode()).hexdigest(), []).append(k)
    links = [(g[0], b) for g in content.values() for b in g[1:]] + [p for p, (s, _) in want.items() if s >= 0.85 and p in met]
    for a, b in links:
        x, y = comp[a], comp[b]
        comp = {k: min(x, y) if c in (x, y) else c for k, c in comp.items()}
    full = [(*r, f"https://h.org/{r[0]}", 50.0, "2024-01-01", f"s{r[0] % 3}") for r in rows]
    a = spark.createDataFrame(full, "id long, title string, summary string, content string, url string, trust double, published_at string, source string").withColumn("published_at", F.to_timestamp("published_at"))
    members, found = D.dedupe(a)
    assert {r.id: r.cluster for r in members.collect()} == comp
    out = {r.id: r for r in D.clusters(a, members, found).collect()}
    assert {k: r.main_id for k, r in out.items()} == comp  # equal trust and time: the least id
    assert all((r.status == "main") == (r.id == r.main_id) for r in out.values())
    for r in found.collect():
        assert abs(r.score - want[r.a, r.b][0]) < 1e-3
    empty = a.limit(0)
    assert D.dedupe(empty)[0].count() == 0


def test_sha1_signatures(spark):
    rows = some_articles()[:5]
    d = spark.createDataFrame([(k, c) for k, _, _, c in rows], "id long, text string")
    got = {r.id: r.s for r in d.select("id", V.minhash_sha1(X.word_shingles(X.dedupe_tokens(F.col("text")))).alias("s")).collect()}
    for k, _, _, c in rows:
        w = tokens(c)
        shingles = {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}
        assert got[k] == [min(int.from_bytes(hashlib.sha1(f"{seed}:{x}".encode()).digest()[:4], "big") for x in shingles) for seed in range(96)]


def test_banded_by_arrays_as_by_columns(spark, monkeypatch):
    """Bands by arrays are those of the column rule, for short and for long texts, and articles without words have none."""
    rows = [(k, tokens(c) * n) for n in (0, 1) for k, _, _, c in some_articles() for k in [k + 1000 * n]] + [(5000, [f"w{i}" for i in range(9000)]), (5001, ["one"])]
    d = spark.createDataFrame(rows, "id long, whole array<string>").repartition(3)
    want = d.filter(F.size("whole") > 0).select("id", D.signature_bands(X.word_shingles(F.col("whole"))).alias("bands"))
    got = {r.id: r.bands for r in D.banded(d).collect()}
    assert got == {r.id: r.bands for r in want.collect()} and 5000 in got and 103 not in got


def test_normal_form_of_any_letters(spark):
    texts = ["İIıi ÇĞİÖŞÜ çé,ñ😀a😀.b ÂÎÛ—ßİxK ſ", "é ñ , é", "<b>x</b>é<y", "", None]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.dedupe_normal(F.col("t")).alias("x")).collect()]
    assert got == [normal(t) for t in texts]
