"""Candidates and groups that earlier versions left untested."""

from __future__ import annotations

import math
import random
import string
from pathlib import Path

import pytest

from lumenpress import scratch
from lumenpress.llm import quality, secrets

DOCS = "doc_id long, text string, lang string, source string"


def drawn(rng: random.Random, n: int, chars: str = string.ascii_letters + string.digits) -> str:
    return "".join(rng.choice(chars) for _ in range(n))


def added(spark, texts: list[str]) -> list[set[str]]:
    """Of each text the strings that the battery adds."""
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {r.text[a["start"] : a["end"]] for a in r.added} for r in secrets.find_secrets(d).collect()}
    return [got[k] for k in range(len(texts))]


def test_values_after_an_equals_sign(spark):
    rng = random.Random(11)
    names = ["AWS_SECRET_ACCESS_KEY", "sig", "auth", "AccountKey", "a=b"]
    values = [drawn(rng, 39) + "7" for _ in names]
    values[3] += "=="
    texts = [f"set {n}={v} here" for n, v in zip(names, values, strict=True)]
    assert added(spark, texts) == [{v} for v in values]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in secrets.redact(d).collect()} == {k: f"set {n}=[secret] here" for k, n in enumerate(names)}


def test_random_letters_and_long_words(spark):
    rng = random.Random(12)
    keys = [drawn(rng, n, string.ascii_letters) for n in (20, 24, 28) for _ in range(40)]
    names = ["_".join(drawn(rng, rng.randint(3, 8), string.ascii_lowercase) for _ in range(5)) for _ in range(100)] + ["-" * 40, "internationalisierungsfragen", "x" * 50]
    got = added(spark, [f"see {t} end" for t in keys + names])
    assert sum(map(bool, got[: len(keys)])) >= 0.9 * len(keys)
    assert not any(got[len(keys) :])


def test_runs_of_over_a_million_characters(spark):
    token = drawn(random.Random(13), 1_100_000)
    r = secrets.battery(spark.createDataFrame([(token,)], "token string")).first()
    assert r["length"] == len(token) and min(r.p_runs, r.p_serial) > 0.001


def test_small_groups_are_judged_by_their_language_then_by_all(spark):
    rng = random.Random(14)
    prose = lambda n: " ".join(drawn(rng, rng.randint(2, 8), string.ascii_lowercase) for _ in range(n))
    junk = lambda: " ".join(w + "#$%" for w in prose(200).split())
    rows = [(k, prose(rng.randint(20, 400)), "en", "large") for k in range(200)]
    rows += [(1000 + k, prose(rng.randint(20, 400)), "en", "small") for k in range(20)] + [(1100, junk(), "en", "small")]
    rows += [(2000 + k, prose(rng.randint(20, 400)), "de", "rare") for k in range(5)] + [(2100, junk(), "de", "rare")]
    d = quality.robust_outliers(spark.createDataFrame(rows, DOCS)).collect()
    assert len(d) == len(rows) and all(r.d2 is not None for r in d)
    kept = {r.doc_id: r.kept for r in d}
    assert not kept[1100] and not kept[2100] and sum(not v for v in kept.values()) <= 4


def test_runs_of_token_characters(spark):
    """Dotted tokens and quoted ones with other symbols are judged whole."""
    rng = random.Random(16)
    b64 = string.ascii_letters + string.digits + "-_"
    dotted = [".".join((drawn(rng, 24, b64), drawn(rng, 6, b64), drawn(rng, 27, b64))) for _ in range(30)]
    printable = "".join(chr(c) for c in range(33, 127) if chr(c) not in "\"'`")
    quoted = [drawn(rng, 40, printable) for _ in range(30)]
    got = added(spark, [f"see {t} end" for t in dotted] + [f'x="{t}", y' for t in quoted])
    assert sum(t in g for t, g in zip(dotted, got, strict=False)) >= 27
    assert sum(bool(g) for g in got[30:]) >= 27


def test_precision_on_ordinary_identifiers(spark):
    rng = random.Random(17)
    words = ["user", "profile", "image", "version", "update", "module", "number", "final", "draft", "backup", "config", "handler", "parser", "account", "message", "session", "request", "index"]
    pick = lambda n: [rng.choice(words) for _ in range(n)]
    plain = []
    for _ in range(300):
        plain += ["_".join(pick(5)), "".join(w.title() for w in pick(5)), "/" + "/".join(pick(4)) + f"/{rng.randint(1, 31):02d}", "-".join(pick(4)) + f".v{rng.randint(1, 9)}.tar.gz", "_".join(pick(4)).upper(), f"www.{'-'.join(pick(3))}.example.org", f"IMG_2024{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}_{rng.randint(0, 235959):06d}_{rng.choice(words)}", "".join(pick(4))]
    keys = [drawn(rng, n) for n in (20, 24, 32, 40) for _ in range(50)]
    got = added(spark, [f"see {t} end" for t in plain + keys])
    wrong, right = sum(map(bool, got[: len(plain)])), sum(map(bool, got[len(plain) :]))
    assert right >= 0.9 * len(keys) and wrong <= 0.05 * (wrong + right)
    # the same words alone, without any random string around them
    assert sum(map(bool, added(spark, [f"see {t} end" for t in plain]))) <= 0.005 * len(plain)


def test_p_values_equal_plain_ones(spark):
    rng = random.Random(18)
    alphabets = {"digits": string.digits, "hex": "0123456789abcdef", "base32": string.ascii_uppercase + "234567", "letters": string.ascii_letters, "alnum": string.digits + string.ascii_lowercase + string.ascii_uppercase, "base64": string.digits + string.ascii_lowercase + string.ascii_uppercase + "+/"}
    classes = {"hex": [10, 6], "base32": [26, 6], "letters": [26, 26], "alnum": [10, 26, 26], "base64": [10, 26, 26, 2]}
    tokens = [drawn(rng, n, a) + a[0] + a[-1] for a in alphabets.values() for n in (30, 60, 200) for _ in range(5)]
    tokens += ["user_profile_image_version_7", "aaaaaaaaaaaaaaaaaaaaaaaa1Z+"]
    chi = lambda x, df: 1 - quality.chi2_cdf(x, df)
    tail = lambda z: math.erfc(abs(z) / 2**0.5)
    rows = secrets.battery(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        a = alphabets[r.encoding]
        ranks = [a.index(c.replace("-", "+").replace("_", "/")) for c in r.token]
        n, k = len(ranks), len(a)
        assert r.length == n
        want = {"p_symbols": chi(sum(ranks.count(s) ** 2 for s in set(ranks)) * k / n - n, k - 1), "p_classes": 1.0}
        if r.encoding in classes:
            lo, total = 0, 0.0
            for width in classes[r.encoding]:
                total += (sum(lo <= x < lo + width for x in ranks) - n * width / k) ** 2 / (n * width / k)
                lo += width
            want["p_classes"] = chi(total, len(classes[r.encoding]) - 1)
        high = [2 * x >= k for x in ranks]
        want["p_runs"] = tail((sum(x != y for x, y in zip(high, high[1:], strict=False)) - (n - 1) / 2) / ((n - 1) / 4) ** 0.5)
        mid, var = (k - 1) / 2, (k * k - 1) / 12
        want["p_serial"] = tail(sum((x - mid) * (y - mid) for x, y in zip(ranks, ranks[1:], strict=False)) / var / (n - 1) ** 0.5)
        for name, p in want.items():
            assert abs(r[name] - p) < (0.01 if name == "p_symbols" else 1e-6), (r.token, name)
        tests = 3 if r.encoding == "digits" else 4
        assert abs(r.p - (1 - (1 - min(r[x] for x in want)) ** tests)) < 1e-6


def test_bounds_equal_plain_ones(spark):
    rng = random.Random(19)
    rows = [("alnum", 4, rng.choice([-200, -40, -20, -9, -5, -3, -2, -1, 0])) for _ in range(300)] + [("hex", 5, b) for b in (-3, -1, 0)] + [("base64", 5, b) for b in [-12] * 40 + [-60] * 10]
    got = {(r.encoding, r.octave): r.edge for r in secrets.passed_over(spark.createDataFrame(rows, "encoding string, octave int, bin int")).collect()}
    for key in {r[:2] for r in rows}:
        bins = [r[2] for r in rows if r[:2] == key]
        m, upper = len(bins), sum(b >= -4 for b in bins)
        edge = lambda b, bins=bins: min(1.0, 2 ** ((b + 1) / 4)) if any(x <= b for x in bins) else 0.0
        places = [-241, *sorted(set(bins))]
        low = max(b for b in places if edge(b) <= 0.01 * sum(x <= b for x in bins) / m)
        fits = [b for b in places if b >= low and 0.95 * sum(x > b for x in bins) <= 2 * (upper + 1 + 2 * (upper + 1) ** 0.5) * (1 - edge(b))]
        assert got[key] == min(fits)


def test_many_matches_in_one_long_text(spark):
    rng = random.Random(20)
    pieces = [("password=" + drawn(rng, 16, string.ascii_letters) if k % 2 else "word") for k in range(30_000)]
    text = " ".join(pieces)
    d = spark.createDataFrame([(1, text), (1, text), (2, "é " + text)], "doc_id long, text string")
    out = secrets.redact(d).collect()
    clean = " ".join("[secret]" if k % 2 else "word" for k in range(30_000))
    assert sorted(r.text for r in out) == sorted([clean, clean, "é " + clean])
    assert secrets.redact(d.limit(0)).count() == 0


def test_a_concentration_step_reads_its_rows_once_and_equals_a_plain_one(spark):
    """Rows used to be joined back by group, so that a large group met in one task."""
    rng = random.Random(31)
    rows = [(g, *(round(rng.gauss(0, 200) * (1 + (g == "b"))) for _ in range(quality.P))) for g in "aab" * 200]
    z = spark.createDataFrame(rows, "g string, " + ", ".join(f"z{j} int" for j in range(quality.P)))
    factor = quality._factor(quality._first_scatters(z), ["g", "start"])
    z, factor = quality.saved(z, "z"), quality.saved(factor, "factor")
    step = quality._concentrate(z, factor)
    assert step._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2
    got = {(r.g, r.start): r for r in step.collect()}
    assert got.keys() == {(g, k) for g in "ab" for k in range(3)}
    for f in factor.collect():
        own, bins = [[x / quality.UNIT for x in r[1:]] for r in rows if r[0] == f.g], {}
        for x in own:
            y = []
            for j in range(quality.P):
                y.append((x[j] - f[f"mu{j}"] - sum(f[f"l{j}{k}"] * y[k] for k in range(j))) / f[f"l{j}{j}"])
            bins.setdefault(math.floor(quality.BINS * math.log2(sum(v * v for v in y) + 1 / 1024)), []).append(x)
        inner = []
        for b in sorted(bins):
            if len(inner) < math.ceil(quality.H * len(own)):
                inner += bins[b]
        for j in range(quality.P):
            mean = sum(x[j] for x in inner) / len(inner)
            assert got[f.g, f.start][f"mu{j}"] == pytest.approx(mean, abs=1e-9)
            assert got[f.g, f.start][f"s{j}{j}"] == pytest.approx(quality.CONSISTENCY * (sum(x[j] ** 2 for x in inner) / len(inner) - mean**2))


def test_tables_with_a_row_per_group_are_few_files(spark, monkeypatch):
    """They used to be a file for each task that had a group."""
    rng = random.Random(32)
    rows = [(60 * s + k, " ".join(drawn(rng, rng.randint(2, 8), string.ascii_lowercase) for _ in range(25)), "en", f"s{s}") for s in range(12) for k in range(60)]
    kept: dict[str, int] = {}

    def counted(df, name):
        out = scratch.saved(df, name)
        kept[name] = max(kept.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(quality, "saved", counted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert all(r.d2 is not None for r in quality.robust_outliers(spark.createDataFrame(rows, DOCS)).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(n <= 2 for name, n in kept.items() if name not in ("quality", "mcd-z")) and len(kept) >= 7


def test_saved_tables_are_data_files_only(spark):
    """A _SUCCESS file costs the driver processes on a local file system, for each saved table."""
    for rows in (5, 0):
        out = scratch.saved(spark.range(rows), "few")
        files = [f.name for f in Path(out.inputFiles()[0].removeprefix("file:")).parent.iterdir()]
        assert out.count() == rows and "_SUCCESS" not in files and any(f.startswith("part-") for f in files)
