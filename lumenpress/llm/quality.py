"""Quality rules: word-rule base statistics, then robust multivariate outliers.

Per language and source, a minimum-covariance-determinant (MCD) estimate of location and scatter is
fitted to a vector of five transformed statistics, and documents beyond a chi-squared quantile of the
Mahalanobis distance are rejected. Everything is built from DataFrame functions.

How the MCD is found, on any number of rows: the statistics are quantised to integers, so that medians
and deviations are exact aggregations over few distinct values. Three deterministic starts (identity
scatter, spatial-sign scatter, tanh scatter; cf. the deterministic MCD of Hubert, Rousseeuw and Verdonck)
are improved by concentration steps side by side. A step is one aggregation: a histogram of distances per
group with the integer moments of each bin's rows; cumulative counts over the bins give the distance within which
h = 75 % of the group lie, and the moments of the bins up to there are added up. The rows themselves are read once
in a step and are never dealt by group: they meet only per-group rows (one per language and source), and what is
shuffled is sums per bin, of which a group has a bounded number. Sums are integers, so the result doesn't depend on
partitions or order.

Defined cases: null or empty text has no words and fails the base rule. Null languages and sources are
groups of their own. Groups with fewer than MIN_GROUP rows are judged by an estimate from all rows of their
language, in languages with fewer by one from all rows; if these are fewer there is no estimate and documents are kept. A statistic that most of a group share
exactly (no symbols, no repeats) gets a minimum scale, so a zero variance never rejects. Repeated rows each
get the same verdict.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, packed, private, saved, unpacked, words

P = 5
MIN_GROUP = 50
H = 0.75
STEPS = 4
UNIT = 256  # z scores are integers of 1/256
BINS = 32  # distance bins per octave
GROUP_FILES = 2  # of a table with one row per group
#: Quantisation (steps per natural-log unit) and minimum robust scale of the five statistics.
STEP = (64, 256, 64, 64, 64)
FLOOR = (0.25, 0.02, 0.6, 1.0, 1.2)
TAIL = 1e-6
SHRINK = 400  # words at which a document's own sampling noise equals the spread between documents


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_cdf(x: float, df: int) -> float:
    return gamma_p(df / 2, x / 2)


def chi2_quantile(p: float, df: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, df) < p else (lo, mid)
    return hi


#: Makes the scatter of the inner 75 % consistent for normal data.
CONSISTENCY = H / chi2_cdf(chi2_quantile(H, P), P + 2)
CUTOFF = chi2_quantile(1 - TAIL, P)


def _windows8(h: Column) -> Column:
    """Hashes of all 8-element windows of an array of hashes."""

    def widen(a: Column, by: int) -> Column:
        return F.zip_with(a, F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0))), lambda p, q: F.xxhash64(p, q))

    return let(h, lambda a: let(widen(a, 1), lambda b: let(widen(b, 2), lambda c: F.slice(widen(c, 4), 1, F.greatest(F.size(a) - 7, F.lit(0))))))


def _covered(win: Column) -> Column:
    """Of windows of 8 words given by hash in order: how many words lie in a window that occurs twice or more."""
    ordered = F.array_sort(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

    def starts(s: Column) -> Column:
        same = F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)))
        return F.array_sort(F.transform(same, lambda e: e["p"]))

    def total(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.coalesce(F.least(b - a, F.lit(8)), F.lit(8)))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    return let(let(ordered, starts), total)


def base_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    The columns replace any of these names that df has.
    """
    w, win = private(df, "__w", "__win")
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = df.withColumn(w, words(F.col(text)))
    d = d.withColumn(win, _windows8(F.transform(F.col(w), lambda x: F.xxhash64(x))))
    d = d.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": F.when(F.size(F.array_distinct(win)) < F.size(win), _covered(F.col(win))).otherwise(0).cast("long"),
        }
    ).drop(w, win)
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _key(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))


def _transformed() -> list[Column]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    raw = (
        F.log(n.cast("double")),
        F.log(chars / n),
        F.log1p(1000 * F.col("n_symbols") / chars),
        F.log1p(1000 * F.col("n_dup_lines") / n),
        F.log1p(1000 * F.col("n_repeat_words") / n),
    )
    return [F.round(x * s).cast("int") for x, s in zip(raw, STEP, strict=True)]


def _deviation(j: int) -> Column:
    """Of statistic j from its group's median; mean word length of a short text is noisier, which a factor takes out."""
    d = F.col(f"q{j}") - F.col(f"med{j}")
    return F.round(d * F.sqrt(F.col("n_words") / (F.col("n_words") + SHRINK)) * 4) / 4 if j == 1 else d


def _z(j: int) -> Column:
    z = F.round(UNIT * _deviation(j) / F.col(f"scale{j}")).cast("int")
    return F.least(F.greatest(z, F.lit(-64 * UNIT)), F.lit(64 * UNIT))


def _factor(moments: DataFrame, keys: list[str]) -> DataFrame:
    """From mu0.. and s00.. (upper part of the scatter): the Cholesky factor l00.. and logdet; no variance is under 1."""
    d = moments.withColumns({f"s{j}{j}": F.greatest(F.col(f"s{j}{j}"), F.lit(1.0)) * 1.05 for j in range(P)})
    for j in range(P):
        done = sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        d = d.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"s{j}{j}") - done, F.lit(1e-6))))
        below = {}
        for i in range(j + 1, P):
            dot = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            below[f"l{i}{j}"] = (F.col(f"s{j}{i}") - dot) / F.col(f"l{j}{j}")
        d = d.withColumns(below) if below else d
    d = d.withColumn("logdet", F.round(sum((F.log(F.col(f"l{j}{j}")) for j in range(P)), F.lit(0.0)), 9))
    return d.select(*keys, *(f"mu{j}" for j in range(P)), *(f"l{i}{j}" for i in range(P) for j in range(i + 1)), "logdet")


def _distance(d: DataFrame) -> DataFrame:
    """d, which has z0.. and a factor, with d2: the squared Mahalanobis distance."""
    for j in range(P):
        dot = sum((F.col(f"l{j}{k}") * F.col(f"y{k}") for k in range(j)), F.lit(0.0))
        d = d.withColumn(f"y{j}", (F.col(f"z{j}") / UNIT - F.col(f"mu{j}") - dot) / F.col(f"l{j}{j}"))
    return d.withColumn("d2", sum((F.col(f"y{j}") * F.col(f"y{j}") for j in range(P)), F.lit(0.0))).drop(*(f"y{j}" for j in range(P)))


def _first_scatters(z: DataFrame) -> DataFrame:
    """Three starts per group, all centred at the median: rows (g, start, mu.., s..)."""
    size2 = sum((F.col(f"z{j}").cast("long") * F.col(f"z{j}") for j in range(P)), F.lit(0).cast("long"))
    d = z.withColumn("norm", F.sqrt(F.greatest(size2, F.lit(1)).cast("double")))
    sign = [F.round(UNIT * F.col(f"z{j}") / F.col("norm")).cast("long") for j in range(P)]
    squash = [F.round(UNIT * F.tanh(F.col(f"z{j}") / (3.0 * UNIT))).cast("long") for j in range(P)]
    pairs = [(i, j) for i in range(P) for j in range(i, P)]
    agg = [F.count(F.lit(1)).alias("n")]
    for name, v in (("a", sign), ("b", squash)):
        agg += [F.sum(v[i] * v[j]).alias(f"{name}{i}{j}") for i, j in pairs]
    sums = d.groupBy("g").agg(*agg)
    zero = [F.lit(0.0).alias(f"mu{j}") for j in range(P)]
    scatters = [{(i, j): F.lit(float(i == j)) for i, j in pairs}]
    for name, scale in (("a", P), ("b", 9)):
        scatters.append({(i, j): scale * F.col(f"{name}{i}{j}") / (F.col("n") * UNIT * UNIT) for i, j in pairs})
    starts = [F.struct(F.lit(k).alias("start"), *zero, *(v.alias(f"s{i}{j}") for (i, j), v in s.items())) for k, s in enumerate(scatters)]
    return sums.select("g", F.explode(F.array(*starts)).alias("s")).select("g", "s.*")


def _concentrate(z: DataFrame, factor: DataFrame) -> DataFrame:
    """One concentration step of every group and start."""
    d = _distance(z.join(factor, "g"))
    d = d.withColumn("bin", F.floor(BINS * F.log2(F.col("d2") + 1 / 1024)).cast("int"))
    pairs = [(i, j) for i in range(P) for j in range(i, P)]
    moments = {f"m{j}": F.col(f"z{j}").cast("long") for j in range(P)} | {f"p{i}{j}": F.col(f"z{i}").cast("long") * F.col(f"z{j}") for i, j in pairs}
    bins = d.groupBy("g", "start", "bin").agg(F.count(F.lit(1)).alias("c"), *(F.sum(v).alias(k) for k, v in moments.items()))
    own = Window.partitionBy("g", "start")
    bins = bins.withColumns({"before": F.sum("c").over(own.orderBy("bin")) - F.col("c"), "all": F.sum("c").over(own)})
    inner = bins.filter(F.col("before") < F.ceil(H * F.col("all")))
    sums = inner.groupBy("g", "start").agg(F.sum("c").alias("n"), *(F.sum(k).alias(k) for k in moments))
    mean = {j: F.col(f"m{j}") / F.col("n") / UNIT for j in range(P)}
    cov = [(CONSISTENCY * (F.col(f"p{i}{j}") / F.col("n") / (UNIT * UNIT) - mean[i] * mean[j])).alias(f"s{i}{j}") for i, j in pairs]
    return sums.select("g", "start", *(mean[j].alias(f"mu{j}") for j in range(P)), *cov)


def _per_group(df: DataFrame, name: str) -> DataFrame:
    """Saved, in so few files that their size is that of the rows: Spark then sees that the table is small enough to broadcast."""
    return saved(df.repartition(GROUP_FILES), name)


def fit_mcd(rows: DataFrame, min_group: int = MIN_GROUP) -> tuple[DataFrame, DataFrame]:
    """Fit to rows with lk, sk (group keys), n_words and q0..q4.

    Gives the table (lk, sk, g) of the pool that serves each language and source, and per pool its medians,
    scales, centre and Cholesky factor. Both are written tables with one row per group.
    """
    n = rows.groupBy("lk", "sk").agg(F.count(F.lit(1)).alias("n"))
    n = n.join(n.groupBy("lk").agg((F.sum("n") >= min_group).alias("enough")), "lk")
    own = F.concat("lk", F.lit("\x01"), "sk")
    groups = n.select("lk", "sk", F.when(F.col("n") >= min_group, own).when(F.col("enough"), F.col("lk")).otherwise(F.lit("*")).alias("g"))
    groups = _per_group(groups, "mcd-groups")
    # a pool that serves any group is fitted to all rows of its language, or to all rows
    pools = groups.select("lk", "sk", F.explode(F.array(own, F.col("lk"), F.lit("*"))).alias("g")).join(groups.select("g").distinct(), "g", "left_semi")
    d = rows.join(_per_group(pools, "mcd-pools"), ["lk", "sk"])
    medians = [f"med{j}" for j in range(P)]
    med = _per_group(d.groupBy("g").agg(*(F.percentile(f"q{j}", 0.5).alias(m) for j, m in enumerate(medians))), "mcd-medians")
    spread = d.join(med, "g").groupBy("g", *medians).agg(F.count(F.lit(1)).alias("pool_n"), *(F.percentile(F.abs(_deviation(j)), 0.5).alias(f"mad{j}") for j in range(P)))
    scale = [F.greatest(1.4826 * F.col(f"mad{j}"), F.lit(FLOOR[j] * STEP[j])).alias(f"scale{j}") for j in range(P)]
    frame = _per_group(spread.filter(F.col("pool_n") >= min_group).select("g", *medians, *scale), "mcd-scales")
    z = saved(d.join(frame, "g").select("g", *(_z(j).alias(f"z{j}") for j in range(P))), "mcd-z")
    factor = _per_group(_factor(_first_scatters(z), ["g", "start"]), "mcd-start")
    for _ in range(STEPS - 1):
        factor = _per_group(_factor(_concentrate(z, factor), ["g", "start"]), "mcd-step")
    factor = _factor(_concentrate(z, factor), ["g", "start"])
    one = F.struct(*(c for c in factor.columns if c not in ("g", "start")))
    best = factor.groupBy("g").agg(F.min_by(one, F.struct("logdet", "start")).alias("best")).select("g", "best.*")
    return groups, _per_group(best.join(frame, "g"), "mcd-fit")


def robust_outliers(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None, min_group: int = MIN_GROUP) -> DataFrame:
    """The carried columns of df with the base statistics, base_failed, kept and d2 (null where no estimate was made).

    kept is false if base_failed, else whether the squared Mahalanobis distance in the document's language
    and source is within the chi-squared cutoff. One row per input row, repeated rows included.
    """
    carry = df.columns if carry is None else carry
    rows = df.select(packed(carry), F.col(text).alias("text"), _key(lang).alias("lk"), _key(source).alias("sk"))
    stats = base_statistics(rows).drop("text")
    stats = saved(stats.withColumns({f"q{j}": q for j, q in enumerate(_transformed())}), "quality")
    groups, fit = fit_mcd(stats.filter(~F.col("base_failed")).select("lk", "sk", "n_words", *(f"q{j}" for j in range(P))), min_group)
    d = stats.join(groups, ["lk", "sk"], "left").join(fit, "g", "left")
    d = _distance(d.withColumns({f"z{j}": _z(j) for j in range(P)}))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return d.withColumn("kept", kept).select(*unpacked(carry, *names, "kept", "d2"))
