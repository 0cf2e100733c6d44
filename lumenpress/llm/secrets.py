"""Secret scans: base patterns, and a battery of randomness tests with false-discovery control.

What the battery reports is what it can't tell from random: the hypothesis tested is "drawn at random", so a secret
is a string for which all tests fail to reject. Two bounds hold, per stratum of encoding and length: the
Benjamini-Hochberg bound limits the share of random strings among those passed over, and an estimate from the
upper half of the p values, which random strings fill evenly, limits the share of harmless strings among those
reported. Harmless strings that look random to every test (a code number, a digest) can't be told apart.

Base spans follow three fixed patterns. The battery adds further spans: maximal runs of token characters (dots
inside them set aside) and quoted runs of printable characters. A run's encoding is inferred from its alphabet
(digits, hex, base32, letters, letters and digits, base64, printable), and tests of randomness are made in it:

* chi-squared uniformity of the character classes and of the symbols, against the encoding's alphabet,
* the number of runs above and below the middle of the alphabet (Wald and Wolfowitz),
* the serial correlation of successive symbols' ranks.

Strings that are too short to tell (see LEAST) are no candidates. Bounds are found from a histogram of p values per
stratum, whose size doesn't depend on the corpus. Positions are found by running sums, so a text with very many
matches takes time in proportion to its length times a logarithm.

Defined cases: null text is empty and has no spans. Equal rows get equal spans. Added spans never overlap base
ones. Positions are code points; ends are exclusive. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, packed, saved, unpacked

# The base patterns, with the least number of characters of group 2 or of the match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

_C = "[A-Za-z0-9+/_-]"
#: Candidates of the battery: quoted runs of printable characters, and maximal runs of token characters with dots
#: inside and padding after them; an inner "=" parts runs. Each run is looked at once, from its start.
TOKEN = rf"(?<=[\"'`])[!#-&(-_a-~]{{20,}}+(?=[\"'`])|(?<![A-Za-z0-9+/_.-])(?=[A-Za-z0-9+/_.-]{{20}}){_C}++(?:\.{_C}++)*+(?:=++(?!{_C}))?"
#: Per encoding: alphabet size and the least length at which the tests can tell.
LEAST = {"digits": (10, 24), "hex": (16, 24), "base32": (32, 24), "letters": (52, 20), "alnum": (62, 20), "base64": (64, 20), "print": (94, 20)}
#: Bounds on the share of random strings among those passed over, and of harmless ones among those reported.
FDR, HARMLESS = 0.01, 0.05
#: A p value is counted in bins of a quarter octave down to 2 ** -60.
P_BINS, P_FLOOR = 4, 60

_MATCH = "struct<start:int,end:int,match:string>"


def running(a: Column, with_) -> Column:
    """Of an array: at each place the elements up to it, taken together by with_ (a sum or an extreme), by doubling."""
    steps = F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda d: d < F.size(a))
    return F.aggregate(steps, a, lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, with_(x, F.get(acc, i - d))).otherwise(x)))


def located(text: Column, pattern: str, keep=None) -> Column:
    """Matches of a pattern, leftmost first and not overlapping: array of (start, end, match); keep filters by match."""

    def place(m: Column) -> Column:
        # from the end of one match to that of the next
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(m)), m, lambda g, x: F.length(g) + F.length(x))
        ends = let(steps, lambda a: running(a, lambda x, y: x + y))
        return F.zip_with(ends, m, lambda e, x: F.struct((e - F.length(x)).alias("start"), e.alias("end"), x.alias("match")))

    none = F.array().cast(f"array<{_MATCH}>")
    found = F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)).otherwise(none)
    return F.filter(found, lambda x: keep(x["match"])) if keep else found


def _spans(kind: str, order: int, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def base_spans(text: Column) -> Column:
    """Spans of the base patterns, by start and then kind as listed: array of (start, order, end, kind)."""
    assign = located(text, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_ASSIGN)
    access = located(text, r"AKIA[A-Z0-9]{14,}")
    hexes = located(text, r"[0-9a-f]{16,}")
    return F.array_sort(F.concat(_spans("assign", 0, assign), _spans("access", 1, access), _spans("hex", 2, hexes)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def candidates(text: Column, base: Column) -> Column:
    """Token runs that no base span touches: those that end before the next span begins, and begin after all earlier ones."""
    last = 2**31 - 1

    def free(u: Column) -> Column:  # tokens and spans by start
        ends = let(F.transform(u, lambda x: F.when(x["span"], x["end"]).otherwise(0)), lambda a: running(a, F.greatest))
        starts = F.reverse(let(F.reverse(F.transform(u, lambda x: F.when(x["span"], x["start"]).otherwise(last))), lambda a: running(a, F.least)))
        both = F.zip_with(u, F.arrays_zip(ends.alias("before"), starts.alias("after")), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        left = F.filter(both, lambda e: ~e["x"]["span"] & (e["y"]["before"] <= e["x"]["start"]) & (e["y"]["after"] >= e["x"]["end"]))
        return F.transform(left, lambda e: F.struct(e["x"]["start"].alias("start"), e["x"]["end"].alias("end"), e["x"]["match"].alias("match")))

    as_one = lambda x, span, match: F.struct(x["start"].alias("start"), F.lit(span).alias("span"), x["end"].alias("end"), match.alias("match"))
    every = lambda found: F.array_sort(F.concat(F.transform(found, lambda x: as_one(x, False, x["match"])), F.transform(base, lambda x: as_one(x, True, F.lit("")))))
    return let(located(text, TOKEN), lambda found: F.when((F.size(found) == 0) | (F.size(base) == 0), found).otherwise(let(every(found), free)))


def encoding(body: Column) -> Column:
    """The smallest alphabet that holds the symbols of a token (padding and dots set aside)."""
    return (
        F.when(body.rlike(r"^[0-9]+$"), "digits")
        .when(body.rlike(r"^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(body.rlike(r"^[A-Z2-7]+$"), "base32")
        .when(body.rlike(r"^[A-Za-z]+$"), "letters")
        .when(body.rlike(r"^[A-Za-z0-9]+$"), "alnum")
        .when(body.rlike(r"^[A-Za-z0-9+/_-]+$"), "base64")
        .when(body.rlike(r"^[!-~]+$"), "print")
    )


def _rank(ch: Column) -> Column:
    """A character's place in its alphabet: digits, then a-z, A-Z and the two symbols."""
    c = F.ascii(ch)
    return F.when(c.between(48, 57), c - 48).when(c.between(97, 122), c - 87).when(c.between(65, 90), c - 29).when(ch.isin("+", "-"), 62).otherwise(63)


def _print_rank(ch: Column) -> Column:
    """The same for printable characters, whose other symbols follow from 62 on."""
    c = F.ascii(ch)
    symbol = F.when(c < 48, c - 33).when(c < 65, c - 43).when(c < 97, c - 69).otherwise(c - 95)
    return F.when(c.between(48, 57) | c.between(97, 122) | c.between(65, 90), _rank(ch)).otherwise(62 + symbol)


def _normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution; Zelen and Severo's approximation, error under 1e-7."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2 * F.exp(-x * x / 2) / 2.5066282746310002 * poly)


def _chi2_tail(x: Column, df: Column) -> Column:
    """Upper tail of the chi-squared distribution for many degrees of freedom, by Wilson and Hilferty's normal approximation."""
    v = 2 / (9 * df)
    z = (F.pow(x / df, F.lit(1 / 3)) - (1 - v)) / F.sqrt(v)
    return F.when(z > 0, _normal_tail(z) / 2).otherwise(1 - _normal_tail(z) / 2)


def _chi2_few(x: Column, df: int) -> Column:
    """The same for one to three degrees of freedom, exactly."""
    if df == 2:
        return F.exp(-x / 2)
    one = _normal_tail(F.sqrt(x))
    return one if df == 1 else F.least(F.lit(1.0), one + F.sqrt(2 * x / F.pi()) * F.exp(-x / 2))


def battery(tokens: DataFrame) -> DataFrame:
    """tokens (column token) with encoding, length and p: the combined p value of four tests of randomness.

    Combined by Sidak's rule, so that it is evenly spread for random strings. Rows without an encoding, or too
    short for it, are left out.
    """
    size = F.create_map(*(F.lit(x) for k, v in LEAST.items() for x in (k, v[0])))
    least = F.create_map(*(F.lit(x) for k, v in LEAST.items() for x in (k, v[1])))
    plain = F.rtrim(F.translate("token", ".", ""), F.lit("="))
    body = F.when(plain.rlike("^[A-Za-z0-9+/_-]*$"), plain).otherwise(F.col("token"))
    d = tokens.withColumn("body", body).withColumn("encoding", encoding(F.col("body"))).filter("encoding is not null")
    d = d.withColumn("r", F.filter(F.split("body", ""), lambda c: c != ""))
    d = d.withColumn("r", F.when(F.col("encoding") == "print", F.transform("r", _print_rank)).otherwise(F.transform("r", _rank)))
    # base32 has letters first and digits 2-7; upper-case hex counts like lower-case; letters alone start at 0
    shift = F.when(F.col("encoding") == "letters", F.transform("r", lambda x: x - 10)).when(F.col("encoding") == "base32", F.transform("r", lambda x: F.when(x < 10, x + 24).otherwise(x - 36))).when(F.col("encoding") == "hex", F.transform("r", lambda x: F.when(x >= 36, x - 26).otherwise(x))).otherwise(F.col("r"))
    d = d.withColumns({"r": shift, "k": size[F.col("encoding")].cast("double")}).withColumn("length", F.size("r"))
    d = d.filter(F.col("length") >= least[F.col("encoding")])
    n = F.col("length").cast("double")
    # symbols: sum of squared counts
    distinct = F.array_distinct("r")
    squares = F.aggregate(distinct, F.lit(0.0), lambda acc, s: acc + F.pow(F.size(F.filter("r", lambda x: x == s)).cast("double"), F.lit(2.0)))
    chi = squares * F.col("k") / n - n
    # classes: digits, lower case, upper case and symbols, as far as the alphabet has them
    count = lambda lo, hi: F.size(F.filter("r", lambda x: x.between(lo, hi))).cast("double")
    part = lambda seen, share: F.pow(seen - n * share, F.lit(2.0)) / (n * share)
    two = lambda share, seen: part(seen, share) + part(n - seen, 1 - share)
    mixed = part(count(0, 9), 10 / F.col("k")) + part(count(10, 35), 26 / F.col("k")) + part(count(36, 61), 26 / F.col("k"))
    class_p = (
        F.when(F.col("encoding") == "hex", _chi2_few(two(10 / F.col("k"), count(0, 9)), 1))
        .when(F.col("encoding") == "base32", _chi2_few(two(6 / F.col("k"), count(26, 31)), 1))
        .when(F.col("encoding") == "letters", _chi2_few(two(F.lit(0.5), count(0, 25)), 1))
        .when(F.col("encoding") == "digits", F.lit(1.0))
        .when(F.col("encoding") == "alnum", _chi2_few(mixed, 2))
        .otherwise(_chi2_few(mixed + part(count(62, 93), (F.col("k") - 62) / F.col("k")), 3))
    )
    # runs above and below the middle
    high = F.transform("r", lambda x: (x * 2 >= F.col("k")).cast("int"))
    changes = F.aggregate(F.zip_with(high, F.slice(high, 2, F.greatest(F.size(high) - 1, F.lit(0))), lambda a, b: F.coalesce((a != b).cast("int"), F.lit(0))), F.lit(0), lambda acc, x: acc + x)
    runs_z = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    # serial correlation of ranks, under uniform ranks: mean 0, variance 1 / n
    mid, var = (F.col("k") - 1) / 2, (F.pow(F.col("k"), F.lit(2.0)) - 1) / 12
    serial = F.aggregate(F.zip_with("r", F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), lambda a, b: F.coalesce((a - mid) * (b - mid), F.lit(0.0))), F.lit(0.0), lambda acc, x: acc + x)
    serial_z = serial / var / F.sqrt(n - 1)
    d = d.withColumns({"p_symbols": _chi2_tail(F.greatest(chi, F.lit(0.0)), F.col("k") - 1), "p_classes": class_p, "p_runs": _normal_tail(runs_z), "p_serial": _normal_tail(serial_z)})
    least_p = F.least("p_symbols", "p_classes", "p_runs", "p_serial")
    tests = F.when(F.col("encoding") == "digits", 3.0).otherwise(4.0)
    return d.withColumn("p", -F.expm1(tests * F.log1p(-F.least(least_p, F.lit(1 - 1e-12))))).drop("r", "k", "body")


def passed_over(tested: DataFrame) -> DataFrame:
    """Per stratum (encoding, octave of length) the largest p bin that isn't reported: (encoding, octave, edge).

    First the bins that Benjamini and Hochberg reject over all candidates of the stratum, with p values rounded up
    to their bin's edge. Then as many more as it takes until the reported ones number no more, but for the share
    HARMLESS, than random strings would be: those in the upper half of p values, and two standard deviations, twice.
    """
    counts = tested.groupBy("encoding", "octave", "bin").agg(F.count(F.lit(1)).alias("c"))
    # the bin below all others stands for passing over nothing
    strata = counts.select("encoding", "octave").distinct().select("encoding", "octave", F.lit(-P_BINS * P_FLOOR - 1).alias("bin"), F.lit(0).cast("long").alias("c"))
    own = Window.partitionBy("encoding", "octave")
    counts = counts.unionByName(strata)
    counts = counts.withColumns({"upto": F.sum("c").over(own.orderBy("bin")), "m": F.sum("c").over(own), "upper": F.sum(F.when(F.col("bin") >= -P_BINS, F.col("c")).otherwise(0)).over(own)})
    edge_p = F.when(F.col("upto") == 0, 0.0).otherwise(F.pow(F.lit(2.0), (F.col("bin") + 1) / P_BINS))
    counts = counts.withColumn("edge_p", F.least(F.lit(1.0), edge_p))
    rejected = F.max(F.when(F.col("edge_p") <= FDR * F.col("upto") / F.col("m"), F.col("bin"))).over(own)
    random = 2 * (F.col("upper") + 1 + 2 * F.sqrt(F.col("upper") + 1)) * (1 - F.col("edge_p"))
    enough = (F.col("bin") >= F.col("rejected")) & ((1 - HARMLESS) * (F.col("m") - F.col("upto")) <= random)
    return counts.withColumn("rejected", rejected).filter(enough).groupBy("encoding", "octave").agg(F.min("bin").alias("edge"))


def with_bins(tested: DataFrame) -> DataFrame:
    bin_ = F.floor(P_BINS * F.log2(F.greatest(F.col("p"), F.lit(2.0**-P_FLOOR)))).cast("int")
    return tested.withColumns({"octave": F.floor(F.log2(F.col("length").cast("double"))).cast("int"), "bin": bin_})


def find_secrets(df: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns of df with base (its spans, an array) and added (the battery's spans); one row per input row.

    Spans are structs (start, order, end, kind).
    """
    carry = df.columns if carry is None else carry
    t = F.coalesce(F.col(text), F.lit(""))
    d = df.select(packed(carry), t.alias("t"), F.monotonically_increasing_id().alias("at"))
    d = d.withColumn("base", base_spans(F.col("t")))
    d = saved(d.withColumn("free", candidates(F.col("t"), F.col("base"))).drop("t"), "secrets")
    tokens = d.filter(F.size("free") > 0).select("at", F.explode("free").alias("x")).select("at", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.match").alias("token"))
    tested = saved(with_bins(battery(tokens)).select("at", "start", "end", "encoding", "octave", "bin"), "secrets-tested")
    bounds = saved(passed_over(tested), "secrets-bounds")
    secret = tested.join(bounds, ["encoding", "octave"]).filter(F.col("bin") > F.col("edge"))
    span = F.struct("start", F.lit(3).alias("order"), "end", F.lit("random").alias("kind"))
    added = saved(secret.groupBy("at").agg(F.array_sort(F.collect_list(span)).alias("added")), "secrets-added")
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    # only rows with candidates can have spans added, so only they are joined
    some = d.filter(F.size("free") > 0).join(added, "at", "left").withColumn("added", F.coalesce("added", none))
    out = d.filter(F.size("free") == 0).withColumn("added", none).unionByName(some)
    return out.select(*unpacked(carry, "base", "added"))


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """df with every span of its text replaced by a mark; overlapping spans become one. Null stays null.

    One row per input row, repeated rows included; an empty table stays empty. Parts of plain ASCII texts are cut
    from their bytes, so a long text with very many spans takes time in proportion to its length.
    """
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("whole"), F.col(text).alias("text"))
    d = find_secrets(whole, carry=["whole"]).withColumn("text", F.col("whole")[text])
    ascii_ = F.length("text") == F.octet_length("text")
    cut = lambda lo, n: F.when(ascii_, F.substring(F.col("text").cast("binary"), lo + 1, n).cast("string")).otherwise(F.substring("text", lo + 1, n))

    def parts(spans: Column) -> Column:
        ends = let(F.transform(spans, lambda s: s["end"]), lambda a: running(a, F.greatest))

        def cleaned(upto: Column) -> Column:
            before = lambda i: F.coalesce(F.get(upto, i - 1), F.lit(0))
            part = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(cut(before(i), s["start"] - before(i)), F.lit(mark))).otherwise(""))
            return F.concat(F.array_join(part, ""), cut(F.element_at(upto, -1), F.length("text")))

        return let(ends, cleaned)

    spans = F.array_sort(F.concat("base", "added"))
    clean = F.when(F.size(spans) == 0, F.col("text")).otherwise(let(spans, parts))
    return d.withColumn("__clean", clean).select(*((F.col("__clean") if c == text else F.col("whole")[c]).alias(c) for c in df.columns))
