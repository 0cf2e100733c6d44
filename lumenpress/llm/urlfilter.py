"""URL filters by a Bloom filter cascade, built and asked with DataFrame functions only.

Level 1 encodes the listed keys; level 2 the keys of the corpus that level 1 wrongly contains; level 3 the
listed keys that level 2 wrongly contains; and so on until a level makes no mistake. A key of the corpus is
listed exactly if the first level that doesn't contain it is an even one. The answer is exact because the
levels cover the complete key universe of the corpus, and it needs no join: a level is a constant array of
words in the plan.

Keys of a url are all pairs of a host suffix and a path prefix that a rule could have. Sizes: a level has
BITS bits per key, and only the first level grows with the list. A list over MAX_KEYS is split by key hash
into parts with a cascade each, so that no array passes 6 MB.

Defined cases: a null url, or one without ``://``, has an empty host and path, and no rule fits it. Repeated
rows get equal verdicts; an empty table or an empty list is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

BITS, HASHES = (12, 5), (8, 3)  # of the first level and of the others: 0.3 % and 9 % false positives
MAX_KEYS = 4_000_000
MAX_LEVELS = 40


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    h = F.xxhash64(F.lit(level), key)
    low, high = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 33).bitwiseOR(F.lit(1))
    return [(low + k * high) % F.lit(bits) for k in range(HASHES[level > 0])]


@dataclass
class Level:
    number: int
    bits: int
    words: Column  # array<bigint>, a constant

    def contains(self, key: Column) -> Column:
        out = F.lit(True)
        for p in _positions(key, self.number, self.bits):
            word = F.get(self.words, F.shiftright(p, 6).cast("int"))
            out = out & (F.getbit(word, (p % 64).cast("int")) == 1)
        return out


@dataclass
class Cascade:
    """Levels per part of the key space; a list of up to MAX_KEYS has one part."""

    parts: list[list[Level]] = field(default_factory=list)

    @staticmethod
    def build(listed: DataFrame, universe: DataFrame) -> Cascade:
        """listed and universe: DataFrames of one column ``key``. universe may repeat keys."""
        listed = saved(listed.filter("key is not null").distinct(), "cascade-list")
        n = -(-listed.count() // MAX_KEYS)
        return Cascade([_levels(listed.filter(_part(n) == k), universe.filter(_part(n) == k)) for k in range(n)])

    def member(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(False)
        for k, levels in enumerate(self.parts):
            own = F.lit(False)
            for level in reversed(levels):
                own = level.contains(key) & ~own
            out = out | (own if len(self.parts) == 1 else (_part(len(self.parts), key) == k) & own)
        return out


def _part(n: int, key: Column | None = None) -> Column:
    return F.lit(0) if n < 2 else F.pmod(F.xxhash64(F.lit(-1), F.col("key") if key is None else key), F.lit(n))


def _levels(listed: DataFrame, universe: DataFrame) -> list[Level]:
    inside, outside, levels = listed, universe, []
    while (n := inside.count()) > 0:
        if len(levels) >= MAX_LEVELS:
            raise ValueError(f"{n} keys are left after {MAX_LEVELS} levels")
        level = _encode(inside, n, len(levels))
        wrong = outside.filter(level.contains(F.col("key"))).select("key").distinct()
        if not levels:
            wrong = wrong.join(listed, "key", "left_anti")
        levels.append(level)
        inside, outside = saved(wrong, "cascade-keys"), inside
    return levels


def _encode(keys: DataFrame, n: int, number: int) -> Level:
    """A level over n keys; its words, of a size that MAX_KEYS bounds, go through the driver into a constant."""
    bits = -(-max(64, n * BITS[number > 0]) // 64) * 64
    p = keys.select(F.explode(F.array(*_positions(F.col("key"), number, bits))).alias("p"))
    words = p.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
    dense = ["0"] * (bits // 64)
    for x in words.toLocalIterator():
        dense[x["w"]] = str(x["v"])
    return Level(number, bits, F.split(F.lit(",".join(dense)), ",").cast("array<bigint>"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys a rule fitting this url can have: array of (length, host_length, key).

    A rule's host is the url's host or what follows one of its dots; its path is a prefix of the url's, of one
    of the lengths that the rules' paths have.
    """
    parts = F.split(host, r"\.")
    n = F.size(parts)
    hosts = F.filter(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), ".")), lambda h: h != "")
    fits = F.filter(F.array(*(F.lit(x) for x in lengths)), lambda k: k <= F.length(path))
    keys = F.transform(hosts, lambda h: F.transform(fits, lambda k: F.struct((F.length(h) + k).alias("length"), F.length(h).alias("host_length"), F.concat(h, F.substr(path, F.lit(1), k)).alias("key"))))
    return F.flatten(keys)


def filter_urls(df: DataFrame, rules: DataFrame, listed_hosts: DataFrame | None = None, url: str = "url") -> DataFrame:
    """df with host, path, rule and verdict.

    rules: verdict (allow or block), host, path; the longest fitting one decides. Where none fits, a url is
    blocked if its host or a parent of it is in listed_hosts (column host), else allowed.
    """
    spark = df.sparkSession
    host, path = host_path(F.col(url))
    d = df.withColumns({"host": host, "path": path})
    rules = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.length(F.coalesce("path", F.lit(""))).alias("k")).filter("host <> ''")
    lengths = sorted(x["k"] for x in rules.select("k").distinct().collect())  # path lengths: bounded by the longest path of a rule
    keys = candidate_keys(F.col("host"), F.col("path"), lengths) if lengths else None
    sets: dict[str, Cascade] = {}
    if lengths:
        universe = d.filter("host <> ''").select(F.explode(keys).alias("k")).select(F.col("k.key").alias("key"))
        for verdict in ("block", "allow"):
            sets[verdict] = Cascade.build(rules.filter(F.col("verdict") == verdict).select(F.concat("host", "path").alias("key")), universe)
    own = candidate_keys(F.col("host"), F.lit(""), [0])
    hosts = d.filter("host <> ''").select(F.explode(own).alias("k")).select(F.col("k.key").alias("key"))
    bad = Cascade.build(listed_hosts.select(F.translate("host", UPPER, LOWER).alias("key")) if listed_hosts is not None else spark.range(0).select(F.col("id").cast("string").alias("key")), hosts)
    none = F.lit(None).cast("struct<length:int,host_length:int,key:string,verdict:string>")
    best = none
    if lengths:

        def said(x: Column) -> Column:
            verdict = F.when(sets["allow"].member(x["key"]), "allow").when(sets["block"].member(x["key"]), "block")
            return F.struct(x["length"].cast("int").alias("length"), x["host_length"].cast("int").alias("host_length"), x["key"].alias("key"), verdict.alias("verdict"))

        best = F.array_max(F.filter(F.transform(keys, said), lambda x: x["verdict"].isNotNull()))
    name = "__best"
    while name in df.columns:
        name += "_"
    d = d.withColumn(name, best)
    by_list = F.when(F.exists(own, lambda x: bad.member(x["key"])), "block").otherwise("allow")
    return d.withColumns({"rule": F.col(name)["key"], "verdict": F.coalesce(F.col(name)["verdict"], by_list)}).drop(name)
