"""Mixing sources to target weights by capped water-filling.

Every source may give at most ``cap`` epochs of its words. The total is shared by weight; what a capped
source cannot give is shared again among the others by weight, until no target is above its cap. As the
common level (target per unit of weight) only rises, a round needs two sums over the source table.

Each document is then taken a whole number of times that all documents of its source share, and some once
more: in the order of a seeded hash, until the words of the fraction are reached. The cut is found from a
histogram of hash prefixes per source, and only the rows of the bucket that holds the cut are sorted.

Defined cases: null text has size 0, like text without words; null is a source of its own, last in order;
an empty source has target 0; null or repeated doc_ids are told apart by their text, and exact repeats of a
row are ordered by position, so that the result as a bag of rows is the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, packed, saved, unpacked

BITS, PREFIX = 52, 12
SEED = 20240131


def water_level(sources: DataFrame, total: float) -> float | None:
    """The level L for which sum(least(cap, L * weight)) is total; None if every source is at its cap.

    sources has the columns cap and weight. A round brings two numbers to the driver.
    """
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("cap") < level * F.col("weight")
        x = sources.agg(F.sum(F.when(full, F.col("cap")).otherwise(0)).alias("fixed"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open")).first()
        if not x["open"]:
            return None
        new = (total - x["fixed"]) / x["open"]
        if level is not None and new <= level:
            return level
        level = new


def weigh(sources: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """sources with weight: the cycle dealt by code point order, null last. One row per source comes in."""
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    return sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(x)) for x in cycle)), ((rank - 1) % len(cycle) + 1).cast("int")))


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", carry: list[str] | None = None, cycle: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = SEED) -> DataFrame:
    """The carried columns of df with size, source_size, target, copies and taken; one row per input row."""
    carry = df.columns if carry is None else carry
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), F.col(text)), 64 - BITS)
    rows = df.select(packed(carry), F.col(source).alias("source"), size.alias("size"), draw.alias("draw"), F.monotonically_increasing_id().alias("at"))
    rows = saved(rows, "mix")
    plan = mix_plan(rows.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, share, cap)
    prefix = F.shiftright("draw", BITS - PREFIX)
    own = Window.partitionBy("source").orderBy("prefix")
    hist = rows.groupBy("source", prefix.alias("prefix")).agg(F.sum("size").alias("words")).withColumn("before", F.sum("words").over(own) - F.col("words"))
    hist = hist.withColumnRenamed("source", "s")
    at_cut = hist.join(plan.select(F.col("source").alias("p"), "need"), F.col("s").eqNullSafe(F.col("p")))
    at_cut = at_cut.filter((F.col("before") < F.col("need")) & (F.col("before") + F.col("words") >= F.col("need"))).groupBy("s").agg(F.min(F.struct("prefix", "before")).alias("cut"))
    cuts = saved(plan.join(at_cut, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("of"), "source_size", "target", "whole", "need", F.col("cut.prefix").alias("cut"), F.col("cut.before").alias("before")), "mix-cuts")
    d = rows.withColumn("prefix", prefix).join(cuts, F.col("source").eqNullSafe(F.col("of")))
    inside = F.coalesce(F.col("prefix") == F.col("cut"), F.lit(False))
    # no cut: nothing more is needed, or all that there is
    more = F.when(F.col("cut").isNull(), F.col("need") > 0).otherwise(F.col("prefix") < F.col("cut"))
    outer = d.filter(~inside).withColumn("more", more)
    run = Window.partitionBy("source").orderBy("draw", "at").rowsBetween(Window.unboundedPreceding, -1)
    inner = d.filter(inside).withColumn("more", F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0)) + F.col("size") / 2 <= F.col("need"))
    copies = (F.col("whole") + F.col("more").cast("long")).cast("long")
    out = outer.unionByName(inner).withColumn("copies", copies)
    return out.withColumn("taken", F.col("size") * F.col("copies")).select(*unpacked(carry, "size", "source_size", "target", "copies", "taken"))


def mix_plan(sources: DataFrame, cycle: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Per source: weight, target, whole repetitions and the words needed beyond them."""
    sources = saved(weigh(sources, cycle).withColumn("cap", cap * F.col("source_size")), "mix-sources")
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = water_level(sources, total)
    target: Column = F.col("cap") if level is None else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    d = sources.withColumn("target", target.cast("double"))
    d = d.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    return d.withColumn("need", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
