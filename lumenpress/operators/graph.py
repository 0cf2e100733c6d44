"""Connected components, and greedy choice in the order of ids, as rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import saved


def components(links: DataFrame) -> DataFrame:
    """Of undirected links (a, b): (node, comp), comp the least node that a node reaches.

    A round moves the least label along all links and then follows it to that label's own label, so the number
    of rounds grows with the logarithm of the longest path.
    """
    both = links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct()
    both = saved(both, "links")
    label = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        seen = both.join(label, both.b == label.node).groupBy("a").agg(F.min("comp").alias("least"))
        step = label.join(seen, label.node == seen.a).select("node", "comp", F.least("comp", "least").alias("lower"))
        up = label.select(F.col("node").alias("parent"), F.col("comp").alias("grand"))
        new = step.join(up, F.col("lower") == F.col("parent"), "left").select("node", F.col("comp").alias("old"), F.coalesce("grand", "lower").alias("comp"))
        new = saved(new, "labels")
        if not new.filter("comp <> old").limit(1).count():
            return new.select("node", "comp")
        label = new.select("node", "comp")


def first_keeps(links: DataFrame) -> DataFrame:
    """Of links (a, b) between nodes: (node, kept, by), going through nodes in order, a node is dropped if an earlier
    kept one is linked to it; by is the least such node.

    Each round decides every node whose earlier neighbours are all decided.
    """
    pairs = links.select(F.greatest("a", "b").alias("later"), F.least("a", "b").alias("earlier")).filter("later <> earlier").distinct()
    pairs = saved(pairs, "pairs")
    nodes = pairs.select(F.col("later").alias("node")).union(pairs.select("earlier")).distinct()
    state = saved(nodes.select("node", F.lit(None).cast("boolean").alias("kept"), F.lit(None).cast("bigint").alias("by")), "state")
    while state.filter("kept is null").limit(1).count():
        before = pairs.join(state.select(F.col("node").alias("earlier"), F.col("kept").alias("ek")), "earlier")
        seen = before.groupBy(F.col("later").alias("node")).agg(F.min(F.when(F.col("ek"), F.col("earlier"))).alias("first"), F.max(F.col("ek").isNull()).alias("waits"))
        d = state.join(seen, "node", "left")
        kept = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("first").isNotNull(), False).when(~F.coalesce("waits", F.lit(False)), True)
        by = F.when(F.col("kept").isNotNull(), F.col("by")).otherwise(F.col("first"))
        state = saved(d.select("node", kept.alias("kept"), by.alias("by")), "state")
    done = pairs.join(state.filter("kept").select(F.col("node").alias("earlier")), "earlier").groupBy(F.col("later").alias("node")).agg(F.min("earlier").alias("least"))
    return state.join(done, "node", "left").select("node", "kept", F.when(~F.col("kept"), F.col("least")).alias("by"))


def first_keeps_sets(groups: DataFrame, links: DataFrame) -> DataFrame:
    """first_keeps over all members of groups (id, rep, n), where links (a, b) hold between groups by their least member.

    Members of a group are linked to each other and to what their group is linked to, so only the least one can be kept.
    """
    first = first_keeps(links).withColumnsRenamed({"node": "rep", "kept": "__kept"})
    d = groups.join(first, "rep", "left").filter("n > 1 or __kept is not null").withColumn("__kept", F.coalesce("__kept", F.lit(True)))
    return d.select(F.col("id").alias("node"), (F.col("__kept") & (F.col("id") == F.col("rep"))).alias("kept"), F.when(F.col("__kept") & (F.col("id") != F.col("rep")), F.col("rep")).otherwise(F.col("by")).alias("by"))
