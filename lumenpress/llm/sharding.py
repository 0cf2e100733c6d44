"""Sharding by longest-processing-time scheduling: groups that stay together go to the least-loaded shard.

Groups are equal texts. Groups above a small share of the total are scheduled one by one (there are at most
``shards * PER_SHARD`` of them, whatever the input); all smaller ones are first thrown into a fixed number of
lots by the hash of their text, and a lot is scheduled like a group. So the heap sees a bounded number of
units, largest first, and shards differ by about one lot at most, unless one group alone is larger than that.

Slots count rows within a shard without sorting a shard in one task: rows fall into many small buckets, each
bucket is numbered by itself, and the buckets' counts give the offsets.

Defined cases: null text has size 1 like empty text and stays with it; null and repeated doc_ids are rows
like others; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, saved, unpacked

PER_SHARD = 500
LOTS_PER_SHARD = 512
BUCKET_ROWS = 20_000


def lpt(sizes: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Units, largest first and by name where equal, each to the shard with the least load so far."""
    loads = [(0, s) for s in range(shards)]
    out = {}
    for size, name in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(loads)
        out[name] = s
        heapq.heappush(loads, (load + size, s))
    return out


def shard(df: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """The carried columns with size, text_crc32, shard and slot; one row per input row."""
    spark = df.sparkSession
    carry = df.columns if carry is None else carry
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = df.select(packed(carry), F.col(key).alias("key"), raw.alias("raw"))
    rows = rows.select("row", "key", (F.octet_length("raw") + 1).cast("long").alias("size"), F.crc32("raw").alias("text_crc32"), F.sha2("raw", 256).alias("digest"))
    rows = saved(rows, "shard")
    lots = LOTS_PER_SHARD * shards
    groups = saved(rows.groupBy("digest").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "shard-groups")
    total, n = groups.agg(F.sum("size"), F.sum("n")).first()
    large = F.col("size") > F.lit((total or 0) / (PER_SHARD * shards))
    lot = F.concat(F.lit("lot-"), F.pmod(F.xxhash64("digest"), F.lit(lots)).cast("string"))
    units = groups.groupBy(F.when(large, F.col("digest")).otherwise(lot).alias("unit")).agg(F.sum("size").alias("size"))
    # at most PER_SHARD * shards large groups and LOTS_PER_SHARD * shards lots
    to = lpt([(x["size"], x["unit"]) for x in units.collect()], shards)
    place = [to.get(f"lot-{k}", 0) for k in range(lots)]
    single = spark.createDataFrame([(k, s) for k, s in to.items() if not k.startswith("lot-")], "d string, s int")
    d = rows.join(F.broadcast(single), rows.digest == single.d, "left")
    by_lot = F.element_at(F.lit(place), (F.pmod(F.xxhash64("digest"), F.lit(lots)) + 1).cast("int"))
    d = d.withColumn("shard", F.coalesce("s", by_lot).cast("int"))
    return numbered(d, int(n or 0)).select(*unpacked(carry, "size", "text_crc32", "shard", "slot"))


def numbered(d: DataFrame, n: int) -> DataFrame:
    """d, which has key, digest and shard, with slot: 0, 1, ... in each shard."""
    buckets = max(1, -(-n // BUCKET_ROWS))
    d = d.withColumn("bucket", F.pmod(F.xxhash64("key", "digest"), F.lit(buckets)))
    counts = d.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("c")
    counts = counts.select(F.col("shard").alias("cs"), F.col("bucket").alias("cb"), before.alias("before"))
    d = d.withColumn("at", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "digest")))
    d = d.join(counts, (F.col("shard") == F.col("cs")) & (F.col("bucket") == F.col("cb")))
    return d.withColumn("slot", (F.col("before") + F.col("at") - 1).cast("long"))
