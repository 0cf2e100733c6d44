"""Hard negatives by inverted lists of a k-means index with stored centroid radii.

Vectors are quantised to whole numbers, so that inner products are exact. K-means is fitted on a bounded sample; every
row goes to the list of its nearest centroid, and each list keeps the greatest distance r of a member to the centroid c.
By Cauchy-Schwarz a member's product with an anchor a lies within |a| r of <a, c>. An anchor first visits the lists
of the highest bounds, which gives a least kth score; then all lists whose bound isn't strictly below it and whose range
meets the window. So lists are skipped, but never a row that belongs to the result.

Anchors are a stated query set and come in bounded blocks, each broadcast to tasks that read the lists in place. Long
lists are split, so no task holds a cluster; what tasks return is at most k rows for each query.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; a shorter vector
counts as if filled with zeros; a null vec_id is never an anchor and is last among equal scores; repeated ids are rows
of their own, and all but the row itself count as other rows; an anchor with fewer positives or negatives gives those
it has; empty tables give an empty table. Products beyond 64 bits are held at the greatest or least long.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Rows on which centroids are fitted, at most about so many; lists, at most; rows of one stored list.
SAMPLE, LISTS, LIST_ROWS = 16_384, 1024, 4096
#: Anchors of one block, lists that each query visits first, queries whose scores are looked at together.
ANCHORS, FIRST, TOGETHER = 4096, 3, 512
SEED = 20240131
_NONE = np.iinfo(np.int64).max  # stands for a null id


def quantised(df: DataFrame, vector: str, vec_id: str, label: Column, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, v, at) of the rows that take part; v has floor(scale * x) of each component x."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    d = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"), F.monotonically_increasing_id().alias("at"))
    d = d.filter("label is not null and v is not null").filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # as doubles throughout: floor() itself gives a long, which can't hold all of them
    return d.withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) < 2.0**44, F.floor(x * scale).cast("double")).otherwise(x * scale)))


def _matrix(column, width: int) -> np.ndarray:
    """Lists of doubles as rows of a matrix, filled with zeros."""
    ends = column.offsets.to_numpy()
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(ends)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes]) if len(flat) else np.empty(0, int)] = flat
    return out


def products(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as longs."""
    if not a.size or not v.size:
        return np.zeros((len(a), len(v)), np.int64)
    if np.linalg.norm(a, axis=1).max() * np.linalg.norm(v, axis=1).max() < 2.0**52:
        return (a @ v.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return np.clip(whole(a) @ whole(v).T, np.iinfo(np.int64).min, np.iinfo(np.int64).max).astype(np.int64)


def _assign(centres: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row its nearest centroid and the distance to it, rounded up."""
    half = (centres**2).sum(1) / 2
    for b in batches:
        v = _matrix(b.column("v"), centres.shape[1])
        best = np.argmax(v @ centres.T - half, axis=1)
        far = np.linalg.norm(v - centres[best], axis=1) * (1 + 1e-9) + 1e-9
        yield pa.RecordBatch.from_arrays([pa.array(best, pa.int32()), pa.array(far), *(b.column(c) for c in ("vec_id", "label", "v", "at"))], ["list", "far", "vec_id", "label", "v", "at"])


def _pack(width: int, t: pa.Table) -> pa.Table:
    """One row of a list's part: ids, labels, row numbers and vectors as arrays."""
    t = t.combine_chunks()
    v = _matrix(t.column("v").chunk(0), width)
    small = v.astype(np.float32)
    v = small if (small == v).all() else v  # components of single precision stay exact in four bytes
    ids = np.array([_NONE if x is None else x for x in t.column("vec_id").to_pylist()], np.int64)
    data = [ids.tobytes(), t.column("label").to_numpy().astype(np.int64).tobytes(), t.column("at").to_numpy().astype(np.int64).tobytes(), v.tobytes()]
    return pa.table({"list": t.column("list").slice(0, 1), **{n: pa.array([x], pa.binary()) for n, x in zip(("ids", "labels", "ats", "vectors"), data, strict=True)}})


class Index:
    """Inverted lists of all rows: centres and radii (at most LISTS), and the table of stored lists."""

    def __init__(self, rows: DataFrame, lists: int | None = None, sample: int = SAMPLE):
        n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
        self.count, self.width = n, max(1, width or 0)
        k = max(2, min(LISTS, round(math.sqrt(n)) if lists is None else lists))
        self.centres = self._fit(rows, n, k, sample)
        spread = rows.mapInArrow(functools.partial(_assign, self.centres), "list int, far double, vec_id bigint, label bigint, v array<double>, at bigint")
        spread = saved(spread, "negatives-assigned")
        self.radii, parts = np.zeros(len(self.centres)), [1] * len(self.centres)
        for r in spread.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # LISTS rows at most
            self.radii[r["list"]], parts[r["list"]] = r["far"], -(-r["n"] // LIST_ROWS)
        many = F.element_at(F.array(*map(F.lit, parts)), F.col("list") + 1)
        part = F.pmod(F.xxhash64("at"), many)
        width = self.width

        def pack(t: pa.Table) -> pa.Table:
            return _pack(width, t)

        packs = spread.groupBy("list", part.alias("part")).applyInArrow(pack, "list int, ids binary, labels binary, ats binary, vectors binary")
        self.lists = saved(packs, "negatives-lists")

    def _fit(self, rows: DataFrame, n: int, k: int, sample: int) -> np.ndarray:
        if n == 0:
            return np.zeros((1, self.width))
        filled = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(self.width) - F.size("v")))
        some = rows if n <= sample else rows.filter(F.pmod(F.xxhash64("at", F.lit(SEED)), F.lit(n)) < sample)
        some = saved(some.select(array_to_vector(filled).alias("features")), "negatives-sample")
        if not some.limit(1).count():
            return np.zeros((1, self.width))
        model = KMeans(k=k, initMode="random", maxIter=8, seed=SEED).fit(some)
        return np.array(model.clusterCenters())


def _visit(index_width: int, centres, radii, queries, k: int, same: bool, first: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k best rows of each query among a task's lists.

    queries: anchors (matrix, labels, row numbers), and per query its anchor, least and greatest score and what the kth is known
    to reach. first: only that many lists of each query, those of the highest bounds.
    """
    anchors, labels, ats, of, low, high, kth = queries
    kth = kth.copy()
    near = anchors @ centres.T
    slack = np.linalg.norm(anchors, axis=1)[:, None] * radii[None, :]
    slack = slack * (1 + 1e-9) + np.abs(near) * 1e-9 + 1e-6
    upper, lower = (near + slack)[of], (near - slack)[of]
    wanted = (upper >= low[:, None]) & (lower <= high[:, None])
    if first is not None and first < len(radii):
        bound = np.where(wanted, np.minimum(upper, high[:, None]), -np.inf)
        order = np.argsort(np.abs(near[of] - np.clip(upper, None, high[:, None])), axis=1, kind="stable")  # among equal bounds the closest centroid
        order = np.take_along_axis(order, np.argsort(-np.take_along_axis(bound, order, 1), axis=1, kind="stable"), 1)[:, :first]
        chosen = np.zeros_like(wanted)
        np.put_along_axis(chosen, order, True, 1)
        wanted &= chosen
    held = [np.empty(0, np.int64)] * 3  # query, score, id
    for b in batches:
        for r in sorted(b.to_pylist(), key=lambda r: -upper[:, r["list"]].max(initial=-np.inf)):
            c = r["list"]
            active = np.flatnonzero(wanted[:, c] & (upper[:, c] >= kth))
            if not len(active):
                continue
            ids, own, rows = (np.frombuffer(r[x], np.int64) for x in ("ids", "labels", "ats"))
            v = np.frombuffer(r["vectors"], np.float32 if len(r["vectors"]) == 4 * index_width * len(ids) else np.float64).reshape(len(ids), index_width).astype(np.float64)
            for s in range(0, len(active), TOGETHER):
                q = active[s : s + TOGETHER]
                who, back = np.unique(of[q], return_inverse=True)
                score = products(anchors[who], v)[back]
                fits = (score >= np.maximum(low[q], kth[q])[:, None]) & (score <= high[q][:, None])
                fits &= (labels[of[q]][:, None] == own[None, :]) == same
                fits &= ats[of[q]][:, None] != rows[None, :]
                x, y = np.nonzero(fits)
                held = [np.concatenate(p) for p in zip(held, (q[x], score[x, y], ids[y]), strict=True)]
            held, kth = _keep(held, kth, k)
    held, kth = _keep(held, kth, k)
    query, score, ids = held
    yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(score), pa.array(ids, mask=ids == _NONE)], ["query", "score", "id"])


def _keep(held: list[np.ndarray], kth: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The k best of each query, and the kth scores that are known now."""
    query, score, ids = held
    order = np.lexsort((ids, ~score, query))
    query, score, ids = query[order], score[order], ids[order]
    new = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.empty(0, int)
    place = np.arange(len(query)) - np.repeat(new, np.diff(np.append(new, len(query))))
    full = place == k - 1
    kth = kth.copy()
    kth[query[full]] = np.maximum(kth[query[full]], score[full])
    best = place < k
    return [query[best], score[best], ids[best]], kth


def top_k(index: Index, anchors: tuple[np.ndarray, np.ndarray, np.ndarray], of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> DataFrame:
    """(query, place, score, id): of each query the k best rows with scores from low to high, of the anchor's label or of others."""
    least = np.full(len(of), np.iinfo(np.int64).min)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))

    def run(kth: np.ndarray, first: int | None) -> DataFrame:
        queries = index.lists.sparkSession.sparkContext.broadcast((*anchors, of, low, high, kth))
        width, centres, radii = index.width, index.centres, index.radii

        def visit(batches):
            return _visit(width, centres, radii, queries.value, k, same, first, batches)

        found = index.lists.mapInArrow(visit, "query bigint, score bigint, id bigint")
        return found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)

    kth = least
    for r in run(least, FIRST).filter(F.col("place") == k).collect():  # a row per query at most
        kth[r["query"]] = r["score"]
    return run(kth, None).select("query", "place", "score", "id")


def mine(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: Column | str = "label", every: int = 100, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows whose id is divisible by ``every``.

    An anchor's positives are the best other rows of its label; of each, the negatives are the best rows of other labels
    whose score is within the window of per cents of the positive's.
    """
    spark = df.sparkSession
    rows = saved(quantised(df, vector, vec_id, F.col(label) if isinstance(label, str) else label), "negatives-rows")
    index = Index(rows)
    chosen = rows.filter(F.col("vec_id") % every == 0)
    blocks = -(-chosen.count() // ANCHORS)
    out = []
    for b in range(blocks):
        block = chosen.filter(F.pmod(F.xxhash64("at"), F.lit(blocks)) == b).toArrow()  # about ANCHORS rows
        if not block.num_rows:
            continue
        block = block.combine_chunks()
        ids, labels, ats = (block.column(c).to_numpy() for c in ("vec_id", "label", "at"))
        anchors = (_matrix(block.column("v").chunk(0), index.width), labels, ats)
        every_one = np.arange(len(ids))
        unbound = np.full(len(ids), np.iinfo(np.int64).max)
        found = top_k(index, anchors, every_one, -unbound, unbound, positives, True).toArrow()  # `positives` rows per anchor
        of, score = found.column("query").to_numpy(), found.column("score").to_numpy()
        # low * p <= 100 * x <= high * p in whole numbers
        low = np.array([-(-window[0] * int(s) // 100) for s in score], np.int64)
        high = np.array([window[1] * int(s) // 100 for s in score], np.int64)
        pairs = pa.table({"query": pa.array(np.arange(len(of)), pa.int64()), "anchor_id": pa.array(ids[of], pa.int64()), "positive_id": found.column("id"), "positive_score": found.column("score")})
        got = top_k(index, anchors, of, low, high, negatives, False)
        joined = got.join(spark.createDataFrame(pairs), "query").select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.append(saved(joined, "negatives-mined"))
    if not out:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return functools.reduce(DataFrame.union, out)
