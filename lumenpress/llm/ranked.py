"""Ranked lexical search by sort-based accumulation.

A stated set of query items is ranked against all documents, in blocks of items whose terms fit one bounded
dictionary. A first pass over the documents counts terms and leaves of each document the terms that some item has.
These rows are dealt out by ranges of documents, so that every (item, document) key is whole in one task. There the
arrays (item, document, impact) of the matched terms are concatenated, their packed keys are radix sorted, and
``numpy.add.reduceat`` sums each run; a heap per item keeps the best, and the heaps' rows of all tasks are ranked.

Score: of every term of the item, repeats included, w * ((10^9 * tf) div (1000 * tf + 12 * m)), where
w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m = 75 + (25 * n * N) div L. N counts documents with a term, L
all their terms, n those of one document. Integers but for the logarithm, so that any order of summing gives the same.

Defined cases: a null text has no terms, neither has an empty one; an item without terms and a document without a
term of the item give no row; equal scores are ranked by the key, nulls last; rows with a repeated key are documents
of their own, and so are repeated items; an empty table on either side gives an empty table; texts are read whole.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import shipped
from .common import packed, saved, unpacked

TOP = 20
#: Terms of one block of items: bounds the dictionary that every task gets.
BLOCK_TERMS = 200_000
#: Entries that are sorted at once.
SLICE = 1 << 20
_LETTERS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(c if c > 127 else ord(chr(c).lower()) if c in _LETTERS else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all other characters from U+0080 on, in UTF-8, A to Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, Counter]]]:
    """(number, terms with repeats) of the items, in blocks of at most BLOCK_TERMS distinct terms, or of one item."""
    block, known = [], set()
    for r in items.toLocalIterator():
        own = Counter(terms(r["text"]))
        if block and len(known | own.keys()) > BLOCK_TERMS:
            yield block
            block, known = [], set()
        if own:
            block.append((r["no"], own))
            known |= own.keys()
    if block:
        yield block


def _matched(vocabulary: dict[bytes, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document: the number of its terms, and the ids and counts of those in the vocabulary."""
    find = vocabulary.get
    for b in batches:
        n, ids, counts, ends = [], [], [], [0]
        for text in b.column("text"):
            found = terms(text.as_py())
            n.append(len(found))
            own = Counter(map(find, found))
            own.pop(None, None)
            ids.extend(own)
            counts.extend(own.values())
            ends.append(len(ids))
        ends = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (ids, counts)]
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(n, pa.int64()), *lists], ["row", "n", "terms", "tf"])


def _radix(key: np.ndarray) -> np.ndarray:
    """The order of packed 32-bit keys: two stable passes over 16 bits, which numpy sorts by radix."""
    order = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((key[order] >> 16).astype(np.uint16), kind="stable")]


def accumulate(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, start: np.ndarray, item: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, sum) of matched terms: those of term t are item[start[t]:start[t + 1]], which have it times[...] times."""
    many = start[term + 1] - start[term]
    first = np.repeat(start[term] - np.concatenate(([0], np.cumsum(many)[:-1])), many)
    entry = first + np.arange(len(first))
    wide = int(doc.max()) + 1 if len(doc) else 1
    key = item[entry].astype(np.uint64) * np.uint64(wide) + np.repeat(doc, many).astype(np.uint64)
    order = _radix(key) if not len(key) or key.max() < 1 << 32 else np.argsort(key, kind="stable")
    key = key[order]
    runs = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, int)
    sums = np.add.reduceat((np.repeat(impact, many) * times[entry])[order], runs) if len(runs) else np.empty(0, np.int64)
    return (key[runs] // np.uint64(wide)).astype(np.int64), (key[runs] % np.uint64(wide)).astype(np.int64), sums


def _best(total: int, words: int, top: int, weight: np.ndarray, csr: tuple, numbers: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The top rows of each item among a task's documents."""
    start, item, times = csr
    heaps: list[list] = [[] for _ in numbers]
    least = np.zeros(len(numbers), np.int64)  # a score must reach it
    seen = 0
    for b in batches:
        ends = b.column("terms").offsets.to_numpy()
        ends = ends - ends[0]
        term, tf = (b.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tf"))
        m = np.array([75 + 25 * n * total // words for n in b.column("n").to_pylist()], np.int64)
        doc = np.repeat(np.arange(len(m)), np.diff(ends))
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        load = np.concatenate(([0], np.cumsum(start[term + 1] - start[term])))[ends]
        keys = b.column("key").to_pylist()
        at = 0
        while at < len(m):
            to = max(at + 1, int(np.searchsorted(load, load[at] + SLICE, "right")) - 1)
            s = slice(ends[at], ends[to])
            who, where, score = accumulate(doc[s] - at, term[s], impact[s], start, item, times)
            for x in np.flatnonzero((score > 0) & (score >= least[who])):
                k, value, key = int(who[x]), int(score[x]), keys[at + int(where[x])]
                seen += 1
                entry = (value, key is not None, 0 if key is None else -key, seen)
                if len(heaps[k]) < top:
                    heapq.heappush(heaps[k], entry)
                else:
                    heapq.heappushpop(heaps[k], entry)
                    least[k] = heaps[k][0][0]
            at = to
    rows = [(numbers[k], -e[2] if e[1] else None, e[0]) for k, heap in enumerate(heaps) for e in heap]
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["no", "key", "score"])


def _rank_block(docs: DataFrame, block: list[tuple[int, Counter]], top: int) -> DataFrame:
    """(no, key, score) of a block's items: at most top rows of each item and task."""
    vocabulary = {t: k for k, t in enumerate(sorted(set().union(*(own for _, own in block))))}
    schema = "row struct<key: bigint, at: bigint>, n bigint, terms array<int>, tf array<int>"
    matched = saved(docs.mapInArrow(functools.partial(_matched, vocabulary), schema), "ranked-terms")
    sums = matched.agg(F.count_if(F.col("n") > 0).alias("total"), F.sum("n").alias("words")).first()
    total, words = sums["total"], sums["words"] or 1
    df = np.zeros(len(vocabulary), np.int64)
    for r in matched.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row per term of the block at most
        df[r["t"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    having: list[list[tuple[int, int]]] = [[] for _ in vocabulary]
    for k, (_, own) in enumerate(block):
        for t, times in own.items():
            having[vocabulary[t]].append((k, times))
    start = np.cumsum([0, *map(len, having)])
    item, times = (np.array([x[c] for own in having for x in own], np.int64) for c in range(2))
    hits = matched.filter(F.size("terms") > 0).select(F.col("row.key").alias("key"), F.col("row.at").alias("at"), "n", "terms", "tf").repartitionByRange("key", "at").drop("at")
    return hits.mapInArrow(functools.partial(_best, total, words, top, weight, (start, item, times), [no for no, _ in block]), "no bigint, key bigint, score bigint")


def rank(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", carry: list[str] | None = None, top: int = TOP) -> DataFrame:
    """The carried columns of items with rank, key and score: the top documents of each item.

    key is a whole number. The rows of items are numbered; a document's rank among equal scores and keys is arbitrary.
    """
    carry = items.columns if carry is None else carry
    shipped(docs.sparkSession)
    plain = docs.select(F.struct(F.col(f"`{key}`").cast("long").alias("key"), F.monotonically_increasing_id().alias("at")).alias("row"), F.col(f"`{text}`").alias("text"))
    numbered = saved(items.select(packed(carry), F.col(f"`{item_text}`").alias("text"), F.monotonically_increasing_id().alias("no")), "ranked-items")
    found = [saved(_rank_block(plain, block, top), "ranked-best") for block in _blocks(numbered.select("no", "text"))]
    if not found:
        best = docs.sparkSession.createDataFrame([], "no bigint, key bigint, score bigint")
    else:
        best = functools.reduce(DataFrame.union, found)
    place = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("key")))
    ranked = best.withColumn("rank", place).filter(F.col("rank") <= top)
    return ranked.join(numbered.select("row", "no"), "no").select(*unpacked(carry, "rank", "key", "score"))
