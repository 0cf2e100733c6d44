"""Passages that repeat across documents, by level-wise doubling.

Windows of 5 words are counted; those that occur once are dropped, and two neighbours that both repeat make a window of
twice the length, which is counted in turn. At the full length (20 words) it is settled for each window whether its
words also start earlier: in a document before it, or before it in its own. Words covered by such windows go.

Documents are put in blocks of about a million words: a dictionary and its ids, written as a table bucketed by block,
so that every level reads the blocks where they lie. A level sends each distinct window of a block once, as the rest
of its hash in packs by hash range, and gets a bit for each back. So a window that all documents share is sent once by
each block, no task holds more than one hash range, and what moves is four bytes a window at the first level and little
at the next ones. Equal documents are found first and only the earliest takes part.

Hashes of short windows only choose candidates; at the full length 96 bits and the hash range tell windows apart
(two different ones of 10^13 are taken for equal with a probability of about 10^-9).

Defined cases: a null text has no words, and neither has an empty or blank one; nothing of it is removed. Documents go
by their key, nulls last, then by a digest of their words; of equal rows one comes first. Texts are read whole, and one of
over a million words is a block of its own. An empty table gives an empty table. Carried columns may have any names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import bucketed
from .common import packed, saved, unpacked

LENGTH, START = 20, 5
#: Words and documents of a block, at most (but for one longer text), and windows of one hash range.
BLOCK_WORDS, BLOCK_DOCS, RANGE = 1 << 20, 1 << 16, 1 << 19
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_BLOCK = "block bigint, sizes binary, ids binary, words binary"
_NOTE = "block bigint, part int, data binary, n bigint"
#: Parts of notes that aren't packs of a hash range: a block's candidates, and the order of its documents.
_STATE, _ORDER = -1, -2


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16) if not len(x) or x.max() < 1 << 16 else x.astype(np.uint32)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's documents; digest: of each document's words."""
    number = TaskContext.get().partitionId() << 24
    ids, sizes, digests, rows, known, total = [], [], [], [], _Ids(), 0

    def block() -> pa.RecordBatch:
        flat = _narrow(np.concatenate(ids))
        held = pa.concat_arrays(rows)
        whole = pa.array([0, len(sizes)], pa.int32())
        lists = [pa.ListArray.from_arrays(whole, x) for x in (held, pa.array(digests, pa.binary()))]
        data = [np.array(sizes, np.int64).tobytes(), flat.tobytes(), b" ".join(known)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in data), *lists], ["block", "sizes", "ids", "words", "rows", "digests"])

    for b in batches:
        own, begin = b.column("row"), 0
        for k, text in enumerate(b.column("text")):
            words = (text.as_py() or "").encode("utf-8", "replace").split()
            if sizes and (total + len(words) > BLOCK_WORDS or len(sizes) >= BLOCK_DOCS):
                rows.append(own.slice(begin, k - begin))
                yield block()
                number, begin = number + 1, k
                ids, sizes, digests, rows, known, total = [], [], [], [], _Ids(), 0
            ids.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
            sizes.append(len(words))
            digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
            total += len(words)
        rows.append(own.slice(begin))
    if sizes:
        yield block()


class _Block:
    """A block's words as hashes, and where its documents begin and end."""

    def __init__(self, row: dict):
        self.number = row["block"]
        self.words = row["words"].split(b" ") if row["words"] else []
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        n = int(self.sizes.sum())
        self.ids = np.frombuffer(row["ids"], np.uint16 if len(row["ids"]) == 2 * n else np.uint32)
        self.ends = np.cumsum(self.sizes)
        self.end = np.repeat(self.ends, self.sizes)  # of each word, its document's end

    def hashes(self, length: int, lane: int) -> np.ndarray:
        """Of the window of this many words (START times a power of two) at each position; past the end of the block it is short."""
        seed = 1 + lane
        word = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))[self.ids]
        h = np.zeros(max(0, len(word) - START + 1), np.uint64)
        for k in range(START):
            h = h * _MIX[lane] + (word[k : k + len(h)] ^ (word[k : k + len(h)] >> np.uint64(31)))
        size = START
        while size < length:
            if len(h) <= size:
                return h[:0]
            a, b = h[:-size], h[size:]
            h = (a ^ (a >> np.uint64(29))) * _MIX[2 + lane] + (b ^ (b >> np.uint64(32))) * _MIX[lane]
            h ^= h >> np.uint64(31)
            size *= 2
        return h

    def inside(self, length: int) -> np.ndarray:
        """Whether a window of this many words at each position stays in its document."""
        return np.arange(len(self.ids)) + length <= self.end


def _ranges(h: np.ndarray, parts: int) -> np.ndarray:
    """The hash range of each hash; it grows with the hash."""
    return (((h >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.int64)


def _cuts(h: np.ndarray, parts: int) -> list[tuple[int, slice]]:
    """(range, slice) of sorted hashes, where there are any."""
    p = _ranges(h, parts)
    edges = np.flatnonzero(np.diff(p, prepend=-1, append=parts + 1)) if len(p) else []
    return [(int(p[a]), slice(int(a), int(b))) for a, b in zip(edges[:-1], edges[1:], strict=True)] if len(p) else []


def _state(notes: list[dict], n: int) -> np.ndarray:
    """The candidates of a block, as one boolean of each word."""
    data = next(r["data"] for r in notes if r["part"] == _STATE)
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _notes(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64())
    return pa.table([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["block", "part", "data", "n"])


def _first_state(length: int, left: pa.Table, right: pa.Table) -> pa.Table:
    """Candidates at the first level: all windows of documents that aren't copies."""
    if not left.num_rows:
        return _notes([])
    b, notes = _Block(left.to_pylist()[0]), right.to_pylist()
    order = np.frombuffer(notes[0]["data"], np.int64)
    ok = b.inside(length) & np.repeat(order >= 0, b.sizes)
    return _notes([(b.number, _STATE, np.packbits(ok).tobytes(), int(ok.sum())), (b.number, _ORDER, notes[0]["data"], 0)])


def _send(length: int, parts: int, left: pa.Table, right: pa.Table) -> pa.Table:
    """Packs of a block's distinct candidates: the low 32 bits of their hashes."""
    if not left.num_rows:
        return _notes([])
    b, notes = _Block(left.select(_COLUMNS).to_pylist()[0]), right.to_pylist()
    at = np.flatnonzero(_state(notes, len(b.ids)))
    h = np.unique(b.hashes(length, 0)[at])
    return _notes([(b.number, p, h[s].astype(np.uint32).tobytes(), s.stop - s.start) for p, s in _cuts(h, parts)])


def _answer(t: pa.Table) -> pa.Table:
    """For each pack a bit of each hash: whether another block has it too."""
    rows = t.to_pylist()
    each = [np.frombuffer(r["data"], np.uint32) for r in rows]
    whole = np.sort(np.concatenate(each))
    twice = np.unique(whole[1:][whole[1:] == whole[:-1]])
    out = []
    if len(twice):
        for r, h in zip(rows, each, strict=True):
            at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
            out.append((r["block"], r["part"], np.packbits(twice[at] == h).tobytes(), 0))
    return _notes(out)


def _replies(notes: list[dict], h: np.ndarray, parts: int) -> np.ndarray:
    """The bits that came back, along the sorted hashes."""
    bits = {r["part"]: r["data"] for r in notes if r["part"] >= 0}
    out = np.zeros(len(h), bool)
    for p, s in _cuts(h, parts):
        if p in bits:
            out[s] = np.unpackbits(np.frombuffer(bits[p], np.uint8), count=s.stop - s.start).astype(bool)
    return out


def _double(length: int, parts: int, left: pa.Table, right: pa.Table) -> pa.Table:
    """Candidates of twice the length: where two neighbours both repeat."""
    if not left.num_rows:
        return _notes([])
    b, notes = _Block(left.select(_COLUMNS).to_pylist()[0]), right.to_pylist()
    at = np.flatnonzero(_state(notes, len(b.ids)))
    h, back, many = np.unique(b.hashes(length, 0)[at], return_inverse=True, return_counts=True)
    repeats = np.zeros(len(b.ids), bool)
    repeats[at] = (_replies(notes, h, parts) | (many > 1))[back]
    ok = np.zeros(len(b.ids), bool)
    ok[: max(0, len(ok) - length)] = repeats[:-length] & repeats[length:]
    ok &= b.inside(2 * length)
    order = next(r["data"] for r in notes if r["part"] == _ORDER)
    return _notes([(b.number, _STATE, np.packbits(ok).tobytes(), int(ok.sum())), (b.number, _ORDER, order, 0)])


def _settled(b: _Block, notes: list[dict], length: int) -> tuple[np.ndarray, ...]:
    """Candidates at the full length, sorted by hash, then by document order and place: hash lanes, order, place, whether first of its hash."""
    at = np.flatnonzero(_state(notes, len(b.ids)))
    order = np.repeat(np.frombuffer(next(r["data"] for r in notes if r["part"] == _ORDER), np.int64), b.sizes)[at]
    one, two = b.hashes(length, 0)[at], b.hashes(length, 1)[at]
    s = np.lexsort((at, order, two, one))
    one, two, order, at = one[s], two[s], order[s], at[s]
    first = np.ones(len(s), bool)
    first[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return one, two, order, at, first


def _send_whole(length: int, parts: int, left: pa.Table, right: pa.Table) -> pa.Table:
    """Packs of a block's distinct windows of full length: 96 bits of their hashes, and their first document's order."""
    if not left.num_rows:
        return _notes([])
    b, notes = _Block(left.select(_COLUMNS).to_pylist()[0]), right.to_pylist()
    one, two, order, _, first = _settled(b, notes, length)
    one, two, order = one[first], two[first], order[first]
    return _notes([(b.number, p, one[s].astype(np.uint32).tobytes() + two[s].tobytes() + order[s].tobytes(), s.stop - s.start) for p, s in _cuts(one, parts)])


def _answer_whole(t: pa.Table) -> pa.Table:
    """For each pack a bit of each window: whether an earlier document of another block has it."""
    rows = t.to_pylist()
    n = [r["n"] for r in rows]
    low = np.concatenate([np.frombuffer(r["data"], np.uint32, k) for r, k in zip(rows, n, strict=True)])
    two = np.concatenate([np.frombuffer(r["data"], np.uint64, k, 4 * k) for r, k in zip(rows, n, strict=True)])
    order = np.concatenate([np.frombuffer(r["data"], np.int64, k, 12 * k) for r, k in zip(rows, n, strict=True)])
    s = np.lexsort((order, two, low))
    low, two = low[s], two[s]
    later = np.zeros(len(s), bool)
    later[s[1:]] = (low[1:] == low[:-1]) & (two[1:] == two[:-1])
    ends = np.cumsum(n)
    return _notes([(r["block"], r["part"], np.packbits(later[e - k : e]).tobytes(), 0) for r, k, e in zip(rows, n, ends, strict=True) if later[e - k : e].any()])


def _cut_out(length: int, parts: int, left: pa.Table, right: pa.Table) -> pa.Table:
    """Of each document of a block: its words, those removed, the spans of removed words and a digest of the rest."""
    rows = left.column("rows").combine_chunks().flatten()
    b, notes = _Block(left.select(_COLUMNS).to_pylist()[0]), right.to_pylist()
    one, _, order, at, first = _settled(b, notes, length)
    later = ~first
    later[first] = _replies(notes, one[first], parts)
    marks = np.zeros(len(b.ids) + 1, np.int64)
    np.add.at(marks, at[later], 1)
    np.add.at(marks, at[later] + length, -1)
    gone = np.cumsum(marks[:-1]) > 0
    order = np.frombuffer(next(r["data"] for r in notes if r["part"] == _ORDER), np.int64)
    gone |= np.repeat((order < 0) & (b.sizes >= length), b.sizes)
    removed, digests, spans = [], [], []
    word = b.words.__getitem__
    for e, n in zip(b.ends, b.sizes, strict=True):
        g = gone[e - n : e]
        removed.append(int(g.sum()))
        digests.append(hashlib.sha256(b" ".join(map(word, b.ids[e - n : e][~g].tolist()))).hexdigest())
        edges = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0))
        spans.append([{"start": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)])
    own = [pa.array(b.sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    return pa.table([rows, *own], names=["row", "n_words", "n_removed", "kept_sha256", "spans"])


_COLUMNS = ["block", "sizes", "ids", "words"]


def _ordered(docs: DataFrame) -> DataFrame:
    """Of documents (block, place, key, digest): a note for each block, its documents' order, -1 for one with an earlier equal."""
    dealt = docs.repartitionByRange(F.asc_nulls_last("key"), "digest", "block", "place").sortWithinPartitions(F.asc_nulls_last("key"), "digest", "block", "place")
    dealt = saved(dealt.withColumn("order", F.monotonically_increasing_id()), "passages-order")  # grows along the ranges
    firsts = dealt.groupBy("digest").agg(F.min("order").alias("first"))
    # by the order itself, which is one row's own: a digest may be that of a third of all rows
    d = dealt.join(firsts, F.col("order") == F.col("first"), "left").withColumn("order", F.coalesce("first", F.lit(-1)))
    return d.select("block", "place", "order").groupBy("block").applyInArrow(_order_note, _NOTE)


def _order_note(t: pa.Table) -> pa.Table:
    order = t.column("order").to_numpy()[np.argsort(t.column("place").to_numpy())]
    return _notes([(t.column("block")[0].as_py(), _ORDER, order.astype(np.int64).tobytes(), 0)])


def repeats(df: DataFrame, text: str = "text", key: str = "doc_id", carry: list[str] | None = None, length: int = LENGTH) -> DataFrame:
    """The carried columns of df with n_words, n_removed, kept_sha256 and spans (of removed words, end exclusive).

    length: words of a window, START times a power of two.
    """
    if length < START or length % START or (length // START) & (length // START - 1):
        raise ValueError(f"a window's words must be {START} times a power of two")
    carry = df.columns if carry is None else carry
    spark = df.sparkSession
    whole = df.select(F.struct(packed(carry), F.col(f"`{key}`").alias("key")).alias("row"), F.col(f"`{text}`").alias("text"))
    row = whole.schema["row"].dataType.simpleString()
    made = whole.mapInArrow(_blocks, f"{_BLOCK}, rows array<{row}>, digests array<binary>")
    blocks = bucketed(made, "block", int(spark.conf.get("spark.sql.shuffle.partitions")), "passages-blocks")
    docs = blocks.select("block", F.posexplode(F.arrays_zip(F.transform("rows", lambda r: r["key"]).alias("k"), "digests")).alias("place", "d")).select("block", "place", F.col("d.k").alias("key"), F.col("d.digests").alias("digest"))
    order = _ordered(docs)
    small = blocks.select(*_COLUMNS)

    def together(f: Callable, notes: DataFrame, of: DataFrame = small, schema: str = _NOTE) -> DataFrame:
        return of.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(f, schema)

    state, size = saved(together(functools.partial(_first_state, START), order), "passages-state"), START
    while True:
        candidates = state.agg(F.sum("n")).first()[0] or 0
        if not candidates:  # none survive: none would at a greater length
            parts, notes = 1, state
            break
        parts = -(-candidates // RANGE)
        send, answer = (_send_whole, _answer_whole) if size == length else (_send, _answer)
        packs = together(functools.partial(send, size, parts), state)
        notes = state.union(saved(packs.groupBy("part").applyInArrow(answer, _NOTE), "passages-replies"))
        if size == length:
            break
        state = saved(together(functools.partial(_double, size, parts), notes), "passages-state")
        size *= 2
    out = f"row {row}, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start: bigint, end: bigint>>"
    cut = together(functools.partial(_cut_out, length, parts), notes, blocks.drop("digests"), out)
    return cut.withColumn("row", F.col("row.row")).select(*unpacked(carry, "n_words", "n_removed", "kept_sha256", "spans"))
