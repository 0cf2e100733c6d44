"""MinHash near-duplicates: BagMinHash signatures, banding, and verified multiset overlap.

Texts are multisets of five-word shingles (a text of one to four words is one shingle); two texts are linked
if their weighted Jaccard similarity, sum of minima over sum of maxima, is at least 0.8, and a class is a
connected component of links.

Signatures follow BagMinHash (Ertl 2018) for weights discretised to whole counts: weight space is divided into
[0,1), [1,2), [2,4), [4,8), ..., and each element runs one Poisson process per interval below its weight. A
point has a time, a component and, in the hierarchical split of its interval, a place below or above the
weight; a component's value is the least time of a point placed below it. Points come in order of time, so
almost all processes end with their first point, past the time within which every component is filled.

Equal texts are first put together by digest, so hot groups of copies cost one signature row each. Buckets of
a band never expand to all pairs: in a round, every member meets its bucket's pivot only; links merge
members into components, and later rounds look only at buckets that still hold two or more components. What
is then left is compared in blocks of bounded size, without texts; texts are fetched for pairs that can still join
two components and whose sizes and sketches allow the similarity. A sketch has one bit per component of the signature; a pair of
similarity 0.8 is lost with probability under 1e-8. Whole texts decide.

Defined cases: texts without words (null, empty, white space) have no shingles and are classes of equal
texts; null is a class of its own rows, each by itself. Repeated rows share their class. Ties go to the
smallest doc_id, null last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from .common import packed, saved, unpacked

WIDTH = 5
ROWS, BANDS = 5, 40
M = ROWS * BANDS
SIMILARITY = 0.8
#: Bits in which two sketches of similarity 0.8 can differ: mean and six standard deviations.
_APART = (1 - SIMILARITY) / 2
MOST_APART = int(M * _APART + 6 * (M * _APART * (1 - _APART)) ** 0.5)
ROUNDS = 2
BLOCK = 512
#: Members of a bucket that one join key may hold; larger buckets are compared in packs of so many.
PACK = 2048
HOT = 1000
BATCH_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_PLACE = mix64(np.arange(1 << 10, dtype=_U) + _U(0xD1B54A32D192ED03)) | _U(1)
_STEP = mix64(np.arange(WIDTH, dtype=_U) + _U(0x8CB92BA72F3D8DD7)) | _U(1)


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of UTF-8 bytes: where words start, and the words' 64-bit hashes. In blocks, so that memory stays bounded."""
    starts, hashes, lo = [], [], 0
    while lo < len(raw):
        hi = min(len(raw), lo + BATCH_BYTES)
        while hi < len(raw) and not _SPACE[raw[hi]]:  # to the end of the word
            hi += 1
        word = ~_SPACE[raw[lo:hi]]
        at = np.flatnonzero(word)
        if len(at):
            new = np.empty(len(at), bool)
            new[0] = True
            np.not_equal(at[1:], at[:-1] + 1, out=new[1:])
            first = np.flatnonzero(new)
            length = np.diff(np.append(first, len(at)))
            place = np.arange(len(at)) - np.repeat(first, length)
            factor = _PLACE[place & 1023] + (place >> 10).astype(_U) * _U(0x9E3779B97F4A7C15)
            total = np.add.reduceat(_BYTE[raw[lo:hi][at]] * factor, first)
            starts.append(at[first] + lo)
            hashes.append(mix64(total ^ (length.astype(_U) * _U(0x9FB21C651E98DF25))))
        lo = hi
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, int), np.zeros(0, _U))


def shingles(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts laid end to end with a space after each (ends: where the spaces are): text number and hash of each shingle."""
    starts, h = word_hashes(raw)
    text = np.searchsorted(ends, starts)
    n = np.bincount(text, minlength=len(ends)) if len(text) else np.zeros(len(ends), int)
    out = np.zeros(max(0, len(h) - WIDTH + 1), _U)
    for k in range(WIDTH):
        out += mix64(h[k : k + len(out)] * _STEP[k])
    own = text[: len(out)] == text[WIDTH - 1 :] if len(out) else np.zeros(0, bool)
    owner, value = text[: len(out)][own], mix64(out[own])
    short = np.flatnonzero((n > 0) & (n < WIDTH))
    if len(short):
        first = np.concatenate([[0], np.cumsum(n)])[short]
        extra = n[short].astype(_U)
        for k in range(WIDTH - 1):
            has = n[short] > k
            extra[has] += mix64(h[first[has] + k] * _STEP[k])
        extra = mix64(extra)
        owner, value = np.concatenate([owner, short]), np.concatenate([value, extra])
    return owner, value


def bag_minhash(owner: np.ndarray, value: np.ndarray, texts: int, m: int = M) -> np.ndarray:
    """Signatures (texts x m, float64 times) of the multisets of shingles; infinite for texts without any."""
    sig = np.full(texts * m, np.inf)
    if not len(owner):
        return sig.reshape(texts, m)
    # distinct elements with their counts
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    o, v = owner[order], value[order]
    new = np.append(True, (o[1:] != o[:-1]) | (v[1:] != v[:-1]))
    first = np.flatnonzero(new)
    weight = np.diff(np.append(first, len(o)))
    o, v = o[first], v[first]
    total = np.bincount(o, weights=weight, minlength=texts)
    # one process per element and interval [0,1), [1,2), [2,4), ...
    pieces, level = [(np.arange(len(o)), np.zeros(len(o), np.int64))], 1
    while len(more := np.flatnonzero(weight > (1 << (level - 1)))):
        pieces.append((more, np.full(len(more), level)))
        level += 1
    which, level = (np.concatenate(x) for x in zip(*pieces, strict=True))
    po, pw = o[which], weight[which]
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    rate = np.maximum(low, 1).astype(float)  # also the interval's width
    seed = mix64(v[which] + (level.astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93))
    filled, limit = total == 0, np.log(m) + 2.0
    before = np.zeros(len(po))
    count = np.zeros(len(po), _U)
    while not filled.all():
        until = limit / np.maximum(total, 1)
        live = np.flatnonzero(~filled[po])
        while len(live):
            bits = mix64(seed[live] + (count[live] + _U(1)) * _U(0x9E3779B97F4A7C15))
            gap = -np.log(((bits >> _U(11)).astype(float) + 0.5) * 2.0**-53) / (rate[live] * m)
            at = before[live] + gap
            ok = at <= until[po[live]]
            live, at, bits = live[ok], at[ok], mix64(bits[ok])
            before[live], count[live] = at, count[live] + _U(1)
            place = low[live] + rate[live] * ((bits & _U(0xFFFFFFFF)).astype(float) * 2.0**-32)
            below = (level[live] < 2) | (np.floor(place) < pw[live])
            component = ((bits >> _U(32)) % _U(m)).astype(np.int64)
            np.minimum.at(sig, po[live][below] * m + component[below], at[below])
        filled = np.isfinite(sig.reshape(texts, m)).all(axis=1) | (total == 0)
        limit *= 2  # the few that aren't filled go on from where they stopped
    return sig.reshape(texts, m)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi of a string column with their bytes laid end to end, a space after each, and where those are."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lo, size = 0, 0
    for hi in range(len(column)):
        size += int(lengths[hi])
        if size >= BATCH_BYTES or hi == len(column) - 1:
            raw = b" ".join([*(x or b"" for x in column.slice(lo, hi + 1 - lo).cast(pa.binary()).to_pylist()), b""])
            yield lo, hi + 1, np.frombuffer(raw, np.uint8), np.cumsum(lengths[lo : hi + 1] + 1) - 1
            lo, size = hi + 1, 0


def _signer(with_text: bool):
    return lambda batches: _sign(batches, with_text)


def _sign(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    salt = mix64(np.arange(BANDS, dtype=_U) + _U(0xA0761D6478BD642F))
    power = mix64(np.arange(ROWS, dtype=_U) + _U(0xE7037ED1A0B428DB)) | _U(1)
    long = pa.list_(pa.int64())
    for b in batches:
        for lo, hi, raw, ends in _texts(b.column("text")):
            owner, value = shingles(raw, ends)
            n = np.bincount(owner, minlength=hi - lo)
            bits = mix64(bag_minhash(owner, value, hi - lo).view(_U))
            band = mix64((bits.reshape(-1, BANDS, ROWS) * power).sum(axis=2) + salt).view(np.int64)
            flags = np.zeros((hi - lo, -(-M // 64) * 64), np.uint8)
            flags[:, :M] = bits >> _U(63)
            words = np.packbits(flags, axis=1).view(np.int64)
            part = b.slice(lo, hi - lo)
            lists = [pa.array([x[k] if n[k] else None for k in range(hi - lo)], long) for x in (band, words)]
            own = b.num_columns - (not with_text)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(own)), *lists, pa.array(n, pa.int64())], names=[*b.schema.names[:own], "bands", "sketch", "size"])


def _can_be_similar(size_a: Column, sketch_a: Column, size_b: Column, sketch_b: Column) -> Column:
    apart = sum((F.bit_count(sketch_a[k].bitwiseXOR(sketch_b[k])) for k in range(-(-M // 64))), F.lit(0))
    return (F.least(size_a, size_b) >= SIMILARITY * F.greatest(size_a, size_b)) & (apart <= MOST_APART)


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode() + b" ", np.uint8)
    return np.unique(shingles(raw, np.array([len(raw) - 1]))[1], return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two counted multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    high = a[1].sum() + b[1].sum() - low
    return low / high if high else 0.0


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, held = None, None  # rows come sorted by b, so a pivot is counted once
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            x = batch.slice(lo, 128)
            keep = []
            for k, b in enumerate(x.column("b").to_pylist()):
                if b != last:
                    last, held = b, _counted(x.column("text_b")[k].as_py())
                keep.append(overlap(_counted(x.column("text_a")[k].as_py()), held) >= SIMILARITY)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column("a").filter(mask), x.column("b").filter(mask)], names=["a", "b"])


def near_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """The carried columns with class_id: the least key of the document's class, null if no row of it has a key.

    One row per input row.
    """
    carry = docs.columns if carry is None else carry
    signed = _signed(docs, text, key, carry)
    nodes = _nodes(signed)
    least = nodes.groupBy("comp").agg(F.min("best.id").alias("class_id"), F.count(F.lit(1)).alias("nodes"))
    named = _spread(nodes.select("digest", "comp", "copies"), saved(least, "least"), "comp", "nodes").select("digest", "class_id", "copies")
    rows = signed.filter("not missing").select("row", "digest")
    found = _spread(rows, saved(named, "named"), "digest", "copies").select("row", "class_id")
    found = found.unionByName(signed.filter("missing").select("row", F.col("id").alias("class_id")))
    return found.select(*unpacked(carry, "class_id"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each near-duplicate class: that with the least key, null last; of repeated rows one."""
    signed = _signed(docs, text, key, docs.columns)
    kept = saved(_nodes(signed).groupBy("comp").agg(F.min("best")["at"].alias("at")).select("at"), "kept")
    # merge: kept grows with the documents, so it is never sent to every task, whatever its size
    d = signed.filter("not missing").join(kept.hint("merge"), "at", "left_semi").unionByName(signed.filter("missing"))
    return d.select(*unpacked(docs.columns))


def _spread(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined with facts, a saved table with one row per key that counts the key's rows.

    Keys that hold at least one in HOT of all rows, of which there are HOT at most, are sent to every task, so that
    their rows stay where they are; all others are joined by key.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    hot = facts.filter((F.col(count) > 1) & (F.col(count) * HOT >= total))
    cold = facts.filter((F.col(count) <= 1) | (F.col(count) * HOT < total))
    hot_rows = rows.join(F.broadcast(hot.drop(*(c for c in rows.columns if c != key))), key)
    cold_rows = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.drop(*(c for c in rows.columns if c != key)), key)
    return hot_rows.unionByName(cold_rows)


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def _signed(docs: DataFrame, text: str, key: str, carry: list[str]) -> DataFrame:
    """A written table: row (the carried columns), id, at (a number of the row), digest, missing, text, bands, sketch, size."""
    base = docs.select(packed(carry), F.col(key).alias("id"), F.monotonically_increasing_id().alias("at"), _digest(text).alias("digest"), F.col(text).isNull().alias("missing"), F.col(text).alias("text"))
    keep = text not in carry  # else the text is in the row
    fields = T.StructType.fromDDL("bands array<bigint>, sketch array<bigint>, size bigint").fields
    schema = T.StructType([*(f for f in base.schema.fields if keep or f.name != "text"), *fields])
    signed = saved(base.mapInArrow(_signer(keep), schema), "signed")
    return signed if keep else signed.withColumn("text", F.col("row")[text])


def _nodes(signed: DataFrame) -> DataFrame:
    """One row per different text: digest, node (the number of a row that has it), copies, best (its least id, null last) and comp (its class's number)."""
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("best")
    texts = signed.filter("not missing").groupBy("digest").agg(F.min("at").alias("node"), F.count(F.lit(1)).alias("copies"), best)
    # signatures by row number, so that copies of a text don't move theirs
    signs = signed.filter("not missing").select(F.col("at").alias("node"), "bands", "sketch", "size")
    nodes = saved(texts.join(signs, "node"), "nodes")
    members = nodes.filter("bands is not null").select("node", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).filter("n > 1")
    members = saved(members.join(shared, "band").select("band", "node", "pivot"), "members")
    # of the texts in shared buckets, once for all rounds
    needed = members.select("node").distinct().join(nodes.select("node", "size", "sketch"), "node")
    held = saved(needed.join(signed.select(F.col("at").alias("node"), "text"), "node"), "texts")
    links, met, comp = None, None, None
    for k in range(ROUNDS):
        pairs = _pivot_pairs(members if comp is None else _open(members, comp), k).distinct()
        if met is not None:
            pairs = pairs.join(met, ["a", "b"], "left_anti")
        pairs = saved(pairs, "pairs")
        if not pairs.limit(1).count():
            break
        met = pairs if met is None else met.unionByName(pairs)
        found = saved(_verify(pairs, held), "links")
        links = found if links is None else links.unionByName(found)
        comp = components(links)
    if comp is not None:
        found = saved(_rest(_open(members, comp), nodes, held), "links")
        if found.limit(1).count():
            comp = components(links.unionByName(found))
    done = nodes.select("digest", "node", "copies", "best")
    return done.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")) if comp is not None else done.withColumn("comp", F.col("node"))


def _pivot_pairs(members: DataFrame, k: int) -> DataFrame:
    """Every member of a bucket with the bucket's pivot of round k, as pairs (a, b) with a > b.

    Round 0 takes the least node, which buckets of one group of copies tend to share, so that a member has few
    different pivots; later rounds take the least by another hash each.
    """
    if k:
        draw = F.min(F.struct(F.xxhash64(F.lit(k), "node").alias("h"), "node"))["node"]
        members = members.select("band", "node").join(members.groupBy("band").agg(draw.alias("pivot")), "band")
    d = members.filter("node <> pivot")
    return d.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b"))


def _open(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members with their component, of buckets that hold two components or more."""
    d = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = d.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("band")
    return d.join(mixed, "band")


def _rest(members: DataFrame, nodes: DataFrame, held: DataFrame) -> DataFrame:
    """Links between members of a bucket that are of different components.

    First only members stay for which the bucket has one of another component and of fitting size and
    sketch; sizes of similar texts are in the same class (powers of 1.25) or in neighbouring ones. These are dealt
    into blocks, and a task compares the sizes, sketches and bands of two blocks, or of one with itself. A pair is
    looked at in the first bucket it shares. Texts are fetched only for members that fit another one of the two
    blocks; then the task joins components as it finds links, and goes on only where a pair can still join two.
    """
    d = members.select("band", "node", "comp").join(held.select("node", "size", "sketch"), "node")
    d = saved(d.withColumn("class", F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1 / SIMILARITY))).cast("int")), "classed")
    large = d.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PACK).select("band")
    small = _with_mates(d.join(large, "band", "left_anti"))
    d = saved(small.unionByName(_with_mates_in_packs(d.join(large, "band", "left_semi"))), "open")
    count = d.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    d = d.join(count, "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    d = d.join(nodes.select("node", "size", "sketch", "bands"), "node")
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.select("band", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node", "comp", "size", "sketch", "bands")
    fit = saved(d.groupBy("band", "p", "q").applyInArrow(_fitting, "band bigint, p int, q int, node bigint, comp bigint, mates array<bigint>"), "fitting")
    d = fit.join(held.select("node", "text"), "node")
    return d.groupBy("band", "p", "q").applyInArrow(_linked, "a bigint, b bigint")


def _with_mates(d: DataFrame) -> DataFrame:
    """(band, node, comp) of members (with class) for which their bucket has a fitting one of another component."""
    o = d.select(F.col("band").alias("o_band"), *(F.col(c).alias(f"o_{c}") for c in ("node", "comp", "size", "sketch")), F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("o_class"))
    fits = (F.col("comp") != F.col("o_comp")) & _can_be_similar(F.col("size"), F.col("sketch"), F.col("o_size"), F.col("o_sketch"))
    return d.join(o, (F.col("band") == F.col("o_band")) & (F.col("class") == F.col("o_class")) & fits, "left_semi").select("band", "node", "comp")


def _with_mates_in_packs(d: DataFrame) -> DataFrame:
    """The same for buckets of any size: packs of a class meet each other and those of the next class, two in a task."""
    parts = saved(d.groupBy("band", "class").agg(F.ceil(F.count(F.lit(1)) / PACK).cast("int").alias("parts")), "parts")
    dealt = d.join(parts, ["band", "class"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    packs = dealt.groupBy("band", "class", "part").applyInArrow(_pack, "band bigint, class int, part int, node binary, comp binary, size binary, sketch binary")
    packs = saved(packs, "packs")
    near = lambda by, name: parts.select("band", (F.col("class") - by).alias("class"), F.col("parts").alias(name))
    each = packs.join(near(0, "own"), ["band", "class"]).join(near(1, "above"), ["band", "class"], "left").join(near(-1, "below"), ["band", "class"], "left")
    upto = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda a, b, p, q: F.struct(a.alias("a"), b.alias("b"), p.alias("p"), q.alias("q"))
    c, p = F.col("class"), F.col("part")
    cells = F.concat(
        F.transform(upto(F.col("own")), lambda q: cell(c, c, F.least(p, q), F.greatest(p, q))),
        F.transform(upto(F.col("above")), lambda q: cell(c, c + 1, p, q)),
        F.transform(upto(F.col("below")), lambda q: cell(c - 1, c, q, p)),
    )
    meet = each.select("band", "node", "comp", "size", "sketch", F.explode(cells).alias("cell")).select("band", "cell.*", "node", "comp", "size", "sketch")
    return meet.groupBy("band", "a", "b", "p", "q").applyInArrow(_mated, "band bigint, node bigint, comp bigint").distinct()


def _pack(t: pa.Table) -> pa.Table:
    """One row of a pack's members."""
    data = {c: t.column(c).to_numpy().astype(np.int64).tobytes() for c in ("node", "comp", "size")}
    data["sketch"] = np.array(t.column("sketch").to_pylist(), np.int64).tobytes()
    return pa.table({**{c: t.column(c).slice(0, 1) for c in ("band", "class", "part")}, **{c: pa.array([x], pa.binary()) for c, x in data.items()}})


def _mated(t: pa.Table) -> pa.Table:
    """Members of one or two packs that fit one of another component."""
    sides = [[np.frombuffer(r[c], np.int64) for c in ("node", "comp", "size")] + [np.frombuffer(r["sketch"], _U).reshape(-1, -(-M // 64))] for r in t.select(["node", "comp", "size", "sketch"]).to_pylist()]
    one, two = sides[0], sides[-1]
    found = [np.zeros(len(one[0]), bool), np.zeros(len(two[0]), bool)]
    for i in range(len(one[0])):
        fit = (two[1] != one[1][i]) & (np.minimum(two[2], one[2][i]) >= SIMILARITY * np.maximum(two[2], one[2][i]))
        at = np.flatnonzero(fit)
        at = at[np.bitwise_count(two[3][at] ^ one[3][i]).sum(axis=1) <= MOST_APART]
        found[0][i] |= len(at) > 0
        found[1][at] = True
    node, comp = (np.concatenate([s[k][f] for s, f in zip((one, two), found, strict=True)]) for k in range(2))
    return pa.table({"band": pa.array([t.column("band")[0].as_py()] * len(node), pa.int64()), "node": pa.array(node, pa.int64()), "comp": pa.array(comp, pa.int64())})


def _fitting(t: pa.Table) -> pa.Table:
    """Of the blocks p and q of a bucket (all columns of one group): members with the later ones (mates) whose links could join components, and these."""
    node, comp, size, block = (t.column(c).to_numpy() for c in ("node", "comp", "size", "block"))
    sketch, bands = (np.array(t.column(c).to_pylist(), np.int64) for c in ("sketch", "bands"))
    sketch = sketch.view(_U)  # bits of signed numbers would be counted of their absolute value
    key, within = t.column("band")[0].as_py(), t.column("p")[0].as_py() == t.column("q")[0].as_py()
    mates: dict[int, list[int]] = {}
    for i in range(len(node)):
        rest = slice(i + 1, None)
        fit = (comp[rest] != comp[i]) & (np.minimum(size[rest], size[i]) >= SIMILARITY * np.maximum(size[rest], size[i]))
        fit &= within | (block[rest] != block[i])
        at = np.flatnonzero(fit) + i + 1
        at = at[np.bitwise_count(sketch[at] ^ sketch[i]).sum(axis=1) <= MOST_APART]
        if len(at):
            equal = bands[at] == bands[i]
            at = at[bands[i][equal.argmax(axis=1)] == key]
        if len(at):
            mates.setdefault(i, []).extend(node[at].tolist())
            for j in at.tolist():
                mates.setdefault(j, [])
    rows = sorted(mates)
    return pa.table([*(t.column(c).take(pa.array(rows, pa.int64())) for c in ("band", "p", "q", "node", "comp")), pa.array([mates[i] for i in rows], pa.list_(pa.int64()))], names=["band", "p", "q", "node", "comp", "mates"])


def _linked(t: pa.Table) -> pa.Table:
    """Links between members of a group and their mates."""
    comp, text = t.column("comp").to_numpy().copy(), t.column("text")
    node = t.column("node").to_pylist()
    place, counted, links = {n: k for k, n in enumerate(node)}, {}, []
    for i, mates in enumerate(t.column("mates").to_pylist()):
        for j in map(place.__getitem__, mates):
            if comp[j] == comp[i]:
                continue
            for k in (i, j):
                if k not in counted:
                    counted[k] = _counted(text[k].as_py())
            if overlap(counted[i], counted[j]) >= SIMILARITY:
                links.append((node[i], node[j]))
                comp[comp == comp[j]] = comp[i]
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _verify(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs whose sizes and sketches allow the similarity and whose texts have it."""
    side = lambda c, *more: held.select(F.col("node").alias(c), *(F.col(m).alias(f"{m}_{c}") for m in more))
    d = pairs.join(side("a", "size", "sketch"), "a").join(side("b", "size", "sketch"), "b")
    close = saved(d.filter(_can_be_similar(F.col("size_a"), F.col("sketch_a"), F.col("size_b"), F.col("sketch_b"))).select("a", "b"), "close")
    d = close.join(side("a", "text"), "a").join(side("b", "text"), "b")
    return d.sortWithinPartitions("b").select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a bigint, b bigint")
