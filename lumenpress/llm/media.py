"""Media columns by content-defined payload chunking.

A payload becomes a WAV file of one channel of unsigned 8-bit samples. The file is cut where a rolling gear hash
of the last 32 bytes matches a mask (chunks of MIN to MAX bytes, about 4 KB on average), so that equal passages
give equal chunks wherever they stand. Chunks are named by SHA-256.

Store: each task writes the chunks of its rows, each once, into a pack file. Joins on the digests give every
chunk one address, the smallest of its copies', so no chunk bytes are ever shuffled. Packs in which more than
GARBAGE of the bytes belong to chunks kept elsewhere are rewritten without them. A media row is the ordered list
of its chunks' addresses; reading fetches the byte ranges, checks every digest, and puts the file together.

Every attempt of a task writes packs of its own names, which its rows carry, so a repeated attempt can't change
what the lists point to; packs of attempts that didn't count are deleted.

Defined cases: null text is an empty payload, which is padded like any other. Repeated rows are rows of
their own that share all chunks. Payloads of any length are cut and written in bounded memory beside the
payload itself.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, saved, scratch_path, unpacked
from .store import attempt_name, delete, new_run, opened, parts_for, put, sweep

UNIT = 192
MIN, MAX, MASK = 1024, 32768, (1 << 12) - 1
PACK_BYTES = 64 << 20
GARBAGE = 0.25
RATE = 8000
WINDOW = 32
SUFFIX = ".pack"

_GEAR = np.frombuffer(b"".join(hashlib.sha256(bytes([k])).digest()[:4] for k in range(256)), "<u4")


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """Rolling gear hash at every byte: the sum of the last 32 bytes' values, each shifted by its distance."""
    h = _GEAR[raw]
    for by in (1, 2, 4, 8, 16):
        prev = h[:-by] << np.uint32(by) if len(h) > by else h[:0]
        h = h.copy()
        h[by:] += prev
    return h


def cuts(raw: bytes) -> list[int]:
    """Where the chunks of a file end. Hashes are taken in blocks, so memory beside the file is bounded."""
    size, out, last, at = len(raw), [], 0, 0
    data = np.frombuffer(raw, np.uint8)
    while at < size:
        lo = max(0, at - WINDOW + 1)
        to = min(size, at + (1 << 20))
        h = gear_hashes(data[lo:to])[at - lo :]
        for c in (np.flatnonzero((h & np.uint32(MASK)) == MASK) + at + 1).tolist():
            while c - last > MAX:
                last += MAX
                out.append(last)
            if c - last >= MIN and size - c >= MIN:
                out.append(c)
                last = c
        at = to
    while size - last > MAX:
        last += MAX
        out.append(last)
    if last < size:
        out.append(size)
    return out


def payload_of(text: str | bytes | None) -> bytes:
    raw = (text.encode() if isinstance(text, str) else text) or b""
    return raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def wav(payload: bytes) -> bytes:
    """A RIFF WAVE file of unsigned 8-bit mono samples; the payload has an even length."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples_of(media: bytes) -> bytes:
    kind, size = struct.unpack_from("<4sI", media, 36)
    if media[:4] != b"RIFF" or kind != b"data" or size != len(media) - 44:
        raise ValueError("not a media file of this store")
    return media[44:]


def feature(samples: bytes) -> str:
    """Mean, spread, zero crossings about the mean, and entropy of the samples."""
    n = np.bincount(np.frombuffer(samples, np.uint8), minlength=256).astype(float)
    total = n.sum()
    level = np.arange(256)
    mean = (n * level).sum() / total
    spread = np.sqrt(max(0.0, (n * level * level).sum() / total - mean * mean))
    above = np.frombuffer(samples, np.uint8) > mean
    crossings = np.count_nonzero(above[1:] != above[:-1])
    p = n[n > 0] / total
    return f"mean={mean:.4f};spread={spread:.4f};crossings={crossings};entropy={-(p * np.log2(p)).sum():.4f}"


def _writer(folder: str, run: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        state: dict = {"n": 0, "blocks": [], "size": 0, "have": {}}
        attempt = ""

        def flush() -> None:
            if state["blocks"]:
                put(f"{folder}/{attempt}-{state['n']:05d}{SUFFIX}", state["blocks"])
            state.update(n=state["n"] + 1, blocks=[], size=0, have={})

        for b in batches:
            attempt = attempt or attempt_name(run)
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out: dict[str, list] = {k: [] for k in ("n_bytes", "media_bytes", "media_sha256", "chunks")}
                for raw in part.column("raw").to_pylist():
                    media = wav(payload_of(raw))
                    chunks, at = [], 0
                    for to in cuts(media):
                        chunk = media[at:to]
                        digest = hashlib.sha256(chunk).digest()
                        if digest not in state["have"]:
                            z = packer.compress(chunk)
                            state["have"][digest] = (f"{attempt}-{state['n']:05d}", state["size"], len(z))
                            state["blocks"].append(z)
                            state["size"] += len(z)
                        pack, offset, size = state["have"][digest]
                        chunks.append({"digest": digest, "pack": pack, "offset": offset, "size": size})
                        at = to
                    out["n_bytes"].append(len(raw or b""))
                    out["media_bytes"].append(len(media))
                    out["media_sha256"].append(hashlib.sha256(media).hexdigest())
                    out["chunks"].append(chunks)
                    if state["size"] >= PACK_BYTES:
                        flush()
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(out["n_bytes"], pa.int64()), pa.array(out["media_bytes"], pa.int64()), pa.array(out["media_sha256"], pa.string()), pa.array(out["chunks"], pa.list_(_CHUNK))], names=["row", *out])
        flush()

    return write


_CHUNK = pa.struct([("digest", pa.binary()), ("pack", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])
_CHUNK_SQL = "struct<digest:binary,pack:string,offset:bigint,size:bigint>"


def write_media(df: DataFrame, raw: Column, carry: list[str], folder: str) -> DataFrame:
    """Chunk and store the payloads of df: carried columns (struct row), at, n_bytes, media_bytes, media_sha256, chunks.

    chunks has, in order, digest and address of each chunk; equal chunks of the whole table have one address.
    """
    rows = df.select(packed(carry), raw.alias("raw"))
    names = f"n_bytes bigint, media_bytes bigint, media_sha256 string, chunks array<{_CHUNK_SQL}>"
    kinds = T.StructType([rows.schema["row"], *T.StructType.fromDDL(names).fields])
    run = new_run()
    written = saved(rows.mapInArrow(_writer(folder, run), kinds).withColumn("at", F.monotonically_increasing_id()), "media")
    sweep(folder, run, written.select(F.explode("chunks.pack")), SUFFIX)
    each = written.select("at", F.posexplode("chunks").alias("place", "c")).select("at", "place", "c.*")
    address = F.struct("pack", "offset", "size")
    copies = each.select("digest", address.alias("a")).groupBy("digest").agg(F.min("a").alias("a"), F.count_distinct("a").alias("n"))
    copies = saved(copies, "chunks")
    shared = copies.filter("n > 1").select("digest", "a")
    # chunks in one place keep their address; those in several places get the smallest
    moved = each.select("at", "digest").join(shared, "digest").groupBy("at").agg(F.map_from_entries(F.collect_set(F.struct("digest", "a"))).alias("moved"))
    d = written.join(moved, "at", "left")
    new = F.transform("chunks", lambda c: F.coalesce(F.when(F.col("moved").isNotNull(), F.try_element_at("moved", c["digest"])), F.struct(c["pack"].alias("pack"), c["offset"].alias("offset"), c["size"].alias("size"))))
    fixed = F.zip_with("chunks", new, lambda c, a: F.struct(c["digest"].alias("digest"), a["pack"].alias("pack"), a["offset"].alias("offset"), a["size"].alias("size")))
    return saved(d.withColumn("chunks", fixed).drop("moved"), "media-lists")


def compact(lists: DataFrame, folder: str, garbage: float = GARBAGE) -> DataFrame:
    """Rewrite packs with more than this share of bytes that no list uses; gives the lists with their new addresses.

    Each pack's task gets the ranges in use (bounded by the pack), copies them to a new pack and drops the old one
    once the new lists are written.
    """
    used = lists.select(F.explode("chunks").alias("c")).select("c.pack", "c.offset", "c.size").distinct()
    run = new_run()
    ranges = used.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("offset", "size"))).alias("ranges"))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, own in zip(b.column("pack").to_pylist(), b.column("ranges").to_pylist(), strict=True):
                files, path = opened(f"{folder}/{pack}{SUFFIX}")
                size = files.get_file_info(path).size
                if sum(r["size"] for r in own) >= (1 - garbage) * size:
                    continue
                with files.open_input_file(path) as f:

                    def parts(f=f, own=own):
                        for r in own:
                            f.seek(r["offset"])
                            yield f.read(r["size"])

                    new = f"{pack}-{attempt_name(run)}"
                    put(f"{folder}/{new}{SUFFIX}", parts())
                to = np.cumsum([0] + [r["size"] for r in own])[:-1].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([pack] * len(own)), pa.array([r["offset"] for r in own]), pa.array([new] * len(own)), pa.array(to, pa.int64())], names=["pack", "offset", "new", "to"])

    moved = saved(ranges.mapInArrow(copy, "pack string, offset bigint, new string, to bigint"), "media-moved")
    if not moved.limit(1).count():
        return lists
    each = lists.select("at", F.posexplode("chunks").alias("place", "c")).join(moved, (F.col("c.pack") == F.col("pack")) & (F.col("c.offset") == F.col("offset")))
    new = each.groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct("new", "to")))).alias("to"))
    d = lists.join(new, "at", "left")
    fixed = F.transform("chunks", lambda c, i: F.when(F.col("to").isNotNull() & F.try_element_at("to", i).isNotNull(), F.struct(c["digest"].alias("digest"), F.try_element_at("to", i)["new"].alias("pack"), F.try_element_at("to", i)["to"].alias("offset"), c["size"].alias("size"))).otherwise(c))
    out = saved(d.withColumn("chunks", fixed).drop("to"), "media-lists")
    sweep(folder, run, moved.select("new"), SUFFIX)
    delete(folder, moved.select("pack").distinct(), SUFFIX)
    return out


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        files, root = opened(folder)
        handles: dict = {}

        def handle(pack: str):
            if pack not in handles:
                if len(handles) >= 64:
                    handles.pop(next(iter(handles))).close()
                handles[pack] = files.open_input_file(f"{root}/{pack}{SUFFIX}")
            return handles[pack]

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
                for chunks, size, name in zip(part.column("chunks").to_pylist(), part.column("media_bytes").to_pylist(), part.column("media_sha256").to_pylist(), strict=True):
                    parts = []
                    for c in chunks:
                        f = handle(c["pack"])
                        f.seek(c["offset"])
                        raw = expand.decompress(f.read(c["size"]), max_output_size=MAX)
                        if hashlib.sha256(raw).digest() != c["digest"]:
                            raise ValueError(f"chunk {c['digest'].hex()} in {c['pack']} is damaged")
                        parts.append(raw)
                    media = b"".join(parts)
                    if len(media) != size or hashlib.sha256(media).hexdigest() != name:
                        raise ValueError(f"media {name} is damaged")
                    samples = samples_of(media)
                    for k, v in zip(out, (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), size, name, feature(samples)), strict=True):
                        out[k].append(v)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("n_bytes"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=["row", "n_bytes", *out])
        for f in handles.values():
            f.close()

    return read


def read_media(lists: DataFrame, folder: str, carry: list[str]) -> DataFrame:
    """Put the media of lists together again: carried columns with sizes, digests and features."""
    names = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    kinds = T.StructType([lists.schema["row"], *T.StructType.fromDDL(names).fields])
    # tasks by the media they read, not by the bytes of the lists; neighbours share packs
    parts = parts_for(lists.agg(F.sum("media_bytes")).first()[0])
    lists = lists.repartitionByRange(parts, "at").select("row", "n_bytes", "media_bytes", "media_sha256", "chunks")
    return lists.mapInArrow(_reader(folder), kinds).select(*unpacked(carry, *(x.split(" ")[0] for x in names.split(", "))))


def media_column(df: DataFrame, text: str = "text", carry: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """Store the texts of df as media and read them back: carried columns with sizes, digests and features.

    folder (default: a new one in the shared folder) keeps the packs.
    """
    carry = df.columns if carry is None else carry
    folder = folder or scratch_path(df.sparkSession, "packs")
    return read_media(compact(write_media(df, F.encode(F.col(text), "UTF-8"), carry, folder), folder), folder, carry)
