"""WARC archives as seekable Zstandard bundles.

A task's records go to archive files. Records are grouped into frames of about FRAME bytes, each compressed
independently, and a file ends with a seek table in the Zstandard seekable format (a skippable frame that any
decoder passes over), so a reader can fetch any frame alone. The index maps a record id to its archive, frame,
and the offset within the decompressed frame.

Of records with equal payloads of at least ``revisit_from`` bytes, that with the smallest id is written as a
response, the others as revisits: their block has the HTTP headers alone, with the length of the full
payload. Only digests and ids are shuffled to decide this, and rows move only if the table of revisits is too
large for Spark to send it around.

Defined cases: null html is an empty payload, null url an empty target; a null id is written as ``null`` and
is a response only where no equal payload has an id. Repeated rows with the smallest id are all responses, as a
revisit names its response by id and none of them could name another. Every attempt of a task writes archives of its
own names, which its index rows carry. A record larger than a frame has a frame of its own. An empty
table makes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, scratch_path
from .store import attempt_name, new_run, opened, parts_for, put, sweep

FRAME = 1 << 20
ARCHIVE = 256 << 20
LEVEL = 3
# Fixed values of the Zstandard seekable format.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
#: Characters that a target URI keeps as they are, percent sign excluded so that decoding gives the url back.
SAFE = "!#$&'()*+,/:;=?@[]~"
DATE = "2024-01-31T00:00:00Z"
SUFFIX = ".warc.zst"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame for (compressed, decompressed) sizes, without checksums."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, FOOTER)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """Of an open file: (offset, compressed, decompressed) of each frame."""
    f.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != FOOTER or flags & 0x7F:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    f.seek(size - 9 - n * width)
    raw, at, out = f.read(n * width), 0, []
    for k in range(n):
        c, d = struct.unpack_from("<II", raw, k * width)
        out.append((at, c, d))
        at += c
    return out


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None) -> str:
    return f"<urn:page:{'null' if key is None else key}>"


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {urllib.parse.quote(url or '', safe=SAFE)}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record, its payload (empty for a revisit) and the length of the full payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {"fields": fields, "payload": payload, "length": length}


_INDEX = "id bigint, archive string, frame int, offset bigint, length bigint"


def _writer(folder: str, run: str, frame_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        n, attempt = 0, ""
        done: list[tuple] = []  # of this archive: (id, frame, offset, length)
        frames: list[tuple[int, int]] = []
        blocks: list[bytes] = []
        held: list[bytes] = []
        size = packed = 0

        def close_frame() -> None:
            nonlocal size, packed
            if held:
                z = packer.compress(b"".join(held))
                frames.append((len(z), size))
                blocks.append(z)
                packed += len(z)
                held.clear()
                size = 0

        def close_archive() -> pa.RecordBatch:
            nonlocal n, packed
            close_frame()
            name = f"{attempt}-{n:05d}"
            put(f"{folder}/{name}{SUFFIX}", [*blocks, seek_table(frames)])
            ids, number, offset, length = zip(*done, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([name] * len(ids)), pa.array(number, pa.int32()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=["id", "archive", "frame", "offset", "length"])
            n, packed = n + 1, 0
            done.clear()
            frames.clear()
            blocks.clear()
            return out

        for b in batches:
            attempt = attempt or attempt_name(run)
            columns = (b.column(k) for k in ("id", "url", "payload", "refers_to"))
            for key, url, payload, refers in zip(*columns, strict=True):
                raw = record(key.as_py(), url.as_py(), payload.as_py() or b"", refers.as_py())
                if size and size + len(raw) > frame_bytes:
                    close_frame()
                done.append((key.as_py(), len(frames), size, len(raw)))
                held.append(raw)
                size += len(raw)
                if packed >= ARCHIVE:
                    yield close_archive()
        if done:
            yield close_archive()

    return write


def write_archives(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 0, frame_bytes: int = FRAME) -> DataFrame:
    """Write a record per row into archives below folder; gives the index (id, archive, frame, offset, length)."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    facts = saved(rows.select("id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("n")).filter(F.col("n") >= revisit_from), "warc-digests")
    firsts = facts.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 and first is not null")
    again = facts.join(firsts, "sha").filter(~F.col("id").eqNullSafe(F.col("first")))
    again = saved(again.select(F.col("id").alias("of"), F.unhex("sha").alias("sha"), F.col("first").alias("refers_to")).distinct(), "warc-revisits")
    # by id and payload, as an id may be repeated with other payloads
    d = rows.withColumn("own", F.unhex(F.sha1("payload"))).join(again, F.col("id").eqNullSafe(F.col("of")) & (F.col("own") == F.col("sha")), "left")
    run = new_run()
    index = saved(d.select("id", "url", "payload", "refers_to").mapInArrow(_writer(folder, run, frame_bytes), _INDEX), "warc-index")
    sweep(folder, run, index.select("archive"), SUFFIX)
    return index


_READ = "id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target_uri string"


def _reader(folder: str, with_payload: bool):
    def number(urn: str) -> int | None:
        word = urn[len("<urn:page:") : -1]
        return None if word == "null" else int(word)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        files, root = opened(folder)
        name, f, table = None, None, []
        for b in batches:
            for archive, frame, places in zip(b.column("archive").to_pylist(), b.column("frame").to_pylist(), b.column("places").to_pylist(), strict=True):
                if archive != name:
                    if f:
                        f.close()
                    path = f"{root}/{archive}{SUFFIX}"
                    name, f = archive, files.open_input_file(path)
                    table = read_seek_table(f, files.get_file_info(path).size)
                at, c, d = table[frame]
                f.seek(at)
                raw = expand.decompress(f.read(c), max_output_size=d)
                out: list[list] = [[] for _ in range(7)]
                for p in places:
                    r = parse(raw[p["offset"] : p["offset"] + p["length"]])
                    h = r["fields"]
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and digest_of(r["payload"]) != digest:
                        raise ValueError(f"{h['WARC-Record-ID']} in {archive} is damaged")
                    refers = h.get("WARC-Refers-To")
                    for k, v in enumerate((number(h["WARC-Record-ID"]), r["length"], digest, h["WARC-Type"], number(refers) if refers else None, urllib.parse.unquote(h["WARC-Target-URI"]), r["payload"])):
                        out[k].append(v)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                names = [x.split(" ")[0] for x in _READ.split(", ")] + ["payload"]
                n = 7 if with_payload else 6
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out[:n], kinds, strict=False)], names=names[:n])
        if f:
            f.close()

    return read


def read_archives(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Records back from their frames: id, payload_bytes, payload_digest, record_type, refers_to, target_uri (and payload).

    A frame is fetched and decompressed once for all its records in the index; for single records filter the index.
    """
    place = F.struct("offset", "length")
    frames = index.groupBy("archive", "frame").agg(F.array_sort(F.collect_list(place)).alias("places"))
    schema = T.StructType.fromDDL(_READ + (", payload binary" if with_payload else ""))
    # tasks by what they read from archives, not by the bytes of the index
    parts = parts_for(index.agg(F.sum("length")).first()[0])
    frames = frames.repartitionByRange(parts, "archive", "frame")
    return frames.sortWithinPartitions("archive", "frame").mapInArrow(_reader(folder, with_payload), schema)


def archive(df: DataFrame, folder: str | None = None, **how) -> DataFrame:
    """Write all rows of df, then read every record back."""
    folder = folder or scratch_path(df.sparkSession, "warc")
    return read_archives(write_archives(df, folder, **how), folder)
