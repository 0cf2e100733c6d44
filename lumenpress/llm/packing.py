"""Packing documents into token sequences by vector best-fit.

A document's token ids, and the end id after them, are one piece, or pieces of the sequence length if they
are longer. A sequence has three capacities: tokens, documents, and attention cost (the sum of squared piece
lengths). Pieces, longest first, go to the open sequence that can take them in all three and is then left with
the least residual: by the weighted norm of what remains of each capacity, or by the weighted dot product of
the piece's needs with what remains (``rule``).

Pieces are dealt by hash into groups of about GROUP pieces, each packed by one task, so that a task's memory
doesn't depend on the corpus; a group leaves about one sequence partly filled.

Tokens: a text is cut into the parts that the tokenizer encodes one by one; the ids of parts seen before come
from a bounded cache, and new parts are encoded together.

Defined cases: null or empty text is the end id alone. Repeated rows and null keys are packed like others.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, saved, unpacked

LENGTH = 4096
END_ID = 1
GROUP = 4096
CACHE = 1_000_000
BLOCK = 1 << 19

_LATIN = [chr(c) for c in range(0x250)]
_LETTERS = "".join(c for c in _LATIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _LATIN if unicodedata.category(c)[0] == "N")
#: How the tokenizer cuts texts into parts (contractions, letters, single numbers, the rest), for texts in Latin letters.
_PARTS = re.compile(rf"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTERS}{_NUMBERS}]+")
_ODD = "\x1c\x1d\x1e\x1f"  # white space for Python only
#: Texts for which Python's and the tokenizer's lower case and white space agree, and normalisation changes nothing:
#: of characters whose lower case has only letters of the patterns above (or the dot that a capital dotted I leaves).
_PLAIN = re.compile(f"[{re.escape(''.join(c for c in _LATIN if c not in _ODD and all(x < chr(0x250) or x == chr(0x307) for x in c.lower())))}]*")
_ASCII_SPACE = re.compile(r"[\x20\x09-\x0d]+")


class Encoder:
    """Little-endian 32-bit ids of texts, equal to encoding each whole text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _keys(self, text: str) -> list[str]:
        """The parts of a text; a word that isn't plain stays whole, marked by a character that plain parts never have."""
        if (not any(c in text for c in _ODD) if text.isascii() else _PLAIN.fullmatch(text)) and not any(t in text for t in self.special):
            return _PARTS.findall(text.lower())
        out = []
        for w in _ASCII_SPACE.split(text):
            if _PLAIN.fullmatch(w) and not any(t in w for t in self.special):
                out += _PARTS.findall(w.lower())
            elif w:
                out.append("\x1c" + w)
        return out

    def _learn(self, new: list[str]) -> None:
        if len(self.known) > CACHE:
            self.known.clear()
        whole = [p for p in new if p[0] == "\x1c"]
        self.known.update(zip(whole, self._whole([p[1:] for p in whole]), strict=True))
        parts = [p for p in new if p[0] != "\x1c"]
        ids = np.array(self.tokenizer.encode(" ".join(parts), add_special_tokens=False).ids, "<u4")
        to = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()  # each part's last token has the end mark
        if len(to) == len(parts):
            raw = ids.tobytes()
            self.known.update(zip(parts, [raw[i:j] for i, j in zip([0, *to], to, strict=False)], strict=True))
        else:
            self.known.update(zip(parts, self._whole(parts), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._keys(t) for t in texts]
        get = self.known.get
        ids = [list(map(get, parts)) for parts in cut]
        gaps = [[i for i, x in enumerate(found) if x is None] for found in ids]
        new = list({parts[i] for parts, own in zip(cut, gaps, strict=True) for i in own})
        if new:
            self._learn(new)
            for parts, found, own in zip(cut, ids, gaps, strict=True):
                for i in own:
                    found[i] = get(parts[i])
        return [b"".join(found) for found in ids]


def _blocks(text: str) -> Iterator[str]:
    """text in blocks of bounded size, cut at white space."""
    at = 0
    while at < len(text):
        space = _ASCII_SPACE.search(text, at + BLOCK) if len(text) - at > BLOCK else None
        to = space.end() if space else len(text)
        yield text[at:to]
        at = to


def _encoded(encoder: Encoder, texts: list[str | None]) -> Iterator[tuple[int, bytes]]:
    """(row, ids) for each text, texts taken together in blocks of bounded size."""
    held: list[int] = []
    size = 0
    for k, t in enumerate(texts):
        if t and len(t) > BLOCK:
            yield k, b"".join(x for b in _blocks(t) for x in encoder.encode([b]))
            continue
        held.append(k)
        size += len(t or "")
        if size > BLOCK:
            yield from zip(held, encoder.encode([texts[i] or "" for i in held]), strict=True)
            held, size = [], 0
    if held:
        yield from zip(held, encoder.encode([texts[i] or "" for i in held]), strict=True)


_ENCODERS: dict[str, Encoder] = {}


def _cutter(path: str | None, length: int, end_id: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path
        if where is None:
            import public_tokenizers

            where = public_tokenizers.path("word_bpe_49k.json")
        if where not in _ENCODERS:
            _ENCODERS[where] = Encoder(where)
        encoder = _ENCODERS[where]
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                rows, number, start, size, crc, ids = [], [], [], [], [], []
                for k, raw in _encoded(encoder, part.column("text").to_pylist()):
                    raw += end
                    for j, at in enumerate(range(0, len(raw), 4 * length)):
                        piece = raw[at : at + 4 * length]
                        rows.append(k)
                        number.append(j)
                        start.append(at // 4)
                        size.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        ids.append(piece)
                columns = [part.column("row").take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                names = ["row", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return cut


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float], rule: str = "norm") -> np.ndarray:
    """The bin of each piece. A piece alone always has a bin, even if it passes a capacity by itself."""
    need = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], axis=1) / np.array(capacity, float)
    w = np.array(weights, float)
    out = np.empty(len(lengths), np.int64)
    left, name, n, made = np.empty((len(lengths), 3)), np.empty(len(lengths), np.int64), 0, 0
    order = np.argsort(-lengths, kind="stable")
    least = need[order[-1], 0] if len(order) else 0
    for i in order:
        q = need[i]
        room = left[:n] - q
        fits = np.flatnonzero((room >= -1e-12).all(axis=1))
        if len(fits):
            score = (room[fits] ** 2) @ w if rule == "norm" else -((left[fits] * q) @ w)
            b = fits[np.argmin(score)]
            left[b] -= q
            out[i] = name[b]
        else:
            b = n
            left[b], name[b], out[i] = 1 - q, made, made
            n, made = n + 1, made + 1
        if left[b, 0] < least - 1e-12:  # full: the last open one takes its place
            n -= 1
            left[b], name[b] = left[n], name[n]
    return out


def _packer(length: int, documents: int, attention: float, weights: tuple[float, float, float], rule: str):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "at"], ascending=[False, True], kind="stable", ignore_index=True)
        bins = best_fit(pdf["length"].to_numpy(), (length, documents, attention), weights, rule)
        size = pdf["length"].to_numpy()
        order = np.argsort(bins, kind="stable")
        run = np.cumsum(size[order]) - size[order]
        first = np.append(True, bins[order][1:] != bins[order][:-1]) if len(order) else np.zeros(0, bool)
        offset = np.empty(len(order), np.int64)
        offset[order] = run - np.repeat(run[first], np.diff(np.append(np.flatnonzero(first), len(order))))
        return pdf[["at", "group"]].assign(sequence_id=(pdf["group"].to_numpy(np.int64) << 32) + bins, offset=offset)

    return pack


def pack(
    df: DataFrame,
    text: str = "text",
    carry: list[str] | None = None,
    tokenizer: str | None = None,
    length: int = LENGTH,
    documents: int = LENGTH,
    attention: float = float(LENGTH) ** 2,
    weights: tuple[float, float, float] = (1.0, 0.001, 0.01),
    rule: str = "norm",
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """The carried columns with piece, start, length, ids_crc32, sequence_id and offset (and ids): a row per piece.

    tokenizer is the vocabulary file; None finds the public one on each executor. The default capacities of
    documents and attention are those that any set of pieces within the token capacity keeps.
    """
    carry = df.columns if carry is None else carry
    rows = df.select(packed(carry), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        schema = schema.add("ids", T.BinaryType())
    pieces = rows.mapInArrow(_cutter(tokenizer, length, end_id, with_ids), schema).withColumn("at", F.monotonically_increasing_id())
    pieces = saved(pieces, "pieces")
    groups = max(1, -(-pieces.count() // GROUP))
    light = pieces.select("at", "length", F.pmod(F.xxhash64("at"), F.lit(groups)).cast("int").alias("group"))
    if not with_ids:  # then a row is small, and goes with its piece
        light = pieces.withColumn("group", F.pmod(F.xxhash64("at"), F.lit(groups)).cast("int"))
        out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
        place = _packer(length, documents, attention, weights, rule)

        def placed(t: pa.Table) -> pa.Table:
            got = place(t.select(["at", "length", "group"]).to_pandas())
            t = t.drop_columns(["group"])
            spot = pd.Series(np.arange(len(got)), index=got["at"]).loc[t.column("at").to_numpy()].to_numpy()
            return t.append_column("sequence_id", pa.array(got["sequence_id"].to_numpy()[spot])).append_column("offset", pa.array(got["offset"].to_numpy()[spot]))

        d = light.groupBy("group").applyInArrow(placed, out)
    else:
        d = light.groupBy("group").applyInPandas(_packer(length, documents, attention, weights, rule), "at bigint, group int, sequence_id bigint, offset bigint")
        d = pieces.join(d.drop("group"), "at")
    names = ["piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", "offset"]
    return d.select(*unpacked(carry, *names))
