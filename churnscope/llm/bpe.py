"""Byte-level BPE encoding and decoding with the tokenizers library (operator 7).

The rank file gives the vocabulary; the merge rules follow from it: a pair of
tokens whose bytes together are a token may merge, lower rank first. Each byte
is written as one printable character (the byte-to-character mapping), so the
library's BPE model works on strings. Encoding runs over Arrow batches. A text
is cut into the pattern's matches; each distinct match is encoded once by the
library and kept in bounded per-process tables, because invented or natural
prose repeats its words. Decoding looks each id's bytes up and joins them; a
character whose bytes are split between tokens comes out whole when its ids
are together, and as U+FFFD in ``decode_text`` when the id list cuts it.

Defined results: a null text encodes as an empty text (no ids); a null id list
decodes to no bytes; ids outside the vocabulary raise ``KeyError``; other
columns pass through untouched, and an input column named like an output
column is replaced.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.llm.common import KEPT, drop_clashing, read, released

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of tables kept per process: chunks of text, and single matches.
CHUNKS_KEPT, PIECES_KEPT = 40 << 20, 48 << 20
#: Bytes of text encoded before an output batch is handed on.
SLICE_BYTES = 1 << 20


def byte_chars() -> list[str]:
    """One printable character per byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def merge_rules(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every split of a token into two tokens, in the order of the whole token's rank."""
    return [(t[:k], t[k:]) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]


class Bounded(dict):
    """A table that fills itself by ``make`` and starts anew beyond ``limit`` bytes of keys, values and places.

    An entry of more than a thousandth of the limit is made anew each time."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.size = make, limit, 0

    def __missing__(self, key):
        value = self.make(key)
        size = 100 + sys.getsizeof(key) + sys.getsizeof(value)
        if 1000 * size > self.limit:
            return value
        if self.size + size > self.limit:
            self.clear()
        self[key] = value
        self.size += size
        return value

    def clear(self):
        super().clear()
        self.size = 0


class ByteBpe:
    """Encoder and decoder of one rank file; ids travel as little-endian 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import models

        ranks, chars = read_ranks(path), byte_chars()
        shown = {t: "".join(chars[b] for b in t) for t in ranks}
        self.model = models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=[(shown[a], shown[b]) for a, b in merge_rules(ranks)])
        self.chars, self.pattern = chars, regex.compile(pattern)
        self.loose = re.compile(r" (?:\s|\Z)|\0")
        self.plain = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*$%&#|<>()]+)?")
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.pieces = Bounded(self._piece, PIECES_KEPT)
        self.chunks = Bounded(self._chunk, CHUNKS_KEPT)
        self.packed = [i.to_bytes(4, "little") for i in range(max(ranks.values(), default=-1) + 1)]

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            raw = piece.replace(" ", self.chars[32])
        else:
            raw = "".join(map(self.chars.__getitem__, piece.encode()))
        return b"".join([self.packed[t.id] for t in self.model.tokenize(raw)])

    def _chunk(self, chunk: str) -> bytes:
        if m := self.plain.fullmatch(chunk):  # the pattern's two matches in a word and its punctuation
            return self.pieces[m[1]] + (self.pieces[m[2]] if m[2] else b"")
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(chunk)))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text. Where every space precedes a visible character, the pattern's matches never cross
        from one space-led chunk to the next, so the chunks are looked up; any other text is matched as a whole."""
        if self.loose.search(text):
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        return b"".join(map(self.chunks.__getitem__, text.replace(" ", "\0 ").split("\0")))

    def offsets(self, ids: list[int], text: str) -> list[int]:
        """The character of ``text`` in which each id begins (ids inside one character share it)."""
        ends = np.cumsum([0, *(len(self.bytes_of[i]) for i in ids)])
        leads = np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80
        return (np.cumsum(leads)[ends[:-1]] - 1).tolist() if ids else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


KEPT.append(("bpe", codec.cache_clear))


def slices(column: pa.Array) -> Iterator[list]:
    """The values of a text or binary column, a bounded number of bytes at a time (one value at least)."""
    values, size = [], 0
    for v in column:
        values.append(v.as_py())
        size += len(values[-1] or "")
        if size >= SLICE_BYTES:
            yield values
            values, size = [], 0
    if values:
        yield values


def id_lists(blobs: list[bytes]) -> pa.Array:
    """A list<int32> array of id bytes, without a Python object per id."""
    ends = np.cumsum([0, *(len(b) // 4 for b in blobs)], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(blobs), "<i4")))


def id_runs(column: pa.Array) -> Iterator[list[int]]:
    """The ids of each row of a list column (null: none), without an Arrow scalar per id, which takes longer than decoding."""
    ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(column), 0).to_pylist()]).tolist()
    ids = column.flatten().to_numpy(zero_copy_only=False)
    return (ids[a:b].tolist() for a, b in itertools.pairwise(ends))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and, if asked for, ``offsets`` (the character each id begins in).

    One pass without a shuffle; a batch is bounded by Arrow's batch size, its output by ``SLICE_BYTES`` of text."""
    docs = drop_clashing(docs, ["ids", "offsets"])
    out = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("offsets", T.ArrayType(T.IntegerType()))] * offsets])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(text)):
                blobs = [bpe.encode(t or "") for t in texts]
                columns = [*batch.slice(at, len(texts)).columns, id_lists(blobs)]
                if offsets:
                    columns.append(pa.array([bpe.offsets(np.frombuffer(b, "<i4").tolist(), t or "") for b, t in zip(blobs, texts)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out])
                at += len(texts)

    return docs.mapInArrow(released(run, "bpe"), out)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``ids`` replaced by ``decoded`` (binary): the bytes of all ids in order."""
    encoded = drop_clashing(encoded, ["decoded"])
    keep = [c for c in encoded.columns if c != ids]
    out = T.StructType([*(encoded.schema[c] for c in keep), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                decoded = [bpe.decode(x) for x in id_runs(part.column(ids))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(decoded, pa.binary())], names=[f.name for f in out])

    return encoded.mapInArrow(released(run, "bpe"), out)


def decode_text(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """As ``decode``, with ``decoded`` as a string: bytes that make no whole character become U+FFFD."""
    return decode(encoded, path, pattern, ids).withColumn("decoded", F.make_valid_utf8(F.col("decoded").cast("string")))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: number of ids, and hashes of the ids and of the bytes they decode to."""
    encoded = encode(docs.select("doc_id", "text"), path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        "ids",
    )
    return decode(encoded, path, pattern).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
