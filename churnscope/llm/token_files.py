"""Token-id files of independent zstandard frames with a trailing seek table (operator 3).

Documents are range-partitioned and sorted by ``doc_id``; each task encodes its
documents and writes one file to a shared folder. A file is a run of
independent zstandard frames of at most ``FRAME_IDS`` ids (little-endian
unsigned 32-bit), then a skippable frame that holds the seek table: compressed
size, plain size and checksum (low 32 bits of xxh64 of the plain bytes) per
frame, the number of frames, a descriptor byte and a closing magic number. The
layout is zstandard's public seekable format, so standard tools decompress the
files as a whole. An index row per document (file, first id in the file,
number of ids) lets a reader fetch the frames that hold the wanted documents
and no others; every frame it decompresses is checked.

A file's name holds its task's attempt, and the index, which only attempts that
Spark commits write, names the files that count. So a repeated or speculative
task never writes over another's file, and nothing is renamed. Files of lost
attempts are removed once the index stands. Folders are addressed by URI
through Arrow's file systems.

Strings of special tokens in a text become those tokens, as the library's plain
call does; ``plain_specials`` takes them as ordinary text.

Defined results: a null or empty text holds the end id alone; rows with a null
``doc_id`` come first; equal ids are ordered by text, null text first; every
repeated row has its own entry; empty input leaves no files. Other columns are
ignored.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnscope.llm.bpe import Bounded, byte_chars, slices
from churnscope.llm.common import KEPT, new_folder, read, released, shuffle_width, write_table

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Ids per frame at most; a longer document spans frames.
FRAME_IDS = 65_536
#: Bytes of tables kept per process: words as they stand, and their letters.
WORDS_KEPT, STEMS_KEPT = 80 << 20, 80 << 20
#: Magic numbers and descriptor (checksums present) of the seekable format.
SKIPPABLE, SEEKABLE, DESCRIPTOR = 0x184D2A5E, 0x8F92EAB1, 0x80


class WordBpe:
    """A tokenizer file whose tokens never cross ASCII white space, applied word by word.

    A word of Latin letters and plain punctuation is lower-cased, cut where the letters end and handed to the
    library's model; any other word goes through the whole tokenizer. ``tests`` hold both against whole texts."""

    def __init__(self, path: str, plain_specials: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.model, self.chars = self.tokenizer.model, byte_chars()
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*$%&#|<>()]+)?")
        self.stems = Bounded(self._stem, STEMS_KEPT)
        self.words = Bounded(self._word, WORDS_KEPT)

    def _stem(self, stem: str) -> bytes:
        shown = stem if stem.isascii() else "".join(map(self.chars.__getitem__, stem.encode()))
        return b"".join([self.packed[t.id] for t in self.model.tokenize(shown)])

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if m := self.plain.fullmatch(text):
            return self.stems[unicodedata.normalize("NFC", m[1]).lower()] + (self.stems[m[2]] if m[2] else b"")
        return b"".join([self.packed[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, text.split()))


@functools.lru_cache(maxsize=2)
def word_bpe(path: str, plain_specials: bool = False) -> WordBpe:
    return WordBpe(path, plain_specials)


KEPT.append(("token files", word_bpe.cache_clear))


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Writes ids to one file; ``close`` adds the seek table."""

    def __init__(self, folder: str, name: str, level: int):
        import zstandard

        self.fs, path = file_system(folder)
        self.fs.create_dir(path, recursive=True)
        self.out = self.fs.open_output_stream(f"{path}/{name}", compression=None)
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.pending, self.table, self.n_ids = bytearray(), [], 0

    def add(self, ids: bytes) -> int:
        """Appends a document's ids; returns the position of its first id in the file."""
        start = self.n_ids
        self.n_ids += len(ids) // 4
        self.pending += ids
        while len(self.pending) >= 4 * FRAME_IDS:
            self._frame(bytes(self.pending[: 4 * FRAME_IDS]))
            del self.pending[: 4 * FRAME_IDS]
        return start

    def _frame(self, plain: bytes) -> None:
        import xxhash

        packed = self.zstd.compress(plain)
        self.out.write(packed)
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.pending:
            self._frame(bytes(self.pending))
        rows = b"".join(struct.pack("<III", *t) for t in self.table)
        self.out.write(struct.pack("<II", SKIPPABLE, len(rows) + 9) + rows + struct.pack("<IBI", len(self.table), DESCRIPTOR, SEEKABLE))
        self.out.close()


class FrameReader:
    """Random access to the ids of one file; keeps the frame read last."""

    def __init__(self, folder: str, name: str):
        import zstandard

        fs, path = file_system(folder)
        self.file, self.name, self.zstd = fs.open_input_file(f"{path}/{name}"), name, zstandard.ZstdDecompressor()
        size = self.file.size()
        n, descriptor, magic = struct.unpack("<IBI", self._bytes(size - 9, 9))
        if magic != SEEKABLE or descriptor != DESCRIPTOR:
            raise ValueError(f"{name} has no seek table")
        table = list(struct.iter_unpack("<III", self._bytes(size - 9 - 12 * n, 12 * n)))
        self.frames, at = [], 0
        for packed, plain, check in table:
            self.frames.append((at, packed, plain, check))
            at += packed
        self.last, self.decompressed = (-1, b""), 0

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _frame(self, k: int) -> bytes:
        import xxhash

        if self.last[0] != k:
            at, packed, plain, check = self.frames[k]
            data = self.zstd.decompress(self._bytes(at, packed), max_output_size=plain)
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} of {self.name} fails its checksum")
            self.last, self.decompressed = (k, data), self.decompressed + 1
        return self.last[1]

    def ids(self, start: int, n: int) -> bytes:
        """``n`` ids from position ``start``, as little-endian 32-bit integers."""
        parts, at, end = [], 4 * start, 4 * (start + n)
        while at < end:  # every frame but the last holds FRAME_IDS ids
            k, skip = divmod(at, 4 * FRAME_IDS)
            parts.append(self._frame(k)[skip : skip + end - at])
            at += len(parts[-1])
        return b"".join(parts)


def write_documents(docs: DataFrame, folder: str, path: str, end_id: int = 1, level: int = 3, plain_specials: bool = False) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) with the tokenizer file at ``path`` and writes the files to ``folder``.

    Returns the stored index: doc_id, file, pos (first id in the file), n_tokens (end id included)."""
    from pyspark import TaskContext

    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        bpe, name, writer = word_bpe(path, plain_specials), f"part-{task.partitionId():06d}-{task.taskAttemptId():x}-{uuid.uuid4().hex[:8]}.zst", None
        for batch in batches:
            writer, at = writer or FrameWriter(folder, name, level), 0
            for texts in slices(batch.column("text")):
                blobs = [bpe.encode(t or b"") + end for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array([name] * len(texts)), pa.array([writer.add(b) for b in blobs], pa.int64()), pa.array([len(b) // 4 for b in blobs], pa.int64())], names=["doc_id", "file", "pos", "n_tokens"])
                at += len(texts)
        if writer:
            writer.close()

    width = shuffle_width(docs.sparkSession)
    text = F.col("text")
    ordered = docs.select(F.col("doc_id").cast("long"), text.cast("binary").alias("text")).repartitionByRange(width, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    index = write_table(ordered.mapInArrow(released(run, "token files"), "doc_id long, file string, pos long, n_tokens long"), "token-index")
    remove_lost(index, folder)
    return index


def remove_lost(index: DataFrame, folder: str) -> None:
    """Removes files that no index row names; there is at most one file a task and attempt."""
    from pyarrow import fs

    store, path = file_system(folder)
    named = {r["file"] for r in index.select("file").distinct().collect()}
    for found in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if found.is_file and found.base_name not in named:
            store.delete_file(found.path)


def read_documents(index: DataFrame, folder: str) -> DataFrame:
    """``index`` rows with ``ids`` (binary, little-endian 32-bit): only frames that hold these rows are decompressed."""
    from pyspark.sql import types as T

    out = T.StructType([*index.schema.fields, T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, found = batch.slice(at, 500), []
                for name, pos, n in zip(*(part.column(c).to_pylist() for c in ("file", "pos", "n_tokens"))):
                    if reader is None or reader.name != name:
                        reader = FrameReader(folder, name)
                    found.append(reader.ids(pos, n))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=[f.name for f in out])

    return index.mapInArrow(run, out)


def with_start(index: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before this one, over the files in order (one row a file is summed)."""
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("file_start"))
    # one row a file, and a task writes one file: at most as many rows as shuffle partitions
    return index.join(F.broadcast(starts), "file").withColumn("start", F.col("file_start") + F.col("pos")).drop("file_start")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "token-ids")
    index = write_documents(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    stored = read_documents(with_start(index), folder)
    # n_tokens and the checksum come from the ids read back
    return stored.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
