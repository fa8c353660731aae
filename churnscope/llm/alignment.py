"""Cross-tokenizer alignment by an associative fragment monoid (operator 13).

A text is encoded by two tokenizers, A (byte-level BPE) and B (pieces with
byte fallback). Where a token of each ends at the same byte, a group ends. A
stretch of the two token streams is a ``Fragment``: the open prefix up to its
first common end, the closed groups, and the open suffix after its last common
end. Fragments of neighbouring stretches compose: the left one's suffix and the
right one's prefix make one more group. Composition is associative and the
empty fragment is its unit, so a document may be cut into byte ranges anywhere
and put together in any order of reductions.

Encoding: neither tokenizer has a token across a space that follows a
character other than a space and precedes a visible one (A's pattern gives such
a space to what follows; no piece of B has a space after another character,
which is checked when B is loaded). Texts are cut there. The fragments of short
stretches, the words, are kept in a table bounded by bytes; longer stretches
are encoded as they are and cut into byte ranges of ``RANGE``.

Very long documents are cut into chunks of about ``CHUNK`` bytes at such
places before anything is encoded. Chunks are dealt over the tasks, and a tree
of reductions of ``FAN`` neighbours each composes their fragments. All other
documents stay where they are.

Counts: a document passes on its distinct linked id pairs. A task adds them up
before the shuffle. The table of pair counts, with the best of each A id, is
small where vocabularies meet on ordinary text; it is broadcast if it has at
most ``BROADCAST_PAIRS`` rows, and joined by pair otherwise, with the same
result.

Defined results: texts that are null or empty, or whose joined tokens of A or
B differ from a space and the text, have no tokens: zeros and an empty hash;
repeated rows count as documents of their own, null ids too; empty input gives
an empty result; other columns are ignored. Strings of special tokens are
plain text.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.llm.bpe import byte_chars
from churnscope.llm.common import KEPT, read, released, shuffle_width, stored_steps, write_table

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters of a document's chunk, about; documents beyond twice this are cut.
CHUNK = 1 << 17
#: Fragments that one reduction composes.
FAN = 8
#: Bytes of a fragment of a long stretch.
RANGE = 1 << 14
#: Longest stretch, in characters, and bytes of all stretches that a process keeps.
WORD_LENGTH, WORD_BYTES = 64, 128 << 20
#: Pairs a task adds up at once, and the most rows of a broadcast pair table (16 bytes each).
PAIRS_HELD, BROADCAST_PAIRS = 1_000_000, 2_000_000
#: Characters of text whose stretches are looked up, and encoded where they are new, together.
SLICE = 1 << 19
#: Places where no token crosses: a space after a character that is none, before a visible one.
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
LOOSE = re.compile(r" (?:\s|\Z)")


# ---------------------------------------------------------------- the monoid


@dataclass
class Tokens:
    """A run of tokens: ids and byte lengths."""

    ids: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(self.ids + other.ids, self.lengths + other.lengths) if self.ids and other.ids else other if other.ids else self

    def slice(self, start: int, end: int) -> Tokens:
        return Tokens(self.ids[start:end], self.lengths[start:end])


@dataclass
class Fragment:
    """A stretch of both token streams. ``cut`` tells that a common end lies in it; without one all is in the prefix.

    ``groups`` are the closed groups' texts, ``pairs`` the links inside them (A id << 32 | B id) with their numbers."""

    n_a: int = 0
    n_b: int = 0
    cut: bool = False
    head: tuple[Tokens, Tokens] = field(default_factory=lambda: (Tokens(), Tokens()))
    groups: list[bytes] = field(default_factory=list)
    n_groups: int = 0
    pairs: dict[int, int] = field(default_factory=dict)
    tail: tuple[Tokens, Tokens] = field(default_factory=lambda: (Tokens(), Tokens()))


def closed(ids_a: list[int], lengths_a: list[int], ids_b: list[int], lengths_b: list[int]) -> tuple[list[str], list[int]]:
    """Group texts and links of two token streams over the same bytes, walked once: a link between every two neighbouring
    ends of either, a group up to every end of both."""
    groups, pairs, n = [], [], len(ids_a)
    i = j = from_a = from_b = ahead = 0  # ``ahead``: by how many bytes A's end lies behind B's
    if n:
        ahead = lengths_a[0] - lengths_b[0]
    while i < n:
        pairs.append(ids_a[i] << 32 | ids_b[j])
        if ahead < 0:
            i += 1
            ahead += lengths_a[i]
        elif ahead > 0:
            j += 1
            ahead -= lengths_b[j]
        else:
            i, j = i + 1, j + 1
            groups.append(",".join(map(str, ids_a[from_a:i])) + "|" + ",".join(map(str, ids_b[from_b:j])))
            from_a, from_b = i, j
            if i < n:
                ahead = lengths_a[i] - lengths_b[j]
    return groups, pairs


def compose(parts: list[Fragment]) -> Fragment:
    """The fragment of neighbouring stretches, in their order; their own pair tables are not changed."""
    out = Fragment()
    tail_a, tail_b = out.tail
    for x in parts:
        out.n_a += x.n_a
        out.n_b += x.n_b
        mid = (tail_a + x.head[0], tail_b + x.head[1])
        if not x.cut:
            tail_a, tail_b = mid
            continue
        if not out.cut:
            out.cut, out.head = True, mid
        elif mid[0].ids or mid[1].ids:  # else a common end meets itself
            groups, pairs = closed(mid[0].ids, mid[0].lengths, mid[1].ids, mid[1].lengths)
            out.groups += [g.encode() for g in groups]
            out.n_groups += len(groups)
            for p in pairs:
                out.pairs[p] = out.pairs.get(p, 0) + 1
        out.groups += x.groups
        out.n_groups += x.n_groups
        for p, n in x.pairs.items():
            out.pairs[p] = out.pairs.get(p, 0) + n
        tail_a, tail_b = x.tail
    if out.cut:
        out.tail = (tail_a, tail_b)
    else:
        out.head = (tail_a, tail_b)
    return out


#: Closes the open prefix of what follows a common end, as the start of a document is one.
START = Fragment(cut=True)


def stretch(a: Tokens, b: Tokens, before: tuple[int, int] = (0, 0)) -> Fragment:
    """The fragment of two token runs; ``before`` are the bytes of each stream in front of them."""
    ends_a, ends_b = before[0] + np.cumsum(a.lengths, dtype=np.int64), before[1] + np.cumsum(b.lengths, dtype=np.int64)
    common = np.intersect1d(ends_a, ends_b)
    at_a, at_b = (np.searchsorted(ends_a, common) + 1).tolist(), (np.searchsorted(ends_b, common) + 1).tolist()
    if not at_a:
        return Fragment(len(a.ids), len(b.ids), False, (a, b))
    out = Fragment(len(a.ids), len(b.ids), True, (a.slice(0, at_a[0]), b.slice(0, at_b[0])))
    out.tail = (a.slice(at_a[-1], None), b.slice(at_b[-1], None))
    a, b = a.slice(at_a[0], at_a[-1]), b.slice(at_b[0], at_b[-1])
    groups, pairs = closed(a.ids, a.lengths, b.ids, b.lengths)
    out.groups = [g.encode() for g in groups]
    out.n_groups, out.pairs = len(out.groups), dict(Counter(pairs))
    return out


def byte_ranges(a: Tokens, b: Tokens, size: int = RANGE) -> list[Fragment]:
    """Fragments of byte ranges of a stretch; a token belongs to the range in which it ends."""
    ends_a, ends_b = np.cumsum(a.lengths), np.cumsum(b.lengths)
    total = int(max(ends_a[-1], ends_b[-1])) if len(ends_a) and len(ends_b) else 0
    out = []
    for low in range(0, total, size):
        i, j = np.searchsorted(ends_a, [low, low + size], "right").tolist()
        k, m = np.searchsorted(ends_b, [low, low + size], "right").tolist()
        out.append(stretch(a.slice(i, j), b.slice(k, m), (int(ends_a[i - 1]) if i else 0, int(ends_b[k - 1]) if k else 0)))
    return out


# ---------------------------------------------------------------- the two tokenizers


@dataclass
class Document:
    """A text from one common end to another: a fragment without anything open."""

    n_a: int
    n_b: int
    n_groups: int
    groups: bytes
    pairs: np.ndarray
    counts: np.ndarray


class Aligner:
    """Both tokenizers, and the table of kept stretches."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.chars = self.a.model, byte_chars()
        self.plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*$%&#|<>()]+)?")  # two matches of A's pattern
        byte_of = {c: b for b, c in enumerate(self.chars)}
        self.bytes_a = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a = {i: len(t) for i, t in self.bytes_a.items()}
        self.length_b = [len(t) for t in self.bytes_b]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.clear()

    def clear(self) -> None:
        """Empties the table of stretches: their numbers, and by number counts, texts and a run of pairs in one array."""
        self.kept: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.n_a, self.n_b, self.n_groups, self.starts, self.pairs, self.size = array("q"), array("q"), array("q"), array("q", [0]), array("q"), 0

    def streams(self, text: str) -> tuple[Tokens, Tokens] | None:
        """Tokens of a space and ``text``; None where joined tokens differ from it."""
        want = b" " + text.encode()
        ids = self.a.encode(" " + text, add_special_tokens=False).ids
        of = [self.bytes_a[i] for i in ids]
        if b"".join(of) != want:
            return None
        a = Tokens(ids, [len(x) for x in of])
        ids = self.b.encode(text, num_threads=1)
        of = [self.bytes_b[i] for i in ids]
        return (a, Tokens(ids, [len(x) for x in of])) if b"".join(of) == want else None

    def whole(self, text: str) -> Fragment | None:
        """The closed fragment of a stretch between two cuts."""
        found = self.streams(text)
        if found is None:
            return None
        long = sum(found[0].lengths) > RANGE
        return compose([START, *(byte_ranges(*found) if long else [stretch(*found)])])

    def learn(self, texts: list[str]) -> None:
        """Short stretches into the table, encoded together; those whose bytes differ have a negative number."""
        if not texts:
            return
        plain = [self.plain.fullmatch(t) for t in texts]
        odd = iter(self.a.encode_batch([" " + t for t, m in zip(texts, plain) if not m], add_special_tokens=False))
        bytes_a, bytes_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        for text, m, ids_b in zip(texts, plain, self.b.encode(texts, num_threads=1)):
            ids_a, want = self.words(m) if m else next(odd).ids, b" " + text.encode()
            self.size += 250 + 4 * len(text)
            if b"".join(map(bytes_a, ids_a)) != want or b"".join(map(bytes_b, ids_b)) != want:
                self.kept[text] = -1
                continue
            groups, pairs = closed(ids_a, list(map(self.length_a.__getitem__, ids_a)), ids_b, list(map(self.length_b.__getitem__, ids_b)))
            self.kept[text] = len(self.texts)
            self.texts.append(";".join(groups).encode())
            self.n_a.append(len(ids_a))
            self.n_b.append(len(ids_b))
            self.n_groups.append(len(groups))
            self.pairs.extend(pairs)
            self.starts.append(len(self.pairs))
            self.size += len(self.texts[-1]) + 8 * len(pairs)

    def words(self, m: re.Match) -> list[int]:
        """A's ids of a space, letters and plain punctuation, by the library's model."""
        stem = m[1] if m[1].isascii() else "".join(map(self.chars.__getitem__, m[1].encode()))
        found = self.model.tokenize(self.chars[32] + stem)
        if m[2]:
            found += self.model.tokenize(m[2])
        return [t.id for t in found]

    def stretches(self, text: str) -> list[str]:
        """``text`` cut where no token crosses, without the spaces at the cuts."""
        if not self.cuts:
            return [text]
        if not text.startswith(" ") and not LOOSE.search(text):
            return text.split(" ")
        first, *rest = CUT.split(" " + text)
        return [first[1:], *rest]

    def align_all(self, texts: list[str | None]) -> list[Document | None]:
        """The closed fragments of texts, which start and end at common ends; None where bytes differ or none are."""
        if self.size > WORD_BYTES:
            self.clear()
        cut = [self.stretches(t) if t else None for t in texts]
        self.learn([*dict.fromkeys(p for parts in cut for p in parts or () if len(p) <= WORD_LENGTH and p not in self.kept)])
        table = [np.array(x) for x in (self.n_a, self.n_b, self.n_groups, self.starts, self.pairs)]
        return [self.document(parts, *table) if parts else None for parts in cut]

    def document(self, parts: list[str], n_a, n_b, n_groups, starts, pool) -> Document | None:
        """A document of its stretches, each distinct one looked up once."""
        seen, texts, numbers, times, long = Counter(parts), {}, [], [], Fragment(cut=True)
        for part, n in seen.items():
            if len(part) <= WORD_LENGTH:
                number = self.kept[part]
                if number < 0:
                    return None
                texts[part] = self.texts[number]
                numbers.append(number)
                times.append(n)
            else:
                whole = self.whole(part)
                if whole is None:
                    return None
                texts[part] = b";".join(whole.groups)
                long = compose([long, *[whole] * n])
        at, n = np.array(numbers, np.int64), np.array(times, np.int64)
        runs = starts[at + 1] - starts[at]
        ends = np.cumsum(runs)
        pairs = pool[np.repeat(starts[at] - ends + runs, runs) + np.arange(ends[-1] if len(ends) else 0)]
        pairs, weights = np.concatenate([pairs, np.array([*long.pairs], np.int64)]), np.concatenate([np.repeat(n, runs), np.array([*long.pairs.values()], np.int64)])
        pairs, turn = np.unique(pairs, return_inverse=True)
        counts = np.bincount(turn, weights, len(pairs)).astype(np.int64)  # sums far below 2 ** 53
        total = [int(c[at] @ n) for c in (n_a, n_b, n_groups)]
        return Document(total[0] + long.n_a, total[1] + long.n_b, total[2] + long.n_groups, b";".join([texts[p] for p in parts]), pairs, counts)


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


KEPT.append(("alignment", aligner.cache_clear))


# ---------------------------------------------------------------- documents


FRAGMENT = "n_a long, n_b long, n_groups long, cut boolean, valid boolean, groups binary, pairs array<bigint>, counts array<bigint>, {}".format(
    ", ".join(f"{e}_{s}_{w} array<bigint>" for e in ("head", "tail") for s in "ab" for w in ("ids", "lengths"))
)
OPEN = [f"{e}_{s}_{w}" for e in ("head", "tail") for s in "ab" for w in ("ids", "lengths")]


def fragment_row(x: Fragment | Document | None) -> tuple:
    if x is None:
        return (0, 0, 0, False, False, b"", [], [], *[[]] * 8)
    if isinstance(x, Document):
        return (x.n_a, x.n_b, x.n_groups, True, True, x.groups, x.pairs, x.counts, *[[]] * 8)
    opened = [values for run in (*x.head, *x.tail) for values in (run.ids, run.lengths)]
    return (x.n_a, x.n_b, x.n_groups, x.cut, True, b";".join(x.groups), [*x.pairs], [*x.pairs.values()], *opened)


def row_fragment(row: dict) -> Fragment | None:
    if not row["valid"]:
        return None
    head, tail = (tuple(Tokens(row[f"{e}_{s}_ids"], row[f"{e}_{s}_lengths"]) for s in "ab") for e in ("head", "tail"))
    return Fragment(row["n_a"], row["n_b"], row["cut"], head, [row["groups"]] if row["n_groups"] else [], row["n_groups"], dict(zip(row["pairs"], row["counts"])), tail)


def batch_of(names: list[str], types: list, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)


LONGS = pa.list_(pa.int64())
FRAGMENT_NAMES = ["n_a", "n_b", "n_groups", "cut", "valid", "groups", "pairs", "counts", *OPEN]
FRAGMENT_TYPES = [*[pa.int64()] * 3, pa.bool_(), pa.bool_(), pa.binary(), LONGS, LONGS, *[LONGS] * 8]
DONE_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "counts"]
DONE_TYPES = [*[pa.int64()] * 4, pa.string(), LONGS, LONGS]
DONE = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<bigint>, counts array<bigint>"


def done_row(doc_id: int | None, x: Document | None) -> tuple:
    if x is None:
        return (doc_id, 0, 0, 0, "", [], [])
    return (doc_id, x.n_a, x.n_b, x.n_groups, hashlib.sha256(x.groups).hexdigest(), x.pairs, x.counts)


def slices_of(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[list[tuple], list[str | None]]]:
    """Keys and texts of a batch, about ``SLICE`` characters at a time."""
    held, texts, size = [], [], 0
    for *key, text in zip(*(batch.column(c).to_pylist() for c in keys), batch.column("text")):
        held.append(tuple(key))
        texts.append(text.as_py())
        size += len(texts[-1] or "")
        if size >= SLICE:
            yield held, texts
            held, texts, size = [], [], 0
    if held:
        yield held, texts


def short_documents(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = aligner(path_a, path_b)
        for batch in batches:
            for keys, texts in slices_of(batch, ["doc_id"]):
                yield batch_of(DONE_NAMES, DONE_TYPES, [done_row(*k, x) for k, x in zip(keys, at.align_all(texts))])

    return rows.mapInArrow(released(run, "alignment"), DONE)


def chunks_of(text: str, size: int) -> Iterator[str]:
    """``text`` cut after about ``size`` characters each, where no token crosses; the spaces at the cuts are left out."""
    at = 0
    while True:
        found = CUT.search(text, max(at + size, 1)) if at + size < len(text) else None
        if not found:
            yield text[at:]
            return
        yield text[at : found.start()]
        at = found.end()


def long_documents(rows: DataFrame, path_a: str, path_b: str, size: int) -> DataFrame:
    """Fragments of chunks, dealt over the tasks and composed by a tree of reductions."""
    spark = rows.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c) for c in ("row", "doc_id", "text"))):
                for k, part in enumerate(chunks_of(text.as_py(), size) if aligner(path_a, path_b).cuts else [text.as_py()]):
                    yield batch_of(["row", "doc_id", "chunk", "text"], [pa.int64()] * 3 + [pa.string()], [(row.as_py(), doc_id.as_py(), k, part)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = aligner(path_a, path_b)
        for batch in batches:
            for keys, texts in slices_of(batch, ["row", "doc_id", "chunk"]):
                yield batch_of(["row", "doc_id", "chunk", *FRAGMENT_NAMES], [pa.int64()] * 3 + FRAGMENT_TYPES, [(*k, *fragment_row(x)) for k, x in zip(keys, at.align_all(texts))])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def composed():
            whole = None if any(x is None for x in held) else compose(held)
            return batch_of(["row", "doc_id", "chunk", *FRAGMENT_NAMES], [pa.int64()] * 3 + FRAGMENT_TYPES, [(*key, *fragment_row(whole))])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                here = (row["row"], row["doc_id"], row["chunk"] // FAN)
                if key is not None and here != key:
                    yield composed()
                    held = []
                key = here
                held.append(row_fragment(row))
        if held:
            yield composed()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = row_fragment(row)
                yield batch_of(DONE_NAMES, DONE_TYPES, [done_row(row["doc_id"], x and Document(x.n_a, x.n_b, x.n_groups, b";".join(x.groups), [*x.pairs], [*x.pairs.values()]))])

    schema = "row long, doc_id long, chunk long, "
    width = shuffle_width(spark)
    cut_up = rows.mapInArrow(cut, schema + "text string").repartition(width, "row", "chunk")
    found = write_table(cut_up.mapInArrow(encode, schema + FRAGMENT), "alignment-fragments")
    most = found.agg(F.max("chunk")).first()[0] or 0
    while most > 0:
        level = found.repartition(width, "row", F.floor(F.col("chunk") / FAN)).sortWithinPartitions("row", "chunk")
        found = write_table(level.mapInArrow(reduce, schema + FRAGMENT), "alignment-fragments")
        most //= FAN
    return found.mapInArrow(finish, DONE)


def aligned(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK) -> DataFrame:
    """Stored, per row of ``docs`` (doc_id, text): row, doc_id, token and group counts, a hash of the groups, and the
    distinct linked pairs (A id << 32 | B id) with their numbers."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.length("text") > 2 * chunk, F.lit(False))
    done = short_documents(rows.filter(~long), path_a, path_b).unionByName(long_documents(rows.filter(long).withColumn("row", F.monotonically_increasing_id()), path_a, path_b, chunk))
    return write_table(done.withColumn("row", F.monotonically_increasing_id()), "alignments")


def pair_counts(found: DataFrame) -> DataFrame:
    """Stored: (pair, n, best) of all linked pairs: documents that hold it, and whether no other of its A id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy())
            size += len(held[-1])
            if size >= PAIRS_HELD:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    counts = found.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = write_table(counts, "pair-counts")
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return write_table(counts.join(most, a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-table")


def with_counts(found: DataFrame, table: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``found`` with n_links, n_best (links whose pair is the best of its A id) and count_sum (pair counts over links)."""
    keep = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    if table.count() <= broadcast_pairs:  # its size is known: it is stored
        held = table.toArrow()
        order = np.argsort(held.column("pair").to_numpy())
        shared = found.sparkSession.sparkContext.broadcast(tuple(held.column(c).to_numpy(zero_copy_only=False)[order] for c in ("pair", "n", "best")))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, n, best = shared.value
            for batch in batches:
                pairs, counts = batch.column("pairs").flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
                at = np.searchsorted(pair, pairs)
                ends = np.concatenate([[0], np.cumsum(np.diff(batch.column("pairs").offsets.to_numpy()))])
                sums = [np.concatenate([[0], np.cumsum(v, dtype=np.int64)]) for v in (counts, counts * best[at], counts * n[at])] if len(pairs) else [np.zeros(1, np.int64)] * 3
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()) for s in sums)], names=[*keep, "n_links", "n_best", "count_sum"])

        return found.mapInArrow(look_up, "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long")
    each = found.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("k"))
    sums = each.join(table, "pair").groupBy("row").agg(F.sum("k").alias("n_links"), F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
    joined = found.select(keep).join(sums, "row", "left")
    return joined.select(*keep, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_links", "n_best", "count_sum")))


def align(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    with stored_steps(docs.sparkSession):
        found = aligned(docs, path_a, path_b, chunk)
        out = with_counts(found, pair_counts(found), broadcast_pairs)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
