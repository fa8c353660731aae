"""Exact n-gram Jaccard join by grouped prefixes, and its link classes (operator 4).

A document's set holds the 64-bit hashes of its distinct word shingles.
Documents with equal sets are one class. All sets are put in one global order:
shingles by hash, and after them the frequent ones by count, so that passages
many documents share come last. Two sets that reach the threshold share a
shingle within short prefixes of this order. Classes with the same prefix and
size collapse into one group; groups are joined on the shingles of their
prefixes; size and position filters cut the pairs; the members of what is left
are verified on their whole sets.

Links are wanted as classes, so pairs that are known to be connected need no
verification. In a first round every group, and every group on a shared
shingle, is compared with one pivot (the group that shares most of its prefix),
a number of pairs in proportion to the index however large a group of near
copies is. In a second round only pairs from different classes of the first
meet on a shingle: the rows outside the shingle's most common class against
the others, where their places and the parities of their sets allow a link.
Large sets carry more parities, in proportion to their size, and pairs of them
are held against these before prefixes and whole sets travel. No similar pair
is lost: it is verified, or connected already.

Frequent shingles: each task counts its shingles exactly and passes on those
above a share of 1/``FREQUENT`` of what it holds, so every shingle above twice
that share of all is found and at most ``FREQUENT`` of them exist, the bound
of the one broadcast. Counts order the shingles and decide nothing else.

Defined results: a null or empty text, or one without words, has the empty
set, links with nothing and keeps its own id; a text of fewer words than a
shingle has is one shingle; repeated rows and equal texts share a class; null
ids take the class of their text, and the smallest id that is not null names
it (null where none is); empty input gives an empty result; other columns are
ignored. Hashes of 64 bits stand for shingles and sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnscope.llm.bpe import Bounded, slices
from churnscope.llm.common import KEPT, read, released, shuffle_width, stored_steps, write_table

WIDTH, PERCENT = 4, 85
#: Bound of the frequent shingles, and shingles a task counts at once.
FREQUENT, CHUNK = 1 << 20, 1_000_000
#: Members that one copy of a pivot's set serves.
PIVOT_SHARE = 2000
#: Words of 64 parity bits that summarise a set.
PARITY = 8
#: Sets of more shingles than this also have a wide parity, of a bit a shingle at least.
WIDE_FROM = 1024
#: Bits of the array that picks documents, at most (16 MB).
SIEVE_BITS = 1 << 27
#: Bytes of word hashes, and of the group ids a task has written, that are kept.
WORDS_KEPT, GROUPS_KEPT = 24 << 20, 24 << 20
_WORDS: Bounded | None = None
KEPT.append(("shingles", lambda: _WORDS is not None and _WORDS.clear()))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Distinct shingle hashes of a text in ascending order (int64)."""
    import xxhash

    global _WORDS
    if _WORDS is None:
        _WORDS = Bounded(xxhash.xxh3_64_intdigest, WORDS_KEPT)
    words = (text or b"").lower().split()  # on bytes both know ASCII only
    if not words:
        return np.empty(0, np.int64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64).view(np.int64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = len(w) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += mixed(w[k : k + n] * _ODD[k % 4] + np.uint64(k))
    return np.unique(mixed(total).view(np.int64))


def digest(values: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes(), seed=len(values))).view(np.int64))


def least_overlap(nx, ny, percent: int):
    """Shared shingles two sets of these sizes need: p (nx + ny) / (100 + p), rounded up (numbers or columns)."""
    return (percent * (nx + ny) + 99 + percent) / (100 + percent)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def parity(values: np.ndarray, words: int = PARITY) -> list[int]:
    """For each of 64 * words classes of hashes, whether a set has an odd number of shingles in it, as words."""
    odd = np.bincount((values.view(np.uint64) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def wide_parity(values: np.ndarray) -> list[int] | None:
    """The parity of a large set, of a power of two words; None for others."""
    return parity(values, 1 << (len(values) - 1).bit_length() - 6) if len(values) > WIDE_FROM else None


def wide_unlike(x: np.ndarray, y: np.ndarray) -> int:
    """Parities two sets differ in; the longer array is folded to the classes of the shorter."""
    if len(x) < len(y):
        x, y = y, x
    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)))
    return int(np.unpackbits((x ^ y).view(np.uint8)).sum())


def frequent(docs: DataFrame, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles, ascending, and the rank of each by count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= max(2, -(-size // most))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(values[keep], 0)), pa.array(np.append(counts[keep], size)), pa.array(np.append(np.zeros(keep.sum(), bool), True))], names=["shingle", "n", "total"])

        for batch in batches:
            for texts in slices(batch.column(0)):
                for t in texts:
                    held.append(shingles(t, width))
                    size += len(held[-1])
                    if size >= CHUNK:
                        yield from counted()
                        held, size = [], 0
        if size:
            yield from counted()

    counts = docs.select(F.col("text").cast("binary")).mapInArrow(released(run, "shingles"), "shingle long, n long, total boolean").groupBy("shingle", "total").agg(F.sum("n").alias("n"))
    counts = write_table(counts, "shingle-counts")
    total = counts.filter("total").agg(F.sum("n")).first()[0] or 0
    # counts add up to the total at most, so no more than `most` rows pass
    found = counts.filter(~F.col("total") & (F.col("n") >= max(2, -(-total // most)))).select("shingle", "n").toArrow()
    values, n = found.column("shingle").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(values)
    values, n = values[order], n[order]
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, n))] = np.arange(len(values))
    return values, rank


def prefixes(docs: DataFrame, values: np.ndarray, rank: np.ndarray, width: int, percent: int) -> DataFrame:
    """Stored, per document: doc_id, n (set size), cid (class), gid (group), the set's parities and the group's prefix with its first frequent place.

    A task writes a group's prefix once; equal prefixes of other tasks collapse in the index."""
    shared = docs.sparkSession.sparkContext.broadcast((values, rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (values, rank), seen = shared.value, Bounded(lambda g: 0, GROUPS_KEPT)
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text")):
                out: list[list] = [[], [], [], [], [], [], []]
                for t in texts:
                    s = shingles(t, width)
                    n = len(s)
                    if not n:
                        for column, x in zip(out, (0, None, None, None, None, None, None)):
                            column.append(x)
                        continue
                    place = np.searchsorted(values, s) if len(values) else np.zeros(n, np.int64)
                    often = values[np.minimum(place, len(values) - 1)] == s if len(values) else np.zeros(n, bool)
                    rare = s[~often]
                    length = prefix_length(n, percent)
                    head = rare[:length]
                    if len(head) < length:
                        common, order = s[often], np.argsort(rank[place[often]])
                        head = np.concatenate([head, common[order][: length - len(head)]])
                    gid = digest(np.append(head, n))
                    first = gid not in seen
                    seen[gid]
                    for column, x in zip(out, (n, digest(s), gid, head if first else None, min(len(rare), length) if first else None, parity(s), wide_parity(s) if first else None)):
                        column.append(x)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), *(pa.array(x, t) for x, t in zip(out, types))], names=["doc_id", "n", "cid", "gid", "prefix", "n_rare", "parity", "wide"])
                at += len(texts)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    out = write_table(rows.mapInArrow(released(run, "shingles"), "doc_id long, n long, cid long, gid long, prefix array<bigint>, n_rare int, parity array<bigint>, wide array<bigint>"), "prefixes")
    shared.destroy()  # the step is stored
    return out


def index(rows: DataFrame, percent: int) -> DataFrame:
    """Stored: (key, gid, n, pos) of shingles that prefixes of different groups share; a group of several classes also has itself as a key.

    A row whose neighbours by size on its key are too small and too large has no partner there and goes. Rare shingles are looked at key by key (each has few rows by the bound above); frequent ones are known to be
    shared and only lose their repetitions, before the shuffle."""
    places = rows.filter(F.col("prefix").isNotNull()).select("gid", "n", "n_rare", F.posexplode("prefix").alias("pos", "key"))
    rare = places.filter(F.col("pos") < F.col("n_rare")).select("key", "gid", (F.col("n") * F.lit(1 << 32) + F.col("pos")).alias("at"))
    key = Window.partitionBy("key").orderBy("at")
    every = key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    size = F.shiftright("at", 32)
    fits = (100 * F.shiftright(F.lag("at").over(key), 32) >= percent * size) | (100 * size >= percent * F.shiftright(F.lead("at").over(key), 32))
    rare = rare.withColumn("_a", F.min("gid").over(every)).withColumn("_b", F.max("gid").over(every)).withColumn("_fits", fits)
    rare = rare.filter((F.col("_a") != F.col("_b")) & F.col("_fits")).select("key", "gid", "at").distinct()
    often = places.filter(F.col("pos") >= F.col("n_rare")).select("key", "gid", (F.col("n") * F.lit(1 << 32) + F.col("pos")).alias("at")).distinct()
    several = rows.filter(F.col("n") > 0).groupBy("gid").agg(F.min("cid").alias("a"), F.max("cid").alias("b"), F.max("n").alias("n")).filter(F.col("a") != F.col("b"))
    own = several.select(F.col("gid").alias("key"), "gid", (F.col("n") * F.lit(1 << 32)).alias("at"))
    out = rare.unionByName(often).unionByName(own)
    return write_table(out.select("key", "gid", F.shiftright("at", 32).alias("n"), (F.col("at") % F.lit(1 << 32)).alias("pos")), "prefix-index")


def may_link(percent: int, a: str = "", b: str = "p_"):
    """Size and position filters for two index rows of one key."""
    na, nb, ia, ib = (F.col(x) for x in (f"{a}n", f"{b}n", f"{a}pos", f"{b}pos"))
    need = F.floor(least_overlap(na, nb, percent))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (F.least(na - ia, nb - ib) >= need)


def may_differ(percent: int, a: str = "", b: str = "p_"):
    """Whether what two sets are known to differ in still allows a link.

    Before the first shingle they share all are in one set only, so a pair that links passes on that key at the latest.
    Every parity that differs stands for a shingle in one set only; groups of several sets have no parities and pass."""
    na, nb, ia, ib = (F.col(x) for x in (f"{a}n", f"{b}n", f"{a}pos", f"{b}pos"))
    return (ia + ib <= na + nb - 2 * F.floor(least_overlap(na, nb, percent))) & alike(percent, a, b)


def alike(percent: int, a: str = "", b: str = "p_"):
    """Whether the parities of two sets allow a link."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    unlike = F.lit(0)
    for k in range(PARITY):
        unlike += F.bit_count(F.col(f"{a}w{k}").bitwiseXOR(F.col(f"{b}w{k}")))
    return F.coalesce(unlike <= na + nb - 2 * F.floor(least_overlap(na, nb, percent)), F.lit(True))


def alike_pairs(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) whose sizes and parities, of ``known`` (id, n, w0, ...), allow a link."""
    of = [known.select(*(F.col(c).alias(f"{p}{c}") for c in known.columns)) for p in ("a_", "b_")]
    out = pairs.distinct().join(of[0], F.col("a") == F.col("a_id")).join(of[1], F.col("b") == F.col("b_id"))
    return out.filter(alike(percent, "a_", "b_")).select("a", "b")


def compared(pairs: DataFrame, arrays: DataFrame, passes: Callable[[np.ndarray, int, np.ndarray, int], bool], shared: list[Broadcast] | None = None) -> DataFrame:
    """Stored: the pairs (a, b) whose arrays (id, n, values) pass; ``shared`` values, no longer used then, are destroyed.

    Each array travels to its pivots b, a popular pivot's own array to several tasks with a share of the members each."""
    shares = pairs.groupBy("b").agg(F.ceil(F.count("*") / PIVOT_SHARE).cast("int").alias("shares"))
    members = pairs.join(shares, "b").select(F.col("a").alias("id"), "b", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("role"))
    pivots = shares.select(F.col("b").alias("id"), "b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("role"))
    sent = members.unionByName(pivots).join(arrays, "id").repartition(shuffle_width(pairs.sparkSession), "b", "share").sortWithinPartitions("b", "share", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, here = None, None
        for batch in batches:
            found: tuple[list, list] = ([], [])
            column = batch.column("values")
            for i, (a, b, share, role, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "b", "share", "role", "n")))):
                values = column[i].values.to_numpy()
                if role == 0:
                    pivot, here = (values, n), (b, share)
                elif here == (b, share) and passes(values, n, *pivot):
                    found[0].append(a)
                    found[1].append(b)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    out = write_table(sent.select("id", "b", "share", "role", "n", "values").mapInArrow(released(run, "shingles"), "a long, b long"), "compared")
    for value in shared or []:
        value.destroy()
    return out.distinct()


def common(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def held_by(rows: DataFrame, pairs: DataFrame, values: str) -> tuple[DataFrame, list[Broadcast]]:
    """(id, n, values) of the groups in pairs (a, b) that have these values, and what its plan shares."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
    held, shared = sifted(rows.filter(F.col(values).isNotNull()).select(F.col("gid").alias("id"), "n", F.col(values).alias("values")), "id", asked)
    return held.join(asked, F.col("id") == F.col("_id"), "left_semi").dropDuplicates(["id"]), [shared]


def wide_alike(pairs: DataFrame, known: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs of groups (a, b) whose wide parities allow a link, and those where a group is small or has several sets."""

    def passes(x: np.ndarray, nx: int, y: np.ndarray, ny: int) -> bool:
        return wide_unlike(x, y) <= nx + ny - 2 * -(-percent * (nx + ny) // (100 + percent))

    large = known.filter(F.col("w0").isNotNull() & (F.col("n") > WIDE_FROM))
    for c in ("a", "b"):
        pairs = pairs.join(large.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_wide")), c, "left")
    pairs = write_table(pairs.select("a", "b", (F.col("a_wide") & F.col("b_wide")).alias("wide")), "sized-pairs")
    wide = pairs.filter("wide").select("a", "b")
    held, shared = held_by(rows, wide, "wide")
    return pairs.filter("wide is null").select("a", "b").unionByName(compared(wide, held, passes, shared))


def near_prefixes(pairs: DataFrame, known: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs of groups (a, b) whose wide parities and prefixes allow a link.

    What the prefix that ends first shares with the other set is in the other's prefix, so the two sets share no more
    than their prefixes do and the larger rest behind a prefix holds."""

    def passes(x: np.ndarray, nx: int, y: np.ndarray, ny: int) -> bool:
        rest = max(nx - len(x), ny - len(y))
        return common(x, y) + rest >= -(-percent * (nx + ny) // (100 + percent))

    pairs = write_table(wide_alike(pairs.distinct(), known, rows, percent), "group-pairs")
    held, shared = held_by(rows, pairs, "prefix")
    return compared(pairs, held, passes, shared)


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the threshold."""

    def passes(x: np.ndarray, nx: int, y: np.ndarray, ny: int) -> bool:
        both = common(x, y)
        return 100 * both >= percent * (nx + ny - both)

    pairs = write_table(pairs.distinct(), "class-pairs")
    sets = class_sets(docs, rows, pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), width)
    return compared(pairs, sets, passes)


def sieve(ids: DataFrame) -> tuple[int, np.ndarray]:
    """A bit array of hashed ids (``_id`` long), of SIEVE_BITS at most; two words a row reach the driver."""
    bits = min(SIEVE_BITS, 1 << max(10, (16 * ids.count()).bit_length()))
    spot = ids.select(F.pmod(F.xxhash64("_id"), F.lit(bits)).alias("p"))
    word = spot.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[word.column("w").to_numpy()] = word.column("v").to_numpy()
    return bits, out


def sifted(rows: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, Broadcast]:
    """Rows whose ``column`` may be one of ``ids`` (``_id`` long), and the bits they share; an exact join is to follow.

    A bit array of bounded size keeps most other rows out of that join's shuffle; where there are too many ids for the
    bits, the join does all the work."""
    shared, names = rows.sparkSession.sparkContext.broadcast(sieve(ids)), rows.columns

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, word = shared.value
        for batch in batches:
            spot = batch.column("_h").to_numpy() % bits
            keep = (word[spot >> 6] >> (spot & 63)) & 1 == 1
            yield batch.select(names).filter(pa.array(keep))

    return rows.withColumn("_h", F.xxhash64(column)).mapInArrow(released(some), rows.schema), shared


def may_be(ids: DataFrame) -> Callable[[Column], Column]:
    """For a long column, whether it may be one of ``ids`` (``_id`` long): false for no id, and by the bits for few others.

    Only hashes travel to Python; rows that are surely none of the ids need no shuffle, an exact join is to decide on the rest."""
    shared = ids.sparkSession.sparkContext.broadcast(sieve(ids))

    @F.arrow_udf("boolean")
    def some(h: pa.Array) -> pa.Array:
        bits, word = shared.value
        spot = h.to_numpy() % bits
        return pa.array((word[spot >> 6] >> (spot & 63)) & 1 == 1)

    return lambda column: some(F.xxhash64(column))


def class_sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Stored: (id, n, values) of the wanted classes, from the whole text of one document of each."""
    of = rows.filter(F.col("n") > 0).groupBy("cid").agg(F.min("doc_id").alias("_id")).join(wanted, "cid", "left_semi")
    of = write_table(of.select("_id").distinct(), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    texts, shared = sifted(texts, "doc_id", of)
    # a merge join at every size: the sieve and the sets are stages of their own, so a task holds one Python worker
    texts = texts.join(of.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                found = [s for s in (shingles(t, width) for t in part) if len(s)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["id", "n", "values"])

    out = write_table(texts.mapInArrow(released(run, "shingles"), "id long, n long, values array<bigint>"), "class-sets")
    shared.destroy()
    return out


def spread(edges: DataFrame, rounds: int) -> DataFrame:
    """Stored: (node, label) after some rounds of taking the smallest label around; equal labels mean connected nodes."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    for _ in range(rounds):
        labels = write_table(labels, "labels")
        around = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        labels = labels.join(around, F.col("node") == F.col("a")).select("node", F.least("label", "m").alias("label"))
    return write_table(labels, "labels")


def components(edges: DataFrame) -> DataFrame:
    """Stored: (node, label) with the smallest node of each connected component, by alternating star contractions."""

    def trace(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = write_table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = trace(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter(F.col("b") != F.col("m")).select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        edges = write_table(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        seen = trace(edges)
        if seen == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        last = seen


def link_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    with stored_steps(docs.sparkSession):
        rows, named = labelled(docs, width, percent, most)
    out = rows.select("doc_id", "n", "cid").join(named, F.col("cid") == F.col("_cid"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def labelled(docs: DataFrame, width: int, percent: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Stored: the documents' sets and classes, and for each class (_cid) its component_id."""
    values, rank = frequent(docs, width, most)
    rows = prefixes(docs, values, rank, width, percent)
    shared = index(rows, percent)
    members = write_table(rows.filter(F.col("n") > 0).groupBy("gid", "cid").agg(F.count("*").alias("docs"), F.min("n").alias("n"), *(F.min(F.col("parity")[k]).alias(f"w{k}") for k in range(PARITY))).join(shared.select("gid").distinct(), "gid", "left_semi"), "members")

    words = [f"w{k}" for k in range(PARITY)]
    known_classes = members.select(F.col("cid").alias("id"), "n", *words)
    known_groups = members.groupBy(F.col("gid").alias("id")).agg(F.min("n").alias("n"), *(F.when(F.count("*") == 1, F.min(w)).alias(w) for w in words))

    # first round: every group on a key against the key's pivot, every member of a group against its first
    held = shared.groupBy("gid").agg(F.count("*").alias("keys"), F.max("n").alias("n"))
    groups = members.groupBy("gid").agg(F.min("cid").alias("head"), F.sum("docs").alias("docs"))
    share = F.col("keys") / (F.col("n") - F.ceil(percent * F.col("n") / 100) + 1)
    weight = held.select("gid", share.alias("share")).join(groups.select("gid", "docs"), "gid")
    weighed = write_table(shared.join(weight, "gid"), "weighed")
    pivot = weighed.groupBy("key").agg(F.max(F.struct("share", "docs", "gid", "n", "pos")).alias("p"))
    near = weighed.join(pivot.select("key", F.col("p.gid").alias("p_gid"), F.col("p.n").alias("p_n"), F.col("p.pos").alias("p_pos")), "key")
    near = near.filter((F.col("gid") != F.col("p_gid")) & may_link(percent)).select(F.col("gid").alias("a"), F.col("p_gid").alias("b"))
    near = near_prefixes(alike_pairs(near, known_groups, percent), known_groups, rows, percent).withColumnRenamed("b", "near_b")
    heads = groups.select(F.col("gid").alias("p_gid"), F.col("head").alias("b"))
    first = members.join(near, F.col("gid") == F.col("a")).join(heads, F.col("p_gid") == F.col("near_b")).select(F.col("cid").alias("a"), "b")
    own = members.join(heads, F.col("gid") == F.col("p_gid")).filter(F.col("cid") != F.col("b")).select(F.col("cid").alias("a"), "b")
    links = verified(alike_pairs(first.unionByName(own), known_classes, percent), docs, rows, width, percent)
    labels = spread(links, 2)

    # second round: what meets on a key and is not known to be connected
    placed = members.join(labels, F.col("cid") == F.col("node"), "left").select("gid", "cid", F.coalesce("label", "cid").alias("label"))
    placed = write_table(placed, "placed")
    units = placed.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    open_keys = shared.join(units, "gid").groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter(F.col("lo") != F.col("hi")).select("key")
    labels = placed.select("gid", "label").distinct().join(known_groups.select(F.col("id").alias("gid"), *words), "gid")
    open_rows = write_table(shared.join(open_keys, "key", "left_semi").join(labels, "gid"), "open-keys")
    top = open_rows.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label"))["label"].alias("top"))
    some = open_rows.join(top, "key").filter(F.col("label") != F.col("top"))
    others = open_rows.select("key", *(F.col(c).alias(f"p_{c}") for c in ("gid", "n", "pos", "label", *words)))
    met = some.join(others, "key").filter((F.col("label") != F.col("p_label")) & ((F.col("p_label") == F.col("top")) | (F.col("label") < F.col("p_label"))) & may_link(percent) & may_differ(percent))
    turned = F.col("gid") > F.col("p_gid")
    met = met.select(*(F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("gid", "p_gid"), ("label", "p_label"), ("p_gid", "gid"), ("p_label", "label")))).distinct()
    met = write_table(met, "open-pairs")
    apart = met.filter("gid <> p_gid")
    close = near_prefixes(apart.select(F.col("gid").alias("a"), F.col("p_gid").alias("b")), known_groups, rows, percent)
    met = apart.join(close, (F.col("gid") == F.col("a")) & (F.col("p_gid") == F.col("b"))).drop("a", "b").unionByName(met.filter("gid = p_gid"))
    p_placed = placed.select(F.col("gid").alias("p_gid"), F.col("label").alias("p_label"), F.col("cid").alias("b"))
    second = met.join(placed, ["gid", "label"]).join(p_placed, ["p_gid", "p_label"]).select(F.col("cid").alias("a"), "b")
    links = links.unionByName(verified(alike_pairs(second, known_classes, percent), docs, rows, width, percent))

    # classes to components, and the smallest id of each
    found = components(links).select(F.col("node").alias("cid"), "label")
    classes = rows.filter(F.col("n") > 0).groupBy("cid").agg(F.min("doc_id").alias("least")).join(found, "cid", "left").select("cid", "least", F.coalesce("label", "cid").alias("label"))
    names = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    return rows, write_table(classes.join(names, "label").select(F.col("cid").alias("_cid"), "component_id"), "components")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_classes(read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, hash(words[i], words[i+1], words[i+2], words[i+3]) AS g FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 4)
  UNION SELECT doc_id, hash(words) FROM w WHERE len(words) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(root)::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.node = w.doc_id GROUP BY w.doc_id, n.n
"""
