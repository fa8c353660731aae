"""SimHash near-duplicates by the generalised pigeonhole principle (operator 11).

A document's fingerprint is the bitwise majority of the XXH64 hashes of its
word shingles. Equal fingerprints collapse first, so all that follows works on
distinct 64-bit values.

Two values that differ in at most ``distance`` bits are alike: cut the bits
into m parts and give part i a threshold t_i >= -1, with t_1 + ... + t_m =
distance - m + 1; then any two alike values differ in at most t_i bits of some
part i with t_i >= 0. So a value may look for partners in its own way:

* Parts: bits that go together over the corpus are put in the same part
  (greedily, by correlations counted over all values), for m = 1 .. distance + 1.
* Thresholds: for each value, dynamic programming over the parts finds the
  thresholds of least cost for each m, and the cheapest m is taken. The cost
  of (part, t) is the number of keys to probe and the estimated number of
  candidates: the exact count of values that share the part, scaled by how
  much the histograms of the part's blocks of at most ``BLOCK`` bits grow
  with t around the value. One part alone has few candidates that are no
  links, so a crowded value costs a bounded number of probes however crowded.
* Probe: every value is indexed under each part's bits; each probe is the
  value's own bits of a part with up to t_i of them flipped.
* Verify: candidates are held to ``distance`` by their whole values, inside
  the join, and links become components.

Defined results: a text that is null, empty or without words has the
fingerprint zero, linked like any other; fewer words than a shingle make one
shingle; repeated rows and equal texts share a fingerprint; null ids take the
component of their fingerprint, and the smallest id that is not null names it
(null where none is); empty input gives an empty result; other columns are
ignored. Very long texts are hashed piece by piece.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.llm.bpe import slices
from churnscope.llm.common import read, released, stored_steps, write_table
from churnscope.llm.jaccard_join import components

WIDTH, SEED, DISTANCE = 3, 42, 2
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20
#: Bits of a histogram's block, at most.
BLOCK = 11
#: A probed key's cost in candidates: a key travels, a candidate is one comparison.
PROBE_COST = 2.0
#: Parts whose keys within ``distance`` outnumber this are never probed at that threshold.
MOST_PROBES = 100_000
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, ASCII letters lower-cased, in runs of about ``size`` bytes."""
    at = 0
    while at < len(text):
        found = SPACE.search(text, at + size)
        end = found.start() if found else len(text)
        if words := text[at:end].lower().split():
            yield words
        at = end


def majority(text: bytes | None, width: int = WIDTH, seed: int = SEED, size: int = PIECE) -> int:
    """The fingerprint: each bit that is set in more than half of the shingles' hashes."""
    import xxhash

    hashed, ones, total, tail = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for words in pieces(text or b"", size):
        words = tail + words
        shingles = [hashed(b" ".join(s), seed) for s in zip(*(words[k:] for k in range(width)))]
        for at in range(0, len(shingles), 1 << 16):
            h = np.array(shingles[at : at + (1 << 16)], "<u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(h)
        tail = words[len(words) - min(len(words), width - 1) :]
    if not total and tail:
        return hashed(b" ".join(tail), seed)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row of ``docs`` (doc_id, text); fp is a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text")):
                fp = np.array([majority(t, width, seed) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(fp)], names=["doc_id", "fp"])
                at += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(released(run, "simhash"), "doc_id long, fp long")


# ---------------------------------------------------------------- parts and their statistics


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def mask_of(bits) -> int:
    return signed(sum(1 << b for b in bits))


@dataclass(frozen=True)
class Part:
    """Bits of one part, of the partition into ``m`` parts; ``blocks`` are its histograms' bits."""

    number: int
    m: int
    bits: tuple[int, ...]

    @property
    def blocks(self) -> list[tuple[int, ...]]:
        n = -(-len(self.bits) // BLOCK)
        return [tuple(b.tolist()) for b in np.array_split(np.array(self.bits), n)]

    def probes(self, t: int) -> int:
        """Keys within ``t`` flipped bits."""
        return sum(choose(len(self.bits), k) for k in range(t + 1))


def choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def bits_of(fp: np.ndarray) -> np.ndarray:
    """(n, 64) zeros and ones, lowest bit first."""
    return np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlations(values: DataFrame) -> np.ndarray:
    """|correlation| of every two bits over all values (fp); a 64 x 64 count matrix a task is added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64)), 0
        for batch in batches:
            b = bits_of(batch.column(0).to_numpy()).astype(np.float32)
            both += b.T @ b
            n += len(b)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(4097), pa.int32()), pa.array([*both.astype(np.int64).ravel(), n], pa.int64())], names=["cell", "n"])

    cells = values.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(4097)
    count[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    n, both = max(count[-1], 1), count[:-1].reshape(64, 64)
    p = np.diag(both) / n
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    out = np.abs(np.divide(both / n - np.outer(p, p), spread, out=np.zeros((64, 64)), where=spread > 0))
    np.fill_diagonal(out, 0)
    return out


def grouped(corr: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """The 64 bits in ``m`` parts of equal size (to one bit): a part starts with the most correlated bit left and
    takes the bit that goes best with it until it is full."""
    left, out = list(range(64)), []
    for k in range(m):
        size = len(left) // (m - k)
        part = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < size:
            part.append(max(left, key=lambda b: (corr[b, part].sum(), -b)))
            left.remove(part[-1])
        out.append(tuple(part))
    return out


def partitions(corr: np.ndarray, distance: int) -> list[Part]:
    out: list[Part] = []
    for m in range(1, distance + 2):
        for bits in grouped(corr, m):
            out.append(Part(len(out), m, bits))
    return out


def block_values(fp: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    u = fp.view(np.uint64)
    out = np.zeros(len(u), np.int64)
    for k, b in enumerate(bits):
        out |= ((u >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def histograms(values: DataFrame, parts: list[Part]) -> list[list[np.ndarray]]:
    """For each part and block, the number of values of each pattern; a task passes on its sums."""
    blocks = [b for p in parts for b in p.blocks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(1 << len(b), np.int64) for b in blocks]
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for h, b in zip(held, blocks):
                h += np.bincount(block_values(fp, b), minlength=len(h))
        for k, h in enumerate(held):
            at = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(h[at])], names=["block", "v", "n"])

    found = values.select("fp").mapInArrow(run, "block int, v long, n long").groupBy("block", "v").agg(F.sum("n").alias("n")).toArrow()
    flat = [np.zeros(1 << len(b), np.int64) for b in blocks]
    k, v, n = (found.column(c).to_numpy() for c in ("block", "v", "n"))
    for i, h in enumerate(flat):
        h[v[k == i]] = n[k == i]
    turn = iter(flat)
    return [[next(turn) for _ in p.blocks] for p in parts]


def growth(hist: np.ndarray, distance: int) -> np.ndarray:
    """(pattern, t): values at exactly t flipped bits of the block, as a multiple of those of the pattern itself."""
    bits = len(hist).bit_length() - 1
    at = np.arange(len(hist))
    near = [sum((hist[at ^ sum(1 << b for b in flip)] for flip in itertools.combinations(range(bits), t)), np.zeros(len(hist), np.int64)) for t in range(distance + 1)]
    return (np.stack(near, 1) / np.maximum(hist, 1)[:, None]).astype(np.float32)


def estimates(fp: np.ndarray, own: np.ndarray, part: Part, tables: list[np.ndarray], distance: int) -> np.ndarray:
    """(value, t): estimated values within t flipped bits of the part; ``own`` counts those that share all its bits.
    The blocks' multiples are convolved as if blocks were independent."""
    total = np.zeros((len(fp), distance + 1))
    total[:, 0] = 1
    for bits, table in zip(part.blocks, tables):
        step, new = table[block_values(fp, bits)], np.zeros_like(total)
        for t in range(distance + 1):
            for s in range(t + 1):
                new[:, t] += total[:, t - s] * step[:, s]
        total = new
    return own[:, None] * np.cumsum(total, 1)


def allocate(costs: list[np.ndarray], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds of least total cost for one partition, by dynamic programming over its parts.

    ``costs[i][:, t + 1]`` is part i's cost at threshold t from -1 to ``distance``; the thresholds add up to
    distance - m + 1. Returns (cost, thresholds (value, part))."""
    m, n = len(costs), len(costs[0])
    goal = distance - m + 1  # sums are kept from -m up, as s + m >= 0
    best = np.full((n, goal + 2 * m + 1), np.inf)
    best[:, m] = 0
    picks = []
    for cost in costs:
        new, pick = np.full_like(best, np.inf), np.full(best.shape, -2, np.int8)
        for t in range(-1, distance + 1):
            for s in range(best.shape[1]):
                if 0 <= s - t < best.shape[1]:
                    tried = best[:, s - t] + cost[:, t + 1]
                    better = tried < new[:, s]
                    new[better, s], pick[better, s] = tried[better], t
        best = new
        picks.append(pick)
    at, out = np.full(n, goal + m), np.full((n, m), -1, np.int8)
    total = best[:, goal + m]
    for i in range(m - 1, -1, -1):
        out[:, i] = np.where(np.isfinite(total), picks[i][np.arange(n), at], -1)
        at = np.where(np.isfinite(total), at - out[:, i], at)
    return total, out


def thresholds(counted: DataFrame, parts: list[Part], hists: list[list[np.ndarray]], distance: int) -> DataFrame:
    """(fp, part, t) of the parts that each value probes; ``counted`` is (fp, counts: one a part, by number)."""
    tables = [[growth(h, distance) for h in hs] for hs in hists]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            own = np.array(batch.column("counts").flatten().to_numpy(), float).reshape(len(fp), len(parts))
            least, chosen = np.full(len(fp), np.inf), np.full((len(fp), len(parts)), -1, np.int8)
            for m in sorted({p.m for p in parts}):
                of = [p for p in parts if p.m == m]
                costs = []
                for p in of:
                    cost = np.zeros((len(fp), distance + 2))
                    probes = np.array([p.probes(t) if p.probes(t) <= MOST_PROBES else np.inf for t in range(distance + 1)])
                    cost[:, 1:] = estimates(fp, own[:, p.number], p, tables[p.number], distance) + PROBE_COST * probes
                    costs.append(cost)
                total, picked = allocate(costs, distance)
                better = total < least
                least[better] = total[better]
                chosen[better] = -1
                for i, p in enumerate(of):
                    chosen[better, p.number] = picked[better, i]
            row, part = np.nonzero(chosen >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(fp[row]), pa.array(part.astype(np.int32)), pa.array(chosen[row, part].astype(np.int32))], names=["fp", "part", "t"])

    return counted.mapInArrow(run, "fp long, part int, t int")


# ---------------------------------------------------------------- probe and verify


def part_keys(parts: list[Part]):
    """Array of each part's own bits of ``fp``."""
    return F.array(*(F.col("fp").bitwiseAND(F.lit(mask_of(p.bits))) for p in parts))


def indexed(values: DataFrame, parts: list[Part]) -> DataFrame:
    """(part, key, other): every value under the bits of each part."""
    return values.select(F.col("fp").alias("other"), F.posexplode(part_keys(parts)).alias("part", "key"))


def flips(spark: SparkSession, parts: list[Part], distance: int) -> DataFrame:
    """(part, flipped, flip): the masks of up to ``distance`` bits of each part; their number depends on the parts only."""
    rows = [(p.number, t, mask_of(bits)) for p in parts for t in range(distance + 1) if p.probes(t) <= MOST_PROBES for bits in itertools.combinations(p.bits, t)]
    schema = T.StructType([T.StructField("flip_part", T.IntegerType()), T.StructField("flipped", T.IntegerType()), T.StructField("flip", T.LongType())])
    return spark.createDataFrame(rows, schema)


def links(values: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Stored: the pairs (a, b), a < b, of ``values`` (fp, distinct) that differ in at most ``distance`` bits."""
    spark = values.sparkSession
    parts = partitions(correlations(values), distance)
    hists = histograms(values, parts)
    index = indexed(values, parts)
    shares = index.groupBy("part", "key").agg(F.count("*").alias("n"))
    counts = index.join(shares, ["part", "key"]).groupBy(F.col("other").alias("fp")).agg(F.array_sort(F.collect_list(F.struct("part", "n")))["n"].alias("counts"))
    plan = write_table(thresholds(counts, parts, hists, distance), "simhash-thresholds")
    masks = F.create_map(*itertools.chain.from_iterable((F.lit(p.number), F.lit(mask_of(p.bits))) for p in parts))
    # a row a flip mask, a few thousand whatever the data
    flip = F.broadcast(flips(spark, parts, distance))
    probes = plan.join(flip, (F.col("part") == F.col("flip_part")) & (F.col("flipped") <= F.col("t")))
    probes = probes.select("fp", "part", F.col("fp").bitwiseAND(masks[F.col("part")]).bitwiseXOR(F.col("flip")).alias("key"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    met = probes.join(index.withColumnsRenamed({"part": "i_part", "key": "i_key"}), (F.col("part") == F.col("i_part")) & (F.col("key") == F.col("i_key")) & (F.col("fp") < F.col("other")) & (apart <= distance))
    return write_table(met.select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct(), "simhash-links")


def near_duplicates(docs: DataFrame, width: int = WIDTH, seed: int = SEED, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id of every row of ``docs`` (doc_id, text)."""
    with stored_steps(docs.sparkSession):
        prints = write_table(fingerprints(docs, width, seed), "fingerprints")
        least = write_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-values")
        found = components(links(least.select("fp"), distance))
        labelled = least.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
        names = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
        named = write_table(labelled.join(names, "label").select(F.col("fp").alias("_fp"), "component_id"), "simhash-components")
    out = prints.join(named, F.col("fp") == F.col("_fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
