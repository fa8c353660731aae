"""SimHash classes against all pairs, and the parts of the generalised pigeonhole search."""

import random
import re

import numpy as np
import pytest
import xxhash

from churnscope.llm import simhash
from tests.llm.conftest import DOCS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_print(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, alike):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = list(nodes)
    for i, x in enumerate(nodes):
        for y in nodes[:i]:
            if alike(x, y):
                root[max(find(x), find(y))] = min(find(x), find(y))
    return {x: find(x) for x in nodes}


def held_to_plain(got, rows):
    prints = {t: plain_print(t) for _, t in rows}
    root = plain_components(set(prints.values()), lambda x, y: (x ^ y).bit_count() <= 2)
    least = {}
    for i, t in rows:
        if i is not None:
            least[root[prints[t]]] = min(i, least.get(root[prints[t]], i))
    want = sorted([(i, f"{prints[t]:016x}", least.get(root[prints[t]])) for i, t in rows], key=str)
    assert sorted([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got], key=str) == want


def test_fingerprints_in_pieces():
    r = random.Random(1)
    for text in ("", " \n", "One", "a b", "a b c", "É É é x", "w " * 500, " ".join(f"w{r.randrange(50)}" for _ in range(900))):
        for size in (1, 7, 100, 1 << 20):
            assert simhash.majority(text.encode(), size=size) == plain_print(text)
    assert simhash.majority(None) == 0


def test_classes_against_all_pairs(spark, docs):
    r = random.Random(2)
    rows = [(d["doc_id"], d["text"]) for d in docs.collect()]
    base = [f"w{k}" for k in range(400)]
    for k in range(300):  # one group of near copies, of many fingerprints close to each other
        words = list(base)
        for _ in range(r.randrange(3)):
            words[r.randrange(400)] = f"x{r.randrange(50)}"
        rows.append((1000 + k, " ".join(words)))
    rows += [(2000 + k, " ".join(r.choice("abcdefgh") * 3 for _ in range(r.randrange(1, 60)))) for k in range(150)]
    held_to_plain(simhash.near_duplicates(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).withColumnRenamed("lang", "fingerprint").withColumnRenamed("source", "fp")).collect(), rows)


def test_registered_query(spark, stored):
    full, empty = stored
    rows = [(d["doc_id"], d["text"]) for d in spark.read.parquet(full + "/documents.parquet").collect()]
    held_to_plain(simhash.op11_simhash(spark, full).collect(), rows)
    assert simhash.op11_simhash(spark, empty).count() == 0


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_links_of_crowded_and_spread_values(spark, distance):
    """Values of a crowded corner, of skewed bits and at random: the same links as all pairs, whatever the distance."""
    r = random.Random(distance)
    crowd = [0x0123456789ABCDEF ^ sum(1 << b for b in r.sample(range(12), r.randrange(5))) for _ in range(200)]
    skewed = [sum(1 << b for b in range(64) if r.random() < (0.02 if b < 40 else 0.5)) for _ in range(200)]
    spread = [r.getrandbits(64) for _ in range(100)]
    spread += [x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for x in spread]
    values = sorted({simhash.signed(v) for v in [*crowd, *skewed, *spread, 0, (1 << 64) - 1]})
    got = {(x["a"], x["b"]) for x in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), distance).collect()}
    assert got == {(x, y) for i, y in enumerate(values) for x in values[:i] if bin((x ^ y) & (2**64 - 1)).count("1") <= distance}


def test_allocation_is_the_cheapest():
    r = np.random.default_rng(3)
    for m, distance in ((1, 2), (2, 2), (3, 2), (3, 4), (4, 3)):
        costs = [np.concatenate([np.zeros((20, 1)), np.sort(r.integers(1, 100, (20, distance + 1)), 1)], 1) for _ in range(m)]
        total, picked = simhash.allocate(costs, distance)
        grids = np.stack(np.meshgrid(*[np.arange(-1, distance + 1)] * m, indexing="ij"), -1).reshape(-1, m)
        grids = grids[grids.sum(1) == distance - m + 1]
        every = np.array([[sum(costs[i][v, g[i] + 1] for i in range(m)) for g in grids] for v in range(20)])
        assert (picked.sum(1) == distance - m + 1).all() and np.allclose(total, every.min(1))
        assert np.allclose(total, [sum(costs[i][v, picked[v, i] + 1] for i in range(m)) for v in range(20)])


def test_crowded_values_leave_crowded_parts():
    """A part that most values share gets no threshold, and a value with many near ones is probed as a whole."""
    corr = np.zeros((64, 64))
    parts = simhash.partitions(corr, 2)
    assert sorted(b for p in parts if p.m == 3 for b in p.bits) == list(range(64))
    costs = [np.array([[0.0, 9e6, 9e6, 9e6]]), np.array([[0.0, 3, 60, 999]]), np.array([[0.0, 3, 60, 999]])]
    assert sorted(simhash.allocate(costs, 2)[1][0].tolist()) == [-1, 0, 1]
    assert parts[0].m == 1 and parts[0].probes(2) == 1 + 64 + 2016
