"""The Shapley kernel against its plain definition over (row, leaf, position) arrays, and the memory it takes a row."""

import tracemalloc

import numpy as np

from churnscope.plans import explain as X


def forest(rng, trees, depth, d):
    L = 2 ** depth
    feat, thr = np.zeros((trees, L, depth), dtype=np.int64), np.zeros((trees, L, depth))
    left, valid, value = np.zeros((trees, L, depth), dtype=bool), np.zeros((trees, L, depth), dtype=bool), np.zeros((trees, L))
    for t in range(trees):
        leaves = []

        def grow(path):
            if t == 1 or len(path) == depth or (path and rng.random() < 0.2):  # tree 1 is a single leaf
                leaves.append(path)
                return
            f, th = int(rng.integers(d)), float(rng.integers(-2, 3))
            grow(path + [(f, th, True)])
            grow(path + [(f, th, False)])

        grow([])
        for i, path in enumerate(leaves):
            value[t, i] = rng.normal()
            for k, (f, th, lf) in enumerate(path):
                feat[t, i, k], thr[t, i, k], left[t, i, k], valid[t, i, k] = f, th, lf, True
    return feat, thr, left, valid, value


def plain(x, tables, contrib, reps, d):
    feat, thr, left, valid, value = tables
    phi, margin = np.zeros((len(x), d)), np.zeros(len(x))
    for t in range(len(feat)):
        holds, _ = X._satisfied(x, feat[t], thr[t], left[t], valid[t])
        margin += (holds.all(-1) * value[t]).sum(-1)
        pattern = X._pattern(holds)
        for leaf in range(feat.shape[1]):
            for k in np.flatnonzero(reps[t, leaf]):
                phi[:, feat[t, leaf, k]] += contrib[t, leaf, pattern[:, leaf], k]
    return phi, margin


def test_same_numbers_as_the_plain_definition():
    rng = np.random.default_rng(5)
    for depth, d in ((1, 3), (3, 2), (5, 4)):
        tables = forest(rng, 12, depth, d)
        contrib, reps, _ = X.leaf_tables(tables, rng.integers(-2, 3, (30, d)).astype(float))
        x = rng.integers(-3, 4, (200, d)).astype(float)  # values equal to thresholds too
        x[3, 0], x[4, 0], x[5, 0] = np.nan, np.inf, -np.inf
        phi, margin = X.shap_rows(x, tables, contrib, reps, d)
        want_phi, want_margin = plain(x, tables, contrib, reps, d)
        assert np.array_equal(phi, want_phi) and np.array_equal(margin, want_margin)
    empty = X.shap_rows(x[:0], tables, contrib, reps, d)
    assert empty[0].shape == (0, d) and empty[1].shape == (0,)


def test_memory_a_row_is_that_of_the_features_not_of_all_paths():
    rng = np.random.default_rng(6)
    tables = forest(rng, 4, 5, 16)
    contrib, reps, _ = X.leaf_tables(tables, rng.normal(size=(20, 16)))
    x = rng.normal(size=(20_000, 16))
    tracemalloc.start()
    X.shap_rows(x, tables, contrib, reps, 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 800 * len(x)  # 32 leaves of 5 positions: a number for each would take 1,280 bytes
