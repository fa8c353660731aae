"""Additivity (efficiency) and agreement with brute-force Shapley values."""

import itertools
import math

import numpy as np
import pytest

from churnscope.plans import explain as X


def _brute_shap(x, Z, f):
    d = len(x)
    phi = np.zeros(d)
    for z in Z:
        for i in range(d):
            others = [j for j in range(d) if j != i]
            for r in range(d):
                for S in itertools.combinations(others, r):
                    w = math.factorial(len(S)) * math.factorial(d - len(S) - 1) / math.factorial(d)
                    a = z.copy(); a[list(S)] = x[list(S)]
                    b = a.copy(); b[i] = x[i]
                    phi[i] += w * (f(b) - f(a))
    return phi / len(Z)


def _tables_from(trees, depth):
    """trees: list of (weight, nested tuple tree) -> padded tables."""
    n = len(trees)
    L = 2 ** depth
    feat = np.zeros((n, L, depth), dtype=np.int64); thr = np.zeros((n, L, depth))
    left = np.zeros((n, L, depth), dtype=bool); valid = np.zeros((n, L, depth), dtype=bool)
    value = np.zeros((n, L))
    for t, (w, tree) in enumerate(trees):
        leaves = []

        def walk(node, path):
            if not isinstance(node, tuple):
                leaves.append((node, path)); return
            f, th, l, r = node
            walk(l, path + [(f, th, True)]); walk(r, path + [(f, th, False)])
        walk(tree, [])
        for li, (v, p) in enumerate(leaves):
            value[t, li] = v * w
            for k, (f, th, lf) in enumerate(p):
                feat[t, li, k], thr[t, li, k], left[t, li, k], valid[t, li, k] = f, th, lf, True
    return feat, thr, left, valid, value


def _predict(tree, x):
    while isinstance(tree, tuple):
        f, th, l, r = tree
        tree = l if x[f] <= th else r
    return tree


def test_shap_matches_brute_force():
    rng = np.random.default_rng(0)
    # feature 0 appears twice on one path; depth 3
    t1 = (0, 0.5, (1, 0.2, 1.0, (0, 0.1, 2.0, 3.0)), (2, 0.7, -1.0, 4.0))
    t2 = (2, 0.3, (1, 0.6, 0.5, -0.5), 1.5)
    trees = [(1.0, t1), (0.3, t2)]
    tables = _tables_from(trees, 3)
    f = lambda v: sum(w * _predict(t, v) for w, t in trees)
    X_ = rng.random((5, 3)); Z = rng.random((4, 3))
    phi, margin, base = X.shap_batch(X_, Z, tables, 3)
    for i in range(5):
        assert phi[i] == pytest.approx(_brute_shap(X_[i], Z, f), abs=1e-9)
        assert margin[i] == pytest.approx(f(X_[i]))
        assert phi[i].sum() + base == pytest.approx(margin[i])
