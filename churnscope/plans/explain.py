"""M13 (+ A18, W7, W10): feature contributions of a boosted-tree model.

Exact interventional Shapley values of the model margin against a background
sample (at most 100 training rows), per customer.

For one tree and one (x, z) pair, v(S) = tree(x on S, z elsewhere). A leaf is
reached iff every feature tested on its path is satisfied by x (and then must
be in S) or by z (then must be out of S) or by both (free). With A = features
only x satisfies and B = features only z satisfies, the leaf's game is
u(S) = 1[A in S, B disjoint S], whose Shapley values are (a-1)! b! / (a+b)!
for i in A and -a! (b-1)! / (a+b)! for i in B. Summing leaf values times
these weights over leaves and trees, and averaging over z, gives the values;
they add up to margin(x) - mean margin(z).

The game of a leaf for a pair (x, z) depends only on which path positions x
and z satisfy (at most 2^depth patterns each). So the background is folded
once, on the driver, into a table (tree, leaf, x pattern) -> contribution per
path position: bounded by model size, whatever the number of customers or
background rows. The trees and folded tables are broadcast; ``mapInPandas``
evaluates batches of customers with numpy (one table lookup per tree leaf),
so the work is spread over the customer partitions. Margins are in the model's raw units
(GBT margin; probability = 1 / (1 + exp(-2 margin))).
"""

from __future__ import annotations

import math
import os
import uuid

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnscope import config as C
from churnscope.config import DEFAULT, RiskConfig
from churnscope.functions.random import key32, uniform
from churnscope.plans.model import assemble, fit_scaler

BACKGROUND_ROWS = 100
BACKGROUND_STREAM = 4


def _ship_by_value():
    """Serialise this module's functions into the tasks, so Python workers do
    not need the package installed (the Shapley kernel runs in
    ``mapInPandas``)."""
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: rely on installed package
        pass


_ship_by_value()


def fit_explainer(train: DataFrame, cfg: RiskConfig = DEFAULT, label: str = "churn",
                  cols=C.FEATURE_COLS):
    """A single boosted-tree model on standardised features (the model explained)."""
    b = cfg.boost
    from churnscope.plans.model import _training_frame
    rows = _training_frame(train, label, alone=True)
    scaler = fit_scaler(rows, cols)
    d = assemble(rows, scaler, cols)
    gbt = GBTClassifier(maxIter=b.max_iter, maxDepth=b.max_depth, stepSize=b.step_size,
                        subsamplingRate=b.subsampling_rate, featureSubsetStrategy=b.feature_subset,
                        seed=cfg.seed).fit(d)
    rows.unpersist()
    return scaler, gbt


def background(train: DataFrame, scaler, cfg: RiskConfig = DEFAULT, n: int = BACKGROUND_ROWS,
               cols=C.FEATURE_COLS) -> np.ndarray:
    """Up to ``n`` training rows chosen by hash order (TakeOrdered, n rows)."""
    u = uniform(key32("customer_id", F.lit(cfg.seed)), F.lit(BACKGROUND_STREAM))
    rows = (assemble(train.withColumn("_u", u).orderBy("_u").limit(n), scaler, cols)
            .select(vector_to_array("features").alias("f")).collect())
    return np.array([r["f"] for r in rows], dtype=float)


def tree_tables(model: GBTClassificationModel, spark, depth: int):
    """Leaf paths of every tree as fixed-size arrays (bounded by model size).

    Returns feat, thr, left, valid of shape (trees, leaves, depth) and value of
    shape (trees, leaves) (leaf prediction times tree weight, 0 for padding).
    """
    from churnscope.session import checkpoint_dir
    path = os.path.join(checkpoint_dir(spark), "models", f"explain-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold").collect()
    weights = list(model.treeWeights)
    trees = {}
    for r in nodes:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    n_trees = len(weights)
    max_leaves = 2 ** depth
    feat = np.zeros((n_trees, max_leaves, depth), dtype=np.int64)
    thr = np.zeros((n_trees, max_leaves, depth))
    left = np.zeros((n_trees, max_leaves, depth), dtype=bool)
    valid = np.zeros((n_trees, max_leaves, depth), dtype=bool)
    value = np.zeros((n_trees, max_leaves))
    for t in range(n_trees):
        nd = trees[t]
        leaves = []

        def walk(i, path):
            r = nd[i]
            if r["leftChild"] < 0:
                leaves.append((r["prediction"], list(path)))
                return
            f, th = r["featureIndex"], r["leftCategoriesOrThreshold"][0]
            walk(r["leftChild"], path + [(f, th, True)])
            walk(r["rightChild"], path + [(f, th, False)])

        walk(0, [])
        for li, (val, p) in enumerate(leaves):
            value[t, li] = val * weights[t]
            for k, (f, th, lf) in enumerate(p):
                feat[t, li, k], thr[t, li, k], left[t, li, k], valid[t, li, k] = f, th, lf, True
    return feat, thr, left, valid, value


def _weights(depth: int):
    wa = np.zeros((depth + 1, depth + 1))
    wb = np.zeros((depth + 1, depth + 1))
    for a in range(depth + 1):
        for b in range(depth + 1):
            if a + b == 0:
                continue
            if a > 0:
                wa[a, b] = math.factorial(a - 1) * math.factorial(b) / math.factorial(a + b)
            if b > 0:
                wb[a, b] = math.factorial(a) * math.factorial(b - 1) / math.factorial(a + b)
    return wa, wb


def _satisfied(X, feat, thr, left, valid):
    """Per (row, leaf, position): the path condition holds for the row, with
    repeated features on a path combined, and only the first position of each
    feature kept (others, and padding, count as satisfied)."""
    xv = X[:, feat]                                   # (n, L, D)
    cond = np.where(left[None], xv <= thr[None], xv > thr[None]) | ~valid[None]
    D = feat.shape[-1]
    same = (feat[:, :, None] == feat[:, None, :]) & valid[:, :, None] & valid[:, None, :]  # (L, D, D)
    grp = np.ones_like(cond)
    for k in range(D):
        # AND over positions with the same feature as k
        grp[:, :, k] = np.all(cond | ~same[None, :, k, :], axis=-1)
    first = np.ones_like(valid)
    for k in range(1, D):
        first[:, k] = ~np.any(same[:, k, :k], axis=-1)
    rep = valid & first
    return np.where(rep[None], grp, True), rep


def _pattern(sat: np.ndarray) -> np.ndarray:
    """Bit pattern of satisfied path positions: (rows, L, D) bool -> (rows, L) int."""
    D = sat.shape[-1]
    return (sat.astype(np.int64) << np.arange(D)).sum(-1)


def leaf_tables(tables, Z: np.ndarray):
    """Fold the background into per-leaf lookup tables (bounded by model size).

    A leaf's game for a pair (x, z) depends only on which path positions x
    satisfies and which z satisfies: at most 2^D patterns each. Counting the
    background rows per (leaf, z pattern) gives, for every (leaf, x pattern),
    the background-averaged contribution of each path position. Returns
    contrib (trees, L, 2^D, D), rep (trees, L, D) and the base value
    (mean margin over the background).
    """
    feat, thr, left, valid, value = tables
    T, L, D = feat.shape
    P = 1 << D
    wa, wb = _weights(D)
    bits = ((np.arange(P)[:, None] >> np.arange(D)) & 1).astype(bool)          # (P, D)
    xo = bits[:, None, :]                                                        # (P,1,D) x side
    zo = bits[None, :, :]                                                        # (1,P,D) z side
    x_only, z_only = xo & ~zo, ~xo & zo                                          # (P,P,D)
    reach = ~np.any(~xo & ~zo, axis=-1)                                          # (P,P)
    a, b = x_only.sum(-1), z_only.sum(-1)
    pos = reach[..., None] * (x_only * wa[a, b][..., None] - z_only * wb[a, b][..., None])  # (P,P,D)
    contrib = np.zeros((T, L, P, D))
    reps = np.zeros((T, L, D), dtype=bool)
    base = 0.0
    m = Z.shape[0]
    for t in range(T):
        ZO, rep = _satisfied(Z, feat[t], thr[t], left[t], valid[t])             # (m, L, D)
        reps[t] = rep
        base += (ZO.all(-1) * value[t]).sum(-1).mean()
        pz = _pattern(ZO)                                                        # (m, L)
        w = np.zeros((L, P))
        for leaf in range(L):
            w[leaf] = np.bincount(pz[:, leaf], minlength=P) / m
        # contrib[leaf, px, k] = value[leaf] * sum_pz w[leaf, pz] * pos[px, pz, k]
        contrib[t] = value[t][:, None, None] * np.einsum("lz,xzk->lxk", w, pos)
    return contrib, reps, base


def _conditions(feat, thr, left, valid, rep):
    """Per leaf that is not padding: its number, the pattern bits that always hold, and
    per kept position its bit with the (feature, threshold, left) conditions it combines."""
    L, D = feat.shape
    for leaf in range(L):
        if not valid[leaf].any():
            continue
        free = sum(1 << k for k in range(D) if not rep[leaf, k])
        tests = []
        for k in np.flatnonzero(rep[leaf]):
            same = np.flatnonzero(valid[leaf] & (feat[leaf] == feat[leaf, k]))
            tests.append((k, sorted({(int(feat[leaf, j]), float(thr[leaf, j]), bool(left[leaf, j])) for j in same})))
        yield leaf, free, tests


def shap_rows(X: np.ndarray, tables, contrib: np.ndarray, reps: np.ndarray, n_features: int):
    """(phi (n, d), margin (n,)) for rows X from the folded leaf tables.

    A tree tests each of its conditions once a row; a leaf combines them into a pattern,
    one byte a row or a few, and adds its table's row for it, spread over the features."""
    feat, thr, left, valid, value = tables
    T, L, D = feat.shape
    n = X.shape[0]
    phi = np.zeros((n, n_features))
    margin = np.zeros(n)
    columns = np.ascontiguousarray(X.T)
    full = (1 << D) - 1
    kind = np.min_scalar_type(full)
    for t in range(T):
        known = {}                                                               # condition -> 0 or 1 a row
        if not valid[t].any():                                                   # a tree of one leaf
            margin += value[t].sum()
        for leaf, free, tests in _conditions(feat[t], thr[t], left[t], valid[t], reps[t]):
            pattern = np.full(n, free, dtype=kind)
            spread = np.zeros((full + 1, n_features))
            for k, conditions in tests:
                holds = None
                for c in conditions:
                    if c not in known:
                        f, th, lf = c
                        known[c] = (columns[f] <= th if lf else columns[f] > th).astype(kind)
                    holds = known[c] if holds is None else holds & known[c]
                pattern |= holds << kind.type(k)
                spread[:, feat[t, leaf, k]] = contrib[t, leaf, :, k]
            phi += spread[pattern]
            margin += (pattern == full) * value[t, leaf]
    return phi, margin


def shap_batch(X, Z, tables, n_features):
    """(phi (n, d), margin (n,), base) for rows X against background Z."""
    contrib, reps, base = leaf_tables(tables, Z)
    phi, margin = shap_rows(X, tables, contrib, reps, n_features)
    return phi, margin, base


def contributions(df: DataFrame, scaler, model: GBTClassificationModel, bg: np.ndarray,
                  cols=C.FEATURE_COLS, batch: int = 4096) -> DataFrame:
    """Long table (customer_id, feature, phi) for every row of ``df``."""
    spark = df.sparkSession
    depth = model.getMaxDepth()
    tables = tree_tables(model, spark, depth)
    contrib, reps, _ = leaf_tables(tables, bg)
    # Trees and folded tables: trees x 2^depth x 2^depth x depth numbers,
    # bounded by model size whatever the data size.
    b_tables = spark.sparkContext.broadcast((tables, contrib, reps))
    names = list(cols)
    d = len(names)

    def run(it):
        import pandas as pd
        tb, ct, rp = b_tables.value
        for pdf in it:
            for s in range(0, len(pdf), batch):
                part = pdf.iloc[s:s + batch]
                X = np.stack(part["f"].to_numpy()).astype(float)
                phi, _ = shap_rows(X, tb, ct, rp, d)
                yield pd.DataFrame({
                    "customer_id": np.repeat(part["customer_id"].to_numpy(), d),
                    "feature": np.tile(np.array(names, dtype=object), len(part)),
                    "phi": phi.reshape(-1),
                })

    # Each row costs trees x background evaluations: spread the (small in
    # bytes) input over the configured parallelism before the Python stage.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = (assemble(df, scaler, cols).select("customer_id", vector_to_array("features").alias("f"))
         .repartition(parts, "customer_id"))
    return x.mapInPandas(run, "customer_id string, feature string, phi double")


def margins(df: DataFrame, scaler, model: GBTClassificationModel, cols=C.FEATURE_COLS) -> DataFrame:
    """Model margin per customer (for the additivity check)."""
    out = model.transform(assemble(df, scaler, cols))
    return out.select("customer_id", vector_to_array("rawPrediction")[1].alias("margin"))


def base_value(model: GBTClassificationModel, spark, bg: np.ndarray) -> float:
    tables = tree_tables(model, spark, model.getMaxDepth())
    return float(leaf_tables(tables, bg)[2])


def global_importance(contrib: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature."""
    return contrib.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))


def top_contributions(contrib: DataFrame, k: int = 8) -> DataFrame:
    """The k largest contributions by absolute value per customer
    (16 rows per customer, so the window is small), rounded to 4 places."""
    w = Window.partitionBy("customer_id").orderBy(F.desc(F.abs("phi")), F.asc("feature"))
    return (contrib.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumn("phi", F.bround("phi", 4)))
