"""Exact linear-interpolated quantiles without gathering a whole column.

Spark's exact ``percentile`` merges every distinct value into one buffer on
one task. Here one pass computes, for every requested (column, q), a bracket
around the target rank from an approximate quantile sketch (bounded size).
Then, per quantile, only the distinct values inside the bracket (about
6/accuracy of all rows, however the values tie) are ranked exactly, with all
values below the bracket folded into one counted group. Like
``DataFrame.stat.approxQuantile`` this is an action and returns numbers; only
O(1) values per quantile reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 20000


def exact_quantiles(df: DataFrame, specs, accuracy: int = ACCURACY) -> dict:
    """{(col, q): value} for each (col, q) in ``specs`` (nulls ignored,
    interpolation as numpy/pandas ``quantile``; None for an empty column).

    Two jobs whatever the number of specs: one aggregation for counts and
    sketch brackets, one pass that ranks the bracketed values of all specs
    (rows exploded to (spec, value), a window partitioned by spec).
    """
    specs = list(dict.fromkeys(specs))
    d = 3.0 / accuracy
    cols = list(dict.fromkeys(c for c, _ in specs))
    aggs, probes = [], {}
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        qs = sorted({max(q - d, 0.0) for cc, q in specs if cc == c}
                    | {min(q + d, 1.0) for cc, q in specs if cc == c})
        probes[c] = (i, qs)
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"),
                 F.percentile_approx(x, F.array(*[F.lit(q) for q in qs]), accuracy).alias(f"br{i}")]
    row = df.agg(*aggs).first()
    out, plan = {}, []
    for c, q in specs:
        i, qs = probes[c]
        n = row[f"n{i}"]
        if not n:
            out[(c, q)] = None
            continue
        bracket = dict(zip(qs, row[f"br{i}"]))
        lo_q, hi_q = max(q - d, 0.0), min(q + d, 1.0)
        lo = row[f"mn{i}"] if lo_q <= 0 else bracket[lo_q]
        hi = row[f"mx{i}"] if hi_q >= 1 else bracket[hi_q]
        r = (n - 1) * q
        plan.append((c, q, lo, hi, r, math.floor(r), math.ceil(r)))
    if not plan:
        return out
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(j).alias("sid"), F.col(c).cast("double").alias("x"))
        for j, (c, *_rest) in enumerate(plan)])).alias("e")).select("e.sid", "e.x")

    def by_spec(values):
        e = None
        for j, v in enumerate(values):
            e = F.when(F.col("sid") == j, F.lit(v)) if e is None else e.when(F.col("sid") == j, F.lit(v))
        return e

    lo_c, hi_c = by_spec([p[2] for p in plan]), by_spec([p[3] for p in plan])
    r0_c, r1_c = by_spec([p[5] for p in plan]), by_spec([p[6] for p in plan])
    # Values below the bracket collapse into one group per spec (key null).
    key = F.when(F.col("x") < lo_c, F.lit(None).cast("double")).otherwise(F.col("x"))
    g = (pairs.filter(F.col("x").isNotNull() & (F.col("x") <= hi_c))
         .groupBy("sid", key.alias("k")).agg(F.count(F.lit(1)).alias("c")))
    w = (Window.partitionBy("sid").orderBy(F.asc_nulls_first("k"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cum = g.withColumn("cum_end", F.sum("c").over(w)).withColumn("cum_start", F.col("cum_end") - F.col("c"))
    covers = lambda r: (F.col("cum_start") <= r) & (r < F.col("cum_end"))
    hits = cum.filter(F.col("k").isNotNull() & (covers(r0_c) | covers(r1_c))).collect()
    found = {}
    for h in hits:
        j = h["sid"]
        for rr in (plan[j][5], plan[j][6]):
            if h["cum_start"] <= rr < h["cum_end"]:
                found[(j, rr)] = h["k"]
    for j, (c, q, lo, hi, r, r0, r1) in enumerate(plan):
        if (j, r0) not in found or (j, r1) not in found:
            raise RuntimeError(f"quantile bracket missed rank for {c} q={q}")
        v0, v1 = found[(j, r0)], found[(j, r1)]
        out[(c, q)] = v0 + (v1 - v0) * (r - r0)
    return out


def exact_quantile(df: DataFrame, col: str, q: float, accuracy: int = ACCURACY) -> float:
    return exact_quantiles(df, [(col, q)], accuracy)[(col, q)]
