"""Classification metrics from (label, score) columns.

Ranking metrics need cumulative counts in score order. Scores are first
reduced to (score, positives, negatives); the distinct scores are dealt into
range buckets, cumulative sums run per bucket in parallel, and per-bucket
offsets, summed in two levels (buckets within groups, then groups), are added
back. No step puts all scores, or all buckets, in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope import config as C
from churnscope.session import write_table


#: Buckets whose totals are summed in one group of the second level.
LEVEL = 1024


def default_buckets(spark) -> int:
    """Range buckets for running sums: the shuffle parallelism, 64 at least."""
    return max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucket_offsets(totals: DataFrame, cols) -> DataFrame:
    """Per ``_bucket``: ``_o_<col>``, the sum of all earlier buckets, and ``tot_<col>``, of all; from ``_t_<col>``.

    Sums run within groups of LEVEL buckets and over one row a group, so no task orders more than LEVEL buckets or all groups."""
    totals = totals.withColumn("_group", F.floor(F.col("_bucket") / LEVEL))
    groups = totals.groupBy("_group").agg(*[F.sum(f"_t_{c}").alias(f"_g_{c}") for c in cols])
    earlier = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    groups = groups.select("_group", *[F.coalesce(F.sum(f"_g_{c}").over(earlier), zero).alias(f"_e_{c}") for c in cols],
                           *[F.sum(f"_g_{c}").over(Window.partitionBy()).alias(f"tot_{c}") for c in cols])
    within = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inner = totals.select("_bucket", "_group", *[F.coalesce(F.sum(f"_t_{c}").over(within), zero).alias(f"_w_{c}") for c in cols])
    return inner.join(groups, "_group").select("_bucket", *[(F.col(f"_e_{c}") + F.col(f"_w_{c}")).alias(f"_o_{c}") for c in cols],
                                               *[f"tot_{c}" for c in cols])


def prefix_sums(df: DataFrame, order_col: str, cols, n_buckets: int = None) -> DataFrame:
    """Inclusive running sums of ``cols`` in ascending ``order_col`` order,
    added as ``cum_<col>``, and grand totals as ``tot_<col>``.
    ``order_col`` values must be distinct; null comes first and NaN last."""
    if n_buckets is None:
        n_buckets = default_buckets(df.sparkSession)
    # Rows are dealt by ranges of the order and written once, so what they
    # come from, e.g. model scores, is computed once for totals and sums.
    dealt = df.repartitionByRange(n_buckets, order_col) if n_buckets > 1 else df.coalesce(1)
    b = write_table(dealt.withColumn("_bucket", F.spark_partition_id()), "prefix_sums_input")
    off = bucket_offsets(b.groupBy("_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols]), cols)
    wi = (Window.partitionBy("_bucket").orderBy(order_col)
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = b.select("*", *[F.sum(c).over(wi).alias(f"_i_{c}") for c in cols])
    # one row a bucket: as many as the shuffle has partitions; AQE broadcasts them where measured small
    j = inner.join(off, "_bucket")
    return j.select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_i_{c}")).alias(f"cum_{c}") for c in cols],
                    *[f"tot_{c}" for c in cols])


def score_counts(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return scored.groupBy(F.col(p).cast("double").alias("score")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"),
        F.sum((1 - F.col(y)).cast("long")).alias("neg"),
    )


def ranking_metrics(scored: DataFrame, y: str = "y", p: str = "p", n_buckets: int = None) -> DataFrame:
    """ROC-AUC (Mann-Whitney, ties count one half) and average precision
    (step sum over distinct thresholds, highest first)."""
    sc = score_counts(scored, y, p).withColumn("cnt", F.col("pos") + F.col("neg"))
    cs = prefix_sums(sc, "score", ["pos", "neg", "cnt"], n_buckets)
    P = F.col("tot_pos").cast("double")
    N = F.col("tot_neg").cast("double")
    neg_below = (F.col("cum_neg") - F.col("neg")).cast("double")
    auc_term = F.col("pos").cast("double") * (neg_below + 0.5 * F.col("neg").cast("double"))
    tp_at = P - (F.col("cum_pos") - F.col("pos")).cast("double")
    n_at = (P + N) - (F.col("cum_cnt") - F.col("cnt")).cast("double")
    ap_term = F.try_divide(F.col("pos").cast("double"), P) * (tp_at / n_at)
    return cs.agg(
        F.try_divide(F.sum(auc_term), F.max(P) * F.max(N)).alias("auc"),
        F.sum(ap_term).alias("avg_precision"),
    )


def confusion(scored: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Confusion counts with prediction = score strictly above ``threshold``."""
    pred = F.col(p) > threshold
    yy = F.col(y) == 1

    def cnt(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0)).cast("bigint")

    return scored.agg(
        cnt(pred & yy).alias("tp"), cnt(pred & ~yy).alias("fp"),
        cnt(~pred & yy).alias("fn"), cnt(~pred & ~yy).alias("tn"),
        F.avg(F.pow(F.col(p).cast("double") - F.col(y).cast("double"), 2)).alias("brier_score"),
    )


def _div0(a: Column, b: Column) -> Column:
    """a / b with 0 when b is 0 (the zero-division convention of the reports)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def binary_metrics(scored: DataFrame, y: str = "y", p: str = "p", n_buckets: int = None,
                   threshold: float = 0.5) -> DataFrame:
    """Auc, avg_precision, f1, precision, recall, brier_score (one row).

    Everything comes from the (score, positives, negatives) table in one
    final aggregation: ranking terms from the running sums, confusion counts
    from the side of the threshold each score falls on, Brier score from
    pos * (1 - s)^2 + neg * s^2.
    """
    sc = score_counts(scored, y, p).withColumn("cnt", F.col("pos") + F.col("neg"))
    cs = prefix_sums(sc, "score", ["pos", "neg", "cnt"], n_buckets)
    P = F.col("tot_pos").cast("double")
    N = F.col("tot_neg").cast("double")
    s, pos, neg = F.col("score"), F.col("pos").cast("double"), F.col("neg").cast("double")
    neg_below = (F.col("cum_neg") - F.col("neg")).cast("double")
    tp_at = P - (F.col("cum_pos") - F.col("pos")).cast("double")
    n_at = (P + N) - (F.col("cum_cnt") - F.col("cnt")).cast("double")
    above = s > threshold
    agg = cs.agg(
        F.try_divide(F.sum(pos * (neg_below + 0.5 * neg)), F.max(P) * F.max(N)).alias("auc"),
        F.sum(F.try_divide(pos, P) * (tp_at / n_at)).alias("avg_precision"),
        F.sum(F.when(above, pos).otherwise(0.0)).alias("tp"),
        F.sum(F.when(above, neg).otherwise(0.0)).alias("fp"),
        F.sum(F.when(above, 0.0).otherwise(pos)).alias("fn"),
        F.try_divide(F.sum(pos * (1 - s) * (1 - s) + neg * s * s), F.max(P + N)).alias("brier_score"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return agg.select(
        "auc", "avg_precision",
        _div0(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _div0(tp, tp + fp).alias("precision"),
        _div0(tp, tp + fn).alias("recall"),
        "brier_score",
    )


def class_report(scored: DataFrame, y: str = "y", p: str = "p",
                 names=C.CLASS_NAMES) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and
    support-weighted averages (0/0 counts as 0)."""
    c = confusion(scored, y, p)
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    p0, r0 = _div0(tn, tn + fn), _div0(tn, tn + fp)
    p1, r1 = _div0(tp, tp + fp), _div0(tp, tp + fn)
    f0 = _div0(2 * tn, 2 * tn + fn + fp)
    f1 = _div0(2 * tp, 2 * tp + fp + fn)
    s0, s1 = (tn + fp).cast("double"), (tp + fn).cast("double")
    n = s0 + s1
    acc = _div0(tp + tn, tp + tn + fp + fn)
    wide = c.select(
        p0.alias("p0"), r0.alias("r0"), f0.alias("f0"), s0.alias("s0"),
        p1.alias("p1"), r1.alias("r1"), f1.alias("f1"), s1.alias("s1"),
        acc.alias("acc"), n.alias("n"),
        ((p0 + p1) / 2).alias("pm"), ((r0 + r1) / 2).alias("rm"), ((f0 + f1) / 2).alias("fm"),
        _div0(p0 * s0 + p1 * s1, n).alias("pw"), _div0(r0 * s0 + r1 * s1, n).alias("rw"),
        _div0(f0 * s0 + f1 * s1, n).alias("fw"),
    )
    return wide.selectExpr(
        "stack(5, "
        f"'{names[0]}', p0, r0, f0, s0, "
        f"'{names[1]}', p1, r1, f1, s1, "
        "'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), acc, n, "
        "'macro avg', pm, rm, fm, n, "
        "'weighted avg', pw, rw, fw, n"
        ") AS (label, precision, recall, f1_score, support)"
    ).withColumn("support", F.col("support").cast("bigint"))
