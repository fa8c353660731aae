"""Reports over the customer risk table.

Every report is a global or grouped aggregation (partial aggregation before
the shuffle) or a filter; fixed tier orders come from a five-row literal
table; top-k and paging use ``TakeOrderedAndProject`` (k rows per task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope import config as C
from churnscope.config import DEFAULT, RiskConfig
from churnscope.functions.scalar import exact_avg, exact_sum, fmt_delta, fmt_money, fmt_mult, fmt_pct
from churnscope.operators.quantiles import exact_quantiles


def _dbl(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


# ---------------------------------------------------------------- filters

def filter_customers(cust: DataFrame, min_p: float = 0.0, max_p: float = 1.0,
                     segment: str = None, tier: str = None) -> DataFrame:
    """Probability range plus optional segment and tier ("All" = no filter)."""
    cond = (F.col("churn_prob") >= min_p) & (F.col("churn_prob") <= max_p)
    if segment and segment != "All":
        cond = cond & (F.col("segment") == segment)
    if tier and tier != "All":
        cond = cond & (F.col("risk_tier") == tier)
    return cust.filter(cond)


def search_customers(cust: DataFrame, search: str = None, tier: str = None,
                     literal: bool = False) -> DataFrame:
    """Case-insensitive id pattern (regex by default) and tier."""
    df = cust
    if search:
        if literal:
            df = df.filter(F.lower(F.col("customer_id")).contains(search.lower()))
        else:
            df = df.filter(F.coalesce(F.col("customer_id").rlike("(?i)" + search), F.lit(False)))
    if tier and tier != "All":
        df = df.filter(F.col("risk_tier") == tier)
    return df


def lookup_customer(cust: DataFrame, customer_id: str) -> DataFrame:
    """Exact key lookup (the key is trimmed first)."""
    return cust.filter(F.col("customer_id") == customer_id.strip())


def at_risk(cust: DataFrame) -> DataFrame:
    """P10: customers in the Critical or High tier."""
    return cust.filter(F.col("risk_tier").isin(*C.AT_RISK_TIERS))


def select_existing(df: DataFrame, cols) -> DataFrame:
    """Project the listed columns that exist, in the listed order."""
    return df.select(*[c for c in cols if c in df.columns])


METRIC_DISPLAY = dict(C.METRIC_DISPLAY_NAMES)


def display_metrics(metrics: DataFrame) -> DataFrame:
    """Display names of the metric columns."""
    return metrics.withColumnsRenamed({k: v for k, v in METRIC_DISPLAY.items() if k in metrics.columns})


def display_stress(stress: DataFrame) -> DataFrame:
    """P13 + C8: formatted stress table with display column names."""
    cols = (F.col("scenario"), fmt_mult("churn_multiplier"), fmt_mult("clv_multiplier"),
            fmt_money("expected_loss"), F.col("high_risk_customers"), fmt_delta("loss_delta_pct"))
    return stress.select(*[c.alias(n) for c, n in zip(cols, C.STRESS_DISPLAY_NAMES)])


# ---------------------------------------------------------------- profiles (A1-A2)

def profile(tx: DataFrame, cust: DataFrame) -> DataFrame:
    """A1: cleaned rows, distinct customers, churn rate."""
    n_rows = tx.agg(F.count(F.lit(1))).scalar()
    return cust.agg(
        F.first(n_rows).alias("n_rows"),
        F.count(F.lit(1)).alias("n_customers"),
        F.avg(_dbl("churn")).alias("churn_rate"),
    )


def churn_counts(cust: DataFrame) -> DataFrame:
    """A2: customers per churn class."""
    return cust.groupBy("churn").agg(F.count(F.lit(1)).alias("customers"))


# ---------------------------------------------------------------- segments (A3-A5)

def segment_summary(cust: DataFrame) -> DataFrame:
    """A3: count, mean CLV, mean recency, churn rate per segment (2 places)."""
    return cust.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.bround(exact_avg("clv"), 2).alias("avg_clv"),
        F.bround(F.avg(_dbl("recency")), 2).alias("avg_recency"),
        F.bround(F.avg(_dbl("churn")), 2).alias("churn_rate"),
    )


def segment_kpis(cust: DataFrame) -> DataFrame:
    """A4: customers, mean CLV, mean probability, revenue, expected loss per segment."""
    return cust.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.bround(exact_avg("clv"), 2).alias("avg_clv"),
        F.bround(F.avg("churn_prob"), 2).alias("avg_churn_prob"),
        F.bround(exact_sum("monetary"), 2).alias("total_revenue"),
        F.bround(F.sum("expected_loss"), 2).alias("at_risk"),
    )


def segment_kpis_display(kpis: DataFrame) -> DataFrame:
    """The segment KPI table formatted for display."""
    return kpis.select(
        "segment", "customers",
        fmt_money("avg_clv").alias("avg_clv"),
        fmt_pct("avg_churn_prob", 1, 100.0).alias("avg_churn_prob"),
        fmt_money("total_revenue").alias("total_revenue"),
        fmt_money("at_risk").alias("at_risk"),
    )


def segment_distribution(cust: DataFrame) -> DataFrame:
    """A5: customers and mean CLV per segment."""
    return cust.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"), exact_avg("clv").alias("avg_clv"))


def segments(cust: DataFrame) -> DataFrame:
    """Sorted distinct segment names."""
    return cust.select("segment").distinct().orderBy("segment")


# ---------------------------------------------------------------- tiers

def tier_table(spark: SparkSession, order=C.TIER_ORDER) -> DataFrame:
    """The fixed tier order as a literal table (tier, tier_order)."""
    return spark.createDataFrame([(t, i) for i, t in enumerate(order)], "risk_tier string, tier_order int")


def with_tier_order(agg: DataFrame, order=C.TIER_ORDER, fill: dict = None) -> DataFrame:
    """Every tier of ``order`` present, missing ones filled with zeros."""
    tiers = F.broadcast(tier_table(agg.sparkSession, order))
    out = tiers.join(agg, "risk_tier", "left")
    if fill:
        out = out.fillna(fill)
    return out


def tier_summary(cust: DataFrame) -> DataFrame:
    """Per tier (Critical first) count, mean probability, total CLV, expected loss."""
    agg = cust.groupBy("risk_tier").agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("churn_prob").alias("avg_prob"),
        exact_sum("clv").alias("total_clv"),
        F.sum("expected_loss").alias("expected_loss"),
    )
    return with_tier_order(agg, tuple(reversed(C.TIER_ORDER)),
                           {"customers": 0, "avg_prob": 0.0, "total_clv": 0.0, "expected_loss": 0.0})


def tier_distribution(cust: DataFrame) -> DataFrame:
    """Per tier (Safe first) count and share of all customers in % (1 place)."""
    total = cust.agg(F.count(F.lit(1))).scalar()
    agg = cust.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("customers"))
    out = with_tier_order(agg, C.TIER_ORDER, {"customers": 0})
    return out.withColumn("pct", F.bround(F.try_divide(_dbl("customers"), total.cast("double")) * 100, 1))


# ---------------------------------------------------------------- KPIs

def header_kpis(cust: DataFrame) -> DataFrame:
    """Churn rate %, at-risk expected loss, total CLV, critical count."""
    return cust.agg(
        F.count(F.lit(1)).alias("n_customers"),
        (F.avg(_dbl("churn")) * 100).alias("churn_rate_pct"),
        F.coalesce(F.sum(F.when(F.col("risk_tier").isin(*C.AT_RISK_TIERS), F.col("expected_loss"))),
                   F.lit(0.0)).alias("at_risk_revenue"),
        exact_sum("clv").alias("total_clv"),
        F.sum(F.when(F.col("risk_tier") == "Critical Risk", 1).otherwise(0)).cast("bigint")
        .alias("critical_customers"),
    )


def portfolio_summary(cust: DataFrame, stats: DataFrame, metrics: DataFrame) -> DataFrame:
    """Portfolio KPIs with the loss statistics and model metrics (1-row inputs)."""
    # One scalar subquery per input (a struct of its fields), so each 1-row
    # input plan runs once.
    st = stats.select(F.struct("var_95", "cvar_95")).scalar()
    mt = metrics.select(F.struct("auc", "f1")).scalar()
    var, cvar = st.getField("var_95"), st.getField("cvar_95")
    auc, f1 = mt.getField("auc"), mt.getField("f1")
    return cust.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.sum(F.when(F.col("risk_tier").isin(*C.AT_RISK_TIERS), 1).otherwise(0)).cast("bigint")
        .alias("at_risk_customers"),
        # CLV is a margin on cent amounts (4 places): summed exactly in
        # decimal so the half-even rounding of the total is well defined.
        F.bround(F.sum(F.col("clv").cast("decimal(38,4)")), 2).cast("double").alias("total_clv"),
        F.bround(F.sum("expected_loss"), 2).alias("expected_loss"),
        F.bround(F.avg("churn_prob") * 100, 1).alias("avg_churn_rate"),
        F.bround(F.first(var), 2).alias("var_95"),
        F.bround(F.first(cvar), 2).alias("cvar_95"),
        F.bround(F.first(auc), 4).alias("model_auc"),
        F.bround(F.first(f1), 4).alias("model_f1"),
    )


# ---------------------------------------------------------------- decisions

def decision_counts(cust: DataFrame) -> DataFrame:
    """A10: customers per decision, most frequent first."""
    return (cust.groupBy("decision").agg(F.count(F.lit(1)).alias("customers"))
            .orderBy(F.desc("customers"), "decision"))


def roi_by_decision(cust: DataFrame) -> DataFrame:
    """Mean net ROI per decision."""
    return cust.groupBy("decision").agg(exact_avg("net_roi").alias("avg_net_roi"))


# ---------------------------------------------------------------- distributions

def probability_histogram(cust: DataFrame, bins: int = 50, cfg: RiskConfig = DEFAULT) -> DataFrame:
    """Customers per equal-width probability bin on [0, 1] (bin edges
    and empty bins included) with the tier threshold that starts inside each bin, if any."""
    b = F.least(F.floor(F.col("churn_prob") * bins), F.lit(bins - 1)).cast("int")
    h = cust.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("customers"))
    every = cust.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    h = every.join(h, "bin", "left").select("bin", F.coalesce("customers", F.lit(0).cast("long")).alias("customers"))
    lo = F.col("bin") / F.lit(float(bins))
    hi = (F.col("bin") + 1) / F.lit(float(bins))
    cut = F.lit(None).cast("string")
    for name, t in zip(C.TIER_CUT_LABELS, (cfg.tier_low, cfg.tier_medium, cfg.tier_high, cfg.tier_critical)):
        cut = F.when(F.col("bin") == int(t * bins + 1e-9), F.lit(name)).otherwise(cut)
    return h.select("bin", lo.alias("bin_start"), hi.alias("bin_end"), "customers",
                    cut.alias("tier_cut"))


def value_risk_quadrants(cust: DataFrame, risk_cut: float = 0.5) -> DataFrame:
    """CLV median / 90th / 10th percentiles and customers per quadrant
    (value >= median, probability >= risk_cut)."""
    qv = exact_quantiles(cust, [("clv", 0.5), ("clv", 0.9), ("clv", 0.1)])
    med, q90, q10 = (F.lit(qv[("clv", q)]).cast("double") for q in (0.5, 0.9, 0.1))
    hv = F.col("clv") >= med
    hr = F.col("churn_prob") >= risk_cut
    urgent, champion, borderline, monitor = C.QUADRANT_LABELS
    quad = F.when(hv & hr, urgent).when(hv, champion).when(hr, borderline).otherwise(monitor)
    return cust.groupBy(quad.alias("quadrant")).agg(
        F.count(F.lit(1)).alias("customers"),
        F.first(med).alias("clv_median"),
        F.first(q90).alias("clv_q90"),
        F.first(q10).alias("clv_q10"),
    )


def feature_medians(cust: DataFrame, cols=C.FEATURE_COLS) -> DataFrame:
    """Median of each feature (one row, one column per feature)."""
    qv = exact_quantiles(cust, [(c, 0.5) for c in cols])
    return cust.sparkSession.range(1).select(
        *[F.lit(qv[(c, 0.5)]).cast("double").alias(c) for c in cols])


# ---------------------------------------------------------------- rows

PAGE_COLUMNS = ("customer_id", "risk_tier", "churn_prob", "clv", "decision",
                "recency", "frequency", "monetary", "segment")


def page_customers(cust: DataFrame, page: int = 1, limit: int = 20, search: str = None,
                   tier: str = None) -> DataFrame:
    """One page of customers by probability (highest first, ties by id),
    with the total matching count on every row."""
    df = search_customers(cust, search, tier)
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = (select_existing(df, PAGE_COLUMNS)
            .orderBy(F.desc("churn_prob"), F.asc("customer_id"))
            .offset((page - 1) * limit).limit(limit))
    return rows.withColumn("total", total)


def sample_at_risk(cust: DataFrame, seed: int = 42) -> DataFrame:
    """One pseudo-random at-risk customer (md5 order of id and seed)."""
    return (at_risk(cust).withColumn("_h", F.md5(F.concat_ws("|", F.col("customer_id"), F.lit(str(seed)))))
            .orderBy("_h").limit(1).drop("_h"))


def example_high_risk(scored: DataFrame, p: float = 0.75) -> DataFrame:
    """The first customer (by id) with probability above ``p``."""
    return scored.filter(F.col("churn_prob") > p).orderBy("customer_id").limit(1)


def preview(df: DataFrame, n: int = 5, order: str = "customer_id") -> DataFrame:
    """First ``n`` rows in key order."""
    return df.orderBy(order).limit(n)


EXPORT_COLUMNS = ("customer_id", "segment", "risk_tier", "churn_prob", "clv", "expected_loss",
                  "net_roi", "decision", "monetary", "frequency", "recency")


def export_view(cust: DataFrame) -> DataFrame:
    """The export columns with the probability in percent (2 places)."""
    return cust.select(*EXPORT_COLUMNS).withColumn(
        "churn_prob", F.bround(F.col("churn_prob") * 100, 2))
