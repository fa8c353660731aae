"""Per-customer features from cleaned transaction lines.

Shape of the plan (``customer_features``):

* every branch is a ``groupBy`` on ``customer_id`` or on a finer key
  (customer+day, customer+invoice, customer+column+value), so
  map-side partial aggregation shrinks the data before each shuffle and a
  customer holding a large share of all lines is spread over many tasks
  instead of landing in one;
* the (customer, day) aggregate is written once and shuffled once by
  customer; on that partitioning the purchase-gap window, the month level
  (spending trend) and the line totals run without further exchange;
* distinct products and countries are counted in one pass over values
  tagged by column, so the lines are shuffled three times in all (day,
  invoice, tagged product/country);
* each branch ends in an aggregation by ``customer_id``, so all branch
  outputs are hash-partitioned on the same key and the left joins that put
  them together are sort-merge joins with no further exchange;
* the reference date (last purchase + 1 day) is computed once and embedded
  as a literal.

Days are whole 24-hour periods (``timestampdiff(DAY, a, b)``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.config import DEFAULT, RiskConfig
from churnscope.session import write_table

def days_between(start: Column, end: Column) -> Column:
    """Complete days from ``start`` to ``end``."""
    return F.timestamp_diff("DAY", start, end)


def reference_date(tx: DataFrame) -> Column:
    """the reference date, last purchase in the data plus one day.

    One pruned scan of ``ts``; the single value is embedded as a literal. (As a
    scalar subquery it would be executed once per place it is used: five
    times in the feature job.)
    """
    last = tx.agg(F.max("ts")).first()[0]
    if last is None:
        return F.lit(None).cast("timestamp_ntz")
    # Wall-clock text, so no time zone is involved in building the literal.
    return F.lit(last.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")


def month_index(ts: Column) -> Column:
    """Calendar month as one integer (year*12 + month - 1)."""
    return F.year(ts) * 12 + F.month(ts) - 1


def _dbl(c: Column) -> Column:
    return c.cast("double")


def _ratio(num: Column, den: Column) -> Column:
    """Division that yields null on a zero denominator (filled later)."""
    return F.try_divide(_dbl(num), _dbl(den))


# --------------------------------------------------------------------------
# Branches
# --------------------------------------------------------------------------

def daily_totals(tx: DataFrame, ref: Column = None) -> DataFrame:
    """Per (customer, calendar day): first/last time, lines, spend, items,
    weekend lines and the spend inside the 30-day and 30-90-day windows.

    This one partial aggregation of the lines feeds the line totals, the
    monthly spend and the purchase gaps (all sums, minima and maxima reduce
    exactly through it), so those branches share a single line-level shuffle
    keyed by (customer, day), and a large customer is split by day.
    """
    ts, amt = F.col("ts"), F.col("amount")
    aggs = [
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.count(F.lit(1)).alias("lines"),
        F.sum(amt).alias("spend"),
        F.sum("quantity").alias("qty"),
        F.sum(F.when(F.weekday(ts) >= 5, 1).otherwise(0)).alias("weekend_lines"),
    ]
    if ref is not None:
        cut30 = ref - F.expr("INTERVAL 30 DAYS")
        cut90 = ref - F.expr("INTERVAL 90 DAYS")
        aggs += [F.sum(F.when(ts >= cut30, amt)).alias("s30"),
                 F.sum(F.when((ts >= cut90) & (ts < cut30), amt)).alias("s3090")]
    return tx.groupBy("customer_id", F.to_date(ts).alias("day")).agg(*aggs)


def line_totals(tx: DataFrame, ref: Column, daily: DataFrame = None) -> DataFrame:
    """F1, F3, F6, F10, F11, F13, F14 from the daily totals."""
    d = daily_totals(tx, ref) if daily is None else daily
    return d.groupBy("customer_id").agg(*_total_aggs()).select("customer_id", *_total_cols(ref))


def _total_aggs() -> list:
    """Sums, minima and maxima of (customer, day or month) rows that give the
    line totals; they reduce exactly through any finer level."""
    return [
        F.max("last_ts").alias("last_ts"),
        F.min("first_ts").alias("first_ts"),
        F.sum("spend").alias("monetary_dec"),
        F.sum("qty").cast("bigint").alias("total_quantity"),
        F.sum("lines").alias("n_lines"),
        F.sum("weekend_lines").alias("weekend_lines"),
        F.sum("s30").alias("spend_last30_dec"),
        F.sum("s3090").alias("spend_30_90_dec"),
    ]


def _total_cols(ref: Column) -> list:
    return [
        days_between(F.col("last_ts"), ref).cast("bigint").alias("recency"),
        days_between(F.col("first_ts"), ref).cast("bigint").alias("tenure"),
        _dbl(F.col("monetary_dec")).alias("monetary"),
        F.col("total_quantity"),
        F.col("n_lines"),
        _ratio(F.col("weekend_lines"), F.col("n_lines")).alias("weekend_ratio"),
        _dbl(F.col("spend_last30_dec")).alias("spend_last30"),
        _dbl(F.col("spend_30_90_dec")).alias("spend_30_90"),
    ]


def invoice_totals(tx: DataFrame) -> DataFrame:
    """Per (customer, invoice) spend; a missing invoice is not an invoice."""
    return (tx.filter(F.col("invoice").isNotNull())
            .groupBy("customer_id", "invoice")
            .agg(F.sum("amount").alias("invoice_total")))


def invoice_stats(tx: DataFrame) -> DataFrame:
    """F2 frequency, F8 volatility (sample sd), F9 Herfindahl concentration."""
    inv = invoice_totals(tx).withColumn("t", _dbl(F.col("invoice_total")))
    agg = inv.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("frequency"),
        F.stddev_samp("t").alias("purchase_volatility"),
        F.sum(F.col("t") * F.col("t")).alias("sum_sq"),
        F.sum("invoice_total").alias("sum_total"),
    )
    total = _dbl(F.col("sum_total"))
    hhi = F.when(total == 0, F.lit(1.0)).otherwise(F.col("sum_sq") / (total * total))
    return agg.select("customer_id", "frequency", "purchase_volatility",
                      hhi.alias("revenue_concentration"))


def distinct_counts(tx: DataFrame, cols: dict) -> DataFrame:
    """F5 and F7 together: distinct non-null values per customer of each
    column in ``cols`` ({column: alias}). Values are tagged with their column,
    so one partial distinct keyed by (customer, column, value) and one count
    by customer serve all of them (one scan of the lines, one join)."""
    tagged = F.explode(F.array(*[
        F.struct(F.lit(i).alias("kind"), F.col(c).cast("string").alias("v"))
        for i, c in enumerate(cols)])).alias("e")
    pairs = (tx.select("customer_id", tagged).select("customer_id", "e.kind", "e.v")
             .filter(F.col("v").isNotNull()).distinct())
    return pairs.groupBy("customer_id").agg(*[
        F.count(F.when(F.col("kind") == i, 1)).alias(alias)
        for i, alias in enumerate(cols.values())])


def distinct_count(tx: DataFrame, col: str, alias: str) -> DataFrame:
    """distinct values per customer as two group-bys (no Expand)."""
    return (tx.select("customer_id", col).filter(F.col(col).isNotNull())
            .distinct()
            .groupBy("customer_id").agg(F.count(F.lit(1)).alias(alias)))


def monthly_spend(tx: DataFrame, daily: DataFrame = None) -> DataFrame:
    """Per (customer, calendar month) spend; months without purchases are absent."""
    if daily is not None:
        return (daily.groupBy("customer_id", month_index(F.col("day")).alias("month"))
                .agg(F.sum("spend").alias("spend")))
    return (tx.groupBy("customer_id", month_index(F.col("ts")).alias("month"))
            .agg(F.sum("amount").alias("spend")))


def spending_trend(monthly: DataFrame) -> DataFrame:
    """F16: OLS slope of monthly spend over the zero-filled span of months.

    Missing months add nothing to the sums, so the slope comes from closed-form
    sums over present months: x = month - first month, n = months in span,
    Sx = n(n-1)/2, Sxx = (n-1)n(2n-1)/6. Fewer than 3 months gives 0.
    """
    agg = monthly.groupBy("customer_id").agg(*_trend_aggs())
    return agg.select("customer_id", _trend_slope().alias("spending_trend"))


def _trend_aggs() -> list:
    """Closed-form sums over (customer, month) rows with ``month`` and ``spend``."""
    return [
        F.min("month").alias("m0"),
        F.max("month").alias("m1"),
        F.sum("spend").alias("sy"),
        F.sum(F.col("spend") * F.col("month").cast("decimal(10,0)")).alias("smy"),
    ]


def _trend_slope() -> Column:
    n = _dbl(F.col("m1") - F.col("m0") + 1)
    sy = _dbl(F.col("sy"))
    sxy = _dbl(F.col("smy") - F.col("sy") * F.col("m0").cast("decimal(10,0)"))
    sx = n * (n - 1) / 2
    sxx = (n - 1) * n * (2 * n - 1) / 6
    slope = (n * sxy - sx * sy) / (n * sxx - sx * sx)
    return F.when(n < 3, F.lit(0.0)).otherwise(slope)


def purchase_gaps(tx: DataFrame, daily: DataFrame = None) -> DataFrame:
    """Mean whole-day gap between consecutive purchase lines.

    Gaps are taken over lines sorted by time (equal times give zero gaps),
    floored to whole days, averaged over (lines - 1). A gap inside one
    calendar day is under 24 hours, so it floors to 0; only gaps between
    consecutive active days count. Lines are therefore reduced to one row per
    (customer, day) with first/last time, and the ``lag`` window runs over
    those day rows, at most one per active day per customer, however many
    lines the customer has.
    """
    days = daily_totals(tx) if daily is None else daily
    w = Window.partitionBy("customer_id").orderBy("day")
    gaps = days.withColumn(
        "gap", days_between(F.lag("last_ts").over(w), F.col("first_ts")))
    agg = gaps.groupBy("customer_id").agg(
        F.sum("gap").alias("gap_days"), F.sum("lines").alias("lines"))
    return agg.select("customer_id", _gap_mean("gap_days", "lines").alias("avg_days_between_purchases"))


def _gap_mean(gap_days: str, lines: str) -> Column:
    return F.when(F.col(lines) < 2, F.lit(None).cast("double")).otherwise(
        _dbl(F.coalesce(F.col(gap_days), F.lit(0))) / _dbl(F.col(lines) - 1))


#: Day rows of a task of the customer level, about.
DAY_ROWS = 100_000


def by_customer(daily: DataFrame) -> DataFrame:
    """The written day rows dealt by customer into as many tasks as they fill. Partitions that Spark sizes by
    compressed bytes hold more rows as the tables grow, and each task sorts, aggregates and joins what it holds."""
    tasks = -(-daily.count() // DAY_ROWS)
    return daily.repartition(tasks, "customer_id") if tasks > 1 else daily


def day_level_features(daily: DataFrame, ref: Column) -> DataFrame:
    """Line totals (F1, F3, F6, F10, F11, F13, F14), purchase gaps (F15) and
    the spending trend (F16) from the (customer, day) rows with one exchange.

    The gap window needs the day rows hash-partitioned by customer. That
    partitioning also satisfies the (customer, month) and customer group-bys,
    so the month level and the customer level aggregate in the same tasks.
    Every total is a sum, minimum or maximum, so it reduces exactly through the
    month level. A large customer contributes one row per active day.
    """
    w = Window.partitionBy("customer_id").orderBy("day")
    days = (daily.withColumn("gap", days_between(F.lag("last_ts").over(w), F.col("first_ts")))
            .withColumn("month", month_index(F.col("day"))))
    months = days.groupBy("customer_id", "month").agg(
        F.max("last_ts").alias("last_ts"), F.min("first_ts").alias("first_ts"),
        F.sum("spend").alias("spend"), F.sum("qty").alias("qty"), F.sum("lines").alias("lines"),
        F.sum("weekend_lines").alias("weekend_lines"),
        F.sum("s30").alias("s30"), F.sum("s3090").alias("s3090"),
        F.sum("gap").alias("gap_days"))
    agg = months.groupBy("customer_id").agg(
        *_total_aggs(), *_trend_aggs(), F.sum("gap_days").alias("gap_days"))
    return agg.select(
        "customer_id", *_total_cols(ref),
        _gap_mean("gap_days", "n_lines").alias("avg_days_between_purchases"),
        _trend_slope().alias("spending_trend"))


# --------------------------------------------------------------------------
# Feature tables
# --------------------------------------------------------------------------

def zero_fill(df: DataFrame, cols) -> DataFrame:
    """Null, NaN and +-infinity become 0."""
    out = {}
    for c in cols:
        x = F.col(c)
        dt = df.schema[c].dataType
        bad = x.isNull()
        if dt.typeName() in ("double", "float"):
            bad = bad | F.isnan(x) | (x == float("inf")) | (x == float("-inf"))
        out[c] = F.when(bad, F.lit(0).cast(dt)).otherwise(x)
    return df.withColumns(out)


FEATURE_ORDER = (
    "customer_id", "recency", "frequency", "monetary", "avg_order_value",
    "product_diversity", "total_quantity", "geo_spread", "purchase_volatility",
    "avg_days_between_purchases", "spending_trend", "revenue_concentration",
    "spend_last30", "spend_30_90", "recency_acceleration", "weekend_ratio", "tenure",
)


def customer_features(tx: DataFrame, cfg: RiskConfig = DEFAULT, ref: Column = None,
                      daily: DataFrame = None) -> DataFrame:
    """the per-customer feature table (before the churn label and CLV).
    ``daily``: the written ``daily_totals(tx, ref)``, when the caller has it."""
    ref = reference_date(tx) if ref is None else ref
    # The (customer, day) aggregate is written once to the shared checkpoint
    # folder (lineage cut, survives executor loss), then shuffled once by
    # customer for the totals, gaps and trend together; the joins below follow its tasks.
    if daily is None:
        daily = write_table(daily_totals(tx, ref), "daily_totals")
    base = day_level_features(by_customer(daily), ref)
    inv = invoice_stats(tx)
    if "country" in tx.columns:
        counts = distinct_counts(tx, {"stock_code": "product_diversity", "country": "geo_spread"})
        geo = F.col("geo_spread")
    else:
        counts = distinct_count(tx, "stock_code", "product_diversity")
        geo = F.lit(1)
    j = (base.join(inv, "customer_id", "left")
         .join(counts, "customer_id", "left"))
    accel = (F.col("spend_last30") + 1) / (F.col("spend_30_90") + 1)
    out = j.select(
        "customer_id", "recency",
        F.coalesce(F.col("frequency"), F.lit(0)).cast("bigint").alias("frequency"),
        "monetary",
        _ratio(F.col("monetary"), F.col("frequency")).alias("avg_order_value"),
        F.col("product_diversity").cast("bigint").alias("product_diversity"),
        "total_quantity",
        geo.cast("bigint").alias("geo_spread"),
        "purchase_volatility", "avg_days_between_purchases", "spending_trend",
        "revenue_concentration", "spend_last30", "spend_30_90",
        accel.alias("recency_acceleration"),
        "weekend_ratio", "tenure",
    )
    doubles = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    longs = ["frequency", "product_diversity", "geo_spread"]
    return zero_fill(out, doubles + longs)


def with_clv(cust: DataFrame, cfg: RiskConfig = DEFAULT) -> DataFrame:
    """customer lifetime value as a margin on spend."""
    return cust.withColumn("clv", F.col("monetary") * F.lit(cfg.margin))


def churn_label(cust: DataFrame, days=None, cfg: RiskConfig = DEFAULT) -> DataFrame:
    """churned when recency is strictly above the window (a number or a Column)."""
    t = cfg.churn_window_days if days is None else days
    t = t if isinstance(t, Column) else F.lit(t)
    return cust.withColumn("churn", (F.col("recency") > t).cast("int"))


def churn_threshold(cust: DataFrame, cfg: RiskConfig = DEFAULT,
                    lo: float = None, hi: float = None, q: float = None) -> Column:
    """the churn window; if the fixed window gives a churn rate outside
    [lo, hi], the q-th percentile of recency (linear interpolation) instead.

    Recency is an integer day count, so the exact ``percentile`` aggregate
    keeps a value->count map bounded by the number of distinct day counts.
    Returned as a scalar subquery.
    """
    from churnscope.config import CHURN_QUANTILE, CHURN_RATE_HIGH, CHURN_RATE_LOW
    lo = CHURN_RATE_LOW if lo is None else lo
    hi = CHURN_RATE_HIGH if hi is None else hi
    q = CHURN_QUANTILE if q is None else q
    w = cfg.churn_window_days
    rate = F.avg((F.col("recency") > w).cast("double"))
    pct = F.percentile(F.col("recency"), F.lit(q))
    t = F.when((rate < lo) | (rate > hi), pct).otherwise(F.lit(float(w)))
    return cust.agg(t.alias("t")).scalar()


def calibrated_churn_label(cust: DataFrame, cfg: RiskConfig = DEFAULT, **kw) -> DataFrame:
    return churn_label(cust, churn_threshold(cust, cfg, **kw), cfg)


def labelled_features(tx: DataFrame, cfg: RiskConfig = DEFAULT, calibrate: bool = True) -> DataFrame:
    """Features + churn label (auto-calibrated window) + CLV, column order of
    the customer_features table."""
    ref = reference_date(tx)
    daily = write_table(daily_totals(tx, ref), "daily_totals")
    cust = customer_features(tx, cfg, ref, daily)
    if calibrate:
        # The threshold needs recency only: take it from the written daily
        # aggregate (same customers, same values), so the subquery neither
        # re-runs the feature job nor re-reads the lines.
        t = churn_threshold(line_totals(tx, ref, daily).select("recency"), cfg)
        cust = churn_label(cust, t, cfg)
    else:
        cust = churn_label(cust, cfg=cfg)
    return with_clv(cust, cfg)


# --------------------------------------------------------------------------
# Baseline feature table (older pipeline)
# --------------------------------------------------------------------------

def baseline_trend(monthly: DataFrame) -> DataFrame:
    """Mean month-over-month percentage change of zero-filled spend.

    An empty month inside the span makes a later change infinite, so the
    trend is 0 whenever the span has a gap; one month gives no change (0).
    """
    agg = _with_month_change(monthly).groupBy("customer_id").agg(*_baseline_trend_aggs())
    return agg.select("customer_id", _baseline_trend_value().alias("trend"))


def _with_month_change(monthly: DataFrame) -> DataFrame:
    w = Window.partitionBy("customer_id").orderBy("month")
    return monthly.withColumn("chg", _dbl(F.col("spend")) / _dbl(F.lag("spend").over(w)) - 1)


def _baseline_trend_aggs() -> list:
    return [F.min("month").alias("m0"), F.max("month").alias("m1"),
            F.count(F.lit(1)).alias("n_months"), F.avg("chg").alias("avg_chg")]


def _baseline_trend_value() -> Column:
    span = F.col("m1") - F.col("m0") + 1
    return F.when((F.col("n_months") < span) | (F.col("n_months") < 2), F.lit(0.0)) \
        .otherwise(F.col("avg_chg"))


def baseline_features(tx: DataFrame, cfg: RiskConfig = DEFAULT) -> DataFrame:
    """recency, frequency, monetary, avg order value, trend, churn (fixed window)."""
    ref = reference_date(tx)
    daily = write_table(daily_totals(tx), "daily_totals")
    # One exchange of the day rows by customer: the month level, the lag
    # window over months and the customer totals all run on that partitioning.
    by_customer = daily.select("customer_id", "day", "last_ts", "spend").repartition("customer_id")
    months = by_customer.groupBy("customer_id", month_index(F.col("day")).alias("month")).agg(
        F.max("last_ts").alias("last_ts"), F.sum("spend").alias("spend"))
    base = _with_month_change(months).groupBy("customer_id").agg(
        F.max("last_ts").alias("last_ts"), F.sum("spend").alias("m"), *_baseline_trend_aggs()) \
        .withColumn("trend", _baseline_trend_value())
    inv = (invoice_totals(tx).groupBy("customer_id")
           .agg(F.count(F.lit(1)).alias("frequency")))
    j = base.join(inv, "customer_id", "left")
    freq = F.coalesce(F.col("frequency"), F.lit(0)).cast("bigint")
    # Only the trend's infinities were replaced in the older pipeline; a
    # customer without invoices keeps an infinite order value.
    aov = F.when(freq == 0, F.lit(float("inf"))).otherwise(_dbl(F.col("m")) / _dbl(freq))
    out = j.select(
        "customer_id",
        days_between(F.col("last_ts"), ref).cast("bigint").alias("recency"),
        freq.alias("frequency"),
        _dbl(F.col("m")).alias("monetary"),
        aov.alias("avg_order_value"),
        F.coalesce(F.col("trend"), F.lit(0.0)).alias("trend"),
    )
    return churn_label(out, cfg=cfg)


# --------------------------------------------------------------------------
# One operator per feature (F1-F16): each runs only the branch it needs.
# --------------------------------------------------------------------------

def _all_customers(tx: DataFrame, df: DataFrame, col: str) -> DataFrame:
    """``df`` with a row for every customer, 0 where it has none."""
    base = tx.select("customer_id").distinct()
    return zero_fill(base.join(df.select("customer_id", col), "customer_id", "left"), [col])


def _pick(df: DataFrame, col: str, fill=True) -> DataFrame:
    out = df.select("customer_id", col)
    return zero_fill(out, [col]) if fill else out


def recency(tx: DataFrame) -> DataFrame:
    """whole days from the last purchase to the reference date."""
    return _pick(line_totals(tx, reference_date(tx)), "recency", False)


def frequency(tx: DataFrame) -> DataFrame:
    """distinct invoices (0 when a customer has only missing invoices)."""
    return _all_customers(tx, invoice_stats(tx), "frequency")


def monetary(tx: DataFrame) -> DataFrame:
    """total spend."""
    return _pick(line_totals(tx, reference_date(tx)), "monetary", False)


def avg_order_value(tx: DataFrame) -> DataFrame:
    """spend per invoice (0 without invoices)."""
    return customer_features(tx).select("customer_id", "avg_order_value")


def product_diversity(tx: DataFrame) -> DataFrame:
    """distinct stock codes."""
    return _all_customers(tx, distinct_count(tx, "stock_code", "product_diversity"), "product_diversity")


def total_quantity(tx: DataFrame) -> DataFrame:
    """items bought."""
    return _pick(line_totals(tx, reference_date(tx)), "total_quantity", False)


def geo_spread(tx: DataFrame) -> DataFrame:
    """distinct countries, or 1 when the source has no country."""
    if "country" in tx.columns:
        return _all_customers(tx, distinct_count(tx, "country", "geo_spread"), "geo_spread")
    return tx.select("customer_id").distinct().withColumn("geo_spread", F.lit(1).cast("bigint"))


def purchase_volatility(tx: DataFrame) -> DataFrame:
    """F8: sample sd of invoice totals (0 for fewer than two invoices)."""
    return _all_customers(tx, invoice_stats(tx), "purchase_volatility")


def revenue_concentration(tx: DataFrame) -> DataFrame:
    """Herfindahl index of invoice shares."""
    return _all_customers(tx, invoice_stats(tx), "revenue_concentration")


def spend_last_30(tx: DataFrame) -> DataFrame:
    """spend in the 30 days before the reference date."""
    return _pick(line_totals(tx, reference_date(tx)), "spend_last30")


def spend_30_90(tx: DataFrame) -> DataFrame:
    """spend 90 to 30 days before the reference date."""
    return _pick(line_totals(tx, reference_date(tx)), "spend_30_90")


def recency_acceleration(tx: DataFrame) -> DataFrame:
    """(last-30 spend + 1) / (30-90 spend + 1); 0 if either window is empty."""
    lt = line_totals(tx, reference_date(tx))
    acc = (F.col("spend_last30") + 1) / (F.col("spend_30_90") + 1)
    return zero_fill(lt.select("customer_id", acc.alias("recency_acceleration")), ["recency_acceleration"])


def weekend_ratio(tx: DataFrame) -> DataFrame:
    """share of lines bought on Saturday or Sunday."""
    return _pick(line_totals(tx, reference_date(tx)), "weekend_ratio")


def tenure(tx: DataFrame) -> DataFrame:
    """whole days from the first purchase to the reference date."""
    return _pick(line_totals(tx, reference_date(tx)), "tenure", False)


def avg_days_between(tx: DataFrame) -> DataFrame:
    """mean whole-day gap between consecutive lines."""
    return _pick(purchase_gaps(tx), "avg_days_between_purchases")


def spending_trend_of(tx: DataFrame) -> DataFrame:
    """F16: monthly spend slope."""
    return _pick(spending_trend(monthly_spend(tx)), "spending_trend")


def baseline_trend_of(tx: DataFrame) -> DataFrame:
    """mean monthly percentage change (older pipeline)."""
    return _pick(baseline_trend(monthly_spend(tx)), "trend")


SINGLE_FEATURES = {
    "F1": ("recency", recency), "F2": ("frequency", frequency), "F3": ("monetary", monetary),
    "F4": ("avg_order_value", avg_order_value), "F5": ("product_diversity", product_diversity),
    "F6": ("total_quantity", total_quantity), "F7": ("geo_spread", geo_spread),
    "F8": ("purchase_volatility", purchase_volatility),
    "F9": ("revenue_concentration", revenue_concentration),
    "F10": ("spend_last30", spend_last_30), "F11": ("spend_30_90", spend_30_90),
    "F12": ("recency_acceleration", recency_acceleration), "F13": ("weekend_ratio", weekend_ratio),
    "F14": ("tenure", tenure), "F15": ("avg_days_between_purchases", avg_days_between),
    "F16": ("spending_trend", spending_trend_of),
}


def monthly_pct_change(monthly: DataFrame) -> DataFrame:
    """Month-over-month change of spend over each customer's zero-filled
    span of months: (customer_id, month, spend, pct_change).

    The span is generated per customer from first to last month (bounded by
    months in the data) and joined to the months present. The change is null
    for the first month and where both months are empty, +infinity after an
    empty month, -1 into an empty month.
    """
    # One window over the months present (one exchange by customer): each
    # present month also emits the empty months since the previous present
    # month, and knows the spend of the month before each emitted one.
    w = Window.partitionBy("customer_id").orderBy("month")
    present = monthly.select("customer_id", "month", _dbl(F.col("spend")).alias("s"))
    present = present.withColumns({"pm": F.lag("month").over(w), "ps": F.lag("s").over(w)})
    rows = present.select(
        "customer_id", "s", "pm", "ps",
        F.col("month").alias("m"),
        F.explode(F.sequence(F.coalesce(F.col("pm") + 1, F.col("month")), F.col("month"))).alias("month"))
    is_present = F.col("month") == F.col("m")
    spend = F.when(is_present, F.col("s")).otherwise(F.lit(0.0))
    none = F.lit(None).cast("double")
    prev = (F.when(F.col("pm").isNull(), none)
            .when(F.col("month") == F.col("pm") + 1, F.col("ps"))
            .otherwise(F.lit(0.0)))
    pct = (F.when(prev.isNull(), none)
           .when(prev == 0, F.when(spend > 0, F.lit(float("inf"))).otherwise(none))
           .otherwise(spend / prev - 1))
    return rows.select("customer_id", "month", spend.alias("spend"), pct.alias("pct_change"))
