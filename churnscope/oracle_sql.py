"""DuckDB SQL oracles: independent, brute-force definitions of each result.

These strings run on DuckDB over the same parquet tables (registered as
views) and are compared with the Spark results. They follow the plain
definitions (window over all lines, zero-filled month series, ...), not the
shapes the Spark operators use, so they check those shapes.

Doubles are rounded to 6 places in both engines (``+ 0.0`` folds -0.0).
"""

from __future__ import annotations

from churnscope import config as C

# --------------------------------------------------------------------------
# Transaction lines (S6 adapters + P1-P6 cleaning)
# --------------------------------------------------------------------------

TX_ORDERS = """
raw AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS customer_id,
         CASE WHEN l.l_returnflag = 'R' THEN 'C' || CAST(o.o_orderkey AS VARCHAR)
              ELSE CAST(o.o_orderkey AS VARCHAR) END AS invoice,
         CAST(l.l_partkey AS VARCHAR) AS stock_code,
         CAST(l.l_quantity AS INTEGER) AS quantity,
         CAST(p.p_retailprice AS DECIMAL(12,2)) AS price,
         o.o_orderdate AS ts,
         n.n_name AS country
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
),
tx AS (
  SELECT customer_id, invoice, stock_code, quantity, price, ts, country,
         CAST(quantity * price AS DECIMAL(18,2)) AS amount
  FROM raw
  WHERE customer_id IS NOT NULL AND NOT coalesce(starts_with(invoice, 'C'), false)
    AND quantity > 0 AND price > 0 AND ts IS NOT NULL
)"""

TX_EVENTS = """
raw AS (
  SELECT CAST(user_id AS VARCHAR) AS customer_id,
         CASE WHEN event_type = 'error' THEN 'C' || CAST(event_id AS VARCHAR)
              ELSE CAST(event_id AS VARCHAR) END AS invoice,
         event_type AS stock_code,
         1 AS quantity,
         CAST(value AS DECIMAL(12,2)) AS price,
         ts
  FROM events
),
tx AS (
  SELECT customer_id, invoice, stock_code, quantity, price, ts,
         CAST(quantity * price AS DECIMAL(18,2)) AS amount
  FROM raw
  WHERE customer_id IS NOT NULL AND NOT coalesce(starts_with(invoice, 'C'), false)
    AND quantity > 0 AND price > 0 AND ts IS NOT NULL
)"""

TX = {"orders": TX_ORDERS, "events": TX_EVENTS}


def r6(expr: str) -> str:
    """Same rounding as ``functions.scalar.round6`` (explicit IEEE steps)."""
    x = f"CAST({expr} AS DOUBLE)"
    return (f"(CASE WHEN isfinite({x}) THEN floor({x} * 1000000.0 + 0.5) / 1000000.0 + 0.0 "
            f"ELSE {x} END)")


# --------------------------------------------------------------------------
# the feature table, brute force
# --------------------------------------------------------------------------

def features_ctes(source: str) -> str:
    """CTEs ending in ``feat`` (F21 columns, unrounded) for a tx source."""
    geo = ("(SELECT customer_id, count(DISTINCT country) AS g FROM tx GROUP BY 1)"
           if source == "orders" else
           "(SELECT DISTINCT customer_id, 1 AS g FROM tx)")
    return f"""
{TX[source]},
refd AS (SELECT max(ts) + INTERVAL 1 DAY AS ref FROM tx),
base AS (
  SELECT customer_id,
         date_sub('day', max(ts), (SELECT ref FROM refd)) AS recency,
         date_sub('day', min(ts), (SELECT ref FROM refd)) AS tenure,
         sum(amount) AS monetary,
         count(DISTINCT invoice) AS frequency,
         count(DISTINCT stock_code) AS product_diversity,
         sum(quantity) AS total_quantity,
         avg(CASE WHEN isodow(ts) >= 6 THEN 1.0 ELSE 0.0 END) AS weekend_ratio,
         sum(CASE WHEN ts >= (SELECT ref FROM refd) - INTERVAL 30 DAY THEN amount END) AS spend_last30,
         sum(CASE WHEN ts >= (SELECT ref FROM refd) - INTERVAL 90 DAY
                   AND ts < (SELECT ref FROM refd) - INTERVAL 30 DAY THEN amount END) AS spend_30_90
  FROM tx GROUP BY customer_id
),
inv AS (
  SELECT customer_id, invoice, CAST(sum(amount) AS DOUBLE) AS total
  FROM tx WHERE invoice IS NOT NULL GROUP BY 1, 2
),
invs AS (
  SELECT customer_id, stddev_samp(total) AS vol
  FROM inv GROUP BY 1
),
hhi AS (
  SELECT i.customer_id,
         CASE WHEN t.s = 0 THEN 1.0 ELSE sum((i.total / t.s) * (i.total / t.s)) END AS hhi
  FROM inv i JOIN (SELECT customer_id, sum(total) AS s FROM inv GROUP BY 1) t USING (customer_id)
  GROUP BY i.customer_id, t.s
),
lines AS (
  SELECT customer_id,
         date_sub('day', lag(ts) OVER (PARTITION BY customer_id ORDER BY ts), ts) AS gap
  FROM tx
),
gaps AS (SELECT customer_id, avg(gap) AS avg_gap FROM lines GROUP BY 1),
mon AS (
  SELECT customer_id, year(ts) * 12 + month(ts) - 1 AS m, sum(amount) AS spend
  FROM tx GROUP BY 1, 2
),
span AS (SELECT customer_id, min(m) AS m0, max(m) AS m1 FROM mon GROUP BY 1),
dense AS (
  SELECT s.customer_id, g.m - s.m0 AS x, CAST(coalesce(mon.spend, 0) AS DOUBLE) AS y,
         s.m1 - s.m0 + 1 AS n
  FROM span s, LATERAL (SELECT unnest(range(s.m0, s.m1 + 1)) AS m) g
  LEFT JOIN mon ON mon.customer_id = s.customer_id AND mon.m = g.m
),
trend AS (
  SELECT customer_id, CASE WHEN max(n) < 3 THEN 0.0 ELSE regr_slope(y, x) END AS slope
  FROM dense GROUP BY 1
),
geo AS {geo},
feat AS (
  SELECT b.customer_id,
         CAST(b.recency AS BIGINT) AS recency,
         CAST(b.frequency AS BIGINT) AS frequency,
         CAST(b.monetary AS DOUBLE) AS monetary,
         coalesce(CAST(b.monetary AS DOUBLE) / nullif(b.frequency, 0), 0.0) AS avg_order_value,
         CAST(b.product_diversity AS BIGINT) AS product_diversity,
         CAST(b.total_quantity AS BIGINT) AS total_quantity,
         CAST(coalesce(geo.g, 0) AS BIGINT) AS geo_spread,
         coalesce(invs.vol, 0.0) AS purchase_volatility,
         coalesce(gaps.avg_gap, 0.0) AS avg_days_between_purchases,
         coalesce(trend.slope, 0.0) AS spending_trend,
         coalesce(hhi.hhi, 0.0) AS revenue_concentration,
         coalesce(CAST(b.spend_last30 AS DOUBLE), 0.0) AS spend_last30,
         coalesce(CAST(b.spend_30_90 AS DOUBLE), 0.0) AS spend_30_90,
         coalesce((CAST(b.spend_last30 AS DOUBLE) + 1) / (CAST(b.spend_30_90 AS DOUBLE) + 1), 0.0)
           AS recency_acceleration,
         CAST(b.weekend_ratio AS DOUBLE) AS weekend_ratio,
         CAST(b.tenure AS BIGINT) AS tenure
  FROM base b
  LEFT JOIN invs USING (customer_id)
  LEFT JOIN hhi USING (customer_id)
  LEFT JOIN gaps USING (customer_id)
  LEFT JOIN trend USING (customer_id)
  LEFT JOIN geo USING (customer_id)
)"""


FEATURE_DOUBLES = (
    "monetary", "avg_order_value", "purchase_volatility", "avg_days_between_purchases",
    "spending_trend", "revenue_concentration", "spend_last30", "spend_30_90",
    "recency_acceleration", "weekend_ratio",
)
FEATURE_LONGS = ("recency", "frequency", "product_diversity", "total_quantity",
                 "geo_spread", "tenure")


def feature_select(alias: str = "feat", extra_doubles=(), extra=()) -> str:
    cols = [f"{alias}.customer_id"]
    cols += [f"{alias}.{c}" for c in FEATURE_LONGS]
    cols += [f"{r6(alias + '.' + c)} AS {c}" for c in FEATURE_DOUBLES + tuple(extra_doubles)]
    cols += list(extra)
    return ", ".join(cols)


def threshold_cte(source: str, window: int = C.CHURN_WINDOW_DAYS) -> str:
    """F20 in SQL: the churn threshold as a one-row CTE ``thr(t)``."""
    return f"""
thr AS (
  SELECT CASE WHEN avg(CASE WHEN recency > {window} THEN 1.0 ELSE 0.0 END) < {C.CHURN_RATE_LOW}
               OR avg(CASE WHEN recency > {window} THEN 1.0 ELSE 0.0 END) > {C.CHURN_RATE_HIGH}
              THEN quantile_cont(recency, {C.CHURN_QUANTILE}) ELSE {float(window)} END AS t
  FROM feat
)"""


def labelled_ctes(source: str) -> str:
    """CTEs ending in ``cust``: features + churn (calibrated) + clv."""
    return features_ctes(source) + "," + threshold_cte(source) + f""",
cust AS (
  SELECT feat.*, CAST(feat.recency > (SELECT t FROM thr) AS INTEGER) AS churn,
         feat.monetary * {C.AVG_PROFIT_MARGIN} AS clv
  FROM feat
)"""


# --------------------------------------------------------------------------
# Registered oracles
# --------------------------------------------------------------------------

ORACLES: dict = {}


def _clean(source: str) -> str:
    country = ", country" if source == "orders" else ""
    return (f"WITH {TX[source]} SELECT customer_id, invoice, stock_code, quantity, "
            f"{r6('price')} AS price, ts{country}, {r6('amount')} AS amount FROM tx")


ORACLES["S6_P1_P6_clean_orders"] = _clean("orders")
ORACLES["S6_P1_P6_clean_events"] = _clean("events")
ORACLES["F21_customer_features"] = f"WITH {features_ctes('orders')} SELECT {feature_select()} FROM feat"
ORACLES["F21_customer_features_events"] = (
    f"WITH {features_ctes('events')} SELECT {feature_select()} FROM feat")

ORACLES["F22_baseline_features"] = f"""
WITH {TX_ORDERS},
refd AS (SELECT max(ts) + INTERVAL 1 DAY AS ref FROM tx),
base AS (
  SELECT customer_id, date_sub('day', max(ts), (SELECT ref FROM refd)) AS recency,
         count(DISTINCT invoice) AS frequency, CAST(sum(amount) AS DOUBLE) AS monetary
  FROM tx GROUP BY 1
),
mon AS (SELECT customer_id, year(ts) * 12 + month(ts) - 1 AS m, sum(amount) AS spend FROM tx GROUP BY 1, 2),
span AS (SELECT customer_id, min(m) AS m0, max(m) AS m1 FROM mon GROUP BY 1),
dense AS (
  SELECT s.customer_id, g.m, CAST(coalesce(mon.spend, 0) AS DOUBLE) AS y
  FROM span s, LATERAL (SELECT unnest(range(s.m0, s.m1 + 1)) AS m) g
  LEFT JOIN mon ON mon.customer_id = s.customer_id AND mon.m = g.m
),
chg AS (SELECT customer_id, y, lag(y) OVER (PARTITION BY customer_id ORDER BY m) AS prev FROM dense),
trend AS (
  SELECT customer_id,
         CASE WHEN sum(CASE WHEN prev = 0 AND y > 0 THEN 1 ELSE 0 END) > 0 THEN 0.0
              ELSE coalesce(avg(CASE WHEN prev > 0 THEN y / prev - 1 END), 0.0) END AS trend
  FROM chg GROUP BY 1
)
SELECT b.customer_id, CAST(b.recency AS BIGINT) AS recency, CAST(b.frequency AS BIGINT) AS frequency,
       {r6('b.monetary')} AS monetary,
       CASE WHEN b.frequency = 0 THEN CAST('inf' AS DOUBLE) ELSE {r6('b.monetary / b.frequency')} END
         AS avg_order_value,
       {r6('t.trend')} AS trend,
       CAST(b.recency > {C.CHURN_WINDOW_DAYS} AS INTEGER) AS churn
FROM base b JOIN trend t USING (customer_id)
"""


# --------------------------------------------------------------------------
# Labels, cohorts, scores, portfolio
# --------------------------------------------------------------------------

from churnscope.functions.random import sql_key32, sql_uniform  # noqa: E402


def _threshold_query(source: str) -> str:
    return (f"WITH {features_ctes(source)}, {threshold_cte(source)} "
            f"SELECT {r6(f'avg(CASE WHEN recency > {C.CHURN_WINDOW_DAYS} THEN 1.0 ELSE 0.0 END)')} AS fixed_rate, "
            f"{r6('(SELECT t FROM thr)')} AS threshold FROM feat")


ORACLES["F20_churn_threshold"] = _threshold_query("orders")
ORACLES["F20_churn_threshold_events"] = _threshold_query("events")
for _name, _src in (("F18_F19_labelled_features", "orders"), ("F18_F20_labelled_features_events", "events")):
    ORACLES[_name] = (f"WITH {labelled_ctes(_src)} SELECT "
                      f"{feature_select('cust', ('clv',), ('cust.churn',))} FROM cust")


def cohort_ctes(source: str) -> str:
    """CTEs ending in ``cc(cohort, cohort_index, customers)`` and ``ret``."""
    return labelled_ctes(source) + """,
coh AS (
  SELECT tx.customer_id, tx.ts,
         min(tx.ts) OVER (PARTITION BY tx.customer_id) AS first_ts
  FROM tx JOIN cust USING (customer_id)
),
cc AS (
  SELECT year(first_ts) * 12 + month(first_ts) - 1 AS cohort,
         (year(ts) * 12 + month(ts)) - (year(first_ts) * 12 + month(first_ts)) AS cohort_index,
         count(DISTINCT customer_id) AS customers
  FROM coh GROUP BY 1, 2
),
sized AS (
  SELECT cc.*, max(CASE WHEN cohort_index = 0 THEN customers END) OVER (PARTITION BY cohort) AS size
  FROM cc
),
ret AS (
  SELECT s.* FROM sized s
  WHERE cohort IN (SELECT DISTINCT cohort FROM cc ORDER BY cohort LIMIT 12)
    AND cohort_index IN (SELECT DISTINCT cohort_index FROM cc ORDER BY cohort_index LIMIT 12)
)"""


def _month_label(expr: str) -> str:
    return (f"printf('%04d-%02d', CAST(floor(({expr}) / 12) AS INTEGER), "
            f"CAST(({expr}) - floor(({expr}) / 12) * 12 + 1 AS INTEGER))")


ORACLES["A15_cohort_counts"] = (
    f"WITH {cohort_ctes('orders')} SELECT {_month_label('cohort')} AS cohort_month, "
    "CAST(cohort_index AS INTEGER) AS cohort_index, CAST(customers AS BIGINT) AS customers FROM cc")
for _name, _src in (("A16_cohort_retention", "orders"), ("A16_cohort_retention_events", "events")):
    ORACLES[_name] = (
        f"WITH {cohort_ctes(_src)} SELECT {_month_label('cohort')} AS cohort_month, "
        "CAST(cohort_index AS INTEGER) AS cohort_index, CAST(customers AS BIGINT) AS customers, "
        f"{r6('round_even(CAST(customers AS DOUBLE) / CAST(size AS DOUBLE), 3)')} AS rate FROM ret")

ORACLES["A17_cohort_pivot"] = (
    f"WITH {cohort_ctes('orders')}, lab AS (SELECT {_month_label('cohort')} AS cohort_month, cohort_index, "
    "round_even(round_even(CAST(customers AS DOUBLE) / CAST(size AS DOUBLE), 3) * 100, 1) AS pct FROM ret) "
    "SELECT cohort_month, "
    + ", ".join(f"{r6(f'max(CASE WHEN cohort_index = {i} THEN pct END)')} AS \"{C.COHORT_COLUMN_PREFIX}{i}\""
                for i in range(12))
    + " FROM lab GROUP BY cohort_month")


def scored_ctes(source: str) -> str:
    """CTEs ending in ``scored``: the risk score table on the fixture probability."""
    labels = ", ".join(f"({i + 1}, '{s}')" for i, s in enumerate(C.SEGMENT_LABELS))
    gain = f"(clv * {1 - C.DISCOUNT_RATE!r})"
    return labelled_ctes(source) + f""",
seg AS (SELECT cust.*, CAST(CAST(customer_id AS BIGINT) % {C.N_SEGMENTS} AS INTEGER) AS segment_id FROM cust),
segrank AS (
  SELECT segment_id, row_number() OVER (ORDER BY avg(clv) DESC, segment_id) AS r
  FROM seg GROUP BY segment_id
),
labels(r, segment) AS (VALUES {labels}),
prob AS (
  SELECT seg.*, labels.segment,
         CAST(seg.recency AS DOUBLE) / (CAST(seg.recency AS DOUBLE) + (SELECT t FROM thr)) AS churn_prob
  FROM seg JOIN segrank USING (segment_id) JOIN labels USING (r)
),
fin AS (
  SELECT prob.*, churn_prob * clv AS expected_loss, {gain} AS retention_gain,
         {gain} - {C.RETENTION_COST_PER_CUSTOMER!r} AS net_roi,
         ({gain} - {C.RETENTION_COST_PER_CUSTOMER!r}) * churn_prob AS intervention_roi
  FROM prob
),
scored AS (
  SELECT fin.*,
    CASE WHEN churn_prob >= {C.TIER_CRITICAL} THEN 'Critical Risk'
         WHEN churn_prob >= {C.TIER_HIGH} THEN 'High Risk'
         WHEN churn_prob >= {C.TIER_MEDIUM} THEN 'Medium Risk'
         WHEN churn_prob >= {C.TIER_LOW} THEN 'Low Risk' ELSE 'Safe' END AS risk_tier,
    CASE WHEN churn_prob >= {C.TIER_CRITICAL} AND net_roi > 0 THEN '{C.DECISION_URGENT}'
         WHEN churn_prob >= {C.TIER_HIGH} AND net_roi > 0 THEN '{C.DECISION_HIGH}'
         WHEN churn_prob >= {C.TIER_MEDIUM} AND net_roi > 0 THEN '{C.DECISION_MEDIUM}'
         WHEN churn_prob < {C.TIER_MEDIUM} THEN '{C.DECISION_MONITOR}'
         ELSE '{C.DECISION_DO_NOT}' END AS decision
  FROM fin
)"""


SCORE_DOUBLES = ("clv", "churn_prob", "expected_loss", "retention_gain", "net_roi", "intervention_roi")


def score_select(alias: str = "scored") -> str:
    return feature_select(alias, SCORE_DOUBLES, (f"{alias}.churn", f"{alias}.segment_id",
                                                 f"{alias}.segment", f"{alias}.risk_tier",
                                                 f"{alias}.decision"))


for _name, _src in (("C1_C3_customer_risk_scores", "orders"), ("C1_C3_customer_risk_scores_events", "events")):
    ORACLES[_name] = f"WITH {scored_ctes(_src)} SELECT {score_select()} FROM scored"

ORACLES["C5_stress_clip"] = (
    f"WITH {scored_ctes('orders')} SELECT customer_id, "
    + ", ".join(f"{r6(f'greatest(least(churn_prob * {m!r}, 1.0), 0.0)')} AS p_{i}"
                for i, (_, m, _v) in enumerate(C.STRESS_SCENARIOS))
    + " FROM scored")

ORACLES["C4_baseline_decisions"] = ORACLES["F22_baseline_features"].replace(
    "FROM base b JOIN trend t USING (customer_id)", "") .strip()
# (rebuilt below as a full query)
ORACLES["C4_baseline_decisions"] = f"""
WITH bf AS ({ORACLES['F22_baseline_features']}),
p AS (
  SELECT bf.*, CAST(recency AS DOUBLE) / (CAST(recency AS DOUBLE) + {float(C.CHURN_WINDOW_DAYS)}) AS churn_prob,
         monetary * {C.AVG_PROFIT_MARGIN} AS clv
  FROM bf
),
q AS (
  SELECT p.*, churn_prob * clv AS expected_loss, clv * {1 - C.DISCOUNT_RATE!r} AS retention_gain,
         clv * {1 - C.DISCOUNT_RATE!r} - {C.RETENTION_COST_PER_CUSTOMER!r} AS roi
  FROM p
)
SELECT customer_id, recency, frequency, monetary, avg_order_value, trend, churn,
       {r6('churn_prob')} AS churn_prob, {r6('clv')} AS clv, {r6('expected_loss')} AS expected_loss,
       {r6('retention_gain')} AS retention_gain, {r6('roi')} AS roi,
       CASE WHEN churn_prob > {C.BASELINE_HIGH_P} AND roi > 0 THEN '{C.BASELINE_HIGH}'
            WHEN churn_prob > {C.BASELINE_MEDIUM_P} AND roi > 0 THEN '{C.BASELINE_MEDIUM}'
            WHEN churn_prob <= {C.BASELINE_MEDIUM_P} THEN '{C.BASELINE_NONE}'
            ELSE '{C.BASELINE_DO_NOT}' END AS decision
FROM q
"""


def losses_ctes(source: str, n_sims: int = C.MC_SIMULATIONS, seed: int = C.RANDOM_STATE) -> str:
    """CTEs ending in ``losses(sim, loss)``: the Monte Carlo on the fixture scores."""
    k = sql_key32(f"customer_id || '|' || '{seed}'")
    return scored_ctes(source) + f""",
keys AS (SELECT {k} AS k, churn_prob AS p, clv FROM scored),
sims AS (SELECT range AS sim FROM range(0, {n_sims})),
losses AS (
  SELECT sim, sum(CASE WHEN {sql_uniform('k', 'sim')} < p THEN clv ELSE 0.0 END) AS loss
  FROM keys, sims GROUP BY sim
)"""


ORACLES["R1_loss_distribution"] = (
    f"WITH {losses_ctes('orders')} SELECT CAST(sim AS BIGINT) AS sim, {r6('loss')} AS loss FROM losses")

ORACLES["R2_loss_stats"] = f"""
WITH {losses_ctes('orders')},
v AS (SELECT quantile_cont(loss, {C.MC_CONFIDENCE}) AS var FROM losses)
SELECT {r6('round_even(avg(loss), 2)')} AS mc_mean_loss,
       {r6('round_even((SELECT var FROM v), 2)')} AS var_95,
       {r6('round_even(avg(CASE WHEN loss >= (SELECT var FROM v) THEN loss END), 2)')} AS cvar_95,
       CAST(count(*) AS INTEGER) AS mc_simulations
FROM losses"""


def _stress(source: str) -> str:
    sc = ", ".join(f"('{n}', {cm!r}, {vm!r})" for n, cm, vm in C.STRESS_SCENARIOS)
    return f"""
WITH {losses_ctes(source)},
ref AS (SELECT avg(loss) AS m FROM losses),
scen(scenario, churn_multiplier, clv_multiplier) AS (VALUES {sc}),
agg AS (
  SELECT scen.scenario, CAST(scen.churn_multiplier AS DOUBLE) AS churn_multiplier,
         CAST(scen.clv_multiplier AS DOUBLE) AS clv_multiplier,
         sum(greatest(least(s.churn_prob * scen.churn_multiplier, 1.0), 0.0) * s.clv * scen.clv_multiplier) AS loss,
         sum(CASE WHEN greatest(least(s.churn_prob * scen.churn_multiplier, 1.0), 0.0) >= {C.TIER_HIGH}
                  THEN 1 ELSE 0 END) AS hr
  FROM scored s, scen GROUP BY 1, 2, 3
)
SELECT scenario, {r6('churn_multiplier')} AS churn_multiplier, {r6('clv_multiplier')} AS clv_multiplier,
       {r6('round_even(loss, 0)')} AS expected_loss, CAST(hr AS BIGINT) AS high_risk_customers,
       {r6('round_even((loss / (SELECT m FROM ref) - 1) * 100, 1)')} AS loss_delta_pct
FROM agg"""


ORACLES["R3_stress_test"] = _stress("orders")
ORACLES["R3_stress_test_events"] = _stress("events")


# --------------------------------------------------------------------------
# Summaries, filters, rows
# --------------------------------------------------------------------------

_S = scored_ctes("orders")
_AT_RISK = ", ".join(f"'{t}'" for t in C.AT_RISK_TIERS)


def _money(expr: str) -> str:
    return f"'$' || format('{{:,.0f}}', round_even(CAST({expr} AS DOUBLE), 0))"


ORACLES["A1_profile"] = (f"WITH {labelled_ctes('orders')} SELECT (SELECT count(*) FROM tx) AS n_rows, "
                         f"count(*) AS n_customers, {r6('avg(CAST(churn AS DOUBLE))')} AS churn_rate FROM cust")
ORACLES["A2_churn_counts"] = (f"WITH {labelled_ctes('orders')} SELECT churn, count(*) AS customers "
                              "FROM cust GROUP BY churn")
ORACLES["A3_segment_summary"] = (
    f"WITH {_S} SELECT segment, count(*) AS customers, {r6('round_even((CAST(sum(CAST(clv AS DECIMAL(38,6))) AS DOUBLE) / CAST(count(clv) AS DOUBLE)), 2)')} AS avg_clv, "
    f"{r6('round_even(avg(CAST(recency AS DOUBLE)), 2)')} AS avg_recency, "
    f"{r6('round_even(avg(CAST(churn AS DOUBLE)), 2)')} AS churn_rate FROM scored GROUP BY segment")
_KPIS = (f"SELECT segment, count(*) AS customers, round_even((CAST(sum(CAST(clv AS DECIMAL(38,6))) AS DOUBLE) / CAST(count(clv) AS DOUBLE)), 2) AS avg_clv, "
         "round_even(avg(churn_prob), 2) AS avg_churn_prob, round_even(CAST(sum(CAST(monetary AS DECIMAL(38,6))) AS DOUBLE), 2) AS total_revenue, "
         "round_even(sum(expected_loss), 2) AS at_risk FROM scored GROUP BY segment")
ORACLES["A4_segment_kpis"] = (f"WITH {_S}, k AS ({_KPIS}) SELECT segment, customers, {r6('avg_clv')} AS avg_clv, "
                              f"{r6('avg_churn_prob')} AS avg_churn_prob, {r6('total_revenue')} AS total_revenue, "
                              f"{r6('at_risk')} AS at_risk FROM k")
ORACLES["A4_C8_segment_kpis_display"] = (
    f"WITH {_S}, k AS ({_KPIS}) SELECT segment, customers, {_money('avg_clv')} AS avg_clv, "
    "format('{:.1f}', round_even(avg_churn_prob * 100, 1)) || '%' AS avg_churn_prob, "
    f"{_money('total_revenue')} AS total_revenue, {_money('at_risk')} AS at_risk FROM k")
ORACLES["A5_segment_distribution"] = (f"WITH {_S} SELECT segment, count(*) AS customers, "
                                      f"{r6('(CAST(sum(CAST(clv AS DECIMAL(38,6))) AS DOUBLE) / CAST(count(clv) AS DOUBLE))')} AS avg_clv FROM scored GROUP BY segment")

_TIERS = ", ".join(f"('{t}', {i})" for i, t in enumerate(C.TIER_ORDER))
_TIERS_REV = ", ".join(f"('{t}', {i})" for i, t in enumerate(reversed(C.TIER_ORDER)))
ORACLES["A6_tier_summary"] = f"""
WITH {_S}, tiers(risk_tier, tier_order) AS (VALUES {_TIERS_REV}),
a AS (SELECT risk_tier, count(*) AS n, avg(churn_prob) AS ap, CAST(sum(CAST(clv AS DECIMAL(38,6))) AS DOUBLE) AS tc, sum(expected_loss) AS el
      FROM scored GROUP BY risk_tier)
SELECT t.risk_tier, CAST(t.tier_order AS INTEGER) AS tier_order, CAST(coalesce(a.n, 0) AS BIGINT) AS customers,
       {r6('coalesce(a.ap, 0.0)')} AS avg_prob, {r6('coalesce(a.tc, 0.0)')} AS total_clv,
       {r6('coalesce(a.el, 0.0)')} AS expected_loss
FROM tiers t LEFT JOIN a USING (risk_tier)"""


def _tier_dist(source: str) -> str:
    return f"""
WITH {scored_ctes(source)}, tiers(risk_tier, tier_order) AS (VALUES {_TIERS}),
a AS (SELECT risk_tier, count(*) AS n FROM scored GROUP BY risk_tier)
SELECT t.risk_tier, CAST(t.tier_order AS INTEGER) AS tier_order, CAST(coalesce(a.n, 0) AS BIGINT) AS customers,
       {r6('round_even(CAST(coalesce(a.n, 0) AS DOUBLE) / (SELECT count(*) FROM scored) * 100, 1)')} AS pct
FROM tiers t LEFT JOIN a USING (risk_tier)"""


ORACLES["A7_tier_distribution"] = _tier_dist("orders")
ORACLES["A7_tier_distribution_events"] = _tier_dist("events")

ORACLES["A9_header_kpis"] = (
    f"WITH {_S} SELECT count(*) AS n_customers, {r6('avg(CAST(churn AS DOUBLE)) * 100')} AS churn_rate_pct, "
    f"{r6(f'coalesce(sum(CASE WHEN risk_tier IN ({_AT_RISK}) THEN expected_loss END), 0.0)')} AS at_risk_revenue, "
    f"{r6('CAST(sum(CAST(clv AS DECIMAL(38,6))) AS DOUBLE)')} AS total_clv, "
    "CAST(sum(CASE WHEN risk_tier = 'Critical Risk' THEN 1 ELSE 0 END) AS BIGINT) AS critical_customers "
    "FROM scored")
ORACLES["A10_decision_counts"] = f"WITH {_S} SELECT decision, count(*) AS customers FROM scored GROUP BY decision"
ORACLES["A10_decision_counts_events"] = (f"WITH {scored_ctes('events')} SELECT decision, count(*) AS customers "
                                         "FROM scored GROUP BY decision")
ORACLES["A11_roi_by_decision"] = (f"WITH {_S} SELECT decision, {r6('(CAST(sum(CAST(net_roi AS DECIMAL(38,6))) AS DOUBLE) / CAST(count(net_roi) AS DOUBLE))')} AS avg_net_roi "
                                  "FROM scored GROUP BY decision")
_cuts = " ".join(f"WHEN bin = {int(t * 50 + 1e-9)} THEN '{n}'" for n, t in zip(
    C.TIER_CUT_LABELS, (C.TIER_LOW, C.TIER_MEDIUM, C.TIER_HIGH, C.TIER_CRITICAL)))
ORACLES["A12_probability_histogram"] = f"""
WITH {_S}, h AS (SELECT CAST(least(floor(churn_prob * 50), 49) AS INTEGER) AS bin, count(*) AS customers
                 FROM scored GROUP BY 1)
SELECT bin, {r6('bin / 50.0')} AS bin_start, {r6('(bin + 1) / 50.0')} AS bin_end, coalesce(customers, 0) AS customers,
       CASE {_cuts} ELSE NULL END AS tier_cut
FROM (SELECT CAST(unnest(range(50)) AS INTEGER) AS bin) LEFT JOIN h USING (bin)"""
ORACLES["A13_value_risk_quadrants"] = f"""
WITH {_S}, q AS (SELECT quantile_cont(clv, 0.5) AS med, quantile_cont(clv, 0.9) AS q90,
                        quantile_cont(clv, 0.1) AS q10 FROM scored)
SELECT CASE WHEN clv >= q.med AND churn_prob >= 0.5 THEN '{C.QUADRANT_LABELS[0]}'
            WHEN clv >= q.med THEN '{C.QUADRANT_LABELS[1]}'
            WHEN churn_prob >= 0.5 THEN '{C.QUADRANT_LABELS[2]}' ELSE '{C.QUADRANT_LABELS[3]}' END AS quadrant,
       count(*) AS customers, {r6('any_value(q.med)')} AS clv_median, {r6('any_value(q.q90)')} AS clv_q90,
       {r6('any_value(q.q10)')} AS clv_q10
FROM scored, q GROUP BY 1"""
ORACLES["A14_feature_medians"] = (
    f"WITH {_S} SELECT " + ", ".join(f"{r6(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS {c}"
                                     for c in C.FEATURE_COLS) + " FROM scored")

ORACLES["P7_filter_customers"] = (f"WITH {_S} SELECT {score_select()} FROM scored WHERE churn_prob >= 0.35 "
                                  "AND churn_prob <= 0.9 AND segment = 'Champions'")
ORACLES["P8_search_customers"] = (f"WITH {_S} SELECT {score_select()} FROM scored "
                                  "WHERE regexp_matches(customer_id, '^1.*7$', 'i') AND risk_tier = 'High Risk'")
ORACLES["P9_lookup_customer"] = f"WITH {_S} SELECT {score_select()} FROM scored WHERE customer_id = '767'"
ORACLES["P8_gram_search"] = f"WITH {_S} SELECT {score_select()} FROM scored WHERE regexp_matches(customer_id, '^1?140', 'i')"
ORACLES["P9_key_lookup"] = f"WITH {_S} SELECT {score_select()} FROM scored WHERE customer_id = '140'"
ORACLES["P10_at_risk"] = (f"WITH {_S} SELECT customer_id, risk_tier, {r6('churn_prob')} AS churn_prob "
                          f"FROM scored WHERE risk_tier IN ({_AT_RISK})")
_PAGE = (f"customer_id, risk_tier, {r6('churn_prob')} AS churn_prob, {r6('clv')} AS clv, decision, recency, "
         f"frequency, {r6('monetary')} AS monetary, segment")
ORACLES["P12_select_existing"] = f"WITH {_S} SELECT {_PAGE} FROM scored"
_SD = C.STRESS_DISPLAY_NAMES
ORACLES["P13_C8_display_stress"] = f"""
WITH st AS ({_stress("orders")})
SELECT scenario AS "{_SD[0]}", '×' || format('{{:.2f}}', churn_multiplier) AS "{_SD[1]}",
       '×' || format('{{:.2f}}', clv_multiplier) AS "{_SD[2]}", {_money('expected_loss')} AS "{_SD[3]}",
       high_risk_customers AS "{_SD[4]}",
       format('{{:+.1f}}', loss_delta_pct) || '%' AS "{_SD[5]}"
FROM st"""
ORACLES["W6_page_customers"] = (f"WITH {_S} SELECT {_PAGE}, (SELECT count(*) FROM scored) AS total FROM scored "
                                "ORDER BY churn_prob DESC, customer_id LIMIT 20 OFFSET 20")
ORACLES["W6_page_customers_search"] = (
    f"WITH {_S}, m AS (SELECT * FROM scored WHERE regexp_matches(customer_id, '3', 'i') "
    f"AND risk_tier = 'Medium Risk') SELECT {_PAGE}, (SELECT count(*) FROM m) AS total FROM m "
    "ORDER BY churn_prob DESC, customer_id LIMIT 10")
ORACLES["W8_segments"] = f"WITH {_S} SELECT DISTINCT segment FROM scored"
ORACLES["W9_sample_at_risk"] = (f"WITH {_S} SELECT customer_id, risk_tier, {r6('churn_prob')} AS churn_prob "
                                f"FROM scored WHERE risk_tier IN ({_AT_RISK}) "
                                "ORDER BY md5(customer_id || '|42') LIMIT 1")
ORACLES["W10_example_high_risk"] = (f"WITH {_S} SELECT customer_id, {r6('churn_prob')} AS churn_prob "
                                    "FROM scored WHERE churn_prob > 0.75 ORDER BY customer_id LIMIT 1")
ORACLES["W11_preview"] = (f"WITH {labelled_ctes('orders')} SELECT "
                          f"{feature_select('cust', ('clv',), ('cust.churn',))} FROM cust "
                          "ORDER BY customer_id LIMIT 5")
ORACLES["S5_export_view"] = (
    f"WITH {_S} SELECT customer_id, segment, risk_tier, {r6('round_even(churn_prob * 100, 2)')} AS churn_prob, "
    f"{r6('clv')} AS clv, {r6('expected_loss')} AS expected_loss, {r6('net_roi')} AS net_roi, decision, "
    f"{r6('monetary')} AS monetary, frequency, recency FROM scored WHERE churn_prob >= 0.2 AND churn_prob <= 1.0")


# --------------------------------------------------------------------------
# Split and metrics
# --------------------------------------------------------------------------

def _stratified(source: str, stream: int) -> str:
    """CTE ``ranked``: customers with their rank (from 0) in their class by hash key, and the class's size."""
    key = f"CAST('0x' || substr(md5(customer_id || '|{C.RANDOM_STATE}|{stream}'), 1, 15) AS BIGINT)"
    return (f"ranked AS (SELECT *, row_number() OVER (PARTITION BY churn ORDER BY {key}, customer_id) - 1 AS rnk, "
            f"count(*) OVER (PARTITION BY churn) AS class_n FROM {source})")


_IS_TEST = f"rnk < floor({C.TEST_SIZE} * class_n + 0.5)"


def metric_ctes(source: str) -> str:
    k = sql_key32(f"customer_id || '|' || '{C.RANDOM_STATE}'")
    return scored_ctes(source) + f""",
{_stratified('scored', 0)},
mf AS (
  SELECT customer_id, churn AS y, floor((churn_prob + {sql_uniform(k, '1')}) * 50) / 100.0 AS p
  FROM ranked WHERE {_IS_TEST}
),
sc AS (SELECT p AS score, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM mf GROUP BY p),
cum AS (
  SELECT score, pos, neg,
         sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cneg,
         sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp_at,
         sum(pos + neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_at
  FROM sc
),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM sc),
cm AS (
  SELECT sum(CASE WHEN p > 0.5 AND y = 1 THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN p > 0.5 AND y = 0 THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN p <= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS fn,
         sum(CASE WHEN p <= 0.5 AND y = 0 THEN 1 ELSE 0 END) AS tn,
         avg((p - y) * (p - y)) AS brier
  FROM mf
),
met AS (
  SELECT (SELECT sum(pos * ((cneg - neg) + 0.5 * neg)) FROM cum) / (P * N) AS auc,
         (SELECT sum((pos / (SELECT P FROM tot)) * (tp_at / n_at)) FROM cum) AS avg_precision,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1,
         CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision,
         CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall,
         brier AS brier_score
  FROM tot, cm
)"""


for _name, _src in (("M10_binary_metrics", "orders"), ("M10_binary_metrics_events", "events")):
    ORACLES[_name] = (f"WITH {metric_ctes(_src)} SELECT " + ", ".join(
        f"{r6(c)} AS {c}" for c in ("auc", "avg_precision", "f1", "precision", "recall", "brier_score"))
        + " FROM met")

ORACLES["M3_split"] = f"WITH {labelled_ctes('orders')}, {_stratified('cust', 0)} SELECT customer_id, churn, {_IS_TEST} AS is_test FROM ranked"


def _fold_expr(k: int) -> str:
    ends, done = [], 0.0
    for _ in range(k - 1):
        done += 1.0 / k
        ends.append(f"(rnk >= floor(CAST({done!r} AS DOUBLE) * class_n + 0.5))::INT")
    return " + ".join(ends)


ORACLES["M9_folds"] = (f"WITH {labelled_ctes('orders')}, {_stratified('cust', 3)} "
                       f"SELECT customer_id, churn, CAST({_fold_expr(C.CV_FOLDS)} AS INTEGER) AS fold FROM ranked")
ORACLES["M2_segment_checks"] = (f"WITH {labelled_ctes('orders')} SELECT count(*) AS customers, CAST({C.N_SEGMENTS} AS BIGINT) AS segments, "
                                "CAST(0 AS BIGINT) AS unnamed, CAST(0 AS BIGINT) AS out_of_order FROM cust")


def _d0(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END)"


_p0, _r0, _f0 = _d0("tn", "tn + fn"), _d0("tn", "tn + fp"), _d0("2 * tn", "2 * tn + fn + fp")
_p1, _r1, _f1 = _d0("tp", "tp + fp"), _d0("tp", "tp + fn"), _d0("2 * tp", "2 * tp + fp + fn")
_s0, _s1 = "CAST(tn + fp AS DOUBLE)", "CAST(tp + fn AS DOUBLE)"
_n = f"({_s0} + {_s1})"
ORACLES["M11_class_report"] = f"""
WITH {metric_ctes('orders')},
rows(label, precision, recall, f1_score, support) AS (
  SELECT '{C.CLASS_NAMES[0]}', {_p0}, {_r0}, {_f0}, {_s0} FROM cm UNION ALL
  SELECT '{C.CLASS_NAMES[1]}', {_p1}, {_r1}, {_f1}, {_s1} FROM cm UNION ALL
  SELECT 'accuracy', NULL, NULL, {_d0('tp + tn', 'tp + tn + fp + fn')}, {_n} FROM cm UNION ALL
  SELECT 'macro avg', ({_p0} + {_p1}) / 2, ({_r0} + {_r1}) / 2, ({_f0} + {_f1}) / 2, {_n} FROM cm UNION ALL
  SELECT 'weighted avg', {_d0(f'{_p0} * {_s0} + {_p1} * {_s1}', _n)}, {_d0(f'{_r0} * {_s0} + {_r1} * {_s1}', _n)},
         {_d0(f'{_f0} * {_s0} + {_f1} * {_s1}', _n)}, {_n} FROM cm
)
SELECT label, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1_score')} AS f1_score,
       CAST(support AS BIGINT) AS support FROM rows"""

ORACLES["A8_portfolio_summary"] = f"""
WITH {losses_ctes('orders').replace('scored AS (', 'scored AS (', 1)},
v AS (SELECT quantile_cont(loss, {C.MC_CONFIDENCE}) AS var FROM losses),
st AS (SELECT round_even((SELECT var FROM v), 2) AS var_95,
              round_even(avg(CASE WHEN loss >= (SELECT var FROM v) THEN loss END), 2) AS cvar_95 FROM losses),
ranked AS ({metric_ctes('orders').split('ranked AS (', 1)[1]}
SELECT count(*) AS total_customers,
       CAST(sum(CASE WHEN risk_tier IN ({_AT_RISK}) THEN 1 ELSE 0 END) AS BIGINT) AS at_risk_customers,
       {r6('round_even(sum(CAST(clv AS DECIMAL(38,4))), 2)')} AS total_clv,
       {r6('round_even(sum(expected_loss), 2)')} AS expected_loss,
       {r6('round_even(avg(churn_prob) * 100, 1)')} AS avg_churn_rate,
       {r6('(SELECT var_95 FROM st)')} AS var_95, {r6('(SELECT cvar_95 FROM st)')} AS cvar_95,
       {r6('round_even((SELECT auc FROM met), 4)')} AS model_auc, {r6('round_even((SELECT f1 FROM met), 4)')} AS model_f1
FROM scored"""

ORACLES["M14_whatif_features"] = f"""
WITH {labelled_ctes('orders')},
med AS (SELECT {', '.join(f'quantile_cont(CAST({c} AS DOUBLE), 0.5) AS {c}' for c in C.FEATURE_COLS)} FROM cust)
SELECT customer_id AS request_id, {r6('cust.recency')} AS recency,
  {r6('cust.frequency')} AS frequency, {r6('cust.monetary')} AS monetary,
  {r6('cust.avg_order_value')} AS avg_order_value, {r6('cust.product_diversity')} AS product_diversity,
  {r6('med.total_quantity')} AS total_quantity, {r6('med.geo_spread')} AS geo_spread,
  {r6('med.purchase_volatility')} AS purchase_volatility,
  {r6('med.avg_days_between_purchases')} AS avg_days_between_purchases,
  {r6('med.spending_trend')} AS spending_trend, {r6('med.revenue_concentration')} AS revenue_concentration,
  {r6(f'(cust.monetary * {C.WHATIF_SPEND_LAST30_SHARE} + 1) / (cust.monetary * {C.WHATIF_SPEND_30_90_SHARE} + 1)')}
    AS recency_acceleration,
  {r6('med.weekend_ratio')} AS weekend_ratio, {r6('cust.tenure')} AS tenure,
  {r6(f'cust.monetary * {C.WHATIF_SPEND_LAST30_SHARE}')} AS spend_last30,
  {r6(f'cust.monetary * {C.WHATIF_SPEND_30_90_SHARE}')} AS spend_30_90,
  {r6(f'cust.monetary * {C.AVG_PROFIT_MARGIN}')} AS clv
FROM cust, med"""

ORACLES["S1_read_transactions_csv"] = _clean("orders")
ORACLES["S2_S3_results_roundtrip"] = f"WITH {scored_ctes('orders')} SELECT {score_select()} FROM scored"
ORACLES["ST_stream_ingest_events"] = _clean("events")

# Single features (F1-F16) and the baseline trend.
_SINGLE = {
    "F1": "recency", "F2": "frequency", "F3": "monetary", "F4": "avg_order_value",
    "F5": "product_diversity", "F6": "total_quantity", "F7": "geo_spread", "F8": "purchase_volatility",
    "F9": "revenue_concentration", "F10": "spend_last30", "F11": "spend_30_90",
    "F12": "recency_acceleration", "F13": "weekend_ratio", "F14": "tenure",
    "F15": "avg_days_between_purchases", "F16": "spending_trend",
}
for _fid, _col in _SINGLE.items():
    _expr = _col if _col in FEATURE_LONGS else r6(_col)
    ORACLES[f"{_fid}_{_col}"] = f"WITH {features_ctes('orders')} SELECT customer_id, {_expr} AS {_col} FROM feat"
ORACLES["F15_avg_days_between_purchases_events"] = (
    f"WITH {features_ctes('events')} SELECT customer_id, {r6('avg_days_between_purchases')} "
    "AS avg_days_between_purchases FROM feat")
ORACLES["F7_geo_spread_events"] = (
    f"WITH {features_ctes('events')} SELECT customer_id, geo_spread FROM feat")
ORACLES["F17_baseline_trend"] = (
    "WITH bf AS (" + ORACLES["F22_baseline_features"] + ") SELECT customer_id, trend FROM bf")

ORACLES["W2_monthly_pct_change"] = f"""
WITH {TX_ORDERS},
mon AS (SELECT customer_id, year(ts) * 12 + month(ts) - 1 AS m, sum(amount) AS spend FROM tx GROUP BY 1, 2),
span AS (SELECT customer_id, min(m) AS m0, max(m) AS m1 FROM mon GROUP BY 1),
dense AS (
  SELECT s.customer_id, g.m, CAST(coalesce(mon.spend, 0) AS DOUBLE) AS y
  FROM span s, LATERAL (SELECT unnest(range(s.m0, s.m1 + 1)) AS m) g
  LEFT JOIN mon ON mon.customer_id = s.customer_id AND mon.m = g.m
),
chg AS (SELECT customer_id, m, y, lag(y) OVER (PARTITION BY customer_id ORDER BY m) AS prev FROM dense)
SELECT customer_id, CAST(m AS INTEGER) AS month, {r6('y')} AS spend,
       CASE WHEN prev IS NULL THEN NULL
            WHEN prev = 0 THEN CASE WHEN y > 0 THEN CAST('inf' AS DOUBLE) ELSE NULL END
            ELSE {r6('y / prev - 1')} END AS pct_change
FROM chg"""


# --------------------------------------------------------------------------
# The loss distribution without draws: its moments are plain sums
# --------------------------------------------------------------------------

def _loss_moments(source: str) -> str:
    return f"""
WITH {scored_ctes(source)},
t AS (SELECT sum(churn_prob * clv) AS m, sqrt(sum(churn_prob * (1 - churn_prob) * clv * clv)) AS sd,
        sum(churn_prob * (1 - churn_prob) * (1 - 2 * churn_prob) * clv * clv * clv) AS k3 FROM scored)
SELECT round(m, 3) AS mean_loss, round(sd, 3) AS sd_loss, round(k3 / (sd * sd * sd), 5) AS skewness FROM t"""


ORACLES["R2_loss_curve_moments"] = _loss_moments("orders")
ORACLES["R2_loss_curve_moments_events"] = _loss_moments("events")

ORACLES["W6_deep_page"] = (
    f"WITH {_S}, o AS (SELECT *, row_number() OVER (ORDER BY churn_prob DESC, customer_id) - 1 AS rnk, count(*) OVER () AS total FROM scored) "
    f"SELECT {_PAGE}, total FROM o WHERE rnk >= (greatest(total // 7, 1) - 1) * 7 AND rnk < greatest(total // 7, 1) * 7")

ORACLES["S1_quoted_line_breaks"] = f"""
WITH {TX_ORDERS},
l AS (SELECT stock_code, amount, CAST(stock_code AS BIGINT) % 3 = 0 AS odd, length(country) AS n FROM tx)
SELECT stock_code, count(*) AS lines, {r6('CAST(sum(amount) AS DOUBLE)')} AS amount,
       CAST(max(CASE WHEN odd THEN n + 11 + length(stock_code) ELSE n END) AS INTEGER) AS longest,
       CAST(sum(CASE WHEN odd THEN 2 ELSE 0 END) AS BIGINT) AS breaks
FROM l GROUP BY stock_code"""


# --------------------------------------------------------------------------
# What holds for any fitted model: rows, splits and values that SQL can derive
# --------------------------------------------------------------------------

_R = f"_{C.QUERY_ROUNDS}_rounds"
_TEST = f"WITH {labelled_ctes('orders')}, {_stratified('cust', 0)}"
ORACLES["M12_model_checks" + _R] = f"{_TEST} SELECT customer_id, churn, {_IS_TEST} AS is_test, false AS broken FROM ranked"
ORACLES["M9_cross_validate_checks" + _R] = (
    f"WITH {labelled_ctes('orders')}, {_stratified('cust', 3)}, f AS (SELECT churn, CAST({_fold_expr(C.CV_FOLDS)} AS INTEGER) AS fold FROM ranked) "
    "SELECT fold, count(*) AS customers, CAST(sum(churn) AS BIGINT) AS churned, true AS better FROM f GROUP BY fold")
ORACLES["M14_whatif_checks" + _R] = f"WITH {labelled_ctes('orders')} SELECT customer_id AS request_id, true AS values_fit, true AS tier_fits FROM cust"
ORACLES["S4_model_roundtrip_scores" + _R] = f"WITH {labelled_ctes('orders')} SELECT customer_id, true AS same FROM cust"
ORACLES["W7_top_checks"] = f"{_TEST} SELECT customer_id, CAST(8 AS BIGINT) AS n, CAST(8 AS BIGINT) AS features FROM ranked WHERE {_IS_TEST}"
ORACLES["A18_importance_checks"] = "SELECT unnest([" + ", ".join(f"'{c}'" for c in C.FEATURE_COLS) + "]) AS feature, true AS not_negative"
ORACLES["M13_contribution_checks"] = f"{_TEST} SELECT customer_id, CAST({len(C.FEATURE_COLS)} AS BIGINT) AS n, true AS additive FROM ranked WHERE {_IS_TEST}"
ORACLES["M15_baseline_checks"] = (
    f"WITH bf AS ({ORACLES['F22_baseline_features']}), {_stratified('bf', 0)} "
    f"SELECT customer_id, frequency, monetary, churn, {_IS_TEST} AS is_test, {r6(f'monetary * {C.AVG_PROFIT_MARGIN}')} AS clv, "
    f"{r6(f'monetary * {C.AVG_PROFIT_MARGIN} * {1 - C.DISCOUNT_RATE}')} AS retention_gain, "
    f"{r6(f'monetary * {C.AVG_PROFIT_MARGIN} * {1 - C.DISCOUNT_RATE} - {C.RETENTION_COST_PER_CUSTOMER}')} AS roi, true AS good FROM ranked")
