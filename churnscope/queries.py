"""Registered queries: one callable per operator, each (spark, sf_dir) -> DataFrame.

Every query reads the driver's tables through an adapter (S6) and runs over
whole tables. Doubles are rounded to 6 places for comparison with the SQL
oracles in ``churnscope.oracle_sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.functions.scalar import round6
from churnscope.operators.clean import clean
from churnscope.operators import features as FE
from churnscope.session import app_id, write_table
from churnscope.sources.adapters import ADAPTERS

REGISTRY: dict = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


_TABLES: dict = {}


def _memo(spark: SparkSession, key: tuple, build) -> DataFrame:
    """One written copy per session of a shared intermediate table."""
    k = (app_id(spark),) + key
    if k not in _TABLES:
        _TABLES[k] = write_table(build(), "_".join(str(x) for x in key[1:]))
    return _TABLES[k]


def tx_of(spark: SparkSession, sf_dir: str, source: str = "orders") -> DataFrame:
    """Cleaned transaction lines of an adapter, written once per session."""
    return _memo(spark, ("tx", sf_dir, source),
                 lambda: clean(ADAPTERS[source](spark, sf_dir)))


def out(df: DataFrame) -> DataFrame:
    return round6(df)


# ---------------------------------------------------------------- sources / cleaning

@query("S6_P1_P6_clean_orders")
def q_clean_orders(spark, sf_dir):
    tx = tx_of(spark, sf_dir, "orders")
    return out(tx.withColumn("price", F.col("price").cast("double"))
                 .withColumn("amount", F.col("amount").cast("double")))


@query("S6_P1_P6_clean_events")
def q_clean_events(spark, sf_dir):
    tx = tx_of(spark, sf_dir, "events")
    return out(tx.withColumn("price", F.col("price").cast("double"))
                 .withColumn("amount", F.col("amount").cast("double")))


# ---------------------------------------------------------------- features

@query("F21_customer_features")
def q_features(spark, sf_dir):
    return out(FE.customer_features(tx_of(spark, sf_dir, "orders")))


@query("F21_customer_features_events")
def q_features_events(spark, sf_dir):
    return out(FE.customer_features(tx_of(spark, sf_dir, "events")))


@query("F22_baseline_features")
def q_baseline(spark, sf_dir):
    return out(FE.baseline_features(tx_of(spark, sf_dir, "orders")))
FLAGSHIP = "C1_C3_customer_risk_scores"


# ---------------------------------------------------------------- shared tables

from churnscope import config as C  # noqa: E402
from churnscope.config import DEFAULT, QUERY, QUERY_ROUNDS  # noqa: E402
from churnscope.operators import cohorts as CO  # noqa: E402
from churnscope.operators import metrics as ME  # noqa: E402
from churnscope.operators import portfolio as PF  # noqa: E402
from churnscope.operators import scoring as SC  # noqa: E402
from churnscope.operators import summaries as SU  # noqa: E402


def cust_of(spark, sf_dir, source="orders"):
    """Features + calibrated churn label + CLV, written once per session."""
    return _memo(spark, ("cust", sf_dir, source),
                 lambda: FE.labelled_features(tx_of(spark, sf_dir, source)))


def scored_of(spark, sf_dir, source="orders"):
    """The risk score table on the fixture probability and fixture segments."""
    def build():
        cust = cust_of(spark, sf_dir, source)
        t = FE.churn_threshold(cust)
        c = SC.label_segments(SC.fixture_segments(SC.fixture_probability(cust, t)))
        return SC.score_table(c)
    return _memo(spark, ("scored", sf_dir, source), build)


def losses_of(spark, sf_dir, source="orders", n_sims=C.MC_SIMULATIONS):
    return _memo(spark, ("losses", sf_dir, source, n_sims),
                 lambda: PF.loss_distribution(scored_of(spark, sf_dir, source), n_sims))


# ---------------------------------------------------------------- labels

@query("F20_churn_threshold")
def q_threshold(spark, sf_dir):
    cust = FE.recency(tx_of(spark, sf_dir, "orders"))
    return out(cust.agg(F.avg((F.col("recency") > C.CHURN_WINDOW_DAYS).cast("double")).alias("fixed_rate"))
               .select("fixed_rate", FE.churn_threshold(cust).alias("threshold")))


@query("F20_churn_threshold_events")
def q_threshold_events(spark, sf_dir):
    cust = FE.recency(tx_of(spark, sf_dir, "events"))
    return out(cust.agg(F.avg((F.col("recency") > C.CHURN_WINDOW_DAYS).cast("double")).alias("fixed_rate"))
               .select("fixed_rate", FE.churn_threshold(cust).alias("threshold")))


@query("F18_F19_labelled_features")
def q_labelled(spark, sf_dir):
    return out(cust_of(spark, sf_dir, "orders"))


@query("F18_F20_labelled_features_events")
def q_labelled_events(spark, sf_dir):
    return out(cust_of(spark, sf_dir, "events"))


# ---------------------------------------------------------------- cohorts

@query("A15_cohort_counts")
def q_cohort_counts(spark, sf_dir):
    cc = CO.cohort_counts(tx_of(spark, sf_dir, "orders"), cust_of(spark, sf_dir, "orders"))
    return cc.select(CO.month_label(F.col("cohort")).alias("cohort_month"),
                     F.col("cohort_index").cast("int").alias("cohort_index"), "customers")


@query("A16_cohort_retention")
def q_cohort_retention(spark, sf_dir):
    return out(CO.cohort_retention(tx_of(spark, sf_dir, "orders"), cust_of(spark, sf_dir, "orders")))


@query("A16_cohort_retention_events")
def q_cohort_retention_events(spark, sf_dir):
    return out(CO.cohort_retention(tx_of(spark, sf_dir, "events"), cust_of(spark, sf_dir, "events")))


@query("A17_cohort_pivot")
def q_cohort_pivot(spark, sf_dir):
    ret = CO.cohort_retention(tx_of(spark, sf_dir, "orders"), cust_of(spark, sf_dir, "orders"))
    return out(CO.cohort_pivot(ret))


# ---------------------------------------------------------------- scoring

@query("C1_C3_customer_risk_scores")
def q_scores(spark, sf_dir):
    return out(scored_of(spark, sf_dir, "orders"))


@query("C1_C3_customer_risk_scores_events")
def q_scores_events(spark, sf_dir):
    return out(scored_of(spark, sf_dir, "events"))


@query("C4_baseline_decisions")
def q_baseline_decisions(spark, sf_dir):
    from churnscope.functions.scalar import baseline_decision
    b = FE.baseline_features(tx_of(spark, sf_dir, "orders"))
    r = F.col("recency").cast("double")
    b = b.withColumn("churn_prob", r / (r + F.lit(float(C.CHURN_WINDOW_DAYS))))
    b = b.withColumn("clv", F.col("monetary") * F.lit(C.AVG_PROFIT_MARGIN))
    b = b.withColumn("expected_loss", F.col("churn_prob") * F.col("clv"))
    b = b.withColumn("retention_gain", F.col("clv") * F.lit(1 - C.DISCOUNT_RATE))
    b = b.withColumn("roi", F.col("retention_gain") - F.lit(C.RETENTION_COST_PER_CUSTOMER))
    return out(b.withColumn("decision", baseline_decision("churn_prob", "roi")))


@query("C5_stress_clip")
def q_clip(spark, sf_dir):
    from churnscope.functions.scalar import clip
    s = scored_of(spark, sf_dir, "orders")
    return out(s.select("customer_id", *[clip(F.col("churn_prob") * F.lit(m)).alias(f"p_{i}")
                                         for i, (_, m, _v) in enumerate(C.STRESS_SCENARIOS)]))


# ---------------------------------------------------------------- portfolio

@query("R1_loss_distribution")
def q_losses(spark, sf_dir):
    return out(losses_of(spark, sf_dir, "orders"))


@query("R2_loss_stats")
def q_loss_stats(spark, sf_dir):
    return out(PF.loss_stats(losses_of(spark, sf_dir, "orders")))


def curve_of(spark, sf_dir, source="orders"):
    """The loss distribution without draws, written once per session."""
    from churnscope.operators.loss_curve import loss_curve
    return _memo(spark, ("loss_curve", sf_dir, source), lambda: loss_curve(scored_of(spark, sf_dir, source)))


@query("R2_loss_curve_moments")
def q_loss_curve_moments(spark, sf_dir):
    """Moments of the distribution that the characteristic function gives."""
    from churnscope.operators.loss_curve import curve_moments
    m = curve_moments(curve_of(spark, sf_dir, "orders"))
    return m.select(*[F.round(c, 3).alias(c) for c in ("mean_loss", "sd_loss")], F.round("skewness", 5).alias("skewness"))


@query("R2_loss_curve_moments_events")
def q_loss_curve_moments_events(spark, sf_dir):
    from churnscope.operators.loss_curve import curve_moments
    m = curve_moments(curve_of(spark, sf_dir, "events"))
    return m.select(*[F.round(c, 3).alias(c) for c in ("mean_loss", "sd_loss")], F.round("skewness", 5).alias("skewness"))


@query("R2_loss_curve_stats")
def q_loss_curve_stats(spark, sf_dir):
    """Mean, VaR and CVaR without draws, with the stated grid error."""
    from churnscope.operators.loss_curve import curve_stats
    return out(curve_stats(curve_of(spark, sf_dir, "orders")))


@query("R3_stress_test")
def q_stress(spark, sf_dir):
    ref = losses_of(spark, sf_dir, "orders").agg(F.avg("loss")).scalar()
    return out(PF.stress_test(scored_of(spark, sf_dir, "orders"), ref))


@query("R3_stress_test_events")
def q_stress_events(spark, sf_dir):
    ref = losses_of(spark, sf_dir, "events").agg(F.avg("loss")).scalar()
    return out(PF.stress_test(scored_of(spark, sf_dir, "events"), ref))


# ---------------------------------------------------------------- summaries

def _scored(spark, sf_dir):
    return scored_of(spark, sf_dir, "orders")


@query("A1_profile")
def q_profile(spark, sf_dir):
    return out(SU.profile(tx_of(spark, sf_dir, "orders"), cust_of(spark, sf_dir, "orders")))


@query("A2_churn_counts")
def q_churn_counts(spark, sf_dir):
    return SU.churn_counts(cust_of(spark, sf_dir, "orders"))


@query("A3_segment_summary")
def q_segment_summary(spark, sf_dir):
    return out(SU.segment_summary(_scored(spark, sf_dir)))


@query("A4_segment_kpis")
def q_segment_kpis(spark, sf_dir):
    return out(SU.segment_kpis(_scored(spark, sf_dir)))


@query("A4_C8_segment_kpis_display")
def q_segment_kpis_display(spark, sf_dir):
    return SU.segment_kpis_display(SU.segment_kpis(_scored(spark, sf_dir)))


@query("A5_segment_distribution")
def q_segment_distribution(spark, sf_dir):
    return out(SU.segment_distribution(_scored(spark, sf_dir)))


@query("A6_tier_summary")
def q_tier_summary(spark, sf_dir):
    return out(SU.tier_summary(_scored(spark, sf_dir)))


@query("A7_tier_distribution")
def q_tier_distribution(spark, sf_dir):
    return out(SU.tier_distribution(_scored(spark, sf_dir)))


@query("A7_tier_distribution_events")
def q_tier_distribution_events(spark, sf_dir):
    return out(SU.tier_distribution(scored_of(spark, sf_dir, "events")))


@query("A8_portfolio_summary")
def q_portfolio(spark, sf_dir):
    stats = PF.loss_stats(losses_of(spark, sf_dir, "orders"))
    metrics = ME.binary_metrics(metric_fixture(spark, sf_dir), "churn", "p")
    return out(SU.portfolio_summary(_scored(spark, sf_dir), stats, metrics))


@query("A9_header_kpis")
def q_header(spark, sf_dir):
    return out(SU.header_kpis(_scored(spark, sf_dir)))


@query("A10_decision_counts")
def q_decision_counts(spark, sf_dir):
    return SU.decision_counts(_scored(spark, sf_dir))


@query("A10_decision_counts_events")
def q_decision_counts_events(spark, sf_dir):
    return SU.decision_counts(scored_of(spark, sf_dir, "events"))


@query("A11_roi_by_decision")
def q_roi_by_decision(spark, sf_dir):
    return out(SU.roi_by_decision(_scored(spark, sf_dir)))


@query("A12_probability_histogram")
def q_histogram(spark, sf_dir):
    return out(SU.probability_histogram(_scored(spark, sf_dir)))


@query("A13_value_risk_quadrants")
def q_quadrants(spark, sf_dir):
    return out(SU.value_risk_quadrants(_scored(spark, sf_dir)))


@query("A14_feature_medians")
def q_medians(spark, sf_dir):
    return out(SU.feature_medians(_scored(spark, sf_dir)))


# ---------------------------------------------------------------- filters, rows

@query("P7_filter_customers")
def q_filter(spark, sf_dir):
    return out(SU.filter_customers(_scored(spark, sf_dir), 0.35, 0.9, "Champions", "All"))


@query("P8_search_customers")
def q_search(spark, sf_dir):
    return out(SU.search_customers(_scored(spark, sf_dir), "^1.*7$", "High Risk"))


@query("P9_lookup_customer")
def q_lookup(spark, sf_dir):
    return out(SU.lookup_customer(_scored(spark, sf_dir), " 767 "))


@query("P8_gram_search")
def q_gram_search(spark, sf_dir):
    """Search by part of an id through the posting table."""
    from churnscope.operators.lookup import gram_index, search_by_grams
    scored = scored_of(spark, sf_dir, "orders")
    index = _memo(spark, ("gram_index", sf_dir), lambda: gram_index(scored))
    return out(search_by_grams(scored, index, "^1?140"))


@query("P9_key_lookup")
def q_key_lookup(spark, sf_dir):
    """Lookup in the table clustered by id."""
    from churnscope.operators.lookup import key_index, lookup_by_key
    index = _memo(spark, ("key_index", sf_dir), lambda: key_index(scored_of(spark, sf_dir, "orders")))
    return out(lookup_by_key(index, " 140 "))


@query("P10_at_risk")
def q_at_risk(spark, sf_dir):
    return out(SU.at_risk(_scored(spark, sf_dir)).select("customer_id", "risk_tier", "churn_prob"))


@query("P12_select_existing")
def q_select_existing(spark, sf_dir):
    return out(SU.select_existing(_scored(spark, sf_dir), SU.PAGE_COLUMNS + ("not_a_column",)))


@query("P13_C8_display_stress")
def q_display_stress(spark, sf_dir):
    ref = losses_of(spark, sf_dir, "orders").agg(F.avg("loss")).scalar()
    return SU.display_stress(PF.stress_test(_scored(spark, sf_dir), ref))


def order_index_of(spark, sf_dir, source="orders"):
    from churnscope.operators.paging import order_index
    return _memo(spark, ("order_index", sf_dir, source), lambda: order_index(scored_of(spark, sf_dir, source)))


@query("W6_page_customers")
def q_page(spark, sf_dir):
    from churnscope.operators.paging import page_of
    return out(page_of(order_index_of(spark, sf_dir), page=2, limit=20))


@query("W6_page_customers_search")
def q_page_search(spark, sf_dir):
    from churnscope.operators.paging import page_of
    return out(page_of(order_index_of(spark, sf_dir), page=1, limit=10, search="3", tier="Medium Risk"))


@query("W6_deep_page")
def q_deep_page(spark, sf_dir):
    """A page far behind the first: the last whole one of the table's size."""
    from churnscope.operators.paging import page_of
    index = order_index_of(spark, sf_dir)
    return out(page_of(index, page=max(1, index.count() // 7), limit=7))


@query("W8_segments")
def q_segments(spark, sf_dir):
    return SU.segments(_scored(spark, sf_dir))


@query("W9_sample_at_risk")
def q_sample(spark, sf_dir):
    return out(SU.sample_at_risk(_scored(spark, sf_dir), 42).select("customer_id", "risk_tier", "churn_prob"))


@query("W10_example_high_risk")
def q_example(spark, sf_dir):
    return out(SU.example_high_risk(_scored(spark, sf_dir)).select("customer_id", "churn_prob"))


@query("W11_preview")
def q_preview(spark, sf_dir):
    return out(SU.preview(cust_of(spark, sf_dir, "orders")))


@query("S5_export_view")
def q_export(spark, sf_dir):
    return out(SU.export_view(SU.filter_customers(_scored(spark, sf_dir), 0.2, 1.0)))


# ---------------------------------------------------------------- split and metrics

from churnscope.functions.random import key32, uniform  # noqa: E402


def split_of(spark, sf_dir, source="orders"):
    """Customers with the train/test split, written once per session."""
    from churnscope.plans.model import split_flag
    return _memo(spark, ("split", sf_dir, source), lambda: split_flag(cust_of(spark, sf_dir, source), DEFAULT))


def metric_fixture(spark, sf_dir, source="orders"):
    """(customer_id, churn, p, is_test): a deterministic noisy score with ties
    (steps of 0.01) for checking ranking metrics, on the M3 test split."""
    from churnscope.plans.model import split_flag
    s = scored_of(spark, sf_dir, source)
    u = uniform(key32("customer_id", F.lit(C.RANDOM_STATE)), F.lit(1))
    p = F.floor((F.col("churn_prob") + u) * 50).cast("double") / 100.0
    return split_flag(s.select("customer_id", "churn", p.alias("p"))).filter(F.col("is_test"))


@query("M3_split")
def q_split(spark, sf_dir):
    return split_of(spark, sf_dir).select("customer_id", "churn", "is_test")


@query("M9_folds")
def q_folds(spark, sf_dir):
    """The stratified folds of the cross-validation."""
    from churnscope.plans import model as M
    return M.fold_column(cust_of(spark, sf_dir).select("customer_id", "churn"), DEFAULT.cv_folds, M.CV_STREAM, DEFAULT)


@query("M10_binary_metrics")
def q_metrics(spark, sf_dir):
    return out(ME.binary_metrics(metric_fixture(spark, sf_dir), "churn", "p"))


@query("M10_binary_metrics_events")
def q_metrics_events(spark, sf_dir):
    return out(ME.binary_metrics(metric_fixture(spark, sf_dir, "events"), "churn", "p"))


@query("M11_class_report")
def q_class_report(spark, sf_dir):
    return out(ME.class_report(metric_fixture(spark, sf_dir), "churn", "p"))


# ---------------------------------------------------------------- models

def model_of(spark, sf_dir, source="orders", begun=None):
    """Calibrated ensemble trained on the non-test customers; ``begun`` is called when its fits begin."""
    from churnscope.plans.model import fit_calibrated
    k = (app_id(spark), "model", sf_dir, source)
    if k not in _TABLES:
        _TABLES[k] = fit_calibrated(split_of(spark, sf_dir, source).filter(~F.col("is_test")), QUERY, begun=begun)
    return _TABLES[k]


def cv_of(spark, sf_dir, source="orders"):
    """(fold, auc) of the cross-validation, written once per session."""
    from churnscope.plans import model as M
    return _memo(spark, ("cv", sf_dir, source), lambda: M.cross_validate(cust_of(spark, sf_dir, source), QUERY))


def model_scored_of(spark, sf_dir, source="orders"):
    """Risk score table on the model probability and K-means segments."""
    def build():
        scored = model_of(spark, sf_dir, source).transform(segments_of(spark, sf_dir, source))  # segments, tiers: DEFAULT
        test = split_of(spark, sf_dir, source).select("customer_id", "is_test")
        return SC.score_table(scored, DEFAULT).join(test, "customer_id")
    return _memo(spark, ("model_scored", sf_dir, source), build)


def segments_of(spark, sf_dir, source="orders"):
    """Customers with their K-means segments; needs no churn model."""
    from churnscope.plans.segments import segment
    return _memo(spark, ("segments", sf_dir, source), lambda: segment(cust_of(spark, sf_dir, source), DEFAULT))


@query("M2_kmeans_segments")
def q_kmeans(spark, sf_dir):
    return segments_of(spark, sf_dir).select("customer_id", "segment_id", "segment")


@query("M2_segment_checks")
def q_kmeans_checks(spark, sf_dir):
    """What holds for any best K-means: every customer in one of the named segments, names in the order of mean CLV."""
    rank = F.array_position(F.array(*map(F.lit, C.SEGMENT_LABELS)), F.col("segment"))
    means = segments_of(spark, sf_dir).groupBy("segment_id", rank.alias("rank")).agg(F.avg("clv").alias("m"), F.count("*").alias("n"))
    other = means.select(F.col("rank").alias("r2"), F.col("m").alias("m2"))  # a row a segment
    wrong = means.join(F.broadcast(other), (F.col("rank") < F.col("r2")) & (F.col("m") < F.col("m2"))).agg(F.count("*")).scalar()
    return means.agg(F.sum("n").alias("customers"), F.countDistinct("segment_id").alias("segments"), F.sum((F.col("rank") == 0).cast("long")).alias("unnamed"), F.first(wrong).alias("out_of_order"))


@query("M2_A3_segment_summary_kmeans")
def q_kmeans_summary(spark, sf_dir):
    """Figures by K-means segment; tiers and losses take the fixture probability, so no churn model is needed."""
    cust = segments_of(spark, sf_dir)
    t = FE.churn_threshold(cust_of(spark, sf_dir))
    return out(SU.segment_summary(SC.score_table(SC.fixture_probability(cust, t))))


@query(f"M12_model_scores_{QUERY_ROUNDS}_rounds")
def q_model_scores(spark, sf_dir):
    return out(model_scored_of(spark, sf_dir).select("customer_id", "churn", "churn_prob", "risk_tier",
                                                     "decision", "is_test"))


def _broken(scored):
    """Whether a scored row contradicts its own probability: range, tier, loss, decision."""
    from churnscope.functions.scalar import decision, risk_tier
    p = F.col("churn_prob")
    good = ((p >= 0) & (p <= 1) & (F.col("risk_tier") == risk_tier("churn_prob", DEFAULT))
            & (F.abs(F.col("expected_loss") - p * F.col("clv")) <= 0.01) & (F.col("decision") == decision(p, F.col("net_roi"), DEFAULT)))
    return ~F.coalesce(good, F.lit(False))


@query(f"M12_model_checks_{QUERY_ROUNDS}_rounds")
def q_model_checks(spark, sf_dir):
    """Every customer scored once, with the split it was trained on, and nothing that contradicts its probability."""
    s = model_scored_of(spark, sf_dir)
    return s.select("customer_id", "churn", "is_test", _broken(s).alias("broken"))


@query(f"M8_M10_model_metrics_{QUERY_ROUNDS}_rounds")
def q_model_metrics(spark, sf_dir):
    from churnscope.plans.model import model_metrics
    s = model_scored_of(spark, sf_dir).filter(F.col("is_test"))
    return out(model_metrics(s, cv_of(spark, sf_dir)))


@query(f"M11_model_class_report_{QUERY_ROUNDS}_rounds")
def q_model_class_report(spark, sf_dir):
    s = model_scored_of(spark, sf_dir).filter(F.col("is_test"))
    return out(ME.class_report(s, "churn", "churn_prob"))


@query(f"M9_cross_validate_{QUERY_ROUNDS}_rounds")
def q_cv(spark, sf_dir):
    return out(cv_of(spark, sf_dir))


@query(f"M9_cross_validate_checks_{QUERY_ROUNDS}_rounds")
def q_cv_checks(spark, sf_dir):
    """Fold sizes by class, and whether each fold's AUC is better than chance."""
    folds = q_folds(spark, sf_dir).groupBy("fold").agg(F.count("*").alias("customers"), F.sum("churn").cast("bigint").alias("churned"))
    return folds.join(cv_of(spark, sf_dir), "fold").select("fold", "customers", "churned", (F.col("auc") > 0.5).alias("better"))


# ---------------------------------------------------------------- what-if

@query("M14_whatif_features")
def q_whatif_features(spark, sf_dir):
    from churnscope.plans.whatif import requests_from_customers, whatif_features
    cust = cust_of(spark, sf_dir, "orders")
    return out(whatif_features(requests_from_customers(cust), cust))


@query(f"M14_whatif_scores_{QUERY_ROUNDS}_rounds")
def q_whatif_scores(spark, sf_dir):
    from churnscope.plans.whatif import requests_from_customers, whatif_scores
    cust = cust_of(spark, sf_dir, "orders")
    return out(whatif_scores(requests_from_customers(cust), cust, model_of(spark, sf_dir, "orders"), DEFAULT))


@query(f"M14_whatif_checks_{QUERY_ROUNDS}_rounds")
def q_whatif_checks(spark, sf_dir):
    """The parts of a what-if answer that follow from the request, and whether its tier fits its probability."""
    from churnscope.functions.scalar import risk_tier
    s = q_whatif_scores(spark, sf_dir)
    p = F.col("churn_probability")
    near = [risk_tier("p_low", DEFAULT), risk_tier("p_high", DEFAULT)]  # the probability is rounded to 0.1 percent
    s = s.withColumn("p_low", (p - 0.05) / 100).withColumn("p_high", (p + 0.05) / 100)
    asked = cust_of(spark, sf_dir).select(F.col("customer_id").alias("request_id"), (F.col("monetary") * C.AVG_PROFIT_MARGIN).alias("value"))
    s = s.join(asked, "request_id")
    roi = F.col("value") * (1 - C.DISCOUNT_RATE) - C.RETENTION_COST_PER_CUSTOMER
    cents = (F.abs(F.col("clv") - F.col("value")) < 0.0051) & (F.abs(F.col("net_roi") - roi) < 0.0051)  # rounded to cents
    return s.select("request_id", cents.alias("values_fit"), F.col("risk_tier").isin(*near).alias("tier_fits"))


# ---------------------------------------------------------------- explanations

def explainer_of(spark, sf_dir, source="orders"):
    """(scaler, boosted trees) fitted on the non-test customers, once per session."""
    from churnscope.plans import explain as X
    k = (app_id(spark), "explainer", sf_dir, source)
    if k not in _TABLES:
        _TABLES[k] = X.fit_explainer(split_of(spark, sf_dir, source).filter(~F.col("is_test")), DEFAULT)
    return _TABLES[k]


def contributions_of(spark, sf_dir, source="orders", customers=None):
    """Contributions of the boosted-tree explainer for the test customers, or those of them that are named."""
    from churnscope.plans import explain as X
    cust = split_of(spark, sf_dir, source)
    train, test = cust.filter(~F.col("is_test")), cust.filter(F.col("is_test"))
    if customers is not None:
        test = test.join(customers, "customer_id", "left_semi")
    scaler, gbt = explainer_of(spark, sf_dir, source)
    return X.contributions(test, scaler, gbt, X.background(train, scaler, DEFAULT))


def explained_of(spark, sf_dir, source="orders"):
    return _memo(spark, ("contrib", sf_dir, source), lambda: contributions_of(spark, sf_dir, source))


@query("M13_contributions")
def q_contrib(spark, sf_dir):
    return out(explained_of(spark, sf_dir))


@query("A18_global_importance")
def q_importance(spark, sf_dir):
    from churnscope.plans.explain import global_importance
    return out(global_importance(explained_of(spark, sf_dir)))


@query("W7_top_contributions")
def q_top_contrib(spark, sf_dir):
    from churnscope.plans.explain import top_contributions
    return out(top_contributions(explained_of(spark, sf_dir)))


@query(f"W10_example_explanation_{QUERY_ROUNDS}_rounds")
def q_example_explanation(spark, sf_dir):
    from churnscope.plans.explain import top_contributions
    s = model_scored_of(spark, sf_dir).filter(F.col("is_test"))
    ex = write_table(SU.example_high_risk(s).select("customer_id"), "example")  # one customer, and only that one is explained
    return out(top_contributions(contributions_of(spark, sf_dir, customers=ex)))


@query("M13_contribution_checks")
def q_contrib_checks(spark, sf_dir):
    """Sixteen contributions for each test customer, which with the base value add up to the model's margin."""
    from churnscope.plans import explain as X
    cust = split_of(spark, sf_dir)
    scaler, gbt = explainer_of(spark, sf_dir)
    base = X.base_value(gbt, spark, X.background(cust.filter(~F.col("is_test")), scaler, DEFAULT))
    sums = explained_of(spark, sf_dir).groupBy("customer_id").agg(F.sum("phi").alias("phi"), F.count("*").alias("n"))
    both = sums.join(X.margins(cust.filter(F.col("is_test")), scaler, gbt), "customer_id")
    return both.select("customer_id", "n", (F.abs(F.col("phi") + F.lit(base) - F.col("margin")) <= 1e-6).alias("additive"))


@query("W7_top_checks")
def q_top_checks(spark, sf_dir):
    """Eight contributions for each test customer, the largest ones in order."""
    each = q_top_contrib(spark, sf_dir).groupBy("customer_id").agg(F.count("*").alias("n"), F.countDistinct("feature").alias("features"))
    return each.select("customer_id", "n", "features")


@query("A18_importance_checks")
def q_importance_checks(spark, sf_dir):
    """Every model feature once, no negative importance."""
    g = q_importance(spark, sf_dir)
    value = [c for c, t in g.dtypes if t == "double"][0]
    return g.select("feature", (F.col(value) >= 0).alias("not_negative"))


# ---------------------------------------------------------------- sources and sinks (S1-S4), pipeline

def _scratch(spark, name):
    import uuid
    from churnscope.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


@query("S1_read_transactions_csv")
def q_csv(spark, sf_dir):
    """Orders adapter lines exported as a CSV with the original header names
    and text dates, read back through the CSV source and cleaned."""
    from churnscope.sources.transactions import CSV_HEADER, read_transactions
    raw = ADAPTERS["orders"](spark, sf_dir)
    path = _scratch(spark, "transactions_csv")
    inv = {v: k for k, v in CSV_HEADER.items()}
    (raw.withColumn("invoice_date", F.date_format("invoice_date", "yyyy-MM-dd HH:mm:ss"))
        .withColumnsRenamed({c: inv[c] for c in raw.columns})
        .write.option("header", True).csv(path))
    tx = clean(read_transactions(spark, path, "csv"))
    return out(tx.withColumn("price", F.col("price").cast("double"))
                 .withColumn("amount", F.col("amount").cast("double")))


@query("S1_quoted_line_breaks")
def q_csv_breaks(spark, sf_dir):
    """Orders lines written as CSV with line breaks, quotes and commas inside a quoted field, read back and cleaned."""
    from churnscope.sources.transactions import CSV_HEADER, read_transactions
    raw = ADAPTERS["orders"](spark, sf_dir)
    path = _scratch(spark, "transactions_breaks")
    inv = {v: k for k, v in CSV_HEADER.items()}
    odd = F.concat(F.col("country"), F.lit(',\n"of '), F.col("stock_code"), F.lit('"\nend'))
    (raw.withColumn("country", F.when(F.col("stock_code").cast("long") % 3 == 0, odd).otherwise(F.col("country")))
        .withColumn("invoice_date", F.date_format("invoice_date", "yyyy-MM-dd HH:mm:ss"))
        .withColumnsRenamed({c: inv[c] for c in raw.columns})
        .write.option("header", True).option("escape", '"').csv(path))
    tx = clean(read_transactions(spark, path, "csv"))
    return out(tx.groupBy("stock_code").agg(F.count("*").alias("lines"), F.sum("amount").cast("double").alias("amount"), F.max(F.length("country")).alias("longest"),
                                            F.sum((F.length("country") - F.length(F.regexp_replace("country", "\n", ""))).cast("long")).alias("breaks")))


@query("S2_S3_results_roundtrip")
def q_results(spark, sf_dir):
    """Score table written by the result sink and read back by the result source."""
    from churnscope.sources.results import read_results, write_results
    path = _scratch(spark, "results")
    write_results({"customer_risk_scores": scored_of(spark, sf_dir, "orders")}, path)
    return out(read_results(spark, path, ["customer_risk_scores"])["customer_risk_scores"])


@query(f"S4_model_roundtrip_scores_{QUERY_ROUNDS}_rounds")
def q_model_roundtrip(spark, sf_dir):
    """Scores of a saved and reloaded model next to the in-memory model's."""
    from churnscope.sources.results import load_model, save_model
    m = model_of(spark, sf_dir, "orders")
    path = _scratch(spark, "model")
    save_model(m, path)
    m2 = load_model(path)
    cust = cust_of(spark, sf_dir, "orders")
    a = m.transform(cust).select("customer_id", "churn_prob")
    b = m2.transform(cust).select("customer_id", F.col("churn_prob").alias("churn_prob_loaded"))
    return a.join(b, "customer_id").select("customer_id", F.col("churn_prob").eqNullSafe(F.col("churn_prob_loaded")).alias("same"))


@query(f"M15_pipeline_scores_{QUERY_ROUNDS}_rounds")
def q_pipeline(spark, sf_dir):
    """The whole pipeline on the orders adapter, all its results written; the
    fits are the ones that the other model queries use."""
    from threading import Event

    from churnscope.plans.model import Underway, _pool
    from churnscope.plans.pipeline import run_pipeline
    split_of(spark, sf_dir)  # what all of them read, stored once
    begun = Event()
    with _pool(3) as ex:  # the longest chain, the explainer's, runs beside everything else
        model = ex.submit(model_of, spark, sf_dir, "orders", begun.set)
        model.add_done_callback(lambda _: begun.set())
        begun.wait()
        if model.done():
            model.result()  # where it failed, no other fit is begun
        explainer = ex.submit(explainer_of, spark, sf_dir)
        cv = ex.submit(lambda: (model.result(), cv_of(spark, sf_dir))[1])
        fits = Underway(model=model, cv=cv, explainer=explainer)
        res = run_pipeline(spark, ADAPTERS["orders"](spark, sf_dir), QUERY, out_dir=_scratch(spark, "pipeline"), fits=fits)
    return out(res["customer_risk_scores"])


@query("M15_baseline_pipeline")
def q_baseline_pipeline(spark, sf_dir):
    from churnscope.plans.pipeline import run_baseline
    res = run_baseline(spark, ADAPTERS["orders"](spark, sf_dir), DEFAULT)
    return out(res["baseline_decisions"])


# ---------------------------------------------------------------- streaming

@query("ST_stream_ingest_events")
def q_stream_ingest(spark, sf_dir):
    """Event rows streamed through cleaning into an append-only table, read back."""
    from churnscope.streaming.ingest import events_stream, ingest
    path = _scratch(spark, "stream_tx")
    q = ingest(events_stream(spark, sf_dir), path, path + "_checkpoint")
    q.awaitTermination()
    tx = spark.read.parquet(path)
    return out(tx.withColumn("price", F.col("price").cast("double"))
                 .withColumn("amount", F.col("amount").cast("double")))


# ---------------------------------------------------------------- single features

def _feature_query(fid, col, fn, source):
    def q(spark, sf_dir):
        return out(fn(tx_of(spark, sf_dir, source)))
    q.__name__ = f"q_{fid}_{col}"
    return q


for _fid, (_col, _fn) in FE.SINGLE_FEATURES.items():
    query(f"{_fid}_{_col}")(_feature_query(_fid, _col, _fn, "orders"))
query("F15_avg_days_between_purchases_events")(
    _feature_query("F15", "avg_days_between_purchases", FE.avg_days_between, "events"))
query("F7_geo_spread_events")(_feature_query("F7", "geo_spread", FE.geo_spread, "events"))
query("F17_baseline_trend")(_feature_query("F17", "trend", FE.baseline_trend_of, "orders"))


@query("W2_monthly_pct_change")
def q_pct_change(spark, sf_dir):
    return out(FE.monthly_pct_change(FE.monthly_spend(tx_of(spark, sf_dir, "orders"))))


@query("M15_baseline_checks")
def q_baseline_checks(spark, sf_dir):
    """The baseline table's features, values and split, and whether its decisions follow from its probabilities."""
    from churnscope.functions.scalar import baseline_decision
    b = q_baseline_pipeline(spark, sf_dir)
    good = F.col("churn_prob").between(0, 1) & (F.col("decision") == baseline_decision("churn_prob", "roi")) & (F.abs(F.col("expected_loss") - F.col("churn_prob") * F.col("clv")) <= 0.01 + 1e-6 * F.col("clv"))
    b = b.withColumn("good", good)
    return b.select("customer_id", "frequency", "monetary", "churn", "is_test", "clv", "retention_gain", "roi", "good")
