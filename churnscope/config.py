"""Business parameters and model settings as one frozen value.

Every operator takes a ``RiskConfig`` (or uses ``DEFAULT``) instead of module
globals, so a job can run several configurations side by side.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# These must equal the original application's parameters for
# results to agree (thresholds, margins, labels, scenarios, model sizes).
# ---------------------------------------------------------------------------
RETENTION_COST_PER_CUSTOMER = 500.0
AVG_PROFIT_MARGIN = 0.25
DISCOUNT_RATE = 0.10
CHURN_WINDOW_DAYS = 90

TIER_CRITICAL = 0.75
TIER_HIGH = 0.55
TIER_MEDIUM = 0.35
TIER_LOW = 0.20

# Tier names, lowest risk first (the order used by every tier report).
TIER_ORDER = ("Safe", "Low Risk", "Medium Risk", "High Risk", "Critical Risk")
AT_RISK_TIERS = ("Critical Risk", "High Risk")

# Segment labels in CLV-rank order (rank 0 = highest mean CLV).
SEGMENT_LABELS = ("Champions", "Loyal Customers", "At-Risk", "Hibernating", "Lost")

# Decision labels of the five-way policy (plain ASCII) and of the older
# four-way baseline policy.
DECISION_URGENT = "URGENT RETENTION"
DECISION_HIGH = "HIGH PRIORITY"
DECISION_MEDIUM = "MEDIUM PRIORITY"
DECISION_MONITOR = "MONITOR ONLY"
DECISION_DO_NOT = "DO NOT RETAIN"
BASELINE_HIGH = "HIGH PRIORITY RETENTION"
BASELINE_MEDIUM = "MEDIUM PRIORITY RETENTION"
BASELINE_NONE = "NO ACTION"
BASELINE_DO_NOT = "DO NOT RETAIN"
BASELINE_HIGH_P = 0.7
BASELINE_MEDIUM_P = 0.4

# Stress scenarios: (name, churn multiplier, CLV multiplier).
STRESS_SCENARIOS = (
    ("Baseline", 1.0, 1.0),
    ("Mild Recession", 1.25, 0.85),
    ("Market Shock", 1.55, 0.65),
    ("Severe Crisis", 1.90, 0.45),
)

MC_SIMULATIONS = 10000
MC_CONFIDENCE = 0.95
RANDOM_STATE = 42
TEST_SIZE = 0.20
CV_FOLDS = 5
N_SEGMENTS = 5

# Auto-calibrated churn window: used when the fixed window gives a churn rate
# below 5 % or above 95 %; the threshold is then the 70th recency percentile.
CHURN_RATE_LOW = 0.05
CHURN_RATE_HIGH = 0.95
CHURN_QUANTILE = 0.70

# Soft-voting weights of the four-model ensemble; cross-validation uses the first three.
ENSEMBLE_WEIGHTS = (3.0, 3.0, 2.0, 1.0)

# What-if derived values: spend in the last 30 days and in days 30-90 as
# shares of the requested monetary value.
WHATIF_SPEND_LAST30_SHARE = 0.05
WHATIF_SPEND_30_90_SHARE = 0.15

# Display names of the model metrics and of the stress table columns.
METRIC_DISPLAY_NAMES = (
    ("auc", "ROC-AUC"), ("avg_precision", "Avg Precision"), ("f1", "F1 Score"),
    ("brier_score", "Brier Score"), ("cv_auc_mean", "CV AUC Mean"), ("cv_auc_std", "CV AUC Std"),
)
STRESS_DISPLAY_NAMES = ("Scenario", "Churn Shock", "CLV Impact", "Expected Loss",
                        "High Risk Customers", "Loss vs Baseline")
# Value/risk quadrant labels: high value + high risk, high value + low risk,
# low value + high risk, low value + low risk.
QUADRANT_LABELS = ("URGENT", "CHAMPION", "BORDERLINE", "MONITOR")
# Labels of the tier cut lines on the probability histogram (Low..Critical).
TIER_CUT_LABELS = ("Low", "Medium", "High", "Critical")
# Class names of the classification report (label 0, label 1).
CLASS_NAMES = ("Active", "Churned")
# Column-name prefix of the wide cohort table.
COHORT_COLUMN_PREFIX = "Month "

# The sixteen model features, in model order.
FEATURE_COLS = (
    "frequency", "monetary", "avg_order_value", "product_diversity",
    "total_quantity", "geo_spread", "purchase_volatility", "avg_days_between_purchases",
    "spending_trend", "revenue_concentration", "recency_acceleration",
    "weekend_ratio", "tenure", "spend_last30", "spend_30_90", "clv",
)
# Features used for K-means segmentation.
SEGMENT_FEATURES = ("recency", "frequency", "monetary", "avg_order_value", "tenure")


@dataclass(frozen=True)
class BoostParams:
    max_iter: int = 300
    max_depth: int = 5
    step_size: float = 0.05
    subsampling_rate: float = 0.8
    feature_subset: str = "0.8"


@dataclass(frozen=True)
class ForestParams:
    num_trees: int = 200
    max_depth: int = 6
    min_instances_per_node: int = 5


@dataclass(frozen=True)
class RiskConfig:
    retention_cost: float = RETENTION_COST_PER_CUSTOMER
    margin: float = AVG_PROFIT_MARGIN
    discount: float = DISCOUNT_RATE
    churn_window_days: int = CHURN_WINDOW_DAYS
    tier_critical: float = TIER_CRITICAL
    tier_high: float = TIER_HIGH
    tier_medium: float = TIER_MEDIUM
    tier_low: float = TIER_LOW
    scenarios: tuple = STRESS_SCENARIOS
    mc_simulations: int = MC_SIMULATIONS
    mc_confidence: float = MC_CONFIDENCE
    seed: int = RANDOM_STATE
    test_size: float = TEST_SIZE
    cv_folds: int = CV_FOLDS
    n_segments: int = N_SEGMENTS
    kmeans_starts: int = 20
    boost: BoostParams = field(default_factory=BoostParams)
    forest: ForestParams = field(default_factory=ForestParams)
    # The older single-model pipeline: 200 rounds, depth 5, rate 0.1, no subsampling.
    baseline_boost: BoostParams = field(default_factory=lambda: BoostParams(
        max_iter=200, max_depth=5, step_size=0.1, subsampling_rate=1.0, feature_subset="all"))
    logistic_c: float = 0.5
    logistic_max_iter: int = 1000
    calibration_folds: int = 3


DEFAULT = RiskConfig()

# Sizes of the registered queries on the churn ensemble: everything as above but
# the boosting rounds, which their ids name (300 rounds take minutes, see README).
QUERY_ROUNDS = 40
QUERY = RiskConfig(boost=BoostParams(max_iter=QUERY_ROUNDS))

# Small training sizes for tests (the full sizes above take minutes per fit;
# see README).
FAST = RiskConfig(
    boost=BoostParams(max_iter=10),
    baseline_boost=BoostParams(max_iter=10, max_depth=5, step_size=0.1, subsampling_rate=1.0,
                               feature_subset="all"),
    forest=ForestParams(num_trees=20),
    logistic_max_iter=100,
    kmeans_starts=3,
    mc_simulations=MC_SIMULATIONS,
)
