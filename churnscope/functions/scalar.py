"""Scalar column functions (all built-in expressions, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope import config as C
from churnscope.config import DEFAULT, RiskConfig


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def risk_tier(p, cfg: RiskConfig = DEFAULT) -> Column:
    """Tier of a churn probability (thresholds inclusive)."""
    p = _c(p)
    return (F.when(p >= cfg.tier_critical, "Critical Risk")
            .when(p >= cfg.tier_high, "High Risk")
            .when(p >= cfg.tier_medium, "Medium Risk")
            .when(p >= cfg.tier_low, "Low Risk")
            .otherwise("Safe"))


def decision(p, roi, cfg: RiskConfig = DEFAULT) -> Column:
    """Five-way retention decision from probability and net ROI."""
    p, roi = _c(p), _c(roi)
    return (F.when((p >= cfg.tier_critical) & (roi > 0), C.DECISION_URGENT)
            .when((p >= cfg.tier_high) & (roi > 0), C.DECISION_HIGH)
            .when((p >= cfg.tier_medium) & (roi > 0), C.DECISION_MEDIUM)
            .when(p < cfg.tier_medium, C.DECISION_MONITOR)
            .otherwise(C.DECISION_DO_NOT))


def baseline_decision(p, roi) -> Column:
    """C4: the older four-way policy (strict thresholds 0.7 / 0.4)."""
    p, roi = _c(p), _c(roi)
    return (F.when((p > C.BASELINE_HIGH_P) & (roi > 0), C.BASELINE_HIGH)
            .when((p > C.BASELINE_MEDIUM_P) & (roi > 0), C.BASELINE_MEDIUM)
            .when(p <= C.BASELINE_MEDIUM_P, C.BASELINE_NONE)
            .otherwise(C.BASELINE_DO_NOT))


def clip(x, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Clamp into [lo, hi]."""
    return F.greatest(F.least(_c(x), F.lit(hi)), F.lit(lo))


def round_half_even(x, n: int) -> Column:
    """banker's rounding."""
    return F.bround(_c(x), n)


def safe_ratio(num, den) -> Column:
    """Double ratio, null on a zero denominator."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def sum_sq(x) -> Column:
    """Sum of squares aggregate."""
    x = _c(x)
    return F.sum(x * x)


# Display formats -------------------------------------------------------

def fmt_money(x, decimals: int = 0) -> Column:
    """``$1,234`` (comma grouping, HALF_EVEN like Python's format)."""
    return F.concat(F.lit("$"), F.format_number(F.bround(_c(x), decimals), decimals))


def fmt_pct(x, decimals: int = 1, scale: float = 1.0) -> Column:
    """``12.3%`` of ``x * scale``."""
    return F.concat(F.format_string(f"%.{decimals}f", F.bround(_c(x) * scale, decimals)), F.lit("%"))


def fmt_mult(x, decimals: int = 2) -> Column:
    """``×1.25``."""
    return F.concat(F.lit("×"), F.format_string(f"%.{decimals}f", _c(x)))


def fmt_delta(x, decimals: int = 1) -> Column:
    """``+1.2%`` with an explicit sign."""
    return F.concat(F.format_string(f"%+.{decimals}f", _c(x)), F.lit("%"))


# Output normalisation -------------------------------------------------------

def round6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column for stable cross-engine comparison.

    ``floor(x * 10^d + 0.5) / 10^d`` is spelled out so that both engines do
    the same IEEE operations (their built-in ``round`` differ at near-ties);
    ``+ 0.0`` folds -0.0 to 0.0; infinities and NaN pass through.
    """
    out = {}
    scale = float(10 ** digits)
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            x = F.col(f.name).cast("double")
            r = (F.floor(x * scale + 0.5).cast("double") / scale) + F.lit(0.0)
            finite = ~(F.isnan(x) | (F.abs(x) == float("inf")))
            out[f.name] = F.when(finite, r).otherwise(x)
    return df.withColumns(out) if out else df


# Exact aggregates of money-derived doubles ------------------------------------

def exact_sum(x, scale: int = 6) -> Column:
    """Sum of a money-derived double (at most ``scale`` decimals) in exact
    decimal arithmetic, so the total does not depend on summation order."""
    return F.sum(_c(x).cast(f"decimal(38,{scale})")).cast("double")


def exact_avg(x, scale: int = 6) -> Column:
    """Mean via the exact decimal sum divided once by the count."""
    return exact_sum(x, scale) / F.count(_c(x)).cast("double")
