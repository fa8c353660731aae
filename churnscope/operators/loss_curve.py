"""R2 without draws: the portfolio loss distribution from its characteristic function.

The loss is a sum of independent terms, CLV with the churn probability and 0
otherwise, so the log of its characteristic function at a frequency is a sum
over customers. One pass adds it up at ``FREQUENCIES`` fixed frequencies (each
task spreads its own customers over them in generated code and adds up before
the shuffle, as the simulation does with its draws); an inverse transform of
that short vector gives the distribution on a grid.

Window: the grid covers [lo, hi] outside of which the loss lies with a
probability of at most ``EPSILON`` on either side. The ends come from
exponential bounds, log E exp(x L) - x l over fixed tilts x, summed in one pass,
and from the range of the loss; so they hold for one giant customer as well as
for a billion small ones.

Smoothing: a loss of few customers has atoms, which a bounded number of
frequencies cannot resolve. So the curve is that of the loss plus a normal error
of mean 0 and a standard deviation of two grid steps; at the highest frequency
its factor is below 3e-9, so nothing is cut off. A quantile of the curve lies
within 12 grid steps (``grid_error``: six standard deviations of the error) of
one of the loss at a level that differs by 1e-8 at most. The mean does not
change and the known variance of the error is taken off again.

Null probabilities or values add nothing; probabilities are held to [0, 1].
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.config import DEFAULT, RiskConfig
from churnscope.session import write_table

#: Positive frequencies; the grid has twice as many points.
FREQUENCIES = 4096
#: Probability outside each end of the window, at most.
EPSILON = 1e-12
#: Grid steps of the smoothing error's standard deviation, and of the stated error.
SMOOTHING, GRID_ERROR = 2.0, 12.0
#: Tilts of the window's bounds, in standard deviations of the loss.
TILTS = [2.0 ** (k / 2) for k in range(-8, 27)]


def terms(scored: DataFrame, p: str = "churn_prob", clv: str = "clv") -> DataFrame:
    """(p, c) of the customers that can lose anything."""
    q = F.greatest(F.least(F.coalesce(F.col(p).cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return scored.select(q.alias("p"), F.coalesce(F.col(clv).cast("double"), F.lit(0.0)).alias("c")).filter("p > 0 and c <> 0")


def spread_out(rows: DataFrame) -> DataFrame:
    """Rows small in bytes that each expand a thousandfold, over the session's parallelism."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def moments(rows: DataFrame) -> dict:
    """Mean, variance and range of the loss."""
    open_ = F.when(F.col("p") < 1, F.col("p"))
    r = rows.agg(
        F.sum(F.col("p") * F.col("c")).alias("mean"),
        F.sum(F.col("p") * (1 - F.col("p")) * F.col("c") * F.col("c")).alias("var"),
        F.sum(F.when(open_.isNull(), F.col("c")).otherwise(F.least("c", F.lit(0.0)))).alias("least"),
        F.sum(F.when(open_.isNull(), F.col("c")).otherwise(F.greatest("c", F.lit(0.0)))).alias("most"),
    ).first()
    return {k: float(r[k] or 0.0) for k in ("mean", "var", "least", "most")}


def window(rows: DataFrame, m: dict) -> tuple[float, float]:
    """Ends of the loss minus its mean: the best of the exponential bounds, and the range."""
    sd = math.sqrt(m["var"])
    tilts = [sign * t / sd for t in TILTS for sign in (1, -1)]
    each = rows.filter("p < 1").select("p", "c", F.explode(F.array(*(F.lit(t) for t in tilts))).alias("x"))
    stay, go = F.log1p(-F.col("p")), F.log(F.col("p")) + F.col("x") * F.col("c")
    log_mean = F.greatest(stay, go) + F.log1p(F.exp(-F.abs(stay - go))) - F.col("x") * F.col("p") * F.col("c")
    bounds = {r["x"]: (r["k"] - math.log(EPSILON)) / r["x"] for r in each.groupBy("x").agg(F.sum(log_mean).alias("k")).collect()}
    lo = max([v for x, v in bounds.items() if x < 0 and math.isfinite(v)], default=-math.inf)
    hi = min([v for x, v in bounds.items() if x > 0 and math.isfinite(v)], default=math.inf)
    return max(lo, m["least"] - m["mean"]), min(hi, m["most"] - m["mean"])


def log_characteristic(rows: DataFrame, step: float, frequencies: int) -> DataFrame:
    """(k, re, im): log of the characteristic function of the centred loss at frequency k * step."""
    each = spread_out(rows.filter("p < 1")).select("p", "c", F.explode(F.sequence(F.lit(0), F.lit(frequencies))).alias("k"))
    each = each.withColumn("a", F.col("k") * F.lit(step) * F.col("c"))
    p, a = F.col("p"), F.col("a")
    half = F.sin(a / 2)
    size = F.log1p(-4 * p * (1 - p) * half * half) / 2  # of 1 - 2 p (1 - p) (1 - cos a), without cancellation
    turn = F.atan2(p * F.sin(a), 1 - 2 * p * half * half) - a * p
    return each.groupBy("k").agg(F.sum(size).alias("re"), F.sum(turn).alias("im"))


def loss_curve(scored: DataFrame, p: str = "churn_prob", clv: str = "clv", frequencies: int = FREQUENCIES) -> DataFrame:
    """Stored: (loss, mass, cum, step) of the grid in ascending order; ``cum`` includes the point's own mass.

    One certain value (no customer's loss is open) is one row with step 0."""
    rows = terms(scored, p, clv)
    m = moments(rows)
    if m["var"] <= 0:
        return write_table(scored.sparkSession.range(1).select(F.lit(m["mean"]).alias("loss"), F.lit(1.0).alias("mass"), F.lit(1.0).alias("cum"), F.lit(0.0).alias("step")), "loss-curve")
    lo, hi = window(rows, m)
    points = 2 * frequencies
    width = (hi - lo) / (1 - 2 * 6 * SMOOTHING / points)
    h = width / points
    start = lo - 6 * SMOOTHING * h
    mean = m["mean"]

    def invert(batches):
        found = pd.concat(list(batches)).sort_values("k")  # a row a frequency
        t = 2 * np.pi / width * found["k"].to_numpy()
        value = np.exp(found["re"].to_numpy() + 1j * found["im"].to_numpy() - (t * SMOOTHING * h) ** 2 / 2 - 1j * t * start)
        mass = np.fft.irfft(np.conj(value), points)
        yield pd.DataFrame({"loss": mean + start + h * np.arange(points), "mass": mass, "cum": np.cumsum(mass), "step": h})

    vector = log_characteristic(rows, 2 * math.pi / width, frequencies)
    return write_table(vector.coalesce(1).mapInPandas(invert, "loss double, mass double, cum double, step double"), "loss-curve")


def curve_moments(curve: DataFrame) -> DataFrame:
    """Mean, standard deviation and skewness of the loss, the smoothing error's variance taken off."""
    mean = curve.agg(F.sum(F.col("loss") * F.col("mass"))).scalar()
    d = F.col("loss") - mean
    error = F.max(F.pow(F.col("step") * SMOOTHING, 2))
    sd = F.sqrt(F.greatest(F.sum(d * d * F.col("mass")) - error, F.lit(0.0)))
    return curve.agg(F.first(mean).alias("mean_loss"), sd.alias("sd_loss"), F.try_divide(F.sum(d * d * d * F.col("mass")), sd * sd * sd).alias("skewness"))


def curve_stats(curve: DataFrame, conf: float = None, cfg: RiskConfig = DEFAULT) -> DataFrame:
    """Mean, VaR (quantile at ``conf``), CVaR (mean of the quantiles above it) and the stated error of VaR.

    CVaR's error is at most that of the quantiles it averages."""
    conf = cfg.mc_confidence if conf is None else conf
    at = curve.filter(F.col("cum") >= min(conf, 1 - 1e-9)).agg(F.min(F.struct("cum", "loss", "mass", "step"))).scalar()
    cum, loss, mass, h = (at.getField(c) for c in ("cum", "loss", "mass", "step"))
    share = F.coalesce(F.try_divide(conf - (cum - mass), mass), F.lit(0.0))
    var = loss + h * (share - 0.5)
    above = F.coalesce(F.sum(F.when(F.col("cum") > cum, F.col("loss") * F.col("mass"))), F.lit(0.0))
    tail = above + F.first((cum - conf) * (var + loss + h / 2) / 2)
    return curve.agg(
        F.sum(F.col("loss") * F.col("mass")).alias("mean_loss"),
        F.first(var).alias("var_95"),
        F.when(F.max("step") > 0, tail / (1 - conf)).otherwise(F.max("loss")).alias("cvar_95"),
        (F.max("step") * GRID_ERROR).alias("grid_error"),
    )
