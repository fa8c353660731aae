"""Portfolio loss distribution, VaR/CVaR, stress scenarios.

R1 runs n_customers x n_sims Bernoulli draws, the work the Monte Carlo
defines. Customers stay partitioned as they are; each task generates the
simulation indices of its own customers inside the generated code
(``explode(sequence)``), draws with a portable hash and partially sums the
loss per simulation, so only (task x simulations) partial sums are shuffled.
No customer x simulation row is ever written or exchanged.

R3 evaluates all scenarios in one aggregation pass (one conditional sum and
count per scenario), then unpivots the few scenario rows with ``stack``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.config import DEFAULT, RiskConfig
from churnscope.functions.random import key32, with_uniform
from churnscope.functions.scalar import clip


def loss_distribution(scored: DataFrame, n_sims: int = None, seed: int = None,
                      cfg: RiskConfig = DEFAULT, p: str = "churn_prob") -> DataFrame:
    """(sim, loss) where loss = sum of CLV over customers whose draw < p."""
    n_sims = cfg.mc_simulations if n_sims is None else n_sims
    seed = cfg.seed if seed is None else seed
    # The customer table is small in bytes but each row expands n_sims times:
    # spread it over the configured parallelism first (hash of the key, so a
    # retried task sees the same rows).
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = scored.select(
        key32("customer_id", F.lit(seed)).alias("k"),
        F.col(p).cast("double").alias("p"),
        F.col("clv").cast("double").alias("clv"),
    ).repartition(parts, "k")
    draws = base.select("k", "p", "clv",
                        F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1))).alias("sim"))
    draws = with_uniform(draws, "k", "sim", "u")
    hit = F.when(F.col("u") < F.col("p"), F.col("clv")).otherwise(F.lit(0.0))
    losses = draws.groupBy("sim").agg(F.sum(hit).alias("loss"))
    return losses.select(F.col("sim").cast("bigint").alias("sim"), "loss")


def loss_stats(losses: DataFrame, conf: float = None, cfg: RiskConfig = DEFAULT) -> DataFrame:
    """R2: mean, VaR (linear percentile at ``conf``) and CVaR (mean of losses
    at or above VaR), rounded half-even to 2 places.

    The loss table has one row per simulation (a parameter, not data size).
    """
    conf = cfg.mc_confidence if conf is None else conf
    var = losses.agg(F.percentile("loss", F.lit(conf))).scalar()
    return losses.agg(
        F.bround(F.avg("loss"), 2).alias("mc_mean_loss"),
        F.bround(F.first(var), 2).alias("var_95"),
        F.bround(F.avg(F.when(F.col("loss") >= var, F.col("loss"))), 2).alias("cvar_95"),
        F.count(F.lit(1)).cast("int").alias("mc_simulations"),
    )


def stress_test(scored: DataFrame, ref_loss: Column, cfg: RiskConfig = DEFAULT,
                p: str = "churn_prob") -> DataFrame:
    """Per scenario, expected loss (rounded to units, half-even), customers
    whose shocked probability reaches the High tier, and the loss change
    against ``ref_loss`` (the simulated mean) in percent (1 place)."""
    aggs = []
    for i, (_, cm, vm) in enumerate(cfg.scenarios):
        adj_p = clip(F.col(p) * F.lit(cm), 0.0, 1.0)
        aggs.append(F.sum(adj_p * F.col("clv") * F.lit(vm)).alias(f"loss_{i}"))
        aggs.append(F.sum(F.when(adj_p >= cfg.tier_high, 1).otherwise(0)).cast("bigint").alias(f"hr_{i}"))
    wide = scored.agg(*aggs)
    parts = []
    for i, (name, cm, vm) in enumerate(cfg.scenarios):
        parts += [f"'{name}'", f"CAST({cm} AS DOUBLE)", f"CAST({vm} AS DOUBLE)", f"loss_{i}", f"hr_{i}"]
    long = wide.selectExpr(
        f"stack({len(cfg.scenarios)}, {', '.join(parts)}) AS "
        "(scenario, churn_multiplier, clv_multiplier, loss, high_risk_customers)")
    return long.select(
        "scenario", "churn_multiplier", "clv_multiplier",
        F.bround(F.col("loss"), 0).alias("expected_loss"),
        "high_risk_customers",
        F.bround((F.try_divide(F.col("loss"), ref_loss) - 1) * 100, 1).alias("loss_delta_pct"),
    )
