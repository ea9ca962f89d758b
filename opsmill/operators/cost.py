"""Cost analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmill.session import bounded


def token_cost(usage: DataFrame, prices: DataFrame, model: str, tokens: str, key: str, monthly_budget: float) -> DataFrame:
    """Usage x unit price per model (prices is a small literal table, per 1000
    tokens); cost per key and share of the monthly budget."""
    j = usage.join(bounded(prices, 1000), model)
    per = j.groupBy(key).agg(F.sum(F.col(tokens) * F.col("price_per_1k") / 1000.0).alias("cost"))
    return per.withColumn("budget_share", F.col("cost") / monthly_budget)


def tag_allocation(costs: DataFrame, tag, amount: str) -> DataFrame:
    """Cost per tag value; rows without the tag are reported as 'untagged'."""
    t = F.col(tag) if isinstance(tag, str) else tag
    return costs.groupBy(F.coalesce(t, F.lit("untagged")).alias("tag")).agg(
        F.sum(amount).alias("cost"), F.count(F.lit(1)).alias("items")).withColumn("untagged", F.col("tag") == "untagged")


def budget_alerts(costs: DataFrame, key, day: str, amount: str, limit: float, threshold: float = 0.8) -> DataFrame:
    """Per (key, month) actual cost against the limit; alert over threshold x limit."""
    k = F.col(key) if isinstance(key, str) else key
    m = costs.groupBy(k.alias("key"), F.date_trunc("month", F.col(day)).alias("month")).agg(F.sum(amount).alias("actual"))
    return m.withColumn("pct_of_limit", F.col("actual") / limit).withColumn("alert", F.col("actual") > threshold * limit)


# Storage tiers by age in days (minimum age, tier), oldest first.
LIFECYCLE_TIERS = [(365, "expire"), (90, "glacier"), (30, "standard_ia"), (0, "standard")]


def lifecycle_tier(age_days) -> Column:
    """Storage tier by object age; the youngest tier takes everything else."""
    a = F.col(age_days) if isinstance(age_days, str) else age_days
    expr = None
    for lo, tier in LIFECYCLE_TIERS[:-1]:
        cond = a >= lo
        expr = F.when(cond, tier) if expr is None else expr.when(cond, tier)
    return expr.otherwise(LIFECYCLE_TIERS[-1][1])


def rightsizing(usage: DataFrame, key: str, value: str, idle_below: float, oversized_ratio: float = 0.3) -> DataFrame:
    """Per resource p95 and mean; idle when p95 is under the floor, oversized when
    the mean is a small fraction of the p95, otherwise right-sized."""
    g = usage.groupBy(key).agg(F.percentile(value, 0.95).alias("p95"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("samples"))
    return g.withColumn("status", F.when(F.col("p95") < idle_below, "idle")
                        .when(F.col("mean") / F.col("p95") < oversized_ratio, "oversized").otherwise("right_sized"))


def cost_anomalies(daily: DataFrame, key: str, day: str, amount: str, window_days: int = 7, z: float = 3.0) -> DataFrame:
    """Z-score of each day's cost against the trailing window before it (rows, not
    calendar days); anomalies have |z| > threshold."""
    w = Window.partitionBy(key).orderBy(day).rowsBetween(-window_days, -1)
    x = daily.withColumn("trail_mean", F.avg(amount).over(w)).withColumn("trail_sd", F.stddev_samp(amount).over(w))
    x = x.withColumn("z", (F.col(amount) - F.col("trail_mean")) / F.nullif(F.col("trail_sd"), F.lit(0.0)))
    return x.withColumn("anomaly", F.coalesce(F.abs(F.col("z")) > z, F.lit(False)))
