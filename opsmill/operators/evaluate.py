"""Conversation and evaluation analytics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_count(text) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def conversation_stats(turns: DataFrame, conv: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """Turns, turns per role, words (token proxy) and average turn length per
    conversation; follow-ups = user turns after the first."""
    wc = word_count(text)
    return turns.groupBy(conv).agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(F.col(role) == "user").alias("user_turns"),
        F.count_if(F.col(role) == "assistant").alias("assistant_turns"), F.sum(wc).cast("long").alias("words"),
        F.avg(F.length(text)).alias("avg_chars"),
        F.greatest(F.count_if(F.col(role) == "user") - 1, F.lit(0)).alias("follow_ups"))


def failure_mode(text, too_long: int = 1500, too_short: int = 20) -> Column:
    """Rule-based failure class of an answer (first matching rule)."""
    c = F.col(text) if isinstance(text, str) else text
    return (F.when(F.length(F.trim(c)) == 0, "empty").when(F.length(c) > too_long, "too_long")
            .when(F.length(c) < too_short, "too_short").when(~F.trim(c).rlike(r"[.!?]$"), "truncated").otherwise("ok"))


def failure_modes(turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Share of each failure class among assistant turns."""
    a = turns.filter(F.col(role) == "assistant").select(failure_mode(text).alias("mode"))
    total = a.select(F.count(F.lit(1))).scalar()
    return a.groupBy("mode").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / total)


def ab_summary(df: DataFrame, variant: str, metric: str, a: str, b: str) -> DataFrame:
    """Per-variant n, mean and variance, then Cohen's d (pooled sd) and the z
    statistic of the difference of means - all one aggregate and column math."""
    def side(v):
        m = F.when(F.col(variant) == v, F.col(metric))
        return F.count(m), F.avg(m), F.var_samp(m)
    (na, ma, va), (nb, mb, vb) = side(a), side(b)
    # one pass, one row: conditional aggregates per variant
    j = df.agg(na.alias("n_a"), ma.alias("mean_a"), va.alias("var_a"), nb.alias("n_b"), mb.alias("mean_b"), vb.alias("var_b"))
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n_a") + F.col("n_b") - 2))
    se = F.sqrt(F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b"))
    return (j.withColumn("cohens_d", (F.col("mean_b") - F.col("mean_a")) / pooled)
            .withColumn("z", (F.col("mean_b") - F.col("mean_a")) / se)
            .withColumn("enough_samples", (F.col("n_a") >= 100) & (F.col("n_b") >= 100)))


# The five-term rational approximation of erf (absolute error under 1.5e-7).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def two_sided_p(z) -> Column:
    """Normal two-sided p-value, erfc(|z| / sqrt 2), by a rational approximation."""
    x = F.abs(F.col(z) if isinstance(z, str) else z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return poly * F.exp(-x * x)


def ab_test(df: DataFrame, variant: str, metric: str, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """A/B comparison with p-value and significance (n >= 100 each, p < alpha)."""
    s = ab_summary(df, variant, metric, a, b)
    return s.withColumn("p_value", two_sided_p("z")).withColumn(
        "significant", F.col("enough_samples") & (F.col("p_value") < alpha))


def cohen_kappa(df: DataFrame, rater_a: str, rater_b: str) -> DataFrame:
    """Cohen's kappa of two raters over the same samples (categorical labels):
    observed agreement po, chance agreement pe = sum over labels of pa x pb,
    kappa = (po - pe) / (1 - pe). Marginals are two small aggregates joined on the label."""
    n = df.select(F.count(F.lit(1))).scalar()
    pa = df.groupBy(F.col(rater_a).alias("c")).agg((F.count(F.lit(1)) / n).alias("pa"))
    pb = df.groupBy(F.col(rater_b).alias("c")).agg((F.count(F.lit(1)) / n).alias("pb"))
    pe = pa.join(pb, "c").select(F.sum(F.col("pa") * F.col("pb"))).scalar()
    out = df.agg(F.count(F.lit(1)).alias("samples"),
                 F.avg(F.when(F.col(rater_a) == F.col(rater_b), 1.0).otherwise(0.0)).alias("observed_agreement"))
    out = out.withColumn("expected_agreement", pe)
    return out.withColumn("kappa", (F.col("observed_agreement") - F.col("expected_agreement")) / (1 - F.col("expected_agreement")))


def rollback_trigger(baseline: DataFrame, current: DataFrame, success_drop: float = 0.10, error_rise: float = 0.05,
                     cost_rise: float = 0.20) -> DataFrame:
    """Roll back when success rate falls by more than 10 points, the critical error
    rate rises by more than 5 points, or cost rises by more than 20 %. Both inputs are
    one-row frames (success_rate, error_rate, cost)."""
    base = baseline.select(F.struct("success_rate", "error_rate", "cost")).scalar()  # scalar subquery
    j = current.select(*[F.col(x).alias(f"cur_{x}") for x in ("success_rate", "error_rate", "cost")],
                       *[base[x].alias(f"base_{x}") for x in ("success_rate", "error_rate", "cost")])
    reasons = F.filter(F.array(
        F.when(F.col("cur_success_rate") < F.col("base_success_rate") - success_drop, F.lit("success_rate")),
        F.when(F.col("cur_error_rate") > F.col("base_error_rate") + error_rise, F.lit("critical_errors")),
        F.when(F.col("cur_cost") > F.col("base_cost") * (1 + cost_rise), F.lit("cost"))), lambda x: x.isNotNull())
    return j.withColumn("reasons", reasons).withColumn("rollback", F.size("reasons") > 0)
