"""Metrics, traces and reliability analytics.

Time buckets use ``window()`` (tumbling or sliding) so the same code runs on a streaming
DataFrame with a watermark; per-series order-dependent steps (counter resets, runs) are
windows partitioned by the series key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmill.session import cut_lineage

from opsmill.operators.relational import islands, rank_quantiles


def counter_increase(samples: DataFrame, series: Sequence[str], ts: str, value: str, tie: str | None = None,
                     bucket_seconds: int | None = None) -> DataFrame:
    """M1: per-sample increase of a monotonic counter with resets: a drop means the
    counter restarted, so the increase is the new value itself.

    With ``bucket_seconds`` a hot series is split by time bucket: ``lag`` runs inside each
    (series, bucket) and a bucket's first sample takes its previous value from the last
    sample of the nearest earlier non-empty bucket (one row per bucket) - same result."""
    order = [F.col(ts)] + ([F.col(tie)] if tie else [])
    if bucket_seconds is None:
        prev = F.lag(value).over(Window.partitionBy(*series).orderBy(*order))
        inc = F.when(prev.isNull(), F.lit(0)).when(F.col(value) < prev, F.col(value)).otherwise(F.col(value) - prev)
        return samples.withColumn("increase", inc)
    b = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(bucket_seconds * 1_000_000)).cast("long")
    x = samples.withColumn("__b", b)
    inner = F.lag(value).over(Window.partitionBy(*series, "__b").orderBy(*order))
    x = x.withColumn("__prev_in", inner)
    last = x.groupBy(*series, "__b").agg(F.max_by(F.col(value), F.struct(*order)).alias("__last"))
    wb = Window.partitionBy(*series).orderBy("__b")
    carry = last.withColumn("__carry", F.lag("__last").over(wb)).select(*series, "__b", "__carry")
    x = x.join(carry, [*series, "__b"])
    prev = F.coalesce(F.col("__prev_in"), F.col("__carry"))
    inc = F.when(prev.isNull(), F.lit(0)).when(F.col(value) < prev, F.col(value)).otherwise(F.col(value) - prev)
    return x.withColumn("increase", inc).drop("__b", "__prev_in", "__carry")


def counter_rate(samples: DataFrame, series: Sequence[str], ts: str, value: str, window: str = "5 minutes",
                 tie: str | None = None, bucket_seconds: int | None = None) -> DataFrame:
    """M1: ``rate(counter[w])`` = reset-aware increase per tumbling window / window length
    (no extrapolation to the window edges, unlike PromQL)."""
    inc = counter_increase(samples, series, ts, value, tie, bucket_seconds)
    secs = _window_seconds(window)
    return inc.groupBy(*series, F.window(ts, window).alias("w")).agg(F.sum("increase").alias("increase")).select(
        *series, F.col("w.start").alias("window_start"), "increase", (F.col("increase") / secs).alias("rate"))


def _window_seconds(window: str) -> int:
    n, unit = window.split()
    mult = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return int(n) * mult


def bucketize(df: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """M2 input: cumulative ``le`` bucket counts (plus +Inf) from raw observations."""
    aggs = [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    g = df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("le_inf"))
    parts = [F.struct(F.lit(float(b)).alias("le"), F.col(f"le_{i}").alias("cumulative")) for i, b in enumerate(bounds)]
    parts.append(F.struct(F.lit(float("inf")).alias("le"), F.col("le_inf").alias("cumulative")))
    return g.select(*keys, F.explode(F.array(*parts)).alias("b")).select(*keys, "b.le", "b.cumulative")


def histogram_quantile(buckets: DataFrame, keys: Sequence[str], q: float) -> DataFrame:
    """M2: quantile from cumulative buckets with linear interpolation inside the bucket
    that crosses q x total (lower bound = previous bucket bound, 0 for the first). If the
    crossing bucket is +Inf, the largest finite bound is returned."""
    w = Window.partitionBy(*keys).orderBy("le")
    b = (buckets.withColumn("prev_le", F.coalesce(F.lag("le").over(w), F.lit(0.0)))
         .withColumn("prev_cum", F.coalesce(F.lag("cumulative").over(w), F.lit(0)))
         .withColumn("total", F.max("cumulative").over(Window.partitionBy(*keys)))
         .withColumn("rank", F.lit(q) * F.col("total")))
    crossing = b.filter((F.col("cumulative") >= F.col("rank")) & (F.col("total") > 0))
    first = crossing.groupBy(*keys).agg(F.min_by(F.struct("le", "prev_le", "prev_cum", "cumulative", "rank"), F.col("le")).alias("c"))
    c = F.col("c")
    inbucket = c["cumulative"] - c["prev_cum"]
    val = F.when(c["le"] == float("inf"), c["prev_le"]).when(inbucket == 0, c["le"]).otherwise(
        c["prev_le"] + (c["le"] - c["prev_le"]) * (c["rank"] - c["prev_cum"]) / inbucket)
    return first.select(*keys, val.alias("quantile"))


def golden_signals(requests: DataFrame, service: str, ts: str, latency: str, is_error: Column, window: str,
                   capacity_per_window: float | None = None) -> DataFrame:
    """M3: traffic, error %, p50 / p99 latency (by rank, exactly) and saturation per
    (window, service)."""
    rows = requests.select(F.window(ts, window)["start"].alias("window_start"), F.col(service), F.col(latency), is_error.alias("__error"))
    g = rows.groupBy("window_start", service).agg(
        F.count(F.lit(1)).alias("traffic"), (F.avg(F.when(F.col("__error"), 100.0).otherwise(0.0))).alias("error_pct"))
    q = rank_quantiles(rows, ["window_start", service], latency, {"p50": 0.5, "p99": 0.99}).withColumnsRenamed({"window_start": "__start", service: "__service"})
    g = g.join(q, (F.col("window_start") == F.col("__start")) & F.col(service).eqNullSafe(F.col("__service")))
    sat = (F.col("traffic") / capacity_per_window) if capacity_per_window else F.lit(None).cast("double")
    return g.select("window_start", service, "traffic", "error_pct", "p50", "p99", sat.alias("saturation"))


def error_ratio(df: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """M4: 5xx / all x 100."""
    return df.groupBy(*keys).agg((F.avg(F.when(F.col(code).rlike("^5\\d\\d$"), 100.0).otherwise(0.0))).alias("error_pct"))


def alert_rules(metrics: DataFrame, series: str, ts: str, rules: Sequence[dict], bucket_seconds: int | None = None) -> DataFrame:
    """M5: threshold + sustained duration. ``metrics`` has one row per (series, ts step)
    and one column per metric; each rule {name, metric, op, threshold, for_steps,
    severity} fires for every run of consecutive steps breaching it that lasts at least
    ``for_steps`` (gaps and islands)."""
    out = None
    for rule in rules:
        m = F.col(rule["metric"])
        cond = m > rule["threshold"] if rule.get("op", ">") == ">" else m < rule["threshold"]
        runs = islands(metrics, series, ts, cond, bucket_seconds=bucket_seconds).filter(F.col("n_rows") >= rule["for_steps"])
        runs = runs.select(F.lit(rule["name"]).alias("alert"), F.lit(rule["severity"]).alias("severity"), series,
                           F.col("start_ts").alias("since"), F.col("end_ts").alias("until"), "n_rows")
        out = runs if out is None else out.unionByName(runs)
    return out


def cert_expiry(certs: DataFrame, expiry: str, as_of: str, days: int = 7) -> DataFrame:
    """M6: (expiry - as_of) / 86400 < days."""
    left = (F.unix_timestamp(F.col(expiry)) - F.unix_timestamp(F.to_timestamp(F.lit(as_of)))) / 86400.0
    return certs.withColumn("days_left", left).withColumn("expiring", F.col("days_left") < days)


def service_topology(spans: DataFrame, span: str = "span_id", parent: str = "parent_id", service: str = "service",
                     window_seconds: float | None = None) -> DataFrame:
    """M7: call edges (caller service -> callee service) with request counts (and a rate
    when the observation window length is given)."""
    p = spans.select(F.col(span).alias(parent), F.col(service).alias("source"))
    e = spans.join(p, parent).groupBy("source", F.col(service).alias("destination")).agg(F.count(F.lit(1)).alias("requests"))
    return e.withColumn("rate", F.col("requests") / window_seconds) if window_seconds else e


def span_self_time(spans: DataFrame, span: str = "span_id", parent: str = "parent_id", duration: str = "duration") -> DataFrame:
    """M8: self time = own duration - sum of the children's durations (floored at 0)."""
    children = spans.groupBy(F.col(parent).alias(span)).agg(F.sum(duration).alias("children_time"),
                                                           F.count(F.lit(1)).alias("children"))
    return (spans.join(children, span, "left")
            .withColumn("children_time", F.coalesce("children_time", F.lit(0.0)))
            .withColumn("children", F.coalesce("children", F.lit(0)))
            .withColumn("self_time", F.greatest(F.col(duration) - F.col("children_time"), F.lit(0.0))))


def _climb(rows: DataFrame, key: Sequence[str], up: str, joined: dict[str, Column]) -> DataFrame:
    """Pointer jumping: while a row points up, it takes over what ``joined`` says from the row there
    (its columns prefixed ``p_``) and that row's pointer. Rounds grow with the logarithm of the depth.
    Rows on a cycle never end and are left out, as are rows whose pointer leads nowhere."""
    done = cut_lineage(rows.filter(F.col(up).isNull()))
    todo = cut_lineage(rows.filter(F.col(up).isNotNull()))
    cols = rows.columns
    trace, node = key
    while True:
        at = done.unionByName(todo).select(*[F.col(c).alias(f"p_{c}") for c in cols])
        # many rows point at one: the side they are joined to has one row for each pointer
        moved = todo.join(at, (F.col(trace) == F.col(f"p_{trace}")) & (F.col(up) == F.col(f"p_{node}")))
        moved = cut_lineage(moved.select(*[joined.get(c, F.col(f"p_{up}") if c == up else F.col(c)).alias(c) for c in cols]))
        ended = moved.filter(F.col(up).isNull())
        if ended.isEmpty():
            return done  # the rest goes round in circles
        done, todo = done.unionByName(ended), moved.filter(F.col(up).isNotNull())


def critical_path(spans: DataFrame, trace: str = "trace_id", span: str = "span_id", parent: str = "parent_id", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """M8: the longest blocking chain of every trace: the spans that its duration waits for.

    From a span's end backwards, the child that finishes last is on the path; before that child's start,
    the child that finishes last by then, and so on; the same holds inside each of them. A child
    counts inside its parent's time only (clocks differ, and some outlive it); one that lies outside does not
    count. Ties go to the child that really ends last, then to the longer one, then to the smaller id.

    The choice among siblings depends on ancestors only by their latest start and earliest end, so it is made
    for all parents at once: these climb the tree by pointer jumping, one ordered fold per parent picks the
    chain (state: a cursor), and a second climb keeps the spans all of whose ancestors were picked.
    Rounds grow with the logarithm of the depth. A span without its parent is a root; of several roots the
    longest (then the smallest id) is the trace's. A span id that is repeated in its trace counts
    once (longest first); spans on a cycle are left out.

    Result: trace, span, parent, ``from_ms``, ``to_ms`` (its part of the path), ``path_ms`` (time on the path in
    which no picked child runs) and ``share`` of the trace's duration; the shares of a trace sum to 1."""
    from opsmill.operators import folds

    s = spans.select(F.col(trace).alias("trace"), F.col(span).alias("span"), F.col(parent).alias("parent"), F.col(start).cast("long").alias("s"),
                     F.greatest(F.col(start), F.col(end)).cast("long").alias("e"))
    s = s.groupBy("trace", "span").agg(F.max_by(F.struct("parent", "s", "e"), F.struct(F.col("e") - F.col("s"), F.col("e"), F.col("parent"))).alias("x")).select("trace", "span", "x.*")
    known = s.select(F.col("trace").alias("k_trace"), F.col("span").alias("k_span"))
    s = s.join(known, (F.col("trace") == F.col("k_trace")) & (F.col("parent") == F.col("k_span")) & (F.col("parent") != F.col("span")), "left")
    s = cut_lineage(s.select("trace", "span", F.col("k_span").alias("parent"), "s", "e"))

    # over a span and its ancestors: latest start (s) and earliest end (low); the ancestors' end (above); the root
    rows = s.select("trace", "span", "parent", "s", "e", F.col("parent").alias("up"), F.col("e").alias("low"), F.lit(None).cast("long").alias("above"), F.col("span").alias("root"))
    tree = _climb(rows, ("trace", "span"), "up", {"s": F.greatest("s", "p_s"), "low": F.least("low", "p_low"), "above": F.least("above", "p_low"), "root": F.col("p_root")})
    tree = cut_lineage(tree.drop("up"))
    root = tree.filter(F.col("parent").isNull()).groupBy("trace").agg(F.min_by(F.struct("span", (F.col("e") - F.col("s")).alias("total")), F.struct(F.col("s") - F.col("e"), F.col("span"))).alias("r"))
    root = root.select("trace", F.col("r.span").alias("root"), "r.total")
    tree = tree.join(root, ["trace", "root"])

    # children by falling end: picked if they end before the cursor, which moves to their start
    children = tree.filter(F.col("parent").isNotNull() & (F.col("s") <= F.col("low"))).select(
        "trace", "parent", "span", "s", "low", "above", "total", (-F.col("low")).alias("o1"), (-F.col("e")).alias("o2"))
    schema = T.StructType([*[children.schema[c] for c in ("trace", "span", "parent", "s", "low", "total")]])
    picked = folds.ordered_fold(children, ["trace", "parent"], ["o1", "o2", "s", "span"], _LastFinishing(schema.names), schema)
    tops = tree.filter(F.col("parent").isNull()).select("trace", "span", "parent", "s", "low", "total")
    chain = cut_lineage(picked.unionByName(tops))
    path = _climb(chain.withColumn("up", F.col("parent")), ("trace", "span"), "up", {}).drop("up")
    inner = path.filter("parent is not null").groupBy("trace", F.col("parent").alias("span")).agg(F.sum(F.col("low") - F.col("s")).alias("inner"))
    own = F.col("low") - F.col("s") - F.coalesce("inner", F.lit(0))
    out = path.join(inner, ["trace", "span"], "left")
    return out.select(F.col("trace").alias(trace), F.col("span").alias(span), F.col("parent").alias(parent), F.col("s").alias("from_ms"), F.col("low").alias("to_ms"),
                      own.alias("path_ms"), F.try_divide(own.cast("double"), F.col("total").cast("double")).alias("share"))


class _LastFinishing:
    """Fold over siblings by falling end: those that finish before the last picked one began."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)

    def init(self, key):
        return None

    def step(self, cursor, row):
        if cursor is None:
            cursor = row["above"]
        if row["low"] > cursor:
            return cursor, None
        return row["s"], {c: row[c] for c in self.columns}

    def finish(self, state) -> list[dict]:
        return []


def trace_sample(df: DataFrame, trace: str, per_mille: int) -> DataFrame:
    """M9: deterministic head sampling by trace id hash - a trace is kept or dropped whole.
    This is a sampling operator: dropping rows is its purpose."""
    from opsmill.operators.synth import seeded

    return df.filter(F.pmod(seeded("trace", F.col(trace)), F.lit(1000)) < per_mille)


def label_cardinality(df: DataFrame, labels: Sequence[str], limit: int, exact: bool = False) -> DataFrame:
    """Distinct values per label (HyperLogLog unless exact) flagged over the limit."""
    dist = (lambda c: F.countDistinct(c)) if exact else (lambda c: F.approx_count_distinct(c))
    row = df.agg(*[dist(c).alias(c) for c in labels])
    parts = [F.struct(F.lit(c).alias("label"), F.col(c).cast("long").alias("cardinality")) for c in labels]
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*").withColumn("over_limit", F.col("cardinality") > limit)


def outlier_runs(calls: DataFrame, host: str, ts: str, ok: str, min_failures: int = 5, tie: str | None = None,
                 bucket_seconds: int | None = None) -> DataFrame:
    """Runs of consecutive failed calls per host with length >= min_failures (a hot
    host can be split by time bucket, see ``islands``)."""
    return islands(calls, host, ts, ~F.col(ok), tie=tie, bucket_seconds=bucket_seconds).filter(F.col("n_rows") >= min_failures)


# Allowed regression per metric (fraction of the baseline).
REGRESSION_LIMITS = {"cpu": 0.10, "memory": 0.15, "latency": 0.20}


def perf_regression(baseline: DataFrame, candidate: DataFrame, key: str = "metric", value: str = "value",
                    limits: dict[str, float] = REGRESSION_LIMITS) -> DataFrame:
    """Relative change per metric against its limit."""
    lim = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    b = baseline.select(key, F.col(value).alias("baseline"))
    c = candidate.select(key, F.col(value).alias("candidate"))
    j = b.join(c, key)
    change = (F.col("candidate") - F.col("baseline")) / F.col("baseline")
    return j.withColumn("change", change).withColumn("limit", lim[F.col(key)]).withColumn(
        "regressed", F.coalesce(F.col("change") > F.col("limit"), F.lit(False)))


def dora_metrics(deploys: DataFrame, period: Column, failed: Column, lead_seconds: Column, restore_seconds: Column | None = None) -> DataFrame:
    """Deployment frequency, lead time, change failure rate, MTTR per period."""
    aggs = [F.count(F.lit(1)).alias("deployments"), F.avg(lead_seconds).alias("avg_lead_seconds"),
            F.avg(F.when(failed, 1.0).otherwise(0.0)).alias("change_failure_rate"),
            F.avg(F.when(failed, 0.0).otherwise(1.0)).alias("pipeline_success_rate")]
    if restore_seconds is not None:
        aggs.append(F.avg(F.when(failed, restore_seconds)).alias("mttr_seconds"))
    return deploys.groupBy(period.alias("period")).agg(*aggs)


def canary_gate(stages: DataFrame, key: str, weight: str, error_rate: str, max_error: float = 0.01) -> DataFrame:
    """Per rollout, the first stage (lowest weight) whose error rate exceeds the
    limit; a rollout with no failing stage is promoted."""
    bad = F.col(error_rate) > max_error
    return stages.groupBy(key).agg(F.min(F.when(bad, F.col(weight))).alias("failed_at_weight"),
                                   F.max(weight).alias("max_weight")).withColumn(
        "decision", F.when(F.col("failed_at_weight").isNull(), "promote").otherwise("rollback"))


def error_trend(errors: DataFrame, key: str, ts: str, window: str = "1 day", smooth: int = 7) -> DataFrame:
    """Error counts per window and a trailing moving average."""
    c = errors.groupBy(key, F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("errors"))
    w = Window.partitionBy(key).orderBy("w.start").rowsBetween(-(smooth - 1), 0)
    return c.select(key, F.col("w.start").alias("window_start"), "errors", F.avg("errors").over(w).alias("trend"))


def attribute_contrast(df: DataFrame, attrs: Sequence[str], broken: Column) -> DataFrame:
    """Unpivot attributes; failure rate per (attribute, value) and lift over the
    overall rate (scalar subquery)."""
    overall = df.select(F.avg(F.when(broken, 1.0).otherwise(0.0))).scalar()
    long = df.select(F.when(broken, 1.0).otherwise(0.0).alias("__b"),
                     F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value"))
                                         for a in attrs])).alias("kv")).select("__b", "kv.*")
    return long.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"), F.avg("__b").alias("failure_rate")).withColumn(
        "lift", F.col("failure_rate") / overall)


def slo_burn(requests: DataFrame, key: str, ts: str, good: Column, target: float, long_window: str = "7 days",
             short_window: str = "1 day") -> DataFrame:
    """SLI = good / total per window, error budget left and burn rate
    (1 - SLI) / (1 - target), for a long and a short window joined on the long window."""
    def per(win):
        return requests.groupBy(key, F.window(ts, win).alias("w")).agg(
            F.count(F.lit(1)).alias("total"), F.count_if(good).alias("good")).withColumn(
            "sli", F.col("good") / F.col("total"))
    lw = per(long_window).select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                                 "total", "good", "sli")
    sw = per(short_window).select(key, F.col("w.start").alias("short_start"), F.col("sli").alias("short_sli"))
    j = lw.join(sw, (lw[key] == sw[key]) & (sw["short_start"] >= lw["window_start"]) & (sw["short_start"] < lw["window_end"])) \
        .drop(sw[key])
    j = j.groupBy(key, "window_start", "total", "good", "sli").agg(F.max_by("short_sli", "short_start").alias("last_short_sli"))
    budget = 1.0 - target
    return (j.withColumn("burn_rate", (1 - F.col("sli")) / budget)
            .withColumn("short_burn_rate", (1 - F.col("last_short_sli")) / budget)
            .withColumn("budget_left", 1 - (F.col("total") - F.col("good")) / (F.col("total") * budget)))


def capacity_forecast(usage: DataFrame, key: str, day: str, value: str, limit: float) -> DataFrame:
    """Linear trend of usage over day number per resource, days until the limit."""
    dn = F.datediff(F.col(day), F.to_date(F.lit("1970-01-01"))).cast("double")
    g = usage.groupBy(key).agg(F.regr_slope(F.col(value), dn).alias("slope"), F.regr_intercept(F.col(value), dn).alias("intercept"),
                               F.max(dn).alias("last_day"))
    at_last = F.col("intercept") + F.col("slope") * F.col("last_day")
    return g.withColumn("days_to_limit", F.when(F.col("slope") > 0, (F.lit(limit) - at_last) / F.col("slope")))


def flaky_tests(runs: DataFrame, test: str, commit: str, passed: str) -> DataFrame:
    """(test, commit) pairs with both outcomes; flake rate per test."""
    pc = runs.groupBy(test, commit).agg(F.bool_or(passed).alias("any_pass"), F.bool_or(~F.col(passed)).alias("any_fail"))
    return pc.groupBy(test).agg(F.count(F.lit(1)).alias("commits"),
                                F.count_if(F.col("any_pass") & F.col("any_fail")).alias("flaky_commits")).withColumn(
        "flake_rate", F.col("flaky_commits") / F.col("commits"))


def log_correlation(logs: DataFrame, traces: DataFrame, trace: str) -> tuple[DataFrame, DataFrame]:
    """Logs per known trace, and logs whose correlation id matches no trace."""
    t = traces.select(trace).distinct()
    per = logs.join(t, trace).groupBy(trace).agg(F.count(F.lit(1)).alias("log_lines"))
    orphans = logs.join(t, trace, "left_anti")
    return per, orphans


def config_drift(desired: DataFrame, actual: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Desired vs actual -> changed / missing / unexpected (same rows dropped)."""
    d = desired.select(*keys, F.col(value).alias("desired"))
    a = actual.select(*keys, F.col(value).alias("actual"))
    j = d.join(a, list(keys), "full")
    status = (F.when(F.col("actual").isNull() & F.col("desired").isNotNull(), "missing")
              .when(F.col("desired").isNull() & F.col("actual").isNotNull(), "unexpected")
              .when(~F.col("desired").eqNullSafe(F.col("actual")), "changed"))
    return j.withColumn("drift", status).filter(F.col("drift").isNotNull())
