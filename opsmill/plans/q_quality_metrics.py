"""Registered queries for SURVEY 2.11 (quality, migration) and 2.12 (metrics, traces)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsmill.operators import metrics as M
from opsmill.operators import quality as Q
from opsmill.plans.derived import sql_with
from opsmill.plans.registry import r, register, ts_text
from opsmill.tables import Tables

TS = "'%Y-%m-%d %H:%M:%S'"


# ----------------------------------------------------------------------------- Q
@register("q1_null_check", sql=sql_with("usage_cost") + """
SELECT 'resource_id' AS column, count(*) FILTER (WHERE resource_id IS NULL) AS null_count FROM usage_cost
UNION ALL SELECT 'cost_center', count(*) FILTER (WHERE cost_center IS NULL) FROM usage_cost
UNION ALL SELECT 'day', count(*) FILTER (WHERE day IS NULL) FROM usage_cost
UNION ALL SELECT 'amount', count(*) FILTER (WHERE amount IS NULL) FROM usage_cost
""".replace("FROM usage_cost\n", "FROM usage_cost\n", 1))
def q_q1(spark, sf):
    return Q.null_check(Tables(spark, sf).derived.usage_cost, ["resource_id", "cost_center", "day", "amount"]).select(
        "column", "null_count")


@register("q1_null_check_status", sql=sql_with("usage_cost") + """
SELECT 'cost_center' AS column, CASE WHEN count(*) FILTER (WHERE cost_center IS NULL) > 0 THEN 'FAILED' ELSE 'PASSED' END AS status,
  'CRITICAL' AS severity FROM usage_cost
""")
def q_q1s(spark, sf):
    return Q.null_check(Tables(spark, sf).derived.usage_cost, ["cost_center"]).select("column", "status", "severity")


@register("q2_duplicate_key_check", sql="""
SELECT count(*) AS duplicate_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_involved,
  CASE WHEN count(*) > 0 THEN 'FAILED' ELSE 'PASSED' END AS status, 'CRITICAL' AS severity
FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
""")
def q_q2(spark, sf):
    return Q.duplicate_key_check(Tables(spark, sf).lineitem, ["l_orderkey", "l_linenumber"])


@register("q3_row_count_check", sql="""
SELECT 'nation' AS table_name, (SELECT count(*) FROM nation) AS actual, CAST(25 AS BIGINT) AS expected
UNION ALL SELECT 'region', (SELECT count(*) FROM region), 5
UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), 1500
""")
def q_q3(spark, sf):
    t = Tables(spark, sf)
    out = Q.row_count_check(spark, {"nation": t.nation, "region": t.region, "customer": t.customer},
                            {"nation": 25, "region": 5, "customer": 1500})
    return out.select("table_name", "actual", "expected")


@register("q4_table_reconcile", sql="""
WITH s AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders),
t AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
  o_orderstatus FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'P')
  UNION ALL SELECT o_orderkey + 1000000000, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice > 300000)
SELECT CASE WHEN t.o_orderkey IS NULL THEN 'missing' WHEN s.o_orderkey IS NULL THEN 'extra'
  WHEN s.o_totalprice IS DISTINCT FROM t.o_totalprice OR s.o_orderstatus IS DISTINCT FROM t.o_orderstatus THEN 'changed' ELSE 'same' END AS status,
  count(*) AS n FROM s FULL JOIN t ON s.o_orderkey = t.o_orderkey GROUP BY 1
""")
def q_q4(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    o2 = Tables(spark, sf).orders
    changed = (o2["o_orderpriority"] == "1-URGENT") & (o2["o_orderstatus"] == "O")
    tgt = (o2.filter(~((o2["o_orderpriority"] == "5-LOW") & (o2["o_orderstatus"] == "P")))
           .select("o_orderkey", F.when(changed, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
                   "o_orderstatus")
           .unionByName(o.filter(F.col("o_totalprice") > 300000).withColumn("o_orderkey", F.col("o_orderkey") + 1000000000)))
    rec = Q.table_reconcile(o, tgt, ["o_orderkey"], ["o_totalprice", "o_orderstatus"])
    return rec.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("q6_backfill_column", sql="""
SELECT o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_priority, count(*) AS n FROM orders GROUP BY 1
""")
def q_q6(spark, sf):
    o = Tables(spark, sf).orders
    b = Q.backfill_column(o, "is_priority", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return b.groupBy("is_priority").agg(F.count(F.lit(1)).alias("n"))


@register("q7_schema_contract_check", sql="""
WITH x AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT 'minimum' AS type, '$.k' AS path, count(*) AS n FROM x WHERE k < 5
UNION ALL SELECT 'maximum', '$.k', count(*) FROM x WHERE k > 90
""")
def q_q7(spark, sf):
    e = Tables(spark, sf).events
    c = Q.contract_errors(e, "props", {"k": {"type": "integer", "required": True, "minimum": 5, "maximum": 90}})
    errs = c.select(F.explode("errors").alias("e")).select("e.type", "e.path")
    counts = errs.groupBy("type", "path").agg(F.count(F.lit(1)).alias("n"))
    # report every rule, zero-filled
    rules = spark.createDataFrame([("minimum", "$.k"), ("maximum", "$.k")], "type string, path string")
    return rules.join(counts, ["type", "path"], "left").select("type", "path", F.coalesce("n", F.lit(0)).alias("n"))


@register("q8_collect_all_errors", sql="""
WITH x AS (SELECT list_filter([CASE WHEN NOT (c_acctbal >= 0) THEN 'negative_balance' END,
  CASE WHEN NOT (c_mktsegment <> 'MACHINERY') THEN 'segment_blocked' END, CASE WHEN NOT (c_nationkey < 20) THEN 'nation_out_of_range' END],
  lambda y: y IS NOT NULL) AS errors FROM customer)
SELECT array_to_string(errors, ',') AS errors, count(*) AS n FROM x GROUP BY 1
""")
def q_q8(spark, sf):
    c = Tables(spark, sf).customer
    rules = {"negative_balance": F.col("c_acctbal") >= 0, "segment_blocked": F.col("c_mktsegment") != "MACHINERY",
             "nation_out_of_range": F.col("c_nationkey") < 20}
    x = Q.collect_all_errors(c, rules)
    return x.groupBy(F.array_join("errors", ",").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


@register("q9_check_constraint", sql=sql_with("usage_cost") + """
SELECT 'check:cost_center_known' AS constraint, CAST(count_if(NOT coalesce(cost_center IN ('A', 'N'), true)) AS BIGINT) AS violations FROM usage_cost
UNION ALL SELECT 'not_null:cost_center', CAST(count_if(cost_center IS NULL) AS BIGINT) FROM usage_cost
UNION ALL SELECT 'unique:resource_id,day,cost_center', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT resource_id, day, cost_center, count(*) AS n
  FROM usage_cost WHERE resource_id IS NOT NULL AND day IS NOT NULL AND cost_center IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
""")
def q_q9(spark, sf):
    u = Tables(spark, sf).derived.usage_cost
    return Q.constraint_report(u, {"cost_center_known": F.col("cost_center").isin("A", "N")}, ["cost_center"],
                               [["resource_id", "day", "cost_center"]]).select("constraint", "violations")


@register("q10_migration_anomaly", sql="""
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS rate, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS error_rate
  FROM events GROUP BY 1),
s AS (SELECT *, (SELECT avg(rate) FROM d) AS expected FROM d)
SELECT strftime(day, '%Y-%m-%d') AS day, 'low_throughput' AS type, 'warning' AS severity FROM s WHERE rate < expected * 0.95
UNION ALL SELECT strftime(day, '%Y-%m-%d'), 'high_error_rate', 'critical' FROM s WHERE error_rate > 0.21
""")
def q_q10(spark, sf):
    e = Tables(spark, sf).events
    d = e.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("rate"),
                                                    F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("error_rate"))
    d = d.withColumn("expected", d.select(F.avg("rate")).scalar())
    a = Q.migration_anomalies(d, "day", "rate", "expected", "error_rate", low_factor=0.95, max_error=0.21)
    return a.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "type", "severity")


@register("q11_progress_metrics", sql="""
SELECT o_custkey % 20 AS migration_id, o_orderpriority AS table_name, count(*) AS rows_migrated,
  CAST(count_if(o_orderstatus = 'P') AS BIGINT) AS errors,
  CAST(count_if(o_totalprice / 100 <= 60) AS BIGINT) AS le_60, CAST(count_if(o_totalprice / 100 <= 300) AS BIGINT) AS le_300,
  CAST(count_if(o_totalprice / 100 <= 600) AS BIGINT) AS le_600, CAST(count_if(o_totalprice / 100 <= 1800) AS BIGINT) AS le_1800,
  CAST(count_if(o_totalprice / 100 <= 3600) AS BIGINT) AS le_3600, count(*) AS le_inf FROM orders GROUP BY 1, 2
""")
def q_q11(spark, sf):
    o = Tables(spark, sf).orders.select((F.col("o_custkey") % 20).alias("migration_id"), F.col("o_orderpriority").alias("table_name"),
                                        (F.col("o_totalprice") / 100).alias("duration"), F.lit(1).alias("rows"), "o_orderstatus")
    p = Q.progress_metrics(o, ["migration_id", "table_name"], "duration", "rows", F.col("o_orderstatus") == "P")
    return p.withColumn("rows_migrated", F.col("rows_migrated").cast("long"))


@register("q12_lag_status", sql=sql_with("metric_samples") + """
SELECT CASE WHEN lag_s >= 300 THEN 'red' WHEN lag_s >= 60 THEN 'yellow' ELSE 'green' END AS status, count(*) AS n FROM (
  SELECT floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY service ORDER BY ts, event_id))) AS lag_s FROM metric_samples)
WHERE lag_s IS NOT NULL GROUP BY 1
""")
def q_q12(spark, sf):
    from pyspark.sql import Window
    m = Tables(spark, sf).derived.metric_samples
    lag_s = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(Window.partitionBy("service").orderBy("ts", "event_id")))
    x = m.select(lag_s.alias("lag_s")).filter(F.col("lag_s").isNotNull())
    return x.groupBy(Q.lag_status("lag_s").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register("q14_n_plus_one_detect", sql="""
SELECT user_id, 'select * from items where id = ?' AS template, count(*) AS repeats FROM events GROUP BY 1 HAVING count(*) > 70
""")
def q_q14(spark, sf):
    e = Tables(spark, sf).events
    log = e.select("user_id", F.concat(F.lit("SELECT * FROM items WHERE id = "), F.get_json_object("props", "$.k")).alias("query"))
    return Q.n_plus_one(log, "user_id", "query", 70)


@register("q15_dataset_profile", sql="""
SELECT 'c_custkey' AS column, count(*) AS rows, count(*) FILTER (WHERE c_custkey IS NULL) AS nulls, count(DISTINCT c_custkey) AS distinct,
  CAST(min(c_custkey) AS VARCHAR) AS min, CAST(max(c_custkey) AS VARCHAR) AS max FROM customer
UNION ALL SELECT 'c_name', count(*), count(*) FILTER (WHERE c_name IS NULL), count(DISTINCT c_name), min(c_name), max(c_name) FROM customer
UNION ALL SELECT 'c_nationkey', count(*), count(*) FILTER (WHERE c_nationkey IS NULL), count(DISTINCT c_nationkey),
  CAST(min(c_nationkey) AS VARCHAR), CAST(max(c_nationkey) AS VARCHAR) FROM customer
UNION ALL SELECT 'c_mktsegment', count(*), count(*) FILTER (WHERE c_mktsegment IS NULL), count(DISTINCT c_mktsegment), min(c_mktsegment),
  max(c_mktsegment) FROM customer
""")
def q_q15(spark, sf):
    c = Tables(spark, sf).customer
    return Q.dataset_profile(c, ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], exact_distinct=True)


@register("q15_profile_history", sql="""
WITH x AS (SELECT 'l_quantity' AS "column", CAST(l_quantity AS DOUBLE) AS v FROM lineitem UNION ALL SELECT 'l_partkey', l_partkey FROM lineitem)
SELECT "column", count(*) AS rows, count(*) - count(v) AS nulls, min(v) AS low, max(v) AS high, true AS distinct_close, true AS quartiles_close FROM x GROUP BY 1
""")
def q_q15_history(spark, sf):
    """One profile run a return flag, appended to a history table; the whole table's profile from the stored
    sketches, held against a full pass (4 % on distinct values, 3 % of the rows on the quartiles' ranks)."""
    from opsmill.session import scratch_path

    li = Tables(spark, sf).lineitem.select("l_returnflag", "l_quantity", "l_partkey")
    path = scratch_path(spark, "profiles")
    for flag in ("A", "N", "R"):
        Q.append_profile(li.filter(F.col("l_returnflag") == flag), flag, path, ["l_quantity", "l_partkey"])
    merged = Q.merged_profile(spark.read.parquet(path))
    quartiles = merged.select("column", F.array("q25", "q50", "q75").alias("q"))
    x = li.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in ("l_quantity", "l_partkey")])).alias("x")).select("x.*")
    below = x.join(F.broadcast(quartiles), "column").groupBy("column").agg(  # two rows
        F.countDistinct("v").alias("exact"), *[F.count_if(F.col("v") < F.col("q")[i]).alias(f"lt{i}") for i in range(3)], *[F.count_if(F.col("v") <= F.col("q")[i]).alias(f"le{i}") for i in range(3)])
    j = merged.join(below, "column")
    close = F.lit(True)
    for i, share in enumerate((0.25, 0.5, 0.75)):
        close = close & (F.col(f"lt{i}") <= (share + 0.03) * F.col("rows")) & (F.col(f"le{i}") >= (share - 0.03) * F.col("rows"))
    return j.select("column", "rows", "nulls", "low", "high", (F.abs(F.col("distinct") / F.col("exact") - 1) <= 0.04).alias("distinct_close"), close.alias("quartiles_close"))


# ----------------------------------------------------------------------------- M
@register("m1_counter_rate", sql=sql_with("metric_samples") + f"""
, inc AS (SELECT service, ts, CASE WHEN lag(counter_value) OVER w IS NULL THEN 0 WHEN counter_value < lag(counter_value) OVER w THEN counter_value
  ELSE counter_value - lag(counter_value) OVER w END AS increase FROM metric_samples WINDOW w AS (PARTITION BY service ORDER BY ts, event_id))
SELECT service, strftime(date_trunc('hour', ts), {TS}) AS window_start, CAST(sum(increase) AS BIGINT) AS increase, round(sum(increase) / 3600, 6) AS rate
FROM inc GROUP BY service, date_trunc('hour', ts)
""")
def q_m1(spark, sf):
    m = Tables(spark, sf).derived.metric_samples
    out = M.counter_rate(m, ["service"], "ts", "counter_value", "1 hour", tie="event_id", bucket_seconds=86400)
    return out.select("service", ts_text("window_start").alias("window_start"), F.col("increase").cast("long").alias("increase"),
                      r("rate", 6).alias("rate"))


def _hq_sql(q: float) -> str:
    return f"""
, b AS (SELECT service, le, cumulative FROM (SELECT service, count_if(latency <= 25) AS c0, count_if(latency <= 50) AS c1,
    count_if(latency <= 100) AS c2, count_if(latency <= 250) AS c3, count_if(latency <= 500) AS c4, count(*) AS c5 FROM metric_samples GROUP BY 1)
  CROSS JOIN LATERAL (VALUES (25.0, c0), (50.0, c1), (100.0, c2), (250.0, c3), (500.0, c4), ('inf'::DOUBLE, c5)) t(le, cumulative)),
x AS (SELECT service, le, cumulative, coalesce(lag(le) OVER w, 0.0) AS prev_le, coalesce(lag(cumulative) OVER w, 0) AS prev_cum,
  max(cumulative) OVER (PARTITION BY service) AS total FROM b WINDOW w AS (PARTITION BY service ORDER BY le)),
c AS (SELECT service, arg_min(struct_pack(le, prev_le, prev_cum, cumulative, rnk := {q} * total), le) AS c FROM x
  WHERE cumulative >= {q} * total AND total > 0 GROUP BY service)
SELECT service, round(CASE WHEN c.le = 'inf'::DOUBLE THEN c.prev_le WHEN c.cumulative - c.prev_cum = 0 THEN c.le
  ELSE c.prev_le + (c.le - c.prev_le) * (c.rnk - c.prev_cum) / (c.cumulative - c.prev_cum) END, 4) AS quantile FROM c"""


@register("m2_histogram_quantile", sql=sql_with("metric_samples") + _hq_sql(0.9))
def q_m2(spark, sf):
    m = Tables(spark, sf).derived.metric_samples
    b = M.bucketize(m, ["service"], "latency", [25, 50, 100, 250, 500])
    return M.histogram_quantile(b, ["service"], 0.9).select("service", r("quantile", 4).alias("quantile"))


@register("m3_golden_signals", sql=sql_with("metric_samples") + f"""
SELECT strftime(date_trunc('day', ts), {TS}) AS window_start, service, count(*) AS traffic,
  round(avg(CASE WHEN code = '500' THEN 100.0 ELSE 0.0 END), 4) AS error_pct, round(quantile_disc(latency, 0.5), 4) AS p50,
  round(quantile_disc(latency, 0.99), 4) AS p99, round(count(*) / 50.0, 4) AS saturation FROM metric_samples GROUP BY 1, 2
""")
def q_m3(spark, sf):
    m = Tables(spark, sf).derived.metric_samples
    g = M.golden_signals(m, "service", "ts", "latency", F.col("code") == "500", "1 day", 50.0)
    return g.select(ts_text("window_start").alias("window_start"), "service", "traffic", r("error_pct", 4).alias("error_pct"),
                    r("p50", 4).alias("p50"), r("p99", 4).alias("p99"), r("saturation", 4).alias("saturation"))


@register("m4_error_ratio", sql=sql_with("metric_samples") + """
SELECT service, round(avg(CASE WHEN regexp_matches(code, '^5\\d\\d$') THEN 100.0 ELSE 0.0 END), 4) AS error_pct FROM metric_samples GROUP BY 1
""")
def q_m4(spark, sf):
    return M.error_ratio(Tables(spark, sf).derived.metric_samples, ["service"], "code").select(
        "service", r("error_pct", 4).alias("error_pct"))


def _hourly(spark, sf):
    m = Tables(spark, sf).derived.metric_samples
    return m.groupBy("service", F.date_trunc("hour", "ts").alias("ts")).agg(
        F.avg(F.when(F.col("code") == "500", 100.0).otherwise(0.0)).alias("error_pct"), F.max("latency").alias("max_latency"))


ALERT_RULES = [{"name": "HighErrorRate", "metric": "error_pct", "threshold": 5.0, "for_steps": 3, "severity": "critical"},
               {"name": "HighLatency", "metric": "max_latency", "threshold": 300.0, "for_steps": 2, "severity": "warning"}]


def _islands_sql(cond: str, name: str, sev: str, k: int) -> str:
    return f"""SELECT '{name}' AS alert, '{sev}' AS severity, service, strftime(min(ts), {TS}) AS since, strftime(max(ts), {TS}) AS until,
  count(*) AS n_rows FROM (SELECT *, sum(chg) OVER (PARTITION BY service ORDER BY ts ROWS UNBOUNDED PRECEDING) AS isl FROM (
    SELECT *, CASE WHEN c <> coalesce(lag(c) OVER (PARTITION BY service ORDER BY ts), false) THEN 1 ELSE 0 END AS chg FROM (
      SELECT service, ts, coalesce({cond}, false) AS c FROM h))) WHERE c GROUP BY service, isl HAVING count(*) >= {k}"""


@register("m5_alert_rules", sql=sql_with("metric_samples") + f"""
, h AS (SELECT service, date_trunc('hour', ts) AS ts, avg(CASE WHEN code = '500' THEN 100.0 ELSE 0.0 END) AS error_pct,
  max(latency) AS max_latency FROM metric_samples GROUP BY 1, 2)
{_islands_sql('error_pct > 5.0', 'HighErrorRate', 'critical', 3)}
UNION ALL {_islands_sql('max_latency > 300.0', 'HighLatency', 'warning', 2)}
""")
def q_m5(spark, sf):
    a = M.alert_rules(_hourly(spark, sf), "service", "ts", ALERT_RULES)
    return a.select("alert", "severity", "service", ts_text("since").alias("since"), ts_text("until").alias("until"), "n_rows")


@register("m6_cert_expiry", sql="""
WITH c AS (SELECT o_custkey, max(o_orderdate) + INTERVAL 365 DAY AS expiry FROM orders GROUP BY 1),
d AS (SELECT (epoch(expiry) - epoch(TIMESTAMP '1999-01-01')) / 86400.0 AS days_left FROM c)
SELECT CAST(count_if(days_left < 7) AS BIGINT) AS expiring, CAST(count_if(days_left < 0) AS BIGINT) AS expired, count(*) AS certs FROM d
""")
def q_m6(spark, sf):
    o = Tables(spark, sf).orders
    c = o.groupBy("o_custkey").agg((F.max("o_orderdate") + F.expr("INTERVAL 365 DAYS")).alias("expiry"))
    x = M.cert_expiry(c, "expiry", "1999-01-01")
    return x.agg(F.count_if("expiring").alias("expiring"), F.count_if(F.col("days_left") < 0).alias("expired"),
                 F.count(F.lit(1)).alias("certs"))


@register("m7_service_topology", sql=sql_with("spans") + """
SELECT p.service AS source, s.service AS destination, count(*) AS requests FROM spans s JOIN spans p ON s.parent_id = p.span_id GROUP BY 1, 2
""")
def q_m7(spark, sf):
    return M.service_topology(Tables(spark, sf).derived.spans)


@register("m8_span_tree", sql=sql_with("spans") + """
, ch AS (SELECT parent_id AS span_id, sum(duration) AS children_time FROM spans WHERE parent_id IS NOT NULL GROUP BY 1)
SELECT service, count(*) AS spans, round(sum(greatest(duration - coalesce(children_time, 0.0), 0.0)), 2) AS self_time
FROM spans LEFT JOIN ch USING (span_id) GROUP BY service
""")
def q_m8(spark, sf):
    s = M.span_self_time(Tables(spark, sf).derived.spans)
    return s.groupBy("service").agg(F.count(F.lit(1)).alias("spans"), r(F.sum("self_time")).alias("self_time"))


@register("m8_critical_path", sql=sql_with("trace_spans").replace("WITH ", "WITH RECURSIVE ", 1) + """
, root AS (SELECT trace_id, span_id, start_ms, end_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start_ms - end_ms, span_id) AS r FROM trace_spans WHERE parent_id IS NULL) WHERE r = 1),
path AS (
  SELECT trace_id, span_id, CAST(-1 AS BIGINT) AS parent_id, end_ms, start_ms AS from_ms, end_ms AS to_ms, CAST(NULL AS BIGINT) AS low, CAST(NULL AS BIGINT) AS high FROM root
  UNION ALL
  SELECT trace_id, span_id, parent_id, end_ms, from_ms, to_ms, low, high FROM (
    SELECT *, row_number() OVER (PARTITION BY trace_id, parent_id, from_span ORDER BY to_ms DESC, end_ms DESC, from_ms, span_id) AS r FROM (
      -- the last child to finish in a span of the path
      SELECT c.trace_id, c.span_id, c.parent_id, c.end_ms, greatest(c.start_ms, p.from_ms) AS from_ms, least(c.end_ms, p.to_ms) AS to_ms, p.from_ms AS low, p.to_ms AS high, p.span_id AS from_span
      FROM path p JOIN trace_spans c ON c.trace_id = p.trace_id AND c.parent_id = p.span_id WHERE greatest(c.start_ms, p.from_ms) <= least(c.end_ms, p.to_ms)
      UNION ALL
      -- the last sibling to finish before a span of the path began
      SELECT c.trace_id, c.span_id, c.parent_id, c.end_ms, greatest(c.start_ms, p.low), least(c.end_ms, p.high), p.low, p.high, p.span_id
      FROM path p JOIN trace_spans c ON c.trace_id = p.trace_id AND c.parent_id = p.parent_id
      WHERE greatest(c.start_ms, p.low) <= least(c.end_ms, p.high) AND least(c.end_ms, p.high) <= p.from_ms
        AND [-least(c.end_ms, p.high), -c.end_ms, greatest(c.start_ms, p.low), c.span_id] > [-p.to_ms, -p.end_ms, p.from_ms, p.span_id])) WHERE r = 1),
inside AS (SELECT trace_id, parent_id AS span_id, sum(to_ms - from_ms) AS inner_ms FROM path WHERE parent_id >= 0 GROUP BY ALL)
SELECT p.trace_id, p.span_id, p.parent_id, p.from_ms, p.to_ms, CAST(p.to_ms - p.from_ms - coalesce(inner_ms, 0) AS BIGINT) AS path_ms,
  round((p.to_ms - p.from_ms - coalesce(inner_ms, 0)) / (root.end_ms - root.start_ms), 6) AS share
FROM path p JOIN root USING (trace_id) LEFT JOIN inside i ON i.trace_id = p.trace_id AND i.span_id = p.span_id
""")
def q_m8_path(spark, sf):
    p = M.critical_path(Tables(spark, sf).derived.trace_spans)
    return p.withColumn("share", r("share", 6)).withColumn("parent_id", F.coalesce("parent_id", F.lit(-1).cast("long")))


@register("m9_trace_sampling", sql=sql_with("spans") + """
SELECT trace_id, count(*) AS spans FROM spans WHERE CAST('0x' || substr(md5(CAST(trace_id AS VARCHAR) || '|trace'), 1, 15) AS BIGINT) % 1000 < 100 GROUP BY 1
""")
def q_m9(spark, sf):
    s = M.trace_sample(Tables(spark, sf).derived.spans, "trace_id", 100)
    return s.groupBy("trace_id").agg(F.count(F.lit(1)).alias("spans"))


@register("m10_label_cardinality", sql="""
SELECT 'user_id' AS label, count(DISTINCT user_id) AS cardinality, count(DISTINCT user_id) > 100 AS over_limit FROM events
UNION ALL SELECT 'event_type', count(DISTINCT event_type), count(DISTINCT event_type) > 100 FROM events
UNION ALL SELECT 'props', count(DISTINCT props), count(DISTINCT props) > 100 FROM events
""")
def q_m10(spark, sf):
    return M.label_cardinality(Tables(spark, sf).events, ["user_id", "event_type", "props"], 100, exact=True)


@register("m11_outlier_ejection", sql=sql_with("call_log") + """
, f AS (SELECT service, ts, event_id, NOT ok AS c FROM call_log),
g AS (SELECT *, CASE WHEN c <> coalesce(lag(c) OVER (PARTITION BY service ORDER BY ts, event_id), false) THEN 1 ELSE 0 END AS chg FROM f),
h AS (SELECT *, sum(chg) OVER (PARTITION BY service ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM g),
runs AS (SELECT service, count(*) AS n FROM h WHERE c GROUP BY service, isl HAVING count(*) >= 3)
SELECT service, count(*) AS ejections, max(n) AS longest FROM runs GROUP BY 1
""")
def q_m11(spark, sf):
    runs = M.outlier_runs(Tables(spark, sf).derived.call_log, "service", "ts", "ok", 3, tie="event_id", bucket_seconds=86400)
    return runs.groupBy("service").agg(F.count(F.lit(1)).alias("ejections"), F.max("n_rows").alias("longest"))


@register("m12_perf_regression", sql="""
WITH m AS (SELECT ts < TIMESTAMP '2024-01-15' AS base, avg(value) AS cpu, count(*) / 1000.0 AS memory, quantile_cont(value, 0.99) AS latency
  FROM events GROUP BY 1),
l AS (SELECT base, 'cpu' AS metric, cpu AS value FROM m UNION ALL SELECT base, 'memory', memory FROM m UNION ALL SELECT base, 'latency', latency FROM m)
SELECT b.metric, round(b.value, 4) AS baseline, round(c.value, 4) AS candidate, round((c.value - b.value) / b.value, 6) AS change,
  (c.value - b.value) / b.value > CASE b.metric WHEN 'cpu' THEN 0.10 WHEN 'memory' THEN 0.15 ELSE 0.20 END AS regressed
FROM l b JOIN l c ON b.metric = c.metric AND b.base AND NOT c.base
""")
def q_m12(spark, sf):
    e = Tables(spark, sf).events

    def metrics(df):
        row = df.agg(F.avg("value").alias("cpu"), (F.count(F.lit(1)) / 1000.0).alias("memory"),
                     F.percentile("value", 0.99).alias("latency"))
        return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value"))
                                              for k in ("cpu", "memory", "latency")])).alias("x")).select("x.*")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    out = M.perf_regression(metrics(e.filter(F.col("ts") < cut)), metrics(e.filter(F.col("ts") >= cut)))
    return out.select("metric", r("baseline", 4).alias("baseline"), r("candidate", 4).alias("candidate"), r("change", 6).alias("change"),
                      "regressed")


@register("m13_dora_metrics", sql="""
WITH d AS (SELECT o_orderkey, year(o_orderdate) AS period, o_orderstatus = 'P' AS failed, epoch(min(l_shipdate)) - epoch(o_orderdate) AS lead_s
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate, o_orderstatus)
SELECT period, count(*) AS deployments, round(avg(lead_s) / 86400, 4) AS avg_lead_days, round(avg(CASE WHEN failed THEN 1.0 ELSE 0.0 END), 6)
  AS change_failure_rate, round(avg(CASE WHEN failed THEN 0.0 ELSE 1.0 END), 6) AS pipeline_success_rate FROM d GROUP BY 1
""")
def q_m13(spark, sf):
    t = Tables(spark, sf)
    first_ship = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("ship"))
    d = t.orders.join(first_ship, "o_orderkey")
    out = M.dora_metrics(d, F.year("o_orderdate").cast("long"), F.col("o_orderstatus") == "P",
                         F.unix_timestamp("ship") - F.unix_timestamp("o_orderdate"))
    return out.select("period", "deployments", r(F.col("avg_lead_seconds") / 86400, 4).alias("avg_lead_days"),
                      r("change_failure_rate", 6).alias("change_failure_rate"), r("pipeline_success_rate", 6).alias("pipeline_success_rate"))


@register("m14_canary_gate", sql=sql_with("call_log") + """
, s AS (SELECT service, CASE WHEN day(ts) <= 7 THEN 10 WHEN day(ts) <= 14 THEN 25 WHEN day(ts) <= 21 THEN 50 ELSE 100 END AS weight,
  avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END) AS error_rate FROM call_log GROUP BY 1, 2)
SELECT service, coalesce(min(weight) FILTER (WHERE error_rate > 0.2), 0) AS failed_at_weight,
  CASE WHEN min(weight) FILTER (WHERE error_rate > 0.2) IS NULL THEN 'promote' ELSE 'rollback' END AS decision FROM s GROUP BY 1
""")
def q_m14(spark, sf):
    c = Tables(spark, sf).derived.call_log
    d = F.dayofmonth("ts")
    w = F.when(d <= 7, 10).when(d <= 14, 25).when(d <= 21, 50).otherwise(100)
    st = c.groupBy("service", w.alias("weight")).agg(F.avg(F.when(F.col("ok"), 0.0).otherwise(1.0)).alias("error_rate"))
    g = M.canary_gate(st, "service", "weight", "error_rate", 0.2)
    return g.select("service", F.coalesce("failed_at_weight", F.lit(0)).alias("failed_at_weight"), "decision")


@register("m15_error_trends", sql=sql_with("metric_samples") + f"""
WITH2 AS (SELECT 1)
""".replace("WITH2 AS (SELECT 1)", f""", c AS (SELECT service, date_trunc('day', ts) AS d, count(*) AS errors FROM metric_samples WHERE code = '500' GROUP BY 1, 2)
SELECT service, strftime(d, {TS}) AS window_start, errors,
  round(avg(errors) OVER (PARTITION BY service ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS trend FROM c"""))
def q_m15(spark, sf):
    m = Tables(spark, sf).derived.metric_samples.filter(F.col("code") == "500")
    t = M.error_trend(m, "service", "ts", "1 day", 7)
    return t.select("service", ts_text("window_start").alias("window_start"), "errors", r("trend", 4).alias("trend"))


@register("m16_attribute_contrast", sql="""
WITH o AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END AS b, o_orderpriority, year(o_orderdate) AS y FROM orders),
l AS (SELECT b, 'o_orderpriority' AS attribute, o_orderpriority AS value FROM o UNION ALL SELECT b, 'year', CAST(y AS VARCHAR) FROM o)
SELECT attribute, value, count(*) AS n, round(avg(b), 6) AS failure_rate, round(avg(b) / (SELECT avg(b) FROM o), 6) AS lift FROM l GROUP BY 1, 2
""")
def q_m16(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year"))
    c = M.attribute_contrast(o, ["o_orderpriority", "year"], F.col("o_orderstatus") == "P")
    return c.select("attribute", "value", "n", r("failure_rate", 6).alias("failure_rate"), r("lift", 6).alias("lift"))


@register("m17_slo_error_budget", sql=sql_with("call_log") + f"""
, lw AS (SELECT service, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS ws, count(*) AS total, count_if(ok) AS good FROM call_log GROUP BY 1, 2),
sw AS (SELECT service, date_trunc('day', ts) AS ss, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS short_sli FROM call_log GROUP BY 1, 2),
j AS (SELECT lw.*, arg_max(short_sli, ss) AS last_short_sli FROM lw JOIN sw ON lw.service = sw.service AND ss >= ws AND ss < ws + INTERVAL 7 DAY
  GROUP BY ALL)
SELECT service, strftime(ws, {TS}) AS window_start, total, CAST(good AS BIGINT) AS good, round(good / total, 6) AS sli,
  round((1 - good / total) / 0.25, 6) AS burn_rate, round((1 - last_short_sli) / 0.25, 6) AS short_burn_rate,
  round(1 - (total - good) / (total * 0.25), 6) AS budget_left FROM j
""")
def q_m17(spark, sf):
    c = Tables(spark, sf).derived.call_log
    s = M.slo_burn(c, "service", "ts", F.col("ok"), 0.75)
    return s.select("service", ts_text("window_start").alias("window_start"), "total", F.col("good").cast("long").alias("good"),
                    r("sli", 6).alias("sli"), r("burn_rate", 6).alias("burn_rate"), r("short_burn_rate", 6).alias("short_burn_rate"),
                    r("budget_left", 6).alias("budget_left"))


@register("m18_capacity_forecast", sql="""
WITH d AS (SELECT CAST(ts AS DATE) AS day, user_id % 8 AS service, count(*) AS n FROM events GROUP BY 1, 2),
g AS (SELECT service, regr_slope(n, datediff('day', DATE '1970-01-01', day)) AS slope, regr_intercept(n, datediff('day', DATE '1970-01-01', day)) AS icpt,
  max(datediff('day', DATE '1970-01-01', day)) AS last_day FROM d GROUP BY 1)
SELECT service, round(slope, 6) AS slope, round(CASE WHEN slope > 0 THEN (100 - (icpt + slope * last_day)) / slope END, 2) AS days_to_limit FROM g
""")
def q_m18(spark, sf):
    e = Tables(spark, sf).events
    d = e.groupBy(F.to_date("ts").alias("day"), (F.col("user_id") % 8).alias("service")).agg(F.count(F.lit(1)).alias("n"))
    f = M.capacity_forecast(d, "service", "day", "n", 100.0)
    return f.select("service", r("slope", 6).alias("slope"), r("days_to_limit", 2).alias("days_to_limit"))


@register("m19_flaky_tests", sql="""
WITH pc AS (SELECT l_partkey, l_orderkey, bool_or(l_returnflag <> 'R') AS any_pass, bool_or(l_returnflag = 'R') AS any_fail FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, count(*) AS commits, CAST(count_if(any_pass AND any_fail) AS BIGINT) AS flaky_commits,
  round(count_if(any_pass AND any_fail) / count(*), 6) AS flake_rate FROM pc GROUP BY 1
""")
def q_m19(spark, sf):
    li = Tables(spark, sf).lineitem.withColumn("passed", F.col("l_returnflag") != "R")
    f = M.flaky_tests(li, "l_partkey", "l_orderkey", "passed")
    return f.select("l_partkey", "commits", "flaky_commits", r("flake_rate", 6).alias("flake_rate"))


@register("m20_log_correlation", sql=sql_with("spans") + """
SELECT user_id AS trace_id, count(*) AS log_lines FROM events WHERE user_id IN (SELECT trace_id FROM spans WHERE duration > 300) GROUP BY 1
""")
def q_m20(spark, sf):
    t = Tables(spark, sf)
    traces = t.derived.spans.filter(F.col("duration") > 300)  # traces that carry a slow span
    per, _ = M.log_correlation(t.events.withColumnRenamed("user_id", "trace_id"), traces, "trace_id")
    return per


@register("m20_orphan_logs", sql=sql_with("spans") + """
SELECT count(*) AS orphan_lines FROM events WHERE user_id NOT IN (SELECT trace_id FROM spans WHERE duration > 300)
""")
def q_m20o(spark, sf):
    t = Tables(spark, sf)
    traces = t.derived.spans.filter(F.col("duration") > 300)  # traces that carry a slow span
    _, orphans = M.log_correlation(t.events.withColumnRenamed("user_id", "trace_id"), traces, "trace_id")
    return orphans.agg(F.count(F.lit(1)).alias("orphan_lines"))


@register("m21_config_drift", sql="""
WITH desired AS (SELECT p_partkey AS resource, 'size' AS key, CAST(p_size AS VARCHAR) AS value FROM part
  UNION ALL SELECT p_partkey, 'brand', p_brand FROM part),
actual AS (SELECT p_partkey AS resource, 'size' AS key, CAST(p_size + CASE WHEN p_brand = 'Brand#1' THEN 1 ELSE 0 END AS VARCHAR) AS value FROM part
  UNION ALL SELECT p_partkey, 'brand', p_brand FROM part WHERE p_size > 3
  UNION ALL SELECT p_partkey, 'owner', 'ops' FROM part WHERE p_size >= 49)
SELECT key, CASE WHEN a.value IS NULL THEN 'missing' WHEN d.value IS NULL THEN 'unexpected' ELSE 'changed' END AS drift, count(*) AS n
FROM desired d FULL JOIN actual a USING (resource, key) WHERE d.value IS DISTINCT FROM a.value GROUP BY 1, 2
""")
def q_m21(spark, sf):
    p = Tables(spark, sf).part
    desired = (p.select(F.col("p_partkey").alias("resource"), F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value"))
               .unionByName(p.select(F.col("p_partkey").alias("resource"), F.lit("brand").alias("key"), F.col("p_brand").alias("value"))))
    actual = (p.select(F.col("p_partkey").alias("resource"), F.lit("size").alias("key"),
                       (F.col("p_size") + F.when(F.col("p_brand") == "Brand#1", 1).otherwise(0)).cast("string").alias("value"))
              .unionByName(p.filter(F.col("p_size") > 3).select(F.col("p_partkey").alias("resource"), F.lit("brand").alias("key"),
                                                                         F.col("p_brand").alias("value")))
              .unionByName(p.filter(F.col("p_size") >= 49).select(F.col("p_partkey").alias("resource"), F.lit("owner").alias("key"),
                                                                         F.lit("ops").alias("value"))))
    d = M.config_drift(desired, actual, ["resource", "key"])
    return d.groupBy("key", "drift").agg(F.count(F.lit(1)).alias("n"))
