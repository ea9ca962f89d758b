"""Registered queries for the ordered folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmill.operators import folds
from opsmill.plans.derived import sql_with
from opsmill.plans.registry import register, ts_text
from opsmill.tables import Tables

CHAIN_SECRET = "audit-secret"


R12_SQL = sql_with("controls") + """
, items AS (SELECT layer_no AS plan_id, control_id, cost, 6000.0 AS budget,
    row_number() OVER (PARTITION BY layer_no ORDER BY -(effectiveness / cost), control_id) AS rn
  FROM controls WHERE status_no = 0 AND effectiveness > 0 AND cost <= 6000.0)
SELECT plan_id, control_id, selected, remaining FROM (
  WITH RECURSIVE walk(plan_id, rn, control_id, selected, remaining) AS (
    SELECT plan_id, rn, control_id, cost <= budget, CASE WHEN cost <= budget THEN budget - cost ELSE budget END FROM items WHERE rn = 1
    UNION ALL
    SELECT i.plan_id, i.rn, i.control_id, i.cost <= w.remaining, CASE WHEN i.cost <= w.remaining THEN w.remaining - i.cost ELSE w.remaining END
    FROM walk w JOIN items i ON i.plan_id = w.plan_id AND i.rn = w.rn + 1)
  SELECT * FROM walk)
"""


@register("r12_greedy_budget", headline=True, sql=R12_SQL)
def q_r12(spark, sf):
    """Per plan (layer), not-implemented controls by effectiveness per cost, budget 6000."""
    c = Tables(spark, sf).derived.controls
    items = (c.filter((F.col("status_no") == 0) & (F.col("effectiveness") > 0))
             .select(F.col("layer_no").alias("plan_id"), "control_id", "cost", (F.col("effectiveness") / F.col("cost")).alias("value"),
                     F.lit(6000.0).alias("budget")))
    return folds.greedy_budget(items, "plan_id", "control_id", "value", "cost", "budget")


@register("e21_sliding_rate_limit", sql=sql_with("call_log") + """
, c AS (SELECT service, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY service ORDER BY ts, event_id) AS rn FROM call_log)
SELECT service, event_id, accepted FROM (
  WITH RECURSIVE walk(service, rn, event_id, t, accepted, a1, a2) AS (
    SELECT service, rn, event_id, t, true, CAST(NULL AS DOUBLE), t FROM c WHERE rn = 1
    UNION ALL
    SELECT c.service, c.rn, c.event_id, c.t,
      NOT coalesce(w.a1 >= c.t - 3600.0, false),
      CASE WHEN NOT coalesce(w.a1 >= c.t - 3600.0, false) THEN w.a2 ELSE w.a1 END,
      CASE WHEN NOT coalesce(w.a1 >= c.t - 3600.0, false) THEN c.t ELSE w.a2 END
    FROM walk w JOIN c ON c.service = w.service AND c.rn = w.rn + 1)
  SELECT * FROM walk)
""")
def q_e21(spark, sf):
    calls = Tables(spark, sf).derived.call_log
    return folds.sliding_rate_limit(calls, "service", "ts", "event_id", max_rps=2, window_seconds=3600.0)


@register("e29_throttle_first", sql=sql_with("call_log") + """
, c AS (SELECT service, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY service ORDER BY ts, event_id) AS rn FROM call_log)
SELECT service, event_id, emitted FROM (
  WITH RECURSIVE walk(service, rn, event_id, emitted, last) AS (
    SELECT service, rn, event_id, true, t FROM c WHERE rn = 1
    UNION ALL
    SELECT c.service, c.rn, c.event_id, c.t - w.last >= 1800.0, CASE WHEN c.t - w.last >= 1800.0 THEN c.t ELSE w.last END
    FROM walk w JOIN c ON c.service = w.service AND c.rn = w.rn + 1)
  SELECT * FROM walk)
""")
def q_e29(spark, sf):
    calls = Tables(spark, sf).derived.call_log
    return folds.throttle_first(calls, "service", "ts", "event_id", 1800.0)


@register("e28_debounce_events", sql=sql_with("call_log") + """
SELECT service, event_id, lead(ts) OVER w IS NULL OR epoch_us(lead(ts) OVER w) - epoch_us(ts) >= 900000000 AS emitted
FROM call_log WINDOW w AS (PARTITION BY service ORDER BY ts, event_id)
""")
def q_e28(spark, sf):
    calls = Tables(spark, sf).derived.call_log
    return folds.debounce(calls, "service", "ts", "event_id", 900.0).select("service", "event_id", "emitted")


@register("e28_debounce_bursts", sql=sql_with("call_log") + """
SELECT service, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, ok FROM (
  SELECT *, lead(ts) OVER w IS NULL OR epoch_us(lead(ts) OVER w) - epoch_us(ts) >= 900000000 AS emitted FROM call_log WINDOW w AS (PARTITION BY service ORDER BY ts, event_id))
WHERE emitted
""")
def q_e28_bursts(spark, sf):
    """The session form that also runs on a stream: the last call of each burst with its columns."""
    from opsmill.streaming import jobs as J

    b = J.debounce_stream(Tables(spark, sf).derived.call_log, "ts", "service", "event_id", 900.0, "1 hour")
    return b.select("service", "event_id", ts_text("ts").alias("ts"), "ok")


@register("e25_ordered_stream", sql="""
WITH c AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE ts < (SELECT max(ts) FROM events))
SELECT user_id, event_id, emitted FROM (
  WITH RECURSIVE walk(user_id, rn, event_id, emitted, last) AS (
    SELECT user_id, rn, event_id, true, t FROM c WHERE rn = 1
    UNION ALL
    SELECT c.user_id, c.rn, c.event_id, c.t - w.last >= 86400.0, CASE WHEN c.t - w.last >= 86400.0 THEN c.t ELSE w.last END
    FROM walk w JOIN c ON c.user_id = w.user_id AND c.rn = w.rn + 1)
  SELECT * FROM walk)
""")
def q_e25_ordered(spark, sf):
    """The event table as a stream, throttled in event order: each row waits for the watermark, which ends
    at the latest event (whose own rows still wait)."""
    from opsmill.session import scratch_path
    from opsmill.streaming import jobs as J

    place = scratch_path(spark, "ordered")
    table = spark.read.parquet(f"{sf}/events.parquet").select("ts", "user_id", "event_id")
    table.write.parquet(f"{place}/in")  # a stream reads folders
    s = J.file_stream(spark, f"{place}/in", table.schema)
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("emitted", T.BooleanType())])
    out = J.ordered_stream(s, ["user_id"], "ts", ["event_id"], folds.ThrottleFirst("ts", ["user_id", "event_id"], 86400.0), schema, "0 seconds")
    J.run_available_now(out, f"{place}/checkpoint", J.split_late(f"{place}/folded", f"{place}/late"))
    return spark.read.parquet(f"{place}/folded").drop("batch")


def _breaker_sql(variant: str, failures: int = 3, timeout: float = 3600.0, successes: int = 2) -> str:
    """Recursive replay of the breaker: state (st, f, s, opened) is carried row by row."""
    strict = variant == "strict"
    s0 = "w.s" if strict else f"CASE WHEN w.st = 'open' AND c.t - w.opened >= {timeout} THEN 0 ELSE w.s END"
    f_half_ok = "f" if strict else "0"
    closed_ok_f = "0" if strict else "f"
    half_fail_open = "eff = 'half_open' OR " if strict else ""
    return sql_with("call_log") + f"""
, c AS (SELECT service, event_id, epoch(ts) AS t, ok, row_number() OVER (PARTITION BY service ORDER BY ts, event_id) AS rn FROM call_log)
SELECT service, state, allowed, count(*) AS n FROM (
  WITH RECURSIVE walk(service, rn, state, allowed, st, f, s, opened) AS (
    SELECT service, 0, CAST(NULL AS VARCHAR), CAST(NULL AS BOOLEAN), 'closed', 0, 0, CAST(NULL AS DOUBLE) FROM (SELECT DISTINCT service FROM c)
    UNION ALL
    SELECT service, rn, eff, eff <> 'open',
      CASE WHEN eff = 'open' THEN 'open'
           WHEN ok AND eff = 'half_open' AND s0 + 1 >= {successes} THEN 'closed'
           WHEN ok THEN eff
           WHEN {half_fail_open}f + 1 >= {failures} THEN 'open' ELSE eff END,
      CASE WHEN eff = 'open' THEN f
           WHEN ok AND eff = 'half_open' AND s0 + 1 >= {successes} THEN 0
           WHEN ok AND eff = 'half_open' THEN {f_half_ok}
           WHEN ok THEN {closed_ok_f} ELSE f + 1 END,
      CASE WHEN eff = 'open' THEN s0
           WHEN ok AND eff = 'half_open' AND s0 + 1 >= {successes} THEN 0
           WHEN ok AND eff = 'half_open' THEN s0 + 1 ELSE s0 END,
      CASE WHEN eff <> 'open' AND NOT ok AND ({half_fail_open}f + 1 >= {failures}) THEN t ELSE opened END
    FROM (SELECT c.service, c.rn, c.t, c.ok, w.st, w.f, w.opened, {s0} AS s0,
            CASE WHEN w.st = 'open' AND c.t - w.opened >= {timeout} THEN 'half_open' ELSE w.st END AS eff
          FROM walk w JOIN c ON c.service = w.service AND c.rn = w.rn + 1) x)
  SELECT * FROM walk WHERE rn > 0) GROUP BY 1, 2, 3
"""


@register("e20_circuit_breaker_state", sql=_breaker_sql("counting"))
def q_e20(spark, sf):
    calls = Tables(spark, sf).derived.call_log
    b = folds.circuit_breaker(calls, "service", "ts", "event_id", "ok", variant="counting", failure_threshold=3,
                              timeout_seconds=3600.0)
    return b.groupBy("service", "state", "allowed").agg(F.count(F.lit(1)).alias("n"))


@register("e20_circuit_breaker_strict", sql=_breaker_sql("strict"))
def q_e20s(spark, sf):
    calls = Tables(spark, sf).derived.call_log
    b = folds.circuit_breaker(calls, "service", "ts", "event_id", "ok", variant="strict", failure_threshold=3,
                              timeout_seconds=3600.0)
    return b.groupBy("service", "state", "allowed").agg(F.count(F.lit(1)).alias("n"))


def _saga_steps(t):
    li = t.lineitem
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    status = (F.when(F.col("l_linestatus") == "F", "completed")
              .when(F.col("l_returnflag") == "R", "failed").otherwise("executing"))
    return li.select(F.col("l_orderkey").alias("saga_id"), F.row_number().over(w).alias("step_no"), status.alias("status"),
                     F.col("l_shipdate").alias("started_at"))


SAGA_CTE = """
WITH s AS (SELECT l_orderkey AS saga_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
    l_extendedprice, l_quantity) AS step_no,
  CASE WHEN l_linestatus = 'F' THEN 'completed' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'executing' END AS status, l_shipdate AS started_at
  FROM lineitem),
f AS (SELECT *, status = 'failed' OR (status = 'executing' AND epoch(TIMESTAMP '1996-01-01') - epoch(started_at) >= 300) AS failed,
  status = 'executing' AND epoch(TIMESTAMP '1996-01-01') - epoch(started_at) >= 300 AS timed_out FROM s),
g AS (SELECT saga_id, count(*) AS steps, count_if(status = 'completed') AS completed, min(step_no) FILTER (WHERE failed) AS failed_step,
  count_if(timed_out) AS timed_out FROM f GROUP BY 1)
"""

SAGA_SQL = SAGA_CTE + """
, b AS (SELECT f.saga_id, count(*) FILTER (WHERE f.status = 'completed') AS to_compensate,
  max(f.step_no) FILTER (WHERE f.status = 'completed') AS first_to_compensate FROM f JOIN g USING (saga_id) WHERE f.step_no < g.failed_step GROUP BY 1)
SELECT saga_id, steps, CAST(completed AS BIGINT) AS completed, coalesce(failed_step, 0) AS failed_step, CAST(timed_out AS BIGINT) AS timed_out,
  CASE WHEN failed_step IS NOT NULL AND coalesce(to_compensate, 0) = 0 THEN 'compensated' WHEN failed_step IS NOT NULL THEN 'compensating'
    WHEN completed = steps THEN 'completed' WHEN completed > 0 THEN 'running' ELSE 'pending' END AS state,
  CAST(coalesce(to_compensate, 0) AS BIGINT) AS to_compensate, coalesce(first_to_compensate, 0) AS first_to_compensate
FROM g LEFT JOIN b USING (saga_id)
"""


@register("e18_saga_state", sql=SAGA_SQL)
def q_e18(spark, sf):
    s = folds.saga_state(_saga_steps(Tables(spark, sf)), "saga_id", "step_no", "status", "started_at", as_of="1996-01-01")
    return s.select("saga_id", "steps", "completed", F.coalesce("failed_step", F.lit(0)).cast("long").alias("failed_step"), "timed_out",
                    "state", F.col("to_compensate").cast("long").alias("to_compensate"),
                    F.coalesce("first_to_compensate", F.lit(0)).cast("long").alias("first_to_compensate"))


@register("e18_compensation_plan", sql=SAGA_CTE + """
SELECT f.saga_id, f.step_no, row_number() OVER (PARTITION BY f.saga_id ORDER BY f.step_no DESC) AS compensation_order
FROM f JOIN g USING (saga_id) WHERE f.step_no < g.failed_step AND f.status = 'completed'
""")
def q_e18p(spark, sf):
    p = folds.compensation_plan(_saga_steps(Tables(spark, sf)), "saga_id", "step_no", "status", "started_at", as_of="1996-01-01")
    return p.select("saga_id", F.col("step_no").cast("long").alias("step_no"), "compensation_order")


@register("e19_saga_timeout", sql=SAGA_CTE + """
SELECT CAST(count(*) AS BIGINT) AS sagas, CAST(count_if(timed_out > 0) AS BIGINT) AS with_timeouts FROM g
""")
def q_e19(spark, sf):
    s = folds.saga_state(_saga_steps(Tables(spark, sf)), "saga_id", "step_no", "status", "started_at", as_of="1996-01-01")
    return s.agg(F.count(F.lit(1)).alias("sagas"), F.count_if(F.col("timed_out") > 0).alias("with_timeouts"))


@register("g10_hash_chain", sql=f"""
WITH c AS (SELECT user_id, event_id, '{{"event_id": ' || CAST(event_id AS VARCHAR) || ', "event_type": "' || event_type || '", "value": '
    || CAST(value AS VARCHAR) || '}}' AS content, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
SELECT user_id, event_id, checksum FROM (
  WITH RECURSIVE walk(user_id, rn, event_id, checksum) AS (
    SELECT user_id, rn, event_id, sha256(content || '{CHAIN_SECRET}') FROM c WHERE rn = 1
    UNION ALL
    SELECT c.user_id, c.rn, c.event_id, sha256(w.checksum || c.content || '{CHAIN_SECRET}') FROM walk w JOIN c ON c.user_id = w.user_id AND c.rn = w.rn + 1)
  SELECT * FROM walk)
""")
def q_g10(spark, sf):
    e = Tables(spark, sf).events.select("user_id", "ts", "event_id", "event_type", "value")
    ch = folds.hash_chain(e, "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"], CHAIN_SECRET)
    return ch.select("user_id", "event_id", "checksum")


@register("g10_verify_chain", sql="""
SELECT count(*) AS rows, count(*) AS valid FROM events
""")
def q_g10v(spark, sf):
    e = Tables(spark, sf).events.select("user_id", "ts", "event_id", "event_type", "value")
    ch = folds.hash_chain(e, "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"], CHAIN_SECRET)
    ch = ch.join(e, ["user_id", "ts", "event_id"])
    content = F.format_string('{"event_id": %d, "event_type": "%s", "value": %s}', "event_id", "event_type",
                              F.regexp_replace(F.col("value").cast("string"), r"E", "e"))
    v = folds.verify_chain(ch, "user_id", ["ts", "event_id"], content, CHAIN_SECRET)
    return v.agg(F.count(F.lit(1)).alias("rows"), F.count_if("valid").alias("valid"))


@register("v4_token_budget_pack", sql="""
WITH items AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 3 WHEN 'user' THEN 2 ELSE 1 END - turn / 100.0 AS priority,
    len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS tokens FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY -priority, turn) AS rn FROM items)
SELECT conv_id, turn, selected, remaining FROM (
  WITH RECURSIVE walk(conv_id, rn, turn, selected, remaining) AS (
    SELECT conv_id, rn, turn, tokens <= 300.0, CASE WHEN tokens <= 300.0 THEN 300.0 - tokens ELSE 300.0 END FROM k WHERE rn = 1
    UNION ALL
    SELECT k.conv_id, k.rn, k.turn, k.tokens <= w.remaining, CASE WHEN k.tokens <= w.remaining THEN w.remaining - k.tokens ELSE w.remaining END
    FROM walk w JOIN k ON k.conv_id = w.conv_id AND k.rn = w.rn + 1)
  SELECT * FROM walk)
""")
def q_v4(spark, sf):
    c = Tables(spark, sf).conversations
    items = c.select("conv_id", "turn",
                     (F.when(F.col("role") == "system", 3).when(F.col("role") == "user", 2).otherwise(1) - F.col("turn") / 100.0)
                     .alias("priority"), F.size(F.split(F.col("text"), r"\s+")).alias("tokens"))
    packed = folds.token_budget_pack(items, "conv_id", "turn", "priority", "tokens", budget=300)
    return packed
