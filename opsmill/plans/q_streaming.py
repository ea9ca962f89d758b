"""Registered queries for the windowed event operators (E22-E24, E26, E27, E30) run on the
batch events table; the same functions drive the streaming jobs (tests/test_streaming.py)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsmill.plans.registry import register, ts_text
from opsmill.streaming import jobs as J
from opsmill.tables import Tables

TS = "'%Y-%m-%d %H:%M:%S'"


@register("e22_tumbling_window_counts", headline=True, sql=f"""
SELECT strftime(date_trunc('hour', ts), {TS}) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total
FROM events GROUP BY 1, 2
""")
def q_e22(spark, sf):
    c = J.tumbling_counts(Tables(spark, sf).events, "ts", ["event_type"], "1 hour", "10 minutes", value="value")
    return c.select(ts_text("window_start").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@register("e23_sliding_window_rate", sql=f"""
WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS ws FROM events)
SELECT strftime(ws, {TS}) AS window_start, event_type, count(*) AS n FROM w GROUP BY 1, 2
""")
def q_e23(spark, sf):
    c = J.sliding_counts(Tables(spark, sf).events, "ts", ["event_type"], "1 hour", "30 minutes", "10 minutes")
    return c.select(ts_text("window_start").alias("window_start"), "event_type", "n")


@register("e24_session_window", sql=f"""
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new_s
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, strftime(min(ts), {TS}) AS session_start, strftime(max(ts) + INTERVAL 2 HOUR, {TS}) AS session_end, count(*) AS events
FROM s GROUP BY user_id, sid
""")
def q_e24(spark, sf):
    s = J.sessions(Tables(spark, sf).events, "ts", "user_id", "2 hours", "1 hour")
    return s.select("user_id", ts_text("session_start").alias("session_start"), ts_text("session_end").alias("session_end"), "events")


@register("e26_correlated_stream_join", sql="""
WITH p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view')
SELECT count(*) AS pairs, count(DISTINCT p.event_id) AS purchases_with_followup FROM p JOIN v ON p.user_id = v.user_id AND v.ts >= p.ts
  AND v.ts <= p.ts + INTERVAL 6 HOUR
""")
def q_e26(spark, sf):
    e = Tables(spark, sf).events
    p = e.filter(F.col("event_type") == "purchase").select("user_id", F.col("ts").alias("pts"), F.col("event_id").alias("pid"))
    v = e.filter(F.col("event_type") == "view").select("user_id", F.col("ts").alias("vts"), F.col("event_id").alias("vid"))
    j = J.correlated_join(p, v, "user_id", "pts", "vts", "6 HOURS", "1 day", "1 day")
    return j.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("pid").alias("purchases_with_followup"))


@register("e27_realtime_alert_stream", sql="""
SELECT event_id, user_id FROM events WHERE event_type = 'error' AND value > 300
""")
def q_e27(spark, sf):
    e = Tables(spark, sf).events
    return J.alerts(e, (F.col("event_type") == "error") & (F.col("value") > 300)).select("event_id", "user_id")


@register("e30_content_routing_dlq", sql="""
SELECT CASE WHEN json_valid(props) AND event_type IN ('purchase', 'signup') THEN 'billing'
  WHEN json_valid(props) AND event_type IN ('click', 'view') THEN 'analytics' ELSE 'dead_letter' END AS route, count(*) AS n FROM events GROUP BY 1
""")
def q_e30(spark, sf):
    e = Tables(spark, sf).events
    ok = F.try_parse_json("props").isNotNull()
    route = (F.when(ok & F.col("event_type").isin("purchase", "signup"), "billing")
             .when(ok & F.col("event_type").isin("click", "view"), "analytics"))
    routed = e.withColumn("route", route)
    return routed.groupBy(F.coalesce("route", F.lit("dead_letter")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@register("e14_dedupe_within_watermark", sql="SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY 1")
def q_e14w(spark, sf):
    e = Tables(spark, sf).events
    d = J.dedupe_stream(e.unionByName(e.filter(F.col("value") > 300)), "event_id", "ts", "1 hour")
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
