"""Registered queries for SURVEY 2.1 (event-log scans) and 2.9 (projections, CDC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsmill.operators import eventlog as ev
from opsmill.plans.derived import sql_with
from opsmill.plans.registry import r, register, ts_text
from opsmill.sources import eventlog as src
from opsmill.tables import Tables

TS = "'%Y-%m-%d %H:%M:%S'"


# ----------------------------------------------------------------------------- S1-S3
@register("s1_read_event_log", sql=sql_with("user_event_log") + """
SELECT global_position, stream_id, version FROM user_event_log WHERE global_position > 9000
""")
def q_s1(spark, sf):
    log = Tables(spark, sf).derived.user_event_log
    return src.after_position(log, 9000).select("global_position", "stream_id", "version")


@register("s2_read_stream_of", sql=sql_with("user_event_log") + """
SELECT global_position, version FROM user_event_log WHERE stream_id = 'User-7' AND version >= 10 ORDER BY version LIMIT 20
""")
def q_s2(spark, sf):
    log = Tables(spark, sf).derived.user_event_log
    return src.read_stream_of(log, "User-7", 10, 20).select("global_position", "version")


@register("s3_read_category", sql=sql_with("user_event_log", "order_event_log") + """
, s AS (SELECT stream_id FROM user_event_log UNION ALL SELECT 'Order-' || CAST(o_orderkey AS VARCHAR) FROM order_event_log)
SELECT split_part(stream_id, '-', 1) AS category, count(*) AS n, count(DISTINCT stream_id) AS streams FROM s GROUP BY 1
""")
def q_s3(spark, sf):
    d = Tables(spark, sf).derived
    s = d.user_event_log.select("stream_id").unionByName(
        d.order_event_log.select(F.concat(F.lit("Order-"), F.col("o_orderkey").cast("string")).alias("stream_id")))
    return s.groupBy(src.category_of().alias("category")).agg(F.count(F.lit(1)).alias("n"),
                                                               F.countDistinct("stream_id").alias("streams"))


@register("s3_read_category_orders", sql=sql_with("order_event_log") + """
SELECT count(*) AS n FROM (SELECT 'Order-' || CAST(o_orderkey AS VARCHAR) AS stream_id FROM order_event_log) WHERE starts_with(stream_id, 'Order-')
""")
def q_s3o(spark, sf):
    d = Tables(spark, sf).derived
    s = d.order_event_log.select(F.concat(F.lit("Order-"), F.col("o_orderkey").cast("string")).alias("stream_id"))
    return src.read_category(s, "Order").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------------------- E1
@register("e1_append_with_expected_version", sql=sql_with("user_event_log") + """
, cur AS (SELECT stream_id, max(version) AS cv FROM user_event_log WHERE created_at < TIMESTAMP '2024-01-20' GROUP BY 1),
expct AS (SELECT user_id, count(*) - CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS expected FROM events
  WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1),
b AS (SELECT 'User-' || CAST(e.user_id AS VARCHAR) AS stream_id, e.event_id, e.ts, coalesce(x.expected, 0) AS expected
  FROM events e LEFT JOIN expct x USING (user_id) WHERE e.ts >= TIMESTAMP '2024-01-20'),
j AS (SELECT b.*, coalesce(cv, 0) AS cv FROM b LEFT JOIN cur USING (stream_id))
SELECT stream_id, CASE WHEN min(CASE WHEN expected = cv THEN 1 ELSE 0 END) = 1 THEN 'accepted' ELSE 'conflict' END AS status,
  count(*) AS n_events, CAST(CASE WHEN min(CASE WHEN expected = cv THEN 1 ELSE 0 END) = 1 THEN max(cv) + 1 ELSE 0 END AS BIGINT) AS first_version,
  CAST(CASE WHEN min(CASE WHEN expected = cv THEN 1 ELSE 0 END) = 1 THEN max(cv) + count(*) ELSE 0 END AS BIGINT) AS last_version
FROM j GROUP BY stream_id
""")
def q_e1(spark, sf):
    t = Tables(spark, sf)
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    log = t.derived.user_event_log.filter(F.col("created_at") < cut)
    e = t.events
    expct = e.filter(F.col("ts") < cut).groupBy("user_id").agg(
        (F.count(F.lit(1)) - F.when(F.col("user_id") % 5 == 0, 1).otherwise(0)).alias("expected_version"))
    batch = (e.filter(F.col("ts") >= cut).join(expct, "user_id", "left")
             .select(F.concat(F.lit("User-"), F.col("user_id").cast("string")).alias("stream_id"), "event_id",
                     F.col("ts").alias("created_at"), F.coalesce("expected_version", F.lit(0)).alias("expected_version")))
    acc, conf = ev.append_with_expected_version(batch, log, order=["created_at", "event_id"])
    a = acc.groupBy("stream_id").agg(F.lit("accepted").alias("status"), F.count(F.lit(1)).alias("n_events"),
                                     F.min("version").alias("first_version"), F.max("version").alias("last_version"))
    c = conf.groupBy("stream_id").agg(F.lit("conflict").alias("status"), F.count(F.lit(1)).alias("n_events"),
                                      F.lit(0).cast("long").alias("first_version"), F.lit(0).cast("long").alias("last_version"))
    return a.unionByName(c)


# ----------------------------------------------------------------------------- E2 / E7 / E8 / E12
def _user_handlers():
    return {"purchase": {"orders": F.lit(1), "spent": F.col("value")}, "signup": {"signups": F.lit(1)}}


FOLD_SQL = """SELECT stream_id, CAST(count_if(event_type = 'purchase') AS BIGINT) AS orders,
  round(coalesce(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 0), 2) AS spent,
  CAST(count_if(event_type = 'signup') AS BIGINT) AS signups, count(*) AS events_applied, max(version) AS last_event_version
FROM user_event_log WHERE event_type IN ('purchase', 'signup') GROUP BY stream_id"""


def _fold(log):
    f = ev.projection_fold(log, "stream_id", _user_handlers())
    v = log.filter(F.col("event_type").isin("purchase", "signup")).groupBy("stream_id").agg(
        F.max("version").alias("last_event_version"))
    return f.join(v, "stream_id")


def _fold_out(df):
    return df.select("stream_id", F.col("orders").cast("long").alias("orders"), r("spent").alias("spent"),
                     F.col("signups").cast("long").alias("signups"), F.col("events_applied").cast("long").alias("events_applied"),
                     "last_event_version")


@register("e2_projection_fold", sql=sql_with("user_event_log") + FOLD_SQL)
def q_e2(spark, sf):
    return _fold_out(_fold(Tables(spark, sf).derived.user_event_log))


@register("e7_projection_checkpoint", sql=sql_with("user_event_log") + FOLD_SQL)
def q_e7(spark, sf):
    """Two runs: up to the stored position, then only the events after it, merged."""
    log = Tables(spark, sf).derived.user_event_log
    cp = ev.checkpoint_position(log.filter(F.col("global_position") <= 5000))
    first = _fold(log.filter(F.col("global_position") <= 5000))
    pos = cp.select("last_position").scalar()
    second = _fold(log.filter(F.col("global_position") > pos))
    merged = ev.incremental_merge(first, second, "stream_id", ["orders", "spent", "signups", "events_applied"])
    return _fold_out(merged)


@register("e8_projection_rebuild", sql=sql_with("user_event_log") + FOLD_SQL)
def q_e8(spark, sf):
    """Rebuild = replay of the whole log into an empty read model."""
    return _fold_out(_fold(Tables(spark, sf).derived.user_event_log))


@register("e12_snapshot_and_replay", sql=sql_with("user_event_log") + FOLD_SQL)
def q_e12(spark, sf):
    log = Tables(spark, sf).derived.user_event_log
    snap = _fold(log.filter(F.col("version") <= 30))
    tail = _fold(log.filter(F.col("version") > 30))
    return _fold_out(ev.incremental_merge(snap, tail, "stream_id", ["orders", "spent", "signups", "events_applied"]))


# ----------------------------------------------------------------------------- E3 / E4
E3_SQL = """SELECT o_orderkey,
  arg_max(CASE event_type WHEN 'OrderCreated' THEN 'pending' WHEN 'OrderShipped' THEN 'shipped' WHEN 'OrderCompleted' THEN 'completed'
    WHEN 'OrderCancelled' THEN 'cancelled' END, version) FILTER (WHERE event_type IN ('OrderCreated', 'OrderShipped', 'OrderCompleted', 'OrderCancelled')) AS status,
  coalesce(sum(CASE WHEN event_type = 'OrderItemAdded' THEN amount WHEN event_type = 'OrderItemRemoved' THEN -amount END), 0) AS total_amount,
  CAST(count_if(event_type = 'OrderItemAdded') - count_if(event_type = 'OrderItemRemoved') AS BIGINT) AS item_count,
  min(event_time) FILTER (WHERE event_type = 'OrderCreated') AS created_at,
  arg_max(event_time, version) FILTER (WHERE event_type = 'OrderShipped') AS shipped_at,
  arg_max(event_time, version) FILTER (WHERE event_type = 'OrderCompleted') AS completed_at,
  arg_max(event_time, version) FILTER (WHERE event_type = 'OrderCancelled') AS cancelled_at,
  max(version) AS last_event_version
FROM order_event_log GROUP BY o_orderkey HAVING count_if(event_type = 'OrderCreated') > 0"""


@register("e3_order_summary_projection", headline=True, sql=sql_with("order_event_log") + f"""
SELECT o_orderkey, status, round(total_amount, 2) + 0.0 AS total_amount, item_count, strftime(created_at, {TS}) AS created_at,
  strftime(shipped_at, {TS}) AS shipped_at, strftime(completed_at, {TS}) AS completed_at, strftime(cancelled_at, {TS}) AS cancelled_at,
  last_event_version FROM ({E3_SQL})
""")
def q_e3(spark, sf):
    rows, _ = ev.order_summary_projection(Tables(spark, sf).derived.order_event_log)
    return rows.select("o_orderkey", "status", r("total_amount").alias("total_amount"), "item_count",
                       *[ts_text(c).alias(c) for c in ("created_at", "shipped_at", "completed_at", "cancelled_at")],
                       "last_event_version")


@register("e3_orphan_item_events", sql=sql_with("order_event_log") + """
SELECT count(*) AS orphan_orders FROM (SELECT o_orderkey FROM order_event_log WHERE event_time >= TIMESTAMP '1995-03-01' OR event_type <> 'OrderCreated'
  GROUP BY 1 HAVING count_if(event_type = 'OrderCreated') = 0)
""")
def q_e3o(spark, sf):
    log = Tables(spark, sf).derived.order_event_log
    # orders created before March 1995 lost their creation event: their item events are orphans
    log = log.filter((F.col("event_time") >= F.lit("1995-03-01").cast("timestamp_ntz")) | (F.col("event_type") != "OrderCreated"))
    _, orphans = ev.order_summary_projection(log)
    return orphans.agg(F.count(F.lit(1)).alias("orphan_orders"))


@register("e4_daily_sales_projection", sql=sql_with("order_event_log") + f"""
, s AS ({E3_SQL}),
comp AS (SELECT CAST(completed_at AS DATE) AS d, total_amount, item_count FROM s WHERE completed_at IS NOT NULL),
rf AS (SELECT CAST(s.completed_at AS DATE) AS d, e.amount FROM order_event_log e JOIN s USING (o_orderkey)
  WHERE e.event_type = 'OrderItemRemoved' AND s.completed_at IS NOT NULL),
u AS (SELECT d, 1 AS o, total_amount AS rev, item_count AS it, 0.0 AS rfd FROM comp
  UNION ALL SELECT d, -1, -amount, 0, amount FROM rf WHERE d IN (SELECT d FROM comp))
SELECT strftime(d, '%Y-%m-%d') AS date, CAST(sum(o) AS BIGINT) AS total_orders, round(sum(rev), 2) AS total_revenue,
  CAST(sum(it) AS BIGINT) AS total_items, round(sum(rfd), 2) AS total_refunds FROM u GROUP BY d
""")
def q_e4(spark, sf):
    log = Tables(spark, sf).derived.order_event_log
    rows, _ = ev.order_summary_projection(log)
    completed = rows.filter(F.col("completed_at").isNotNull())
    refunds = (log.filter(F.col("event_type") == "OrderItemRemoved").select("o_orderkey", F.col("amount").alias("refund_amount"))
               .join(completed.select("o_orderkey", F.col("completed_at").alias("original_completed_at")), "o_orderkey"))
    out, _ = ev.daily_sales_projection(completed, refunds)
    return out.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "total_orders", r("total_revenue").alias("total_revenue"),
                      "total_items", r("total_refunds").alias("total_refunds"))


# ----------------------------------------------------------------------------- E5 / E6
E5_MAP = {"signup": "CustomerCreated", "purchase": "OrderCompleted", "view": "ReviewSubmitted", "error": "CustomerTierChanged"}


def _e5(spark, sf):
    log = Tables(spark, sf).derived.user_event_log.withColumn(
        "new_tier", F.when(F.col("value") > 100, "gold").otherwise("silver"))
    return ev.customer_activity_projection(log, "stream_id", "created_at", "version", E5_MAP, "value", "new_tier")


@register("e5_customer_activity_summary", sql=sql_with("user_event_log") + f"""
SELECT stream_id, CAST(count_if(event_type = 'purchase') AS BIGINT) AS total_orders,
  round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 2) AS total_spent,
  CAST(count_if(event_type = 'view') AS BIGINT) AS total_reviews,
  strftime(max(created_at) FILTER (WHERE event_type = 'purchase'), {TS}) AS last_order_at,
  strftime(max(created_at) FILTER (WHERE event_type = 'view'), {TS}) AS last_review_at
FROM user_event_log GROUP BY stream_id HAVING count_if(event_type = 'signup') > 0
""")
def q_e5(spark, sf):
    s = _e5(spark, sf)["summary"]
    return s.select("stream_id", "total_orders", r("total_spent").alias("total_spent"), "total_reviews",
                    ts_text("last_order_at").alias("last_order_at"), ts_text("last_review_at").alias("last_review_at"))


@register("e5_customer_tiers", sql=sql_with("user_event_log") + f"""
SELECT stream_id, strftime(min(created_at) FILTER (WHERE event_type = 'signup'), {TS}) AS created_at,
  coalesce(arg_max(CASE WHEN value > 100 THEN 'gold' ELSE 'silver' END, version) FILTER (WHERE event_type = 'error'), 'standard') AS tier
FROM user_event_log GROUP BY stream_id HAVING count_if(event_type = 'signup') > 0
""")
def q_e5t(spark, sf):
    c = _e5(spark, sf)["customers"]
    return c.select("stream_id", ts_text("created_at").alias("created_at"), "tier")


@register("e5_order_history", sql=sql_with("user_event_log") + f"""
SELECT stream_id, strftime(created_at, {TS}) AS completed_at, value AS total_amount FROM user_event_log WHERE event_type = 'purchase'
""")
def q_e5h(spark, sf):
    h = _e5(spark, sf)["history"]
    return h.select("stream_id", ts_text("completed_at").alias("completed_at"), "total_amount")


@register("e6_search_document_projection", sql=sql_with("user_event_log") + """
, e AS (SELECT stream_id, version, event_type, CASE WHEN event_type = 'click' THEN 't' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS title,
  CASE WHEN event_type = 'purchase' THEN value END AS price FROM user_event_log),
lc AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN version END) OVER (PARTITION BY stream_id) AS last_create FROM e),
live AS (SELECT * FROM lc WHERE version >= last_create)
SELECT stream_id, arg_max(title, version) FILTER (WHERE title IS NOT NULL) AS title,
  arg_max(price, version) FILTER (WHERE price IS NOT NULL) AS price
FROM live GROUP BY stream_id HAVING arg_max(event_type, version) FILTER (WHERE event_type IN ('signup', 'error')) = 'signup'
""")
def q_e6(spark, sf):
    log = Tables(spark, sf).derived.user_event_log.select(
        "stream_id", "version", "event_type",
        F.when(F.col("event_type") == "click", F.concat(F.lit("t"), F.floor("value").cast("long").cast("string"))).alias("title"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("price"))
    return ev.search_document_projection(log, "stream_id", ["version"], ["title", "price"], "signup", "error").select(
        "stream_id", "title", "price")


# ----------------------------------------------------------------------------- E9-E11, E13, E14
@register("e9_projection_error_skip", sql="""
WITH x AS (SELECT list_filter([CASE WHEN value > 300 THEN 'amount_over_limit' END, CASE WHEN props IS NULL THEN 'missing_props' END,
  CASE WHEN event_type = 'purchase' AND value < 1 THEN 'tiny_purchase' END], lambda y: y IS NOT NULL) AS errors FROM events),
u AS (SELECT 'valid' AS outcome FROM x WHERE len(errors) = 0 UNION ALL SELECT unnest(errors) AS outcome FROM x WHERE len(errors) > 0)
SELECT outcome, count(*) AS n FROM u GROUP BY 1
""")
def q_e9(spark, sf):
    e = Tables(spark, sf).events
    rules = {"amount_over_limit": F.col("value") > 300, "missing_props": F.col("props").isNull(),
             "tiny_purchase": (F.col("event_type") == "purchase") & (F.col("value") < 1)}
    good, dead = ev.split_valid(e, rules)
    g = good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("valid").alias("outcome"), "n")
    d = dead.select(F.explode("errors").alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    return g.unionByName(d)


@register("e10_read_your_writes", sql=sql_with("user_event_log") + """
, p AS (SELECT stream_id, max(version) AS last_event_version FROM user_event_log WHERE created_at < TIMESTAMP '2024-01-25' GROUP BY 1),
x AS (SELECT stream_id, max(version) AS expected_version FROM user_event_log GROUP BY 1)
SELECT stream_id, last_event_version, expected_version, coalesce(last_event_version < expected_version, false) AS stale FROM p LEFT JOIN x USING (stream_id)
""")
def q_e10(spark, sf):
    log = Tables(spark, sf).derived.user_event_log
    proj = log.filter(F.col("created_at") < F.lit("2024-01-25").cast("timestamp_ntz")).groupBy("stream_id").agg(
        F.max("version").alias("last_event_version"))
    expected = log.groupBy("stream_id").agg(F.max("version").alias("expected_version"))
    return ev.with_staleness(proj, expected, "stream_id").select("stream_id", "last_event_version", "expected_version", "stale")


@register("e11_projection_lag", sql=sql_with("user_event_log") + """
SELECT max(global_position) AS head_position, (SELECT max(global_position) FROM user_event_log WHERE global_position <= 8000) AS last_position,
  max(global_position) - (SELECT max(global_position) FROM user_event_log WHERE global_position <= 8000) AS lag_events,
  CAST(floor(epoch(max(created_at))) - floor(epoch(max(created_at) FILTER (WHERE global_position <= 8000))) AS BIGINT) AS lag_seconds,
  count(*) FILTER (WHERE global_position <= 8000) AS projected FROM user_event_log
""")
def q_e11(spark, sf):
    log = Tables(spark, sf).derived.user_event_log
    cp = ev.checkpoint_position(log.filter(F.col("global_position") <= 8000))
    lag = ev.projection_lag(log, cp)
    return lag.select("head_position", "last_position", "lag_events", "lag_seconds", F.col("projected").cast("long").alias("projected"))


@register("e13_event_upcasting", sql="""
WITH v AS (SELECT event_id, 1 + event_id % 2 AS schema_version,
  CASE WHEN event_id % 2 = 0 THEN props ELSE replace(props, '"k"', '"count"') END AS payload FROM events)
SELECT event_id, CASE WHEN schema_version = 1 THEN CAST(json_extract_string(payload, '$.k') AS INTEGER)
  ELSE CAST(json_extract_string(payload, '$.count') AS INTEGER) END AS count,
  CASE WHEN schema_version = 1 THEN 'items' ELSE coalesce(json_extract_string(payload, '$.unit'), 'items') END AS unit FROM v
""")
def q_e13(spark, sf):
    e = Tables(spark, sf).events.select(
        "event_id", (F.col("event_id") % 2 + 1).alias("schema_version"),
        F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.replace("props", F.lit('"k"'), F.lit('"count"'))).alias("payload"))
    up = {1: {"count": F.get_json_object("payload", "$.k").cast("int"), "unit": F.lit("items")},
          2: {"count": F.get_json_object("payload", "$.count").cast("int"),
              "unit": F.coalesce(F.get_json_object("payload", "$.unit"), F.lit("items"))}}
    return ev.upcast(e, "schema_version", "payload", up, ["count", "unit"]).select("event_id", "count", "unit")


@register("e14_idempotent_consume", sql="""
SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY 1
""")
def q_e14(spark, sf):
    e = Tables(spark, sf).events.select("event_id", "event_type")
    redelivered = e.unionByName(e.filter(F.col("value") > 200))  # large events delivered twice
    return ev.idempotent(redelivered).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------------------- E15-E17
@register("e15_cdc_apply", sql=sql_with("cdc_feed") + f"""
, last AS (SELECT pk, arg_max(op, (ts, event_id)) AS op, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM cdc_feed GROUP BY pk)
SELECT pk, op, value, strftime(ts, {TS}) AS ts FROM last WHERE op <> 'd'
""")
def q_e15(spark, sf):
    feed = Tables(spark, sf).derived.cdc_feed.select("pk", "op", "value", "ts", "event_id")
    out = ev.cdc_apply(feed, "pk", ["ts", "event_id"])
    return out.select("pk", "op", "value", ts_text("ts").alias("ts"))


@register("e15_cdc_apply_to_target", sql=sql_with("cdc_feed") + """
, tgt AS (SELECT c_custkey AS pk, 'seed' AS op, c_acctbal AS value FROM customer),
last AS (SELECT pk, arg_max(op, (ts, event_id)) AS op, arg_max(value, (ts, event_id)) AS value FROM cdc_feed GROUP BY pk)
SELECT pk, op, value FROM tgt WHERE pk NOT IN (SELECT pk FROM last) UNION ALL SELECT pk, op, value FROM last WHERE op <> 'd'
""")
def q_e15t(spark, sf):
    t = Tables(spark, sf)
    tgt = t.customer.select(F.col("c_custkey").alias("pk"), F.lit("seed").alias("op"), F.col("c_acctbal").alias("value"))
    feed = t.derived.cdc_feed.select("pk", "op", "value", "ts", "event_id")
    return ev.cdc_apply(feed, "pk", ["ts", "event_id"], target=tgt)


@register("e16_cdc_metrics", sql=sql_with("cdc_feed") + """
SELECT source_db, table_name, op, count(*) AS events_total FROM cdc_feed GROUP BY ALL
""")
def q_e16(spark, sf):
    return ev.cdc_metrics(Tables(spark, sf).derived.cdc_feed)


@register("e16_replication_lag", sql=sql_with("cdc_feed") + """
, tgt AS (SELECT table_name, ts FROM cdc_feed WHERE ts < TIMESTAMP '2024-01-30 12:00:00')
SELECT s.table_name, CAST(floor(epoch(max(s.ts))) - floor(epoch((SELECT max(ts) FROM tgt))) AS BIGINT) AS lag_seconds FROM cdc_feed s GROUP BY 1
""")
def q_e16l(spark, sf):
    feed = Tables(spark, sf).derived.cdc_feed
    tgt = feed.filter(F.col("ts") < F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))
    return ev.replication_lag(feed, tgt, "table_name", "ts").select("table_name", "lag_seconds")


@register("e17_dual_write_sync", sql="""
WITH mirror AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal < 5000),
src AS (SELECT c_custkey AS id, upper(c_name) AS name, c_acctbal AS balance FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT * FROM mirror WHERE id NOT IN (SELECT id FROM src) UNION ALL SELECT * FROM src
""")
def q_e17(spark, sf):
    c = Tables(spark, sf).customer
    mirror = c.filter(F.col("c_acctbal") < 5000).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                                                        F.col("c_acctbal").alias("balance"))
    source = c.filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey", F.upper("c_name").alias("c_name"), "c_acctbal")
    return ev.dual_write(source, mirror, {"c_custkey": "id", "c_name": "name", "c_acctbal": "balance"}, "id")


@register("e25_late_data_policy", sql="""
WITH x AS (SELECT *, epoch_us(ts) AS t, max(epoch_us(ts)) OVER (ORDER BY (user_id % 4) * 1000000000 + event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events)
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, event_type, value, props, (user_id % 4) * 1000000000 + event_id AS arrival,
  coalesce(seen - 86400000000, -1) AS watermark_us, coalesce(t < seen - 86400000000, false) AS late FROM x
""")
def q_e25(spark, sf):
    """Producers deliver in bursts (one user group after another): arrival position =
    group x 10^9 + event id. Events more than one day behind the latest event time already
    delivered would be dropped by a one-day watermark."""
    e = Tables(spark, sf).events.withColumn("arrival", (F.col("user_id") % 4) * 1000000000 + F.col("event_id"))
    late = ev.late_events(e, "arrival", "ts", 86400)
    return late.withColumn("ts", ts_text("ts")).withColumn("watermark_us", F.coalesce("watermark_us", F.lit(-1)))
