"""Registered queries for SURVEY 2.10 (extension points) and the remaining sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from opsmill.operators import extend as X
from opsmill.operators import risk as R
from opsmill.plans.derived import sql_with
from opsmill.plans.registry import r, register
from opsmill.sources import files as S
from opsmill.tables import Tables


def _normalize_name(s: pd.Series) -> pd.Series:
    return s.str.strip().str.lower().str.replace("#", "-", regex=False)


@register("x1_python_scalar_hook", sql="SELECT c_custkey, replace(lower(trim(c_name)), '#', '-') AS name FROM customer")
def q_x1(spark, sf):
    c = Tables(spark, sf).customer
    return X.apply_hook(c, "c_name", _normalize_name, "name").select("c_custkey", "name")


def _registry():
    reg = X.HandlerRegistry("event_type")
    reg.register("purchase", lambda d: d.groupBy("user_id").agg(F.lit("revenue").alias("kind"), F.sum("value").alias("amount")))
    reg.register("signup", lambda d: d.groupBy("user_id").agg(F.lit("signups").alias("kind"),
                                                               F.count(F.lit(1)).cast("double").alias("amount")))
    return reg


@register("x2_handler_registry", sql="""
SELECT user_id, 'revenue' AS kind, round(sum(value), 2) AS amount FROM events WHERE event_type = 'purchase' GROUP BY 1
UNION ALL SELECT user_id, 'signups', CAST(count(*) AS DOUBLE) FROM events WHERE event_type = 'signup' GROUP BY 1
""")
def q_x2(spark, sf):
    out = _registry().dispatch(Tables(spark, sf).events)
    return out.select("user_id", "kind", r("amount").alias("amount"))


@register("x2_unhandled_types", sql="""
SELECT event_type, count(*) AS events FROM events WHERE event_type NOT IN ('purchase', 'signup') OR event_type IS NULL GROUP BY 1
""")
def q_x2u(spark, sf):
    return _registry().unhandled(Tables(spark, sf).events)


@register("x3_pipe_compose", sql="""
SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1
""")
def q_x3(spark, sf):
    f = X.pipe(lambda d: d.filter(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")),
               lambda d: d.select("l_returnflag", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev")),
               lambda d: d.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r(F.sum("rev")).alias("revenue")))
    return f(Tables(spark, sf).lineitem)


@register("x5_table_function", sql=sql_with("threats") + """
SELECT CASE category_no WHEN 0 THEN 'SPOOFING' WHEN 1 THEN 'TAMPERING' WHEN 2 THEN 'REPUDIATION' WHEN 3 THEN 'INFORMATION_DISCLOSURE'
  WHEN 4 THEN 'DENIAL_OF_SERVICE' ELSE 'ELEVATION_OF_PRIVILEGE' END AS category, count(*) * 3 AS requirements FROM threats GROUP BY 1
""")
def q_x5(spark, sf):
    th = Tables(spark, sf).derived.threats.withColumn("category", R._lookup(R.STRIDE, F.col("category_no")))
    rows = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(i.alias("pattern_no"), F.col("threat_id").alias("tid")))
    expanded = X.table_function(th, rows, keep=["category"])
    return expanded.groupBy("category").agg(F.count(F.lit(1)).alias("requirements"))


@register("x6_custom_aggregate", sql="""
WITH x AS (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS rn,
  count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, round(avg(l_extendedprice), 4) AS trimmed_mean FROM x WHERE rn > floor(n * 0.1) AND rn <= n - floor(n * 0.1) GROUP BY 1
""")
def q_x6(spark, sf):
    t = X.trimmed_mean(Tables(spark, sf).lineitem, ["l_suppkey"], "l_extendedprice")
    return t.select("l_suppkey", r("trimmed_mean", 4).alias("trimmed_mean"))


def _median(s: pd.Series) -> float:
    return float(s.median())


@register("x6_pandas_aggregate", sql="""
SELECT c_nationkey, round(median(c_acctbal), 4) AS median_balance FROM customer GROUP BY 1
""")
def q_x6p(spark, sf):
    m = X.pandas_aggregate(Tables(spark, sf).customer, ["c_nationkey"], "c_acctbal", _median, "median_balance")
    return m.select("c_nationkey", r("median_balance", 4).alias("median_balance"))


@register("s7_range_split_read", sql="""
SELECT CAST(floor((o_orderkey - (SELECT min(o_orderkey) FROM orders)) / 1000) AS BIGINT) AS range_no, count(*) AS rows,
  min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM orders GROUP BY 1
""")
def q_s7(spark, sf):
    return S.id_ranges(Tables(spark, sf).orders, "o_orderkey", 1000)


@register("s12_export_user_data", sql="""
WITH req AS (SELECT c_custkey AS user_id FROM customer WHERE c_acctbal < -990)
SELECT user_id, (SELECT count(*) FROM orders WHERE o_custkey = user_id) AS n_orders,
  (SELECT count(*) FROM events WHERE events.user_id = req.user_id) AS n_events FROM req
""")
def q_s12(spark, sf):
    t = Tables(spark, sf)
    req = t.customer.filter(F.col("c_acctbal") < -990).select(F.col("c_custkey").alias("user_id"))
    ex = S.export_user_data(req, "user_id", {"orders": (t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey"),
                                             "events": (t.events.select("user_id", "event_id", "event_type"), "user_id")})
    return ex.select("user_id", F.size("orders").cast("long").alias("n_orders"), F.size("events").cast("long").alias("n_events"))


@register("x6_mergeable_aggregate", sql="""
SELECT l_returnflag, round(exp(avg(ln(l_extendedprice))), 4) AS geometric_mean FROM lineitem GROUP BY 1
""")
def q_x6_mergeable(spark, sf):
    """The geometric mean of three groups that hold the whole table, by (sum of logarithms, count) states."""
    import numpy as np

    li = Tables(spark, sf).lineitem
    g = X.mergeable_aggregate(li, ["l_returnflag"], "l_extendedprice", lambda v: (float(np.log(v).sum()), len(v)), lambda a, b: (a[0] + b[0], a[1] + b[1]),
                           lambda s: float(np.exp(s[0] / s[1])), "geometric_mean")
    return g.select("l_returnflag", r("geometric_mean", 4).alias("geometric_mean"))


def _export_inputs(spark, sf):
    t = Tables(spark, sf)
    req = t.customer.filter(F.col("c_acctbal") < -990).select(F.col("c_custkey").alias("user_id"))
    return req, {"orders": (t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey"), "events": (t.events.select("user_id", "event_id", "event_type"), "user_id")}


@register("s12_export_xml", sql="""
WITH req AS (SELECT c_custkey AS user_id FROM customer WHERE c_acctbal < -990)
SELECT user_id, (SELECT count(*) FROM orders WHERE o_custkey = user_id) AS n_orders, (SELECT count(*) FROM events WHERE events.user_id = req.user_id) AS n_events,
  coalesce((SELECT sum(o_orderkey) FROM orders WHERE o_custkey = user_id), 0)::BIGINT AS order_keys FROM req
""")
def q_s12_xml(spark, sf):
    """The export of all requested users written as XML in parts of about eight rows and read back."""
    from opsmill.session import scratch_path

    req, sources = _export_inputs(spark, sf)
    path = scratch_path(spark, "export")
    S.write_user_export(req, "user_id", sources, path, "xml", rows_per_part=8)
    schema = ("user_id long, part int, orders array<struct<o_orderkey:long,o_totalprice:double>>, events array<struct<event_id:long,event_type:string>>")
    back = spark.read.format("xml").option("rowTag", "user").schema(schema).load(path)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    keys = F.coalesce(F.aggregate("orders", F.lit(0).cast("long"), lambda s, x: s + x["o_orderkey"]), F.lit(0))
    return back.groupBy("user_id").agg(F.sum(F.greatest(size("orders"), F.lit(0))).alias("n_orders"), F.sum(F.greatest(size("events"), F.lit(0))).alias("n_events"), F.sum(keys).alias("order_keys"))


@register("s12_export_csv", sql="""
WITH req AS (SELECT c_custkey AS user_id FROM customer WHERE c_acctbal < -990)
SELECT user_id, 'orders' AS source, 'o_orderkey' AS field, CAST(o_orderkey AS VARCHAR) AS value FROM req JOIN orders ON o_custkey = user_id
UNION ALL SELECT req.user_id, 'events', f, CASE f WHEN 'event_id' THEN CAST(event_id AS VARCHAR) ELSE event_type END FROM req JOIN events ON events.user_id = req.user_id, (VALUES ('event_id'), ('event_type')) v(f)
""")
def q_s12_csv(spark, sf):
    """The flattened export written as CSV and read back (prices, whose texts differ by engine, aside)."""
    from opsmill.session import scratch_path

    req, sources = _export_inputs(spark, sf)
    path = scratch_path(spark, "export")
    S.write_user_export(req, "user_id", sources, path, "csv")
    back = spark.read.option("header", True).option("escape", '"').schema("user_id long, source string, record string, field string, value string").csv(path)
    return back.filter("field <> 'o_totalprice'").select("user_id", "source", "field", "value")
