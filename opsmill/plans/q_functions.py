"""Registered queries for SURVEY 2.8 (scalar functions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsmill.functions import dates as D
from opsmill.functions import structured as S
from opsmill.functions import text as T
from opsmill.plans.derived import sql_with
from opsmill.plans.registry import r, register
from opsmill.tables import Tables

URL_PATH_RX = r"^[a-z]+://[^/]+(/[^?#]*)"


@register("f1_regex_extract_all", sql=sql_with("pull_requests") + r"""
SELECT number, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(title, '\bPROJ-\d+\b'),
  regexp_extract_all(branch, '\bPROJ-\d+\b')))), ',') AS issue_keys FROM pull_requests
""")
def q_f1(spark, sf):
    pr = Tables(spark, sf).derived.pull_requests
    keys = F.array_sort(F.array_distinct(F.concat(T.issue_keys("title"), T.issue_keys("branch"))))
    return pr.select("number", F.array_join(keys, ",").alias("issue_keys"))


@register("f2_path_normalize", sql=r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS raw FROM pages),
n AS (SELECT page_id, regexp_replace(regexp_replace(raw, '/{2,}', '/', 'g'), ':([A-Za-z_][A-Za-z0-9_]*)', '{\1}', 'g') AS p FROM p),
l AS (SELECT page_id, CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END AS p FROM n),
t AS (SELECT page_id, CASE WHEN length(p) > 1 AND ends_with(p, '/') THEN regexp_replace(p, '/+$', '') ELSE p END AS p FROM l),
e AS (SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS p FROM t)
SELECT page_id, CASE WHEN starts_with(p, '/fr') THEN p WHEN p = '/' THEN '/v1' ELSE '/v1' || p END AS path FROM e
""")
def q_f2(spark, sf):
    p = Tables(spark, sf).pages
    raw = F.regexp_extract("url", URL_PATH_RX, 1)
    return p.select("page_id", T.normalize_path(raw, prefix="v1", exclude=["/fr"]).alias("path"))


@register("f5_glob_match", sql=r"""
SELECT regexp_matches(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '^(?:/en/.*|/de/1[0-9]?)$') AS allowed, count(*) AS n
FROM pages GROUP BY 1
""")
def q_f5(spark, sf):
    p = Tables(spark, sf).pages
    path = F.regexp_extract("url", URL_PATH_RX, 1)
    return p.select(T.glob_match(path, ["/en/*", "/de/1?", "/de/1"]).alias("allowed")).groupBy("allowed").agg(
        F.count(F.lit(1)).alias("n"))


# Well-known package names checked for look-alikes.
COMMON_PACKAGES = ["react", "express", "lodash", "axios", "webpack", "babel", "jest", "typescript", "eslint", "prettier"]


@register("f7_levenshtein_near", sql="""
WITH names AS (SELECT DISTINCT replace(p_name, ' ', '') AS name FROM part),
popular AS (SELECT replace(p_name, ' ', '') AS pop, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, pop LIMIT 10)
SELECT name, pop, levenshtein(lower(name), pop) AS distance FROM names, popular
WHERE levenshtein(lower(name), pop) BETWEEN 1 AND 2
""")
def q_f7(spark, sf):
    p = Tables(spark, sf).part.select(F.regexp_replace("p_name", " ", "").alias("name"))
    names = p.distinct()
    popular = p.groupBy(F.col("name").alias("pop")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.col("n").desc(), "pop").limit(10)
    # the popular list is a top-10: a proven size bound, so it is broadcast
    j = names.join(F.broadcast(popular), T.near_name(F.col("name"), F.col("pop"), 2))
    return j.select("name", "pop", F.levenshtein(F.lower("name"), F.col("pop")).cast("long").alias("distance"))


def _duck_trigrams(col: str) -> str:
    words = f"list_filter(string_split_regex(lower({col}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return (f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length('  ' || w || ' ') - 1), "
            f"lambda i: substring('  ' || w || ' ', i, 3)))))")


@register("f8_trigram_similarity", sql=f"""
WITH pairs AS (SELECT a.conv_id, a.turn, {_duck_trigrams('a.text')} AS ta, {_duck_trigrams('b.text')} AS tb
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(ta, tb))) = 0 THEN 0.0
  ELSE len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) END, 6) AS similarity FROM pairs
""")
def q_f8(spark, sf):
    c = Tables(spark, sf).conversations
    a = c.select("conv_id", "turn", F.col("text").alias("ta"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tb"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", r(T.trigram_similarity("ta", "tb"), 6).alias("similarity"))


@register("f10_domain_type_check", sql="""
SELECT c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'HOUSEHOLD', 'FURNITURE') AS segment_ok, length(c_name) <= 18 AS name_ok,
  count(*) AS n FROM customer GROUP BY ALL
""")
def q_f10(spark, sf):
    c = Tables(spark, sf).customer
    return c.select(T.check_allowed("c_mktsegment", ["BUILDING", "AUTOMOBILE", "HOUSEHOLD", "FURNITURE"]).alias("segment_ok"),
                    T.check_length("c_name", 18).alias("name_ok")).groupBy("segment_ok", "name_ok").agg(
        F.count(F.lit(1)).alias("n"))


@register("f10_email_check", sql=r"""
SELECT w AS candidate, regexp_matches(w, '^[^@]+@[^@]+$') AS valid FROM (
  SELECT unnest(regexp_extract_all(text, '[^\s,;<>()"]*@[^\s,;<>()"]*')) AS w FROM documents)
""")
def q_f10e(spark, sf):
    d = Tables(spark, sf).documents
    w = d.select(F.explode(F.regexp_extract_all("text", F.lit(r'[^\s,;<>()"]*@[^\s,;<>()"]*'), 0)).alias("candidate"))
    return w.select("candidate", T.check_email("candidate").alias("valid"))


@register("f11_date_windowing", sql="""
SELECT 'last_3_days' AS window, count(*) AS n FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-24' - 2 AND CAST(ts AS DATE) < DATE '2024-01-25'
UNION ALL SELECT 'this_week', count(*) FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-22' AND CAST(ts AS DATE) < DATE '2024-01-25'
UNION ALL SELECT 'this_month', count(*) FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-01' AND CAST(ts AS DATE) < DATE '2024-01-25'
UNION ALL SELECT 'since', count(*) FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-10' AND CAST(ts AS DATE) < DATE '2024-01-25'
""")
def q_f11(spark, sf):
    e = Tables(spark, sf).events.select("ts")
    as_of = "2024-01-24"
    wins = {"last_3_days": D.date_window("last_n_days", as_of, 3), "this_week": D.date_window("this_week", as_of),
            "this_month": D.date_window("this_month", as_of), "since": D.date_window("since", as_of, since="2024-01-10")}
    # one scan, one aggregate: every window is a conditional count
    row = e.agg(*[F.count_if(D.in_window("ts", w)).alias(k) for k, w in wins.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("window"), F.col(k).alias("n")) for k in wins])).alias("x")
                      ).select("x.*")


@register("f12_date_bucket", sql="""
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 2) AS revenue FROM events
WHERE event_type = 'purchase' GROUP BY 1
""")
def q_f12(spark, sf):
    e = Tables(spark, sf).events.filter(F.col("event_type") == "purchase")
    return e.groupBy(F.date_format(D.day_key("ts"), "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("value")).alias("revenue"))


PRIORITY_SEVERITY = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium"}
PRIORITY_SEVERITY_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END"


@register("f13_duration_sla", sql=f"""
WITH x AS (SELECT {PRIORITY_SEVERITY_SQL} AS severity, epoch(l_shipdate) - epoch(o_orderdate) AS secs FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT severity, count(*) AS n, CAST(count_if(secs > (CASE severity WHEN 'critical' THEN 24 WHEN 'high' THEN 168 WHEN 'medium' THEN 720 ELSE 2160 END) * 3600) AS BIGINT) AS breaches
FROM x GROUP BY 1
""")
def q_f13(spark, sf):
    t = Tables(spark, sf)
    sev = F.coalesce(F.create_map(*[x for k, v in PRIORITY_SEVERITY.items() for x in (F.lit(k), F.lit(v))])[F.col("o_orderpriority")],
                     F.lit("low"))
    j = t.lineitem.select("l_orderkey", "l_shipdate").join(
        t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderpriority"), "l_orderkey")
    j = j.withColumn("severity", sev).withColumn("limit_s", D.remediation_deadline_hours("severity") * 3600)
    return j.groupBy("severity").agg(F.count(F.lit(1)).alias("n"),
                                     F.count_if(~D.within_sla("o_orderdate", "l_shipdate", F.col("limit_s"))).alias("breaches"))


@register("f14_age_bucket", sql="""
SELECT CASE WHEN age > 365 THEN 30 WHEN age > 180 THEN 20 WHEN age > 90 THEN 10 ELSE 0 END AS points, count(*) AS n
FROM (SELECT datediff('day', CAST(o_orderdate AS DATE), DATE '2001-09-01') AS age FROM orders) GROUP BY 1
""")
def q_f14(spark, sf):
    o = Tables(spark, sf).orders
    age = F.datediff(F.to_date(F.lit("2001-09-01")), F.to_date("o_orderdate"))
    return o.select(D.age_points(age).alias("points")).groupBy("points").agg(F.count(F.lit(1)).alias("n"))


@register("f15_math_scores", sql="""
SELECT o_custkey, least(100, CAST(floor(sum(CASE o_orderpriority WHEN '1-URGENT' THEN 10 WHEN '2-HIGH' THEN 7 WHEN '3-MEDIUM' THEN 4
  WHEN '5-LOW' THEN 1 ELSE 0 END) / 50 * 100) AS INTEGER)) AS score FROM orders GROUP BY 1
""")
def q_f15(spark, sf):
    o = Tables(spark, sf).orders
    w = (F.when(F.col("o_orderpriority") == "1-URGENT", 10).when(F.col("o_orderpriority") == "2-HIGH", 7)
         .when(F.col("o_orderpriority") == "3-MEDIUM", 4).when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0))
    return o.groupBy("o_custkey").agg(S.capped_score(F.sum(w)).alias("score"))


@register("f16_array_ops", sql="""
WITH a AS (SELECT l_orderkey, list_sort(list(l_quantity)) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_reduce(list_prepend(0.0, q), lambda acc, x: acc + x) AS total,
  len(list_filter(q, lambda x: x > 25)) AS n_large, list_bool_or(list_transform(q, lambda x: x > 45)) AS some_over_45,
  list_bool_and(list_transform(q, lambda x: x > 0)) AS all_positive, list_filter(q, lambda x: x > 40)[1] AS first_over_40,
  coalesce(list_position(list_transform(q, lambda x: x > 40), true), 0) AS first_over_40_pos, len(list_concat(q, q)) AS flat_len FROM a
""")
def q_f16(spark, sf):
    li = Tables(spark, sf).lineitem
    # one order has a handful of lines: the collected array is bounded by the order size
    a = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("q"))
    s = a.select("l_orderkey", S.array_summary("q").alias("s"))
    return s.select("l_orderkey", F.col("s.total").alias("total"), F.size("s.large").cast("long").alias("n_large"),
                    F.col("s.some_over_45").alias("some_over_45"), F.col("s.all_positive").alias("all_positive"),
                    F.col("s.first_over_40").alias("first_over_40"),
                    F.col("s.first_over_40_pos").cast("int").alias("first_over_40_pos"),
                    F.size("s.flat_mapped").cast("long").alias("flat_len"))


@register("f17_array_contain_overlap", sql="""
WITH a AS (SELECT l_orderkey, list_distinct(list(l_suppkey)) AS sup FROM lineitem GROUP BY 1),
b AS (SELECT a.l_orderkey, a.sup, n.sup AS nsup FROM a JOIN a n ON n.l_orderkey = a.l_orderkey + 1)
SELECT l_orderkey, len(list_filter(nsup, lambda x: NOT list_contains(sup, x))) = 0 AS contains_all,
  len(list_filter(sup, lambda x: NOT list_contains(nsup, x))) = 0 AS contained_by, len(list_intersect(sup, nsup)) > 0 AS overlaps
FROM b
""")
def q_f17(spark, sf):
    li = Tables(spark, sf).lineitem
    a = li.groupBy("l_orderkey").agg(F.array_distinct(F.collect_list("l_suppkey")).alias("sup"))
    n = a.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("sup").alias("nsup"))
    b = a.join(n, "l_orderkey")
    return b.select("l_orderkey", S.contains_all("sup", "nsup").alias("contains_all"),
                    S.contained_by("sup", "nsup").alias("contained_by"), S.overlaps("sup", "nsup").alias("overlaps"))


@register("f18_map_group_ops", sql="""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, coalesce(array_to_string(list_sort(list(event_type) FILTER (WHERE n >= 15)), ','), '') AS frequent_types,
  CAST(coalesce(sum(n) FILTER (WHERE n >= 15), 0) * 2 AS BIGINT) AS doubled_total FROM c GROUP BY 1
""")
def q_f18(spark, sf):
    e = Tables(spark, sf).events
    c = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = c.groupBy("user_id").agg(F.collect_list("event_type").alias("k"), F.collect_list("n").alias("v"))
    mm = m.select("user_id", S.map_ops("k", "v", 15).alias("m"))
    return mm.select("user_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("frequent_types"),
                     F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("doubled_total"))


@register("f19_json_access", sql="""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, list_contains(json_keys(props), 'k') AS has_k,
  list_contains(json_keys(props), 'k') AND list_contains(json_keys(props), 'x') AS has_k_and_x FROM events
""")
def q_f19(spark, sf):
    e = Tables(spark, sf).events
    return e.select("event_id", S.json_field("props", "$.k", "int").alias("k"), S.json_has_key("props", "k").alias("has_k"),
                    S.json_has_all("props", ["k", "x"]).alias("has_k_and_x"))


@register("f20_json_safe_parse", sql="""
SELECT json_valid(CASE WHEN event_id % 50 = 0 THEN '{' || props ELSE props END) AS ok, count(*) AS n FROM events GROUP BY 1
""")
def q_f20(spark, sf):
    e = Tables(spark, sf).events
    js = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return e.select(S.safe_parse(js).alias("res")).groupBy(F.col("res.ok").alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@register("f21_composite_access", sql="""
SELECT c_custkey, c_name AS name, c_acctbal < 0 AS in_debt FROM customer
""")
def q_f21(spark, sf):
    c = Tables(spark, sf).customer
    s = c.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal")).alias("acct"))
    s = s.withColumn("acct", S.with_field("acct", "in_debt", F.col("acct.bal") < 0))
    return s.select("c_custkey", F.col("acct.name").alias("name"), F.col("acct.in_debt").alias("in_debt"))


@register("f22_geo_distance", sql="""
WITH pts AS (SELECT c_custkey, (c_custkey % 170) - 85.0 AS lat, ((c_custkey * 7) % 360) - 180.0 AS lon FROM customer)
SELECT c_custkey, round(2 * 6371.0 * asin(sqrt(pow(sin((radians(lat) - radians(48.85)) / 2), 2) + cos(radians(48.85)) * cos(radians(lat))
  * pow(sin((radians(lon) - radians(2.35)) / 2), 2))), 1) AS km FROM pts WHERE lat BETWEEN 30 AND 70 AND lon BETWEEN -20 AND 30
""")
def q_f22(spark, sf):
    c = Tables(spark, sf).customer
    pts = c.select("c_custkey", ((F.col("c_custkey") % 170) - 85.0).alias("lat"), (((F.col("c_custkey") * 7) % 360) - 180.0).alias("lon"))
    near = pts.filter(S.in_bbox("lat", "lon", 30, 70, -20, 30))
    return near.select("c_custkey", r(S.haversine_km(F.lit(48.85), F.lit(2.35), "lat", "lon"), 1).alias("km"))
