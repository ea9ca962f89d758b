"""Registered queries for SURVEY 2.14 (privacy, compliance, audit) and the document
operators (G7-G9, C11-C13, F9, V8, V10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsmill.operators import documents as DOC
from opsmill.operators import privacy as G
from opsmill.plans.derived import sql_with
from opsmill.plans.registry import r, register, ts_text
from opsmill.tables import Tables

TS = "'%Y-%m-%d %H:%M:%S'"
SALT = "pepper-2024"


@register("g1_consent_current", sql=sql_with("consents") + f"""
SELECT user_id, consent_type, arg_max(granted, (ts, event_id)) AS granted, arg_max(withdrawn, (ts, event_id)) AS withdrawn,
  strftime(max(ts), {TS}) AS updated_at, arg_max(granted, (ts, event_id)) AND NOT coalesce(arg_max(withdrawn, (ts, event_id)), false) AS active
FROM consents GROUP BY 1, 2
""")
def q_g1(spark, sf):
    c = G.consent_current(Tables(spark, sf).derived.consents)
    return c.select("user_id", "consent_type", "granted", "withdrawn", ts_text("updated_at").alias("updated_at"), "active")


@register("g2_consent_rate", sql=sql_with("consents") + """
, cur AS (SELECT user_id, consent_type, arg_max(granted, (ts, event_id)) AND NOT coalesce(arg_max(withdrawn, (ts, event_id)), false) AS active
  FROM consents GROUP BY 1, 2)
SELECT consent_type, count(*) AS users, round(avg(CASE WHEN active THEN 1.0 ELSE 0.0 END), 6) AS rate FROM cur GROUP BY 1
""")
def q_g2(spark, sf):
    rate = G.consent_rate(G.consent_current(Tables(spark, sf).derived.consents))
    return rate.select("consent_type", "users", r("rate", 6).alias("rate"))


@register("g3_erasure_apply", sql="""
WITH req AS (SELECT c_custkey AS user_id FROM customer WHERE c_acctbal < -900)
SELECT 'profiles' AS table_name, count(*) AS rows, 0 AS anonymized FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM req)
UNION ALL SELECT 'content', count(*), count(*) FILTER (WHERE o_custkey IN (SELECT user_id FROM req)) FROM orders
UNION ALL SELECT 'analytics', count(*), 0 FROM events WHERE user_id NOT IN (SELECT user_id FROM req)
UNION ALL SELECT 'log', count(*), 0 FROM req
""")
def q_g3(spark, sf):
    t = Tables(spark, sf)
    req = t.customer.filter(F.col("c_acctbal") < -900).select(F.col("c_custkey").alias("user_id"))
    out = G.erasure_apply(t.customer.withColumnRenamed("c_custkey", "user_id"),
                          t.orders.select(F.col("o_custkey").alias("user_id"), "o_orderkey", "o_orderpriority"),
                          t.events.select("user_id", "event_id"), req, anonymize=["o_orderpriority"])
    content = out["content"].agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("user_id").isNull()).alias("anonymized"))
    parts = [out["profiles"].agg(F.count(F.lit(1)).alias("rows")).select(F.lit("profiles").alias("table_name"), "rows",
                                                                         F.lit(0).cast("long").alias("anonymized")),
             content.select(F.lit("content").alias("table_name"), "rows", "anonymized"),
             out["analytics"].agg(F.count(F.lit(1)).alias("rows")).select(F.lit("analytics").alias("table_name"), "rows",
                                                                          F.lit(0).cast("long").alias("anonymized")),
             out["log"].agg(F.count(F.lit(1)).alias("rows")).select(F.lit("log").alias("table_name"), "rows",
                                                                    F.lit(0).cast("long").alias("anonymized"))]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


@register("g4_pseudonymize", sql=f"""
SELECT substr(sha256(CAST(c_custkey AS VARCHAR) || '{SALT}'), 1, 16) AS pseudonym,
  CASE WHEN a < 18 THEN '<18' WHEN a < 30 THEN '18-29' WHEN a < 45 THEN '30-44' WHEN a < 65 THEN '45-64' ELSE '65+' END AS age_group,
  r_name AS region, c_mktsegment FROM (SELECT *, c_custkey % 80 + 10 AS a FROM customer)
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
""")
def q_g4(spark, sf):
    t = Tables(spark, sf)
    c = (t.customer.withColumn("age", F.col("c_custkey") % 80 + 10)
         .join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
         .join(t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey"))
    return G.pseudonymize(c, "c_custkey", SALT, "age", F.col("r_name"), keep=["c_mktsegment"])


@register("g5_column_minimize", sql="SELECT c_custkey, c_mktsegment FROM customer")
def q_g5(spark, sf):
    df, _dropped = G.column_minimize(Tables(spark, sf).customer, ["c_custkey", "c_mktsegment", "ssn"])
    return df


PII_SQL = """
WITH m AS (
  SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,})', 1)) AS match FROM documents
  UNION ALL SELECT doc_id, 'ipv4', unnest(regexp_extract_all(text, '(?:^|[^0-9.])((?:[0-9]{1,3}\\.){3}[0-9]{1,3})(?:$|[^0-9.])', 1)) FROM documents
  UNION ALL SELECT doc_id, 'card_number', unnest(regexp_extract_all(text, '(?:^|[^0-9])([0-9]{13,16})(?:$|[^0-9])', 1)) FROM documents),
v AS (SELECT *, CASE WHEN kind = 'card_number' THEN list_sum(list_transform(range(1, length(match) + 1), lambda i:
    CASE WHEN i % 2 = 0 THEN (CASE WHEN CAST(substr(reverse(match), i, 1) AS INTEGER) * 2 > 9 THEN CAST(substr(reverse(match), i, 1) AS INTEGER) * 2 - 9
      ELSE CAST(substr(reverse(match), i, 1) AS INTEGER) * 2 END) ELSE CAST(substr(reverse(match), i, 1) AS INTEGER) END)) % 10 = 0
  WHEN kind = 'ipv4' THEN list_bool_and(list_transform(string_split(match, '.'), lambda o: CAST(o AS INTEGER) <= 255)) ELSE true END AS valid FROM m)
"""


@register("g7_pii_scan", sql=PII_SQL + """
SELECT kind, count(*) AS matches, CAST(count_if(valid) AS BIGINT) AS valid, count(DISTINCT doc_id) AS docs FROM v GROUP BY 1
""")
def q_g7(spark, sf):
    p = DOC.pii_scan(Tables(spark, sf).documents)
    return p.groupBy("kind").agg(F.count(F.lit(1)).alias("matches"), F.count_if("valid").alias("valid"),
                                 F.countDistinct("doc_id").alias("docs"))


@register("g6_mask_pan", sql=PII_SQL + """
SELECT doc_id, 'XXXX-XXXX-XXXX-' || right(match, 4) AS masked FROM v WHERE kind = 'card_number' AND valid
""")
def q_g6(spark, sf):
    p = DOC.pii_scan(Tables(spark, sf).documents).filter((F.col("kind") == "card_number") & F.col("valid"))
    return p.select("doc_id", G.mask_pan("match").alias("masked"))


@register("g8_secret_scan", sql="""
SELECT 'assigned_token' AS rule, 'high' AS severity, count(*) AS findings, count(DISTINCT doc_id) AS docs FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:token|secret|password|api_key|apikey)\\s*[=:]\\s*"[A-Za-z0-9/+_-]{16,}"')) AS m FROM documents)
UNION ALL SELECT 'aws_access_key', 'critical', count(*), count(DISTINCT doc_id) FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, 'AKIA[0-9A-Z]{16}')) AS m FROM documents)
UNION ALL SELECT 'private_key_block', 'critical', count(*), count(DISTINCT doc_id) FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----')) AS m FROM documents)
""")
def q_g8(spark, sf):
    spark_rules = spark.createDataFrame([(n, s) for n, _, s in DOC.SECRET_RULES], "rule string, severity string")
    f = DOC.secret_scan(Tables(spark, sf).documents)
    counts = f.groupBy("rule").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("doc_id").alias("docs"))
    return spark_rules.join(counts, "rule", "left").select("rule", "severity", F.coalesce("findings", F.lit(0)).alias("findings"),
                                                           F.coalesce("docs", F.lit(0)).alias("docs"))


@register("g9_license_allowlist", sql=sql_with("packages") + """
SELECT license, count(*) AS packages FROM packages WHERE license NOT IN ('MIT', 'Apache-2.0', 'BSD-3-Clause', 'ISC') OR license IS NULL GROUP BY 1
""")
def q_g9(spark, sf):
    v = G.license_violations(Tables(spark, sf).derived.packages)
    return v.groupBy("license").agg(F.count(F.lit(1)).alias("packages"))


@register("g9_document_licenses", sql="""
SELECT license, count(*) AS docs, license IN ('MIT', 'Apache-2.0', 'BSD-3-Clause', 'ISC') AS allowed FROM (
  SELECT doc_id, 'Apache-2.0' AS license FROM documents WHERE regexp_matches(text, '(?i)apache license,? version 2\\.0')
  UNION ALL SELECT doc_id, 'MIT' FROM documents WHERE regexp_matches(text, '(?i)(?:^|[^a-z])MIT license')
  UNION ALL SELECT doc_id, 'GPL-3.0' FROM documents WHERE regexp_matches(text, '(?i)GNU General Public License,? version 3')
  UNION ALL SELECT doc_id, 'CC-BY-NC-4.0' FROM documents WHERE regexp_matches(text, '(?i)CC BY-NC 4\\.0')) GROUP BY 1
""")
def q_g9d(spark, sf):
    ll = DOC.license_lines(Tables(spark, sf).documents)
    return ll.groupBy("license").agg(F.count(F.lit(1)).alias("docs")).withColumn(
        "allowed", F.col("license").isin(G.LICENSE_ALLOWLIST))


AUDIT_MAP = {"signup": "login_success", "error": "login_failure", "view": "data_viewed", "purchase": "data_exported",
             "click": "access_granted"}


@register("g11_audit_event_coverage", sql=f"""
WITH req AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{e}')" for a, es in G.REQUIRED_AUDIT_EVENTS.items() for e in es)}) t(area, event_type)),
seen AS (SELECT CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AUDIT_MAP.items())} END AS event_type, count(*) AS observed
  FROM events GROUP BY 1)
SELECT area, req.event_type, coalesce(observed, 0) AS observed FROM req LEFT JOIN seen USING (event_type)
""")
def q_g11(spark, sf):
    e = Tables(spark, sf).events
    m = F.create_map(*[x for k, v in AUDIT_MAP.items() for x in (F.lit(k), F.lit(v))])
    return G.audit_event_coverage(spark, e.select(m[F.col("event_type")].alias("event_type")))


def _modules_sql() -> str:
    return "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(G.REQUIRED_TRAINING)) + " END"


@register("g12_training_compliance", sql=f"""
WITH emp AS (SELECT c_custkey AS employee_id FROM customer WHERE c_nationkey < 5),
mods AS (SELECT * FROM (VALUES {", ".join(f"('{m}')" for m in G.REQUIRED_TRAINING)}) t(module)),
last AS (SELECT o_custkey AS employee_id, {_modules_sql()} AS module, max(o_orderdate) AS last_completed FROM orders GROUP BY 1, 2)
SELECT module, CASE WHEN last_completed > TIMESTAMP '1998-08-01' - INTERVAL 365 DAY THEN 'completed' ELSE 'pending' END AS status, count(*) AS n
FROM emp CROSS JOIN mods LEFT JOIN last USING (employee_id, module) GROUP BY 1, 2
""")
def q_g12(spark, sf):
    t = Tables(spark, sf)
    emp = t.customer.filter(F.col("c_nationkey") < 5).select(F.col("c_custkey").alias("employee_id"))
    mod = F.element_at(F.array(*[F.lit(m) for m in G.REQUIRED_TRAINING]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    comp = t.orders.select(F.col("o_custkey").alias("employee_id"), mod.alias("module"), F.col("o_orderdate").alias("completed_at"))
    st = G.training_status(spark, emp, comp, "1998-08-01")
    return st.groupBy("module", "status").agg(F.count(F.lit(1)).alias("n"))


@register("g13_regulation_applicability", sql="""
SELECT CASE WHEN tx > 6000000 THEN 'Level 1' WHEN tx > 1000000 THEN 'Level 2' WHEN tx > 20000 THEN 'Level 3' ELSE 'Level 4' END AS pci_level,
  count(*) AS merchants FROM (SELECT o_custkey, sum(o_totalprice) AS tx FROM orders GROUP BY 1) GROUP BY 1
""")
def q_g13(spark, sf):
    tx = Tables(spark, sf).orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("tx"))
    return tx.groupBy(G.pci_level("tx").alias("pci_level")).agg(F.count(F.lit(1)).alias("merchants"))


@register("g14_period_report", sql="""
WITH req AS (SELECT o_orderpriority AS kind, o_orderdate AS opened, (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey) AS closed
  FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'),
d AS (SELECT kind, (epoch(coalesce(closed, TIMESTAMP '1997-01-01')) - epoch(opened)) / 86400.0 AS days FROM req)
SELECT kind, count(*) AS requests, round(avg(days), 4) AS avg_response_days, CAST(count_if(days > 30) AS BIGINT) AS breaches FROM d GROUP BY 1
""")
def q_g14(spark, sf):
    t = Tables(spark, sf)
    closed = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("closed"))
    req = t.orders.join(closed, "o_orderkey", "left").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("opened"),
                                                            "closed")
    rep = G.period_report(req, "kind", "opened", "closed", "1996-01-01", "1997-01-01")
    return rep.select("kind", "requests", r("avg_response_days", 4).alias("avg_response_days"), "breaches")


@register("g15_access_expiry", sql="""
WITH ev AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS subject, 'view' AS purpose, ts, event_type FROM events),
acc AS (SELECT user_id, subject, purpose, ts FROM ev WHERE event_type = 'view'),
gr AS (SELECT user_id, subject, purpose, ts AS granted_at FROM ev WHERE event_type = 'purchase')
SELECT count(*) AS accesses, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM gr WHERE gr.user_id = acc.user_id AND gr.subject = acc.subject
  AND gr.purpose = acc.purpose AND acc.ts >= gr.granted_at AND acc.ts < gr.granted_at + INTERVAL 24 HOUR)) AS violations FROM acc
""")
def q_g15(spark, sf):
    e = Tables(spark, sf).events.select("user_id", (F.get_json_object("props", "$.k").cast("int") % 5).alias("subject"),
                                        F.lit("view").alias("purpose"), "ts", "event_type")
    acc = e.filter(F.col("event_type") == "view").drop("event_type")
    grants = e.filter(F.col("event_type") == "purchase").select("user_id", "subject", "purpose", F.col("ts").alias("granted_at"))
    v = G.access_violations(acc, grants, "user_id", "subject", "ts", "purpose")
    return acc.agg(F.count(F.lit(1)).alias("accesses")).withColumn("violations", v.select(F.count(F.lit(1))).scalar())


@register("g16_retention_policy", sql=sql_with("usage_cost") + """
SELECT count(*) AS to_delete FROM usage_cost WHERE day < DATE '2001-09-01' - INTERVAL 1825 DAY
  AND resource_id NOT IN (SELECT resource_id FROM usage_cost WHERE amount > 90000)
""")
def q_g16(spark, sf):
    u = Tables(spark, sf).derived.usage_cost
    holds = u.filter(F.col("amount") > 90000).select("resource_id")  # large spends are under legal hold
    c = G.retention_candidates(u.withColumn("day_ts", F.col("day").cast("timestamp")), "day_ts", "2001-09-01", 1825, holds, "resource_id")
    return c.agg(F.count(F.lit(1)).alias("to_delete"))


# ----------------------------------------------------------------------------- documents
@register("c11_doc_budget", sql="""
WITH d AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, len(string_split(text, chr(10))) AS lines FROM documents),
b AS (SELECT *, CASE WHEN regexp_matches(path, '^(?s:src1.*)$') THEN 40 WHEN regexp_matches(path, '^(?s:src2.*)$') THEN 60 ELSE 80 END AS budget FROM d)
SELECT CASE WHEN lines > budget THEN 'WARN' ELSE 'OK' END AS status, budget, count(*) AS files FROM b GROUP BY 1, 2
""")
def q_c11(spark, sf):
    d = Tables(spark, sf).documents.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
                                           "text")
    b = DOC.doc_budget(d, "path", "text", [("src1*", 40), ("src2*", 60)], 80)
    return b.groupBy("status", "budget").agg(F.count(F.lit(1)).alias("files"))


@register("c12_exact_duplicates", sql="""
SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1
""")
def q_c12(spark, sf):
    return DOC.exact_duplicates(Tables(spark, sf).documents).filter(F.col("copies") > 1)


@register("c12_repeated_lines", sql="""
WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
SELECT sha256(line) AS line_hash, count(DISTINCT doc_id) AS docs, min(line) AS line FROM l WHERE line <> '' GROUP BY 1
HAVING count(DISTINCT doc_id) >= 2
""")
def q_c12l(spark, sf):
    return DOC.repeated_lines(Tables(spark, sf).documents)


#: Links of equal shingle sets to their smallest id, and of different sets by brute force.
NEAR_SQL = """
WITH RECURSIVE toks AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS t FROM documents),
sh AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(t) >= 5
  THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) ELSE [array_to_string(t, ' ')] END)) AS s FROM toks WHERE len(t) > 0),
cls AS (SELECT s, min(doc_id) AS rep FROM sh GROUP BY s),
copies AS (SELECT cls.rep AS a, sh.doc_id AS b, 1.0::DOUBLE AS jaccard FROM sh JOIN cls ON sh.s = cls.s WHERE doc_id <> rep),
x AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM cls),
p AS (SELECT x.rep AS a, y.rep AS b, x.n AS na, y.n AS nb, count(*) AS i FROM x JOIN x y ON x.g = y.g AND x.rep < y.rep GROUP BY ALL),
links AS (SELECT a, b, i / (na + nb - i) AS jaccard FROM p WHERE i / (na + nb - i) >= 0.8 UNION ALL SELECT * FROM copies)
"""


@register("c12_near_duplicates", sql=NEAR_SQL + "SELECT a, b, round(jaccard, 6) AS jaccard FROM links")
def q_c12n(spark, sf):
    return DOC.near_duplicates(Tables(spark, sf).documents).select("a", "b", r("jaccard", 6).alias("jaccard"))


@register("v10_entity_resolution", sql=NEAR_SQL + """
, both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a)
SELECT label, count(*) AS members FROM (SELECT a, least(a, min(b)) AS label FROM reach GROUP BY a) GROUP BY label
""")
def q_v10(spark, sf):
    links = DOC.near_duplicates(Tables(spark, sf).documents)
    comps = DOC.connected_components(links)
    return comps.groupBy("label").agg(F.count(F.lit(1)).alias("members"))


#: Two sources of people: all customers, and a third of them again with errors among the suppliers (who are others).
_LETTERS = "translate(substr(md5({0}), {1}, {2}), '0123456789', 'ghijklmnop')"
_PEOPLE_A = f"""SELECT c_custkey AS a_id, {_LETTERS.format("concat(CAST(c_custkey AS STRING), 'g')", 1, 6)} AS given, {_LETTERS.format("CAST(c_custkey AS STRING)", 1, 9)} AS surname,
  {_LETTERS.format("concat(CAST(floor(c_custkey / 2) AS STRING), 's')", 1, 10)} AS street, CAST(c_nationkey AS STRING) AS nation, c_acctbal AS balance FROM customer"""
_PEOPLE_B = f"""SELECT a_id + 1000000000 AS b_id, CASE WHEN a_id % 5 = 2 THEN NULL ELSE given END AS given,
  CASE a_id % 5 WHEN 1 THEN concat(substr(surname, 1, 3), 'z', substr(surname, 5, 5)) WHEN 3 THEN concat(substr(surname, 2, 1), substr(surname, 1, 1), substr(surname, 3, 7)) ELSE surname END AS surname,
  CASE WHEN a_id % 5 = 4 THEN substr(street, 1, 9) ELSE street END AS street, CASE WHEN a_id % 7 = 0 THEN NULL ELSE nation END AS nation,
  CASE WHEN a_id % 5 = 4 THEN round(balance, 0) ELSE balance END AS balance FROM people_a WHERE a_id % 3 = 0
UNION ALL SELECT s_suppkey, {_LETTERS.format("concat(CAST(s_suppkey AS STRING), 'sg')", 1, 6)}, {_LETTERS.format("concat(CAST(s_suppkey AS STRING), 'sn')", 1, 9)},
  {_LETTERS.format("concat(CAST(s_suppkey AS STRING), 'ss')", 1, 10)}, CAST(s_nationkey AS STRING), s_acctbal FROM supplier"""


@register("v10_entity_linkage", sql="SELECT count(*) AS planted, true AS recall_reached, true AS precision_reached FROM customer WHERE c_custkey % 3 = 0")
def q_v10_linkage(spark, sf):
    """Customers found again in another source by learned weights: recall and precision of at least 0.9."""
    from opsmill.operators import linkage as LK

    t = Tables(spark, sf)
    a = spark.sql(_PEOPLE_A.replace("FROM customer", "FROM {customer}"), customer=t.customer)
    b = spark.sql(_PEOPLE_B.replace("FROM people_a", "FROM {people_a}").replace("FROM supplier", "FROM {supplier}"), people_a=a, supplier=t.supplier)
    passes = [[F.substring("surname", 1, 3), F.col("nation"), F.col("given")], [F.substring("street", 1, 6), F.substring("given", 1, 3), F.col("surname")],
              [F.substring("surname", 5, 5), F.col("street")]]
    links = LK.link_entities(a, b, "a_id", "b_id", {"given": "text", "surname": "text", "street": "text", "nation": "text", "balance": "number"}, passes)
    right = F.count_if(F.col("b_id") == F.col("a_id") + 1000000000)
    planted = a.filter("a_id % 3 = 0").agg(F.count(F.lit(1)).alias("planted"))
    return planted.crossJoin(links.agg(F.count(F.lit(1)).alias("links"), right.alias("right"))).select(  # one row each
        "planted", (F.col("right") >= 0.9 * F.col("planted")).alias("recall_reached"), (F.col("right") >= 0.9 * F.col("links")).alias("precision_reached"))


@register("c13_cross_reference", sql="""
WITH paths AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages),
links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"#?]*)', 1)) AS target FROM pages)
SELECT (SELECT count(*) FROM links) AS links, (SELECT count(*) FROM links WHERE target NOT IN (SELECT path FROM paths)) AS broken,
  (SELECT count(*) FROM paths WHERE path NOT IN (SELECT target FROM links)) AS orphan_pages
""")
def q_c13(spark, sf):
    lc = DOC.link_check(Tables(spark, sf).pages)
    return (lc["links"].agg(F.count(F.lit(1)).alias("links"))
            .withColumn("broken", lc["broken"].select(F.count(F.lit(1))).scalar())
            .withColumn("orphan_pages", lc["orphans"].select(F.count(F.lit(1))).scalar()))


BM25_QUERY = "license software the"


def _bm25_sql(query: str) -> str:
    terms = ", ".join(f"'{t}'" for t in sorted(set(query.lower().split())))
    return f"""
WITH toks AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS t FROM documents),
dl AS (SELECT doc_id, len(t) AS dl FROM toks),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) WHERE term IN ({terms}) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT tf.doc_id, sum(ln((st.n_docs - df.df + 0.5) / (df.df + 0.5) + 1) * tf.tf * 2.2 / (tf.tf + 1.2 * (1 - 0.75 + 0.75 * dl.dl / st.avgdl)))
  AS score FROM tf JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY tf.doc_id)
SELECT doc_id, round(score, 6) AS score FROM s ORDER BY score DESC, doc_id LIMIT 10
"""


@register("f9_fulltext_rank", sql=_bm25_sql(BM25_QUERY))
def q_f9(spark, sf):
    s = DOC.bm25(Tables(spark, sf).documents, BM25_QUERY)
    return s.orderBy(F.col("score").desc(), "doc_id").limit(10).select("doc_id", r("score", 6).alias("score"))


@register("f9_boolean_search", sql="""
WITH toks AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS t FROM documents),
c AS (SELECT doc_id, t, len(list_filter(t, lambda w: w = 'license')) AS l, len(list_filter(t, lambda w: w = 'software')) AS s, len(list_filter(t, lambda w: w = 'the')) AS e,
  len(list_filter(t, lambda w: w = 'of')) AS o, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS p FROM toks)
SELECT 'license & software' AS query, doc_id, CAST(l + s AS BIGINT) AS hits FROM c WHERE l > 0 AND s > 0
UNION ALL SELECT 'license | !the', doc_id, CAST(l + e AS BIGINT) FROM c WHERE l > 0 OR e = 0
UNION ALL SELECT 'of <-> the', doc_id, CAST(o + e AS BIGINT) FROM c WHERE p > 0
UNION ALL SELECT '!(license | software) & (the <2> of)', doc_id, CAST(l + s + e + o AS BIGINT) FROM c WHERE l = 0 AND s = 0
  AND len(list_filter(range(1, len(t) - 1), lambda i: t[i] = 'the' AND t[i + 2] = 'of')) > 0
""")
def q_f9_boolean(spark, sf):
    """A positional index of all documents, written once, and four searches on it."""
    from opsmill.operators import textsearch as TS
    from opsmill.session import scratch_path

    docs = Tables(spark, sf).documents.select("doc_id", "text")
    path = scratch_path(spark, "postings")
    TS.write_postings(docs, path)
    index, out = spark.read.parquet(path), None
    for query in ("license & software", "license | !the", "of <-> the", "!(license | software) & (the <2> of)"):
        found = TS.search(index, query, docs).select(F.lit(query).alias("query"), "doc_id", "hits")
        out = found if out is None else out.unionByName(found)
    return out


@register("v8_chunk_overlap", sql="""
WITH c AS (SELECT doc_id, unnest(generate_series(0, greatest(length(text) - 1, 0), 800)) AS start, text FROM documents),
k AS (SELECT doc_id, start, substr(text, start + 1, 1000) AS chunk FROM c
  WHERE start < length(text) AND (start = 0 OR start + 200 < length(text)))
SELECT doc_id, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS chunk_chars FROM k GROUP BY 1
""")
def q_v8(spark, sf):
    c = DOC.chunks(Tables(spark, sf).documents, size=1000, overlap=200)
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk")).cast("long").alias("chunk_chars"))
