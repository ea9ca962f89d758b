"""Registered queries for SURVEY 2.15 that apply to the given tables (documents, part).

The endpoint extractors (C1-C10) need source files, which no input table holds; they are
covered by tests on literal corpora (``tests/test_inventory.py``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from opsmill.operators import inventory as INV
from opsmill.operators import relational as rel
from opsmill.plans.registry import r, register
from opsmill.tables import Tables


def _doc_corpus(t):
    d = t.documents
    return d.select(F.col("source").alias("repository"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"),
                                                                  F.lit(".md")).alias("path"), F.col("text").alias("content"), "doc_id")


@register("c15_complexity_metrics", sql="""
SELECT source AS repository, count(*) AS files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines,
  CAST(sum(len(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> ''))) AS BIGINT) AS code_lines FROM documents GROUP BY 1
""")
def q_c15(spark, sf):
    m = INV.complexity_metrics(_doc_corpus(Tables(spark, sf)))
    return m.groupBy("repository").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").cast("long").alias("lines"),
                                       F.sum("code_lines").cast("long").alias("code_lines"))


BANDS = [("lines", 0.0, 20.0, "good"), ("lines", 20.0, 60.0, "warning"), ("lines", 60.0, 1e12, "critical"),
         ("avg_line_chars", 0.0, 200.0, "good"), ("avg_line_chars", 200.0, 500.0, "warning"), ("avg_line_chars", 500.0, 1e12, "critical")]


@register("c16_quality_bands", sql="""
WITH m AS (SELECT doc_id, len(string_split(text, chr(10))) AS lines, length(text) / len(string_split(text, chr(10))) AS avg_line_chars FROM documents),
l AS (SELECT doc_id, 'lines' AS metric, CAST(lines AS DOUBLE) AS value FROM m UNION ALL SELECT doc_id, 'avg_line_chars', avg_line_chars FROM m),
b AS (SELECT * FROM (VALUES ('lines', 0.0, 20.0, 'good'), ('lines', 20.0, 60.0, 'warning'), ('lines', 60.0, 1e12, 'critical'),
  ('avg_line_chars', 0.0, 200.0, 'good'), ('avg_line_chars', 200.0, 500.0, 'warning'), ('avg_line_chars', 500.0, 1e12, 'critical')) t(metric, lo, hi, band))
SELECT l.metric, band, count(*) AS files FROM l JOIN b ON l.metric = b.metric AND value >= lo AND value < hi GROUP BY 1, 2
""")
def q_c16(spark, sf):
    d = Tables(spark, sf).documents
    lines = F.size(F.split("text", "\n"))
    m = d.select("doc_id", lines.alias("lines"), (F.length("text") / lines).alias("avg_line_chars"))
    bands = spark.createDataFrame(BANDS, "metric string, lo double, hi double, band string")
    b = INV.quality_bands(m, bands, ["lines", "avg_line_chars"], ["doc_id"])
    return b.groupBy("metric", "band").agg(F.count(F.lit(1)).alias("files"))


@register("c17_debt_priority", sql="""
SELECT p_partkey AS item, round((p_retailprice / 100) * p_size / (((p_partkey % 5) + 1) * ((p_partkey % 3) + 1)), 6) AS priority
FROM part ORDER BY (p_retailprice / 100) * p_size / (((p_partkey % 5) + 1) * ((p_partkey % 3) + 1)) DESC, p_partkey LIMIT 10
""")
def q_c17(spark, sf):
    p = Tables(spark, sf).part.select(F.col("p_partkey").alias("item"), (F.col("p_retailprice") / 100).alias("value"),
                                      F.col("p_size").alias("debt"), ((F.col("p_partkey") % 5) + 1).alias("effort"),
                                      ((F.col("p_partkey") % 3) + 1).alias("risk"))
    d = INV.debt_priority(p, "value", "debt", "effort", "risk")
    return rel.top_n(d, 10, [F.col("priority").desc(), F.col("item")]).select("item", r("priority", 6).alias("priority"))


@register("c18_debt_cost_roi", sql="""
SELECT p_brand AS team, round(sum(p_size * 150.0 * 12), 2) AS annual_cost, round(avg(p_size * 150.0 * 12 / (((p_partkey % 40) + 1) * 150.0)), 6)
  AS avg_roi FROM part GROUP BY 1
""")
def q_c18(spark, sf):
    p = Tables(spark, sf).part.select(F.col("p_brand").alias("team"), F.col("p_size").cast("double").alias("hours"),
                                      ((F.col("p_partkey") % 40) + 1).cast("double").alias("fix_hours"))
    c = INV.debt_cost(p, "hours", 150.0, "fix_hours")
    return c.groupBy("team").agg(r(F.sum("annual_cost")).alias("annual_cost"), r(F.avg("roi"), 6).alias("avg_roi"))


CONCEPTS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "url": r"https?://", "license": r"(?i)licen[cs]e",
            "credential": r"(?i)(?:token|secret|password)\s*[=:]", "digits16": r"[0-9]{16}"}


@register("c19_concept_tags", sql="""
SELECT array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') THEN 'email' END,
  CASE WHEN regexp_matches(text, 'https?://') THEN 'url' END, CASE WHEN regexp_matches(text, '(?i)licen[cs]e') THEN 'license' END,
  CASE WHEN regexp_matches(text, '(?i)(?:token|secret|password)\\s*[=:]') THEN 'credential' END,
  CASE WHEN regexp_matches(text, '[0-9]{16}') THEN 'digits16' END], lambda x: x IS NOT NULL)), ',') AS concepts, count(*) AS docs
FROM documents GROUP BY 1
""")
def q_c19(spark, sf):
    c = INV.concept_tags(Tables(spark, sf).documents, CONCEPTS, "text")
    return c.groupBy(F.array_join("concepts", ",").alias("concepts")).agg(F.count(F.lit(1)).alias("docs"))


STATIC_RULES = [("hardcoded-credential", r"(?i)(token|secret|password)\s*=\s*\"", "HIGH", "CWE-798"),
                ("card-number", r"[0-9]{16}", "CRITICAL", "CWE-359"),
                ("ip-address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "LOW", "CWE-200"),
                ("copyleft-license", r"GNU General Public License", "MEDIUM", "")]


def _findings(spark, t):
    lines = INV.code_lines(_doc_corpus(t))
    return INV.static_findings(lines, STATIC_RULES)


FINDINGS_SQL = """
WITH l AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, unnest(string_split(text, chr(10))) AS text FROM documents),
rules AS (SELECT * FROM (VALUES ('hardcoded-credential', '(?i)(token|secret|password)\\s*=\\s*"', 'HIGH'), ('card-number', '[0-9]{16}', 'CRITICAL'),
  ('ip-address', '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}', 'LOW'), ('copyleft-license', 'GNU General Public License', 'MEDIUM'))
  t(rule_id, pattern, severity)),
f AS (SELECT path, rule_id, severity FROM l JOIN rules ON regexp_matches(l.text, rules.pattern))
"""


@register("c20_static_findings", sql=FINDINGS_SQL + "SELECT rule_id, severity, count(*) AS findings, count(DISTINCT path) AS files FROM f GROUP BY 1, 2")
def q_c20(spark, sf):
    f = _findings(spark, Tables(spark, sf))
    return f.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("path").alias("files"))


@register("c21_finding_risk_score", sql=FINDINGS_SQL + """
SELECT path, CAST(count_if(severity = 'CRITICAL') AS BIGINT) AS critical, CAST(count_if(severity = 'HIGH') AS BIGINT) AS high,
  CAST(count_if(severity = 'MEDIUM') AS BIGINT) AS medium, CAST(count_if(severity = 'LOW') AS BIGINT) AS low, CAST(0 AS BIGINT) AS unknown,
  least(100, CAST(floor(sum(CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 7 WHEN 'MEDIUM' THEN 4 WHEN 'LOW' THEN 1 ELSE 0 END) / 50 * 100)
    AS INTEGER)) AS risk_score FROM f GROUP BY 1
""")
def q_c21(spark, sf):
    f = _findings(spark, Tables(spark, sf))
    return INV.finding_risk(f, ["path"]).drop("weighted")


@register("c23_affected_projects", sql="""
WITH RECURSIVE deps AS (SELECT p_partkey // 2 AS dependency, p_partkey AS dependent FROM part WHERE p_partkey >= 2),
changed AS (SELECT DISTINCT l_partkey AS project FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-11-01' AND l_returnflag = 'R'),
walk(project) AS (SELECT project FROM changed UNION SELECT d.dependent FROM walk w JOIN deps d ON d.dependency = w.project)
SELECT count(*) AS affected FROM walk
""")
def q_c23(spark, sf):
    t = Tables(spark, sf)
    li = t.lineitem.filter((F.col("l_shipdate") >= F.lit("1998-11-01").cast("timestamp_ntz")) & (F.col("l_returnflag") == "R"))
    changed = li.select(F.concat(F.lit("pkg/"), F.col("l_partkey").cast("string"), F.lit("/src/index.ts")).alias("file")).distinct()
    projects = t.part.select(F.col("p_partkey").alias("project"), F.concat(F.lit("pkg/"), F.col("p_partkey").cast("string"), F.lit("/")).alias("root"))
    deps = t.part.filter(F.col("p_partkey") >= 2).select(F.floor(F.col("p_partkey") / 2).cast("long").alias("dependency"),
                                                          F.col("p_partkey").alias("dependent"))
    a = INV.affected_projects(changed, projects, deps)
    return a.agg(F.count(F.lit(1)).alias("affected"))
