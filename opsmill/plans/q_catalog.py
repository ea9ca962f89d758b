"""Registered queries for operators whose inputs are file names, route folders, spec names
and front-matter documents (F3, F4, F6, F23, C10, P11), derived from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsmill.functions import text as T
from opsmill.operators import inventory as INV
from opsmill.tables import Tables
from opsmill.plans.registry import register

EXT_SQL = "CASE p_size % 6 WHEN 0 THEN '.js' WHEN 1 THEN '.test.js' WHEN 2 THEN '.json' WHEN 3 THEN '.md' WHEN 4 THEN '.css' ELSE '' END"


def _ext():
    m = F.col("p_size") % 6
    return (F.when(m == 0, ".js").when(m == 1, ".test.js").when(m == 2, ".json").when(m == 3, ".md").when(m == 4, ".css")
            .otherwise(""))


def _file_name():
    return F.concat(F.regexp_replace("p_name", " ", "_"), _ext())


@register("f6_categorize_file", sql=f"""
WITH f AS (SELECT replace(p_name, ' ', '_') || {EXT_SQL} AS name FROM part)
SELECT CASE WHEN contains(name, '.js') OR contains(name, '.ts') OR contains(name, '.py') OR contains(name, '.java') OR contains(name, '.go')
    OR contains(name, '.rs') THEN 'source'
  WHEN contains(name, 'test') OR contains(name, 'spec') OR contains(name, '.test.') OR contains(name, '.spec.') THEN 'test'
  WHEN contains(name, 'config') OR contains(name, '.json') OR contains(name, '.yml') OR contains(name, '.yaml') OR contains(name, '.toml') THEN 'config'
  WHEN contains(name, '.md') OR contains(name, 'README') OR contains(name, 'CHANGELOG') OR contains(name, '.rst') THEN 'docs'
  WHEN contains(name, '.css') OR contains(name, '.scss') OR contains(name, '.less') THEN 'styles'
  WHEN contains(name, 'Makefile') OR contains(name, 'Dockerfile') OR contains(name, '.gradle') OR contains(name, 'pom.xml') THEN 'build'
  ELSE 'other' END AS category, count(*) AS files FROM f GROUP BY 1
""")
def q_f6(spark, sf):
    p = Tables(spark, sf).part
    return p.select(T.categorize_file(_file_name()).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("files"))


ROUTE_SQL = """'(shop)/' || lower(replace(p_type, ' ', '-')) || '/' || CASE p_size % 4 WHEN 0 THEN '[id]' WHEN 1 THEN '[...slug]'
  WHEN 2 THEN '@modal' ELSE '[[...rest]]' END || '/' || lower(replace(p_name, ' ', '-'))"""


@register("f3_file_route_to_path", sql=f"""
WITH r AS (SELECT p_partkey, {ROUTE_SQL} AS dir FROM part),
s AS (SELECT p_partkey, list_transform(list_filter(string_split(dir, '/'), lambda x: x <> '' AND NOT regexp_matches(x, '^\\(.*\\)$')
    AND NOT starts_with(x, '@')), lambda x: regexp_replace(regexp_replace(x, '^\\[\\[?\\.\\.\\.(.+?)\\]?\\]$', '{{...\\1}}'), '^\\[(.+)\\]$', '{{\\1}}')) AS segs FROM r)
SELECT p_partkey, '/' || array_to_string(segs, '/') AS path FROM s
""")
def q_f3(spark, sf):
    p = Tables(spark, sf).part
    m = F.col("p_size") % 4
    seg = F.when(m == 0, "[id]").when(m == 1, "[...slug]").when(m == 2, "@modal").otherwise("[[...rest]]")
    d = F.concat(F.lit("(shop)/"), F.lower(F.regexp_replace("p_type", " ", "-")), F.lit("/"), seg, F.lit("/"),
                 F.lower(F.regexp_replace("p_name", " ", "-")))
    return p.select("p_partkey", T.file_route_to_path(d).alias("path"))


SPEC_SQL = "lower(replace(p_name, ' ', '-')) || CASE WHEN p_size % 2 = 0 THEN '-api' ELSE '' END || '-v' || CAST(p_size % 3 AS VARCHAR) || '.yaml'"


@register("f4_spec_name_normalize", sql=f"""
WITH n AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace({SPEC_SQL}, '\\.(json|ya?ml)$', ''), '-v\\d+$', ''), '-api$', '') AS n FROM part)
SELECT p_partkey, CASE WHEN regexp_extract(n, '^([a-z]{{3}})(?:[-_].*)?$', 1) <> '' THEN regexp_extract(n, '^([a-z]{{3}})(?:[-_].*)?$', 1) ELSE n END AS repository
FROM n
""")
def q_f4(spark, sf):
    p = Tables(spark, sf).part
    name = F.concat(F.lower(F.regexp_replace("p_name", " ", "-")), F.when(F.col("p_size") % 2 == 0, "-api").otherwise(""),
                    F.lit("-v"), (F.col("p_size") % 3).cast("string"), F.lit(".yaml"))
    return p.select("p_partkey", T.spec_name(name).alias("repository"))


PREFIX_SQL = "CASE p_size % 5 WHEN 0 THEN 'python-' WHEN 1 THEN 'react-' WHEN 2 THEN 'security-' WHEN 3 THEN '' ELSE 'backend-' END"
DOC_SQL = f"""'---' || chr(10) || 'name: ' || {PREFIX_SQL} || lower(replace(p_name, ' ', '-')) || chr(10) || 'description: Use for "' || p_type
  || '" and "' || p_brand || '" work' || chr(10) || 'model: ' || CASE WHEN p_size > 25 THEN 'opus' ELSE 'sonnet' END || chr(10) || '# note' || chr(10)
  || '---' || chr(10) || '# ' || p_name"""


def _agent_docs(t):
    p = t.part
    m = F.col("p_size") % 5
    prefix = F.when(m == 0, "python-").when(m == 1, "react-").when(m == 2, "security-").when(m == 3, "").otherwise("backend-")
    content = F.concat(F.lit("---\nname: "), prefix, F.lower(F.regexp_replace("p_name", " ", "-")), F.lit('\ndescription: Use for "'),
                       F.col("p_type"), F.lit('" and "'), F.col("p_brand"), F.lit('" work\nmodel: '),
                       F.when(F.col("p_size") > 25, "opus").otherwise("sonnet"), F.lit("\n# note\n---\n# "), F.col("p_name"))
    return p.select(F.lit("agents").alias("repository"), F.concat(F.lit("agents/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"),
                    content.alias("content"))


def _category_sql(col: str) -> str:
    parts = []
    for cat, pats in INV.CATALOG_CATEGORIES:
        for pat in pats:
            like = pat.replace("_", "\\\\_").replace("*", "%")
            parts.append(f"WHEN {col} LIKE '{like}' THEN '{cat}'")
    return "CASE " + " ".join(parts) + " ELSE 'Uncategorized' END"


@register("f23_front_matter_fields", sql=f"""
WITH d AS (SELECT p_partkey, {DOC_SQL} AS content FROM part)
SELECT 'agents/' || CAST(p_partkey AS VARCHAR) || '.md' AS path, regexp_extract(content, '(?m)^name:\\s*(.*)$', 1) AS name,
  regexp_extract(content, '(?m)^model:\\s*(.*)$', 1) AS model,
  array_to_string(regexp_extract_all(regexp_extract(content, '(?m)^description:\\s*(.*)$', 1), '"([^"]+)"', 1)[1:4], '|') AS triggers FROM d
""")
def q_f23(spark, sf):
    d = _agent_docs(Tables(spark, sf)).withColumn("fm", T.front_matter("content"))
    return d.select("path", F.col("fm")["name"].alias("name"), F.col("fm")["model"].alias("model"),
                    F.array_join(T.quoted_phrases(F.col("fm")["description"]), "|").alias("triggers"))


@register("c10_catalog_docs", sql=f"""
WITH d AS (SELECT {PREFIX_SQL} || lower(replace(p_name, ' ', '-')) AS name, CASE WHEN p_size > 25 THEN 'opus' ELSE 'sonnet' END AS model FROM part)
SELECT {_category_sql('name')} AS category, model, count(*) AS agents FROM d GROUP BY 1, 2
""")
def q_c10(spark, sf):
    cat = INV.catalog_docs(_agent_docs(Tables(spark, sf)))
    return cat.groupBy("category", "model").agg(F.count(F.lit(1)).alias("agents"))


# ----------------------------------------------------------------------------- J8 / J9 / C1 on page-derived endpoints
PATH_RX = r"^[a-z]+://[^/]+(/[^?#]*)"
HOST_RX = r"^[a-z]+://([^/.]+)"


def _endpoints(t):
    p = t.pages
    method = F.when(F.col("page_id") % 3 == 0, "POST").otherwise("GET")
    base = p.select(F.regexp_extract("url", HOST_RX, 1).alias("repository"), method.alias("method"),
                    F.regexp_extract("url", PATH_RX, 1).alias("path"), "html", F.col("page_id").cast("string").alias("role"))
    spec = base.select("repository", "method", "path", F.lit("unspecified").alias("auth"), F.lit("OpenAPI spec").alias("source_kind"))
    auth = F.when(F.col("html").contains("<form"), "jwt").otherwise("public")
    impl = base.filter(F.col("path").startswith("/en")).select("repository", auth.alias("auth"), "role")
    source = base.filter(F.col("path").startswith("/en")).select("repository", "method", "path", auth.alias("auth"),
                                                                 F.lit("NestJS").alias("source_kind"))
    return spec, impl, source


EP_SQL = """
WITH base AS (SELECT regexp_extract(url, '^[a-z]+://([^/.]+)', 1) AS repository, CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
  regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path, CASE WHEN contains(html, '<form') THEN 'jwt' ELSE 'public' END AS a,
  CAST(page_id AS VARCHAR) AS role FROM pages),
spec AS (SELECT repository, method, path, 'unspecified' AS auth, 'OpenAPI spec' AS source_kind FROM base),
impl AS (SELECT repository, a AS auth, role FROM base WHERE starts_with(path, '/en')),
src AS (SELECT repository, method, path, a AS auth, 'NestJS' AS source_kind FROM base WHERE starts_with(path, '/en'))
"""


@register("j8_spec_impl_link", sql=EP_SQL + """
, last AS (SELECT repository, arg_max(auth, role) AS la FROM impl GROUP BY 1)
SELECT CASE WHEN s.auth = 'unspecified' THEN coalesce(la, s.auth) ELSE s.auth END AS auth, count(*) AS endpoints FROM spec s
LEFT JOIN last USING (repository) GROUP BY 1
""")
def q_j8(spark, sf):
    spec, impl, _ = _endpoints(Tables(spark, sf))
    return INV.link_specs(spec, impl).groupBy("auth").agg(F.count(F.lit(1)).alias("endpoints"))


@register("j9_source_spec_reconcile", sql=EP_SQL + """
, s AS (SELECT path, method, auth AS s_auth, repository AS s_repo FROM src), p AS (SELECT path, method, auth AS p_auth, repository AS p_repo FROM spec)
SELECT coalesce(s_auth, p_auth) AS auth, count(*) AS endpoints, count(*) FILTER (WHERE p_repo IS NULL) AS source_only
FROM s FULL JOIN p USING (path, method) GROUP BY 1
""")
def q_j9(spark, sf):
    spec, _, source = _endpoints(Tables(spark, sf))
    s = source.select("path", "method", F.col("auth").alias("s_auth"), F.col("repository").alias("s_repo"))
    p = spec.select("path", "method", F.col("auth").alias("p_auth"), F.col("repository").alias("p_repo"))
    rows, _stale = INV.reconcile_source_spec(source, spec)
    per_auth = rows.groupBy("auth").agg(F.count(F.lit(1)).alias("endpoints"))
    only = (s.join(p, ["path", "method"], "left_anti").groupBy(F.col("s_auth").alias("auth"))
            .agg(F.count(F.lit(1)).alias("source_only")))
    return per_auth.join(only, "auth", "left").select("auth", "endpoints", F.coalesce("source_only", F.lit(0)).alias("source_only"))


@register("c1_endpoint_inventory", sql=EP_SQL + """
, u AS (SELECT DISTINCT * FROM (SELECT * FROM spec UNION ALL SELECT * FROM src))
SELECT 'repository' AS dimension, repository AS value, count(*) AS rows FROM u GROUP BY 2
UNION ALL SELECT 'auth', auth, count(*) FROM u GROUP BY 2
""")
def q_c1(spark, sf):
    spec, _, source = _endpoints(Tables(spark, sf))
    inv = INV.endpoint_inventory([spec, source])
    return INV.endpoint_counts(inv)
