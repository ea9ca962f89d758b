"""Registered queries for SURVEY 2.16 (delivery analytics, dependency audit) and J10."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from opsmill.operators import delivery as D
from opsmill.operators import relational as rel
from opsmill.plans.derived import sql_with
from opsmill.plans.registry import r, register
from opsmill.tables import Tables

KEYS_SQL = """list_distinct(list_concat(regexp_extract_all(title, '\\bPROJ-\\d+\\b'), regexp_extract_all(branch, '\\bPROJ-\\d+\\b')))"""
CORR_SQL = sql_with("pull_requests", "tickets") + f"""
, k AS (SELECT number, unnest(CASE WHEN len({KEYS_SQL}) = 0 THEN [NULL] ELSE {KEYS_SQL} END) AS ticket_key FROM pull_requests),
j AS (SELECT k.number, coalesce(k.ticket_key, t.ticket_key) AS ticket_key,
  CASE WHEN k.number IS NOT NULL AND t.ticket_key IS NOT NULL THEN 'correlated' WHEN k.number IS NOT NULL THEN 'pr_only' ELSE 'ticket_only' END AS bucket
  FROM k FULL JOIN tickets t ON k.ticket_key = t.ticket_key)
"""


@register("j10_three_bucket_correlation", sql=CORR_SQL + "SELECT bucket, count(*) AS n, count(DISTINCT number) AS prs FROM j GROUP BY 1")
def q_j10(spark, sf):
    d = Tables(spark, sf).derived
    c = D.correlate(d.pull_requests, d.tickets)
    return c.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("number").alias("prs"))


@register("d1_release_digest", sql=CORR_SQL + """
, items AS (SELECT j.number, j.ticket_key, p.title, t.issue_type FROM j JOIN pull_requests p ON p.number = j.number
  LEFT JOIN tickets t ON t.ticket_key = j.ticket_key WHERE j.bucket IN ('correlated', 'pr_only'))
SELECT CASE WHEN regexp_matches(lower(title), '\\b(ci|deploy|pipeline|infra|monitoring)\\b') THEN 'Infrastructure / DevOps'
  WHEN issue_type = 'Bug' THEN 'Bug Fixes' WHEN issue_type = 'Story' THEN 'New Features' ELSE 'Improvements' END AS category, count(*) AS changes
FROM items WHERE title <> 'Tidy up' GROUP BY 1
""")
def q_d1(spark, sf):
    d = Tables(spark, sf).derived
    c = D.correlate(d.pull_requests, d.tickets).filter(F.col("bucket").isin("correlated", "pr_only"))
    items = (c.join(d.pull_requests.select("number", "title"), "number")
             .join(d.tickets.select("ticket_key", "issue_type"), "ticket_key", "left"))
    dig = D.release_digest(items, "issue_type", "title", F.col("title") == "Tidy up")
    return dig.groupBy("category").agg(F.count(F.lit(1)).alias("changes"))


@register("d2_truncate_text", sql="""
SELECT count(*) FILTER (WHERE length(text) > 500) AS truncated, CAST(sum(length(substr(text, 1, 500))) AS BIGINT) AS kept_chars FROM documents
""")
def q_d2(spark, sf):
    d = Tables(spark, sf).documents
    return d.agg(F.count_if(F.length("text") > 500).alias("truncated"),
                 F.sum(F.length(D.truncate_text("text"))).cast("long").alias("kept_chars"))


def _files(t):
    li = t.lineitem
    return li.select(F.col("l_orderkey").alias("pr"), "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag",
                     F.col("l_quantity").alias("ins"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0).alias("del"))


@register("d3_pr_stats", sql="""
SELECT l_orderkey AS pr, count(*) AS files_changed, CAST(sum(l_quantity) AS BIGINT) AS insertions,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS deletions,
  CAST(sum(l_quantity) AS BIGINT) - CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS net_change FROM lineitem GROUP BY 1
""")
def q_d3(spark, sf):
    return D.pr_stats(_files(Tables(spark, sf)), "pr", "ins", "del")


def _cust_files(t):
    li = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return li.select(F.col("o_custkey").alias("pr"), "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag",
                     F.concat("l_returnflag", "l_linestatus").alias("area"), F.col("l_quantity").alias("ins"),
                     F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0).alias("del"))


CUST_FILES_SQL = """
WITH f AS (SELECT o_custkey AS pr, l_partkey, l_suppkey, l_linestatus, l_returnflag, l_returnflag || l_linestatus AS area, l_quantity AS ins,
  CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS del FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
st AS (SELECT pr, count(*) AS files_changed, sum(ins) AS insertions, sum(del) AS deletions FROM f GROUP BY 1)
"""


@register("d4_pr_split", sql=CUST_FILES_SQL + """
SELECT pr, area, count(*) AS files FROM f WHERE pr IN (SELECT pr FROM st WHERE files_changed > 20 OR insertions + deletions > 1000)
GROUP BY 1, 2 HAVING count(*) >= 5
""")
def q_d4(spark, sf):
    t = Tables(spark, sf)
    f = _cust_files(t)
    return D.pr_split(f, D.pr_stats(f, "pr", "ins", "del"), "pr", "area")


@register("d5_pr_risk", sql=CUST_FILES_SQL + """
, fac AS (SELECT pr, least(10, count(*) / 5.0) AS size, least(10, count(DISTINCT l_suppkey) / 4.0) AS complexity,
  10 - least(10, avg(CASE WHEN l_linestatus = 'F' THEN 10.0 ELSE 0.0 END)) AS test_coverage, least(10, count(DISTINCT l_partkey) / 5.0) AS dependencies,
  avg(CASE WHEN l_returnflag = 'R' THEN 10.0 ELSE 0.0 END) AS security FROM f GROUP BY 1),
o AS (SELECT pr, (size + complexity + test_coverage + dependencies + security) / 5 AS overall FROM fac)
SELECT CASE WHEN overall < 3 THEN 'Low' WHEN overall < 6 THEN 'Medium' WHEN overall < 8 THEN 'High' ELSE 'Critical' END AS level, count(*) AS prs
FROM o GROUP BY 1
""")
def q_d5(spark, sf):
    f = _cust_files(Tables(spark, sf))
    fac = f.groupBy("pr").agg(F.least(F.lit(10.0), F.count(F.lit(1)) / 5.0).alias("size"),
                              F.least(F.lit(10.0), F.countDistinct("l_suppkey") / 4.0).alias("complexity"),
                              (10 - F.least(F.lit(10.0), F.avg(F.when(F.col("l_linestatus") == "F", 10.0).otherwise(0.0)))).alias("test_coverage"),
                              F.least(F.lit(10.0), F.countDistinct("l_partkey") / 5.0).alias("dependencies"),
                              F.avg(F.when(F.col("l_returnflag") == "R", 10.0).otherwise(0.0)).alias("security"))
    overall, level = D.pr_risk(["size", "complexity", "test_coverage", "dependencies", "security"])
    return fac.select(level.alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("prs"))


@register("d6_coverage_diff", sql="""
WITH x AS MATERIALIZED (SELECT c_nationkey AS nation, year(o_orderdate) <= 1996 AS early, CASE WHEN o_orderstatus = 'F' THEN 100.0 ELSE 0.0 END AS a,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 100.0 ELSE 0.0 END AS b, CASE WHEN o_totalprice > 100000 THEN 100.0 ELSE 0.0 END AS c FROM orders JOIN customer ON o_custkey = c_custkey),
g AS MATERIALIZED (SELECT nation, avg(a) FILTER (WHERE early) AS a0, avg(a) FILTER (WHERE NOT early) AS a1, avg(b) FILTER (WHERE early) AS b0, avg(b) FILTER (WHERE NOT early) AS b1,
  avg(c) FILTER (WHERE early) AS c0, avg(c) FILTER (WHERE NOT early) AS c1 FROM x GROUP BY nation),
m AS (SELECT nation, 'lines' AS metric, a0 AS x0, a1 AS x1 FROM g UNION ALL SELECT nation, 'functions', b0, b1 FROM g UNION ALL SELECT nation, 'branches', c0, c1 FROM g)
SELECT nation, metric, round(x0, 4) AS before, round(x1, 4) AS after, round(x1 - x0, 4) AS change,
  CASE WHEN x1 - x0 > 0 THEN 'up' WHEN x1 - x0 < 0 THEN 'down' ELSE 'no change' END AS direction FROM m WHERE x0 IS NOT NULL AND x1 IS NOT NULL
""")
def q_d6(spark, sf):
    t = Tables(spark, sf)
    x = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey")
    x = x.withColumn("early", F.year("o_orderdate") <= 1996)
    metrics = {"lines": F.col("o_orderstatus") == "F", "functions": F.col("o_orderpriority") == "1-URGENT",
               "branches": F.col("o_totalprice") > 100000}

    def cov(df):
        parts = [df.groupBy("nation").agg(F.avg(F.when(c, 100.0).otherwise(0.0)).alias("coverage")).withColumn("metric", F.lit(k))
                 for k, c in metrics.items()]
        u = parts[0]
        for p in parts[1:]:
            u = u.unionByName(p)
        return u
    d = D.coverage_diff(cov(x.filter("early")), cov(x.filter("NOT early")), ["nation"])
    return d.select("nation", "metric", r("before", 4).alias("before"), r("after", 4).alias("after"), r("change", 4).alias("change"),
                    "direction")


@register("d7_review_routing", sql=CUST_FILES_SQL + """
, s AS (SELECT pr, count(*) AS files, sum(ins) + sum(del) AS lines, bool_or(l_returnflag = 'R' AND l_linestatus = 'O') AS security,
  100 - avg(CASE WHEN l_linestatus = 'F' THEN 100.0 ELSE 0.0 END) AS gap FROM f GROUP BY 1)
SELECT CASE WHEN files > 50 OR lines > 1000 THEN 'human' WHEN security THEN 'security' WHEN gap > 20 THEN 'test_generation' ELSE 'default' END AS route,
  count(*) AS prs FROM s GROUP BY 1
""")
def q_d7(spark, sf):
    f = _cust_files(Tables(spark, sf))
    s = f.groupBy("pr").agg(F.count(F.lit(1)).alias("files"), (F.sum("ins") + F.sum("del")).alias("lines"),
                            F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).alias("security"),
                            (100 - F.avg(F.when(F.col("l_linestatus") == "F", 100.0).otherwise(0.0))).alias("gap"))
    return s.select(D.review_route("files", "lines", "security", "gap").alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("prs"))


EXT_SQL = "CASE p_size % 4 WHEN 0 THEN '.tsx' WHEN 1 THEN '.css' WHEN 2 THEN '.py' ELSE '.go' END"


@register("d8_channel_routing", sql=f"""
WITH f AS (SELECT l_orderkey AS pr, CASE WHEN c_nationkey % 5 = 0 THEN 'web-' || n_name WHEN c_nationkey % 5 = 1 THEN 'api-' || n_name ELSE 'core' END AS repo,
  lower(replace(p_name, ' ', '_') || {EXT_SQL}) AS path FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
g AS (SELECT pr, repo, avg(CASE WHEN ends_with(path, '.tsx') OR ends_with(path, '.css') THEN 1.0 ELSE 0.0 END) AS fe,
  avg(CASE WHEN ends_with(path, '.py') OR ends_with(path, '.go') THEN 1.0 ELSE 0.0 END) AS be FROM f GROUP BY 1, 2)
SELECT CASE WHEN contains(lower(repo), 'web') OR contains(lower(repo), 'frontend') THEN 'frontend'
  WHEN contains(lower(repo), 'api') OR contains(lower(repo), 'backend') THEN 'backend' WHEN fe >= 0.6 THEN 'frontend' WHEN be >= 0.6 THEN 'backend'
  ELSE 'ask' END AS channel, count(*) AS prs FROM g GROUP BY 1
""")
def q_d8(spark, sf):
    t = Tables(spark, sf)
    ext = (F.when(F.col("p_size") % 4 == 0, ".tsx").when(F.col("p_size") % 4 == 1, ".css").when(F.col("p_size") % 4 == 2, ".py")
           .otherwise(".go"))
    f = (t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
         .join(t.part.select("p_partkey", "p_name", "p_size"), "p_partkey")
         .join(t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey")
         .join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey")
         .join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey"))
    repo = (F.when(F.col("c_nationkey") % 5 == 0, F.concat(F.lit("web-"), "n_name"))
            .when(F.col("c_nationkey") % 5 == 1, F.concat(F.lit("api-"), "n_name")).otherwise("core"))
    f = f.select(F.col("o_orderkey").alias("pr"), repo.alias("repo"), F.lower(F.concat(F.regexp_replace("p_name", " ", "_"), ext)).alias("path"))
    ch = D.channel_route(f, "pr", "path", "repo")
    return ch.groupBy("channel").agg(F.count(F.lit(1)).alias("prs"))


@register("d9_impact_score", sql=sql_with("pull_requests") + """
, m AS (SELECT title || chr(10) || 'Impact: ' || CAST(number % 9 - 4 AS VARCHAR) AS msg, number % 9 - 4 AS raw FROM pull_requests)
SELECT CASE WHEN raw BETWEEN -3 AND 3 THEN CAST(raw AS VARCHAR) ELSE 'invalid' END AS impact, count(*) AS n FROM m GROUP BY 1
""")
def q_d9(spark, sf):
    pr = Tables(spark, sf).derived.pull_requests
    msgs = pr.select(F.concat("title", F.lit("\nImpact: "), (F.col("number") % 9 - 4).cast("string")).alias("msg"))
    s = D.impact_scores(msgs, "msg")
    return s.select(F.coalesce(F.col("impact").cast("string"), F.lit("invalid")).alias("impact")).groupBy("impact").agg(
        F.count(F.lit(1)).alias("n"))


@register("d10_new_since_last_report", sql="""
WITH last AS (SELECT o_custkey, max(o_orderdate) AS last_report FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT o.o_custkey, count(*) AS new_items FROM orders o LEFT JOIN last USING (o_custkey)
WHERE last.last_report IS NULL OR o.o_orderdate > last.last_report GROUP BY 1
""")
def q_d10(spark, sf):
    o = Tables(spark, sf).orders
    reports = o.filter(F.col("o_orderpriority") == "1-URGENT").select("o_custkey", F.col("o_orderdate").alias("report_ts"))
    n = D.new_since_last_report(o, reports, "o_custkey", "o_orderdate", "report_ts")
    return n.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("new_items"))


@register("d11_dependency_flatten", sql=sql_with("packages") + """
SELECT package_id % 40 AS project, CASE WHEN package_id % 3 <> 0 THEN 'dependencies' ELSE 'devDependencies' END AS section,
  count(*) AS packages FROM packages GROUP BY 1, 2
""")
def q_d11(spark, sf):
    p = Tables(spark, sf).derived.packages
    p = p.select((F.col("package_id") % 40).alias("project"), F.concat("name", F.lit("-"), F.col("package_id").cast("string")).alias("pkg"),
                 "version", (F.col("package_id") % 3 != 0).alias("runtime"))
    entry = F.struct(F.col("pkg"), F.col("version"))
    # manifests are per project: one JSON document each, as a package.json would be
    man = p.groupBy("project").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("runtime"), entry))).alias("dependencies"),
        F.map_from_entries(F.collect_list(F.when(~F.col("runtime"), entry))).alias("devDependencies"))
    man = man.select("project", F.to_json(F.struct("dependencies", "devDependencies")).alias("manifest"))
    flat = D.dependency_flatten(man, "project", "manifest")
    return flat.groupBy("project", "section").agg(F.count(F.lit(1)).alias("packages"))


@register("d12_dependency_tree", sql="""
WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey >= 2
    UNION ALL SELECT p_partkey, 2 * p_partkey + 1 FROM part WHERE p_size = 50 AND p_retailprice > 1500),
walk(src, dst, depth) AS (SELECT src, dst, 1 FROM e UNION ALL SELECT w.src, e.dst, w.depth + 1 FROM walk w JOIN e ON w.dst = e.src WHERE w.depth < 40),
pairs AS (SELECT src, dst, min(depth) AS depth FROM walk GROUP BY 1, 2)
SELECT src, count(*) AS reachable, max(depth) AS max_depth, bool_or(src = dst) AS circular FROM pairs GROUP BY 1
""")
def q_d12(spark, sf):
    p = Tables(spark, sf).part
    edges = (p.filter(F.col("p_partkey") >= 2).select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).cast("long").alias("dst"))
             .unionByName(p.filter((F.col("p_size") == 50) & (F.col("p_retailprice") > 1500)).select(F.col("p_partkey").alias("src"),
                                                                           (2 * F.col("p_partkey") + 1).alias("dst"))))
    cl = rel.closure(edges, "src", "dst")
    return cl.groupBy("src").agg(F.count(F.lit(1)).alias("reachable"), F.max("depth").cast("int").alias("max_depth"),
                                 F.bool_or("cycle").alias("circular"))


VPARTS_SQL = "[coalesce(TRY_CAST(split_part({v}, '.', 1) AS INTEGER), 0), coalesce(TRY_CAST(split_part({v}, '.', 2) AS INTEGER), 0), coalesce(TRY_CAST(split_part({v}, '.', 3) AS INTEGER), 0)]"


@register("d13_vuln_match", sql=sql_with("packages", "advisories") + f"""
SELECT a.severity, count(*) AS matches, count(DISTINCT p.package_id) AS packages FROM packages p JOIN advisories a USING (name)
WHERE {VPARTS_SQL.format(v='p.version')} >= {VPARTS_SQL.format(v='a.introduced')} AND {VPARTS_SQL.format(v='p.version')} < {VPARTS_SQL.format(v='a.fixed')}
GROUP BY 1
""")
def q_d13(spark, sf):
    d = Tables(spark, sf).derived
    m = D.vuln_match(d.packages, d.advisories)
    return m.groupBy("severity").agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("package_id").alias("packages"))


@register("d14_vuln_severity", sql=sql_with("advisories") + """
, s AS (SELECT CASE WHEN lower(severity) = 'medium' THEN 'moderate' ELSE lower(severity) END AS sev, * FROM advisories),
x AS (SELECT sev, CASE sev WHEN 'critical' THEN 9.0 WHEN 'high' THEN 7.0 WHEN 'moderate' THEN 4.0 WHEN 'low' THEN 1.0 ELSE 0.0 END
  * CASE WHEN coalesce(exploit_available, false) THEN 1.5 ELSE 1.0 END * CASE WHEN coalesce(publicly_disclosed, true) THEN 1.2 ELSE 1.0 END
  * CASE WHEN contains(lower(coalesce(description, '')), 'remote_code_execution') THEN 2.0 ELSE 1.0 END AS risk_score FROM s)
SELECT sev AS severity_norm, count(*) AS n, round(sum(risk_score), 4) AS risk_score,
  CAST(count_if(sev IN ('critical', 'high') OR risk_score > 8.0) AS BIGINT) AS immediate FROM x GROUP BY 1
""")
def q_d14(spark, sf):
    s = D.vuln_severity(Tables(spark, sf).derived.advisories)
    return s.groupBy("severity_norm").agg(F.count(F.lit(1)).alias("n"), r(F.sum("risk_score"), 4).alias("risk_score"),
                                          F.count_if("immediate").alias("immediate"))


@register("d15_vuln_priority", sql=sql_with("advisories") + """
SELECT advisory_id, round(coalesce(cvss, 0) * 0.4 + CASE WHEN coalesce(exploit_available, false) THEN 1.0 ELSE 0.5 END * 2.0
  + CASE WHEN fixed_in IS NOT NULL AND fixed_in <> '' THEN 1.0 ELSE 0.3 END, 2) AS priority_score FROM advisories
""")
def q_d15(spark, sf):
    a = Tables(spark, sf).derived.advisories
    return a.select("advisory_id", D.vuln_priority("cvss", "exploit_available", "fixed_in").alias("priority_score"))


@register("d16_remediation_plan", sql=sql_with("advisories") + """
SELECT advisory_id, name, severity, CASE WHEN fixed_in = '' THEN 'latest' ELSE fixed_in END AS fixed_version, 1 AS priority FROM advisories
WHERE upper(severity) IN ('CRITICAL', 'HIGH') ORDER BY CAST(substr(advisory_id, 5) AS BIGINT) LIMIT 20
""")
def q_d16(spark, sf):
    a = Tables(spark, sf).derived.advisories.withColumn("__n", F.substring("advisory_id", 5, 20).cast("long"))
    p = D.remediation_plan(a, ["__n"])
    return p.select("advisory_id", "name", "severity", F.when(F.col("fixed_in") == "", "latest").otherwise(F.col("fixed_in")).alias(
        "fixed_version"), "priority")


@register("d17_license_compat", sql=sql_with("packages") + """
SELECT license, 'high' AS severity, count(*) AS issues FROM packages WHERE coalesce(license, 'unknown') NOT IN ('MIT', 'BSD', 'Apache-2.0', 'ISC') GROUP BY 1
UNION ALL SELECT license, 'medium', count(*) FROM packages WHERE coalesce(license, 'unknown') IN ('GPL-3.0', 'AGPL-3.0', 'proprietary', 'unknown') GROUP BY 1
""")
def q_d17(spark, sf):
    i = D.license_issues(spark, Tables(spark, sf).derived.packages)
    return i.groupBy("license", "severity").agg(F.count(F.lit(1)).alias("issues"))


def _outdated(t):
    d = t.derived
    p = d.packages.withColumn("vp", D.version_parts("version"))
    w = Window.partitionBy("name")
    latest = F.max_by(F.col("version"), F.col("vp")).over(w)
    p = p.withColumn("latest", latest)
    vers = p.select("name", "vp").distinct().withColumn("vrank", F.dense_rank().over(Window.partitionBy("name").orderBy(F.col("vp").desc())))
    p = p.join(vers, ["name", "vp"]).withColumn("releases_behind", F.col("vrank") - 1)
    vuln = D.vuln_match(d.packages, d.advisories).select("package_id").distinct().withColumn("has_security_fix", F.lit(True))
    p = p.join(vuln, "package_id", "left").withColumn("has_security_fix", F.coalesce("has_security_fix", F.lit(False)))
    p = p.withColumn("diff_type", D.semver_diff("version", "latest")).withColumn("age_days", F.col("package_id") % 500)
    return p


@register("d18_outdated_priority", sql=sql_with("packages", "advisories") + f"""
, p AS (SELECT *, {VPARTS_SQL.format(v='version')} AS vp FROM packages),
l AS (SELECT name, arg_max(version, vp) AS latest FROM p GROUP BY 1),
vr AS (SELECT name, vp, dense_rank() OVER (PARTITION BY name ORDER BY vp DESC) AS vrank FROM (SELECT DISTINCT name, vp FROM p)),
vu AS (SELECT DISTINCT p.package_id FROM packages p JOIN advisories a USING (name)
  WHERE {VPARTS_SQL.format(v='p.version')} >= {VPARTS_SQL.format(v='a.introduced')} AND {VPARTS_SQL.format(v='p.version')} < {VPARTS_SQL.format(v='a.fixed')}),
x AS (SELECT p.package_id, vr.vrank - 1 AS behind, p.package_id IN (SELECT package_id FROM vu) AS sec, p.package_id % 500 AS age,
  CASE WHEN {VPARTS_SQL.format(v='l.latest')}[1] <> p.vp[1] THEN 'major' WHEN {VPARTS_SQL.format(v='l.latest')}[2] <> p.vp[2] THEN 'minor'
    WHEN {VPARTS_SQL.format(v='l.latest')}[3] <> p.vp[3] THEN 'patch' ELSE 'none' END AS diff_type
  FROM p JOIN l USING (name) JOIN vr ON vr.name = p.name AND vr.vp = p.vp),
s AS (SELECT *, CASE WHEN sec THEN 100 ELSE 0 END + CASE diff_type WHEN 'major' THEN 20 WHEN 'minor' THEN 10 ELSE 5 END
  + CASE WHEN age > 365 THEN 30 WHEN age > 180 THEN 20 WHEN age > 90 THEN 10 ELSE 0 END + least(behind * 2, 20) AS score FROM x)
SELECT CASE WHEN score > 80 THEN 'critical' WHEN score > 50 THEN 'high' ELSE 'medium' END AS priority, count(*) AS packages,
  CAST(sum(score) AS BIGINT) AS total_score FROM s GROUP BY 1
""")
def q_d18(spark, sf):
    p = D.outdated_priority(_outdated(Tables(spark, sf)), "has_security_fix", "diff_type", "age_days", "releases_behind")
    return p.groupBy("priority").agg(F.count(F.lit(1)).alias("packages"), F.sum("priority_score").cast("long").alias("total_score"))


@register("d19_semver_diff", sql=sql_with("packages") + f"""
, p AS (SELECT *, {VPARTS_SQL.format(v='version')} AS vp FROM packages), l AS (SELECT name, arg_max(version, vp) AS latest FROM p GROUP BY 1)
SELECT CASE WHEN {VPARTS_SQL.format(v='latest')}[1] <> vp[1] THEN 'major' WHEN {VPARTS_SQL.format(v='latest')}[2] <> vp[2] THEN 'minor'
  WHEN {VPARTS_SQL.format(v='latest')}[3] <> vp[3] THEN 'patch' ELSE 'none' END AS diff_type, count(*) AS packages FROM p JOIN l USING (name) GROUP BY 1
""")
def q_d19(spark, sf):
    p = _outdated(Tables(spark, sf))
    return p.groupBy("diff_type").agg(F.count(F.lit(1)).alias("packages"))


@register("d20_size_report", sql="""
SELECT p_partkey AS package_id, p_name AS name, round(p_retailprice * 1000, 2) AS size FROM part ORDER BY size DESC, name, package_id LIMIT 10
""")
def q_d20(spark, sf):
    p = Tables(spark, sf).part.select(F.col("p_partkey").alias("package_id"), F.col("p_name").alias("name"),
                                      r(F.col("p_retailprice") * 1000, 2).alias("size"))
    rep = D.size_report(p.withColumn("__k", F.struct("name", "package_id")), "__k", "size")
    return rep["top"].select("package_id", "name", "size")


@register("d20_size_totals", sql="""
SELECT round(sum(p_retailprice * 1000), 2) AS total_size, count(*) AS packages, count(*) FILTER (WHERE p_retailprice * 1000 > 1000000) AS large
FROM part
""")
def q_d20t(spark, sf):
    p = Tables(spark, sf).part.select(F.col("p_partkey").alias("package_id"), F.col("p_name").alias("name"),
                                      (F.col("p_retailprice") * 1000).alias("size"))
    rep = D.size_report(p, "name", "size")
    return rep["total"].select(r("total_size").alias("total_size"), "packages").withColumn(
        "large", rep["large"].select(F.count(F.lit(1))).scalar())


COMMON = ["react", "express", "lodash", "axios", "webpack", "babel", "jest", "typescript", "eslint", "prettier"]


def _typo_sql() -> str:
    arr = "[" + ", ".join(f"'{c}'" for c in COMMON) + "]"
    return f"""substr({arr}[p_partkey % 10 + 1], 1, length({arr}[p_partkey % 10 + 1]) - 1) || substr(p_name, 1, 1)"""


@register("d21_typosquat", sql=f"""
WITH n AS (SELECT p_partkey, {_typo_sql()} AS name FROM part),
h AS (SELECT p_partkey, name, CASE {" ".join(f"WHEN levenshtein(lower(name), '{c}') BETWEEN 1 AND 2 THEN '{c}'" for c in COMMON)} END AS similar_to FROM n)
SELECT similar_to, count(*) AS suspicious FROM h WHERE similar_to IS NOT NULL GROUP BY 1
""")
def q_d21(spark, sf):
    p = Tables(spark, sf).part
    arr = F.array(*[F.lit(c) for c in COMMON])
    pick = F.element_at(arr, (F.col("p_partkey") % 10 + 1).cast("int"))
    names = p.select("p_partkey", pick.alias("base"), "p_name")
    names = names.select("p_partkey", F.concat(F.expr("substring(base, 1, length(base) - 1)"), F.substring("p_name", 1, 1)).alias("name"))
    t = D.typosquat(names, "name", COMMON)
    return t.groupBy("similar_to").agg(F.count(F.lit(1)).alias("suspicious"))


@register("d22_sbom_export", sql="""
WITH c AS (SELECT p_brand AS brand, p_name AS name, concat(CAST(p_size % 5 AS VARCHAR), '.', CAST(p_partkey % 10 AS VARCHAR), '.', CAST(p_partkey % 7 AS VARCHAR)) AS version FROM part)
SELECT brand, '{"bomFormat":"CycloneDX","specVersion":"1.5","version":1,"metadata":{"timestamp":"2001-09-01T00:00:00"},"components":[' ||
  string_agg('{"type":"library","name":"' || name || '","version":"' || version || '","purl":"pkg:npm/' || name || '@' || version || '"}', ',' ORDER BY name, version) || ']}' AS document
FROM c GROUP BY brand
""")
def q_d22(spark, sf):
    t = Tables(spark, sf)
    p = t.derived.packages.join(t.part.select(F.col("p_partkey").alias("package_id"), F.col("p_brand").alias("brand")), "package_id")
    return D.sbom_documents(p, "brand", F.lit("npm"), "name", "version", "2001-09-01T00:00:00")


@register("d23_sarif_export", sql=sql_with("advisories") + """
SELECT CAST(json_object('ruleId', coalesce(advisory_id, 'unknown'), 'level', CASE upper(severity) WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error'
  WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN 'note' ELSE 'warning' END, 'message', json_object('text', name || ' has known vulnerability')) AS VARCHAR)
  AS result FROM advisories
""")
def q_d23(spark, sf):
    return D.sarif_results(Tables(spark, sf).derived.advisories, "advisory_id", "severity", "name")
