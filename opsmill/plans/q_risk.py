"""Registered queries for SURVEY 2.13 (risk, threat and attack-tree analytics)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsmill.operators import relational as rel
from opsmill.operators import risk as R
from opsmill.plans.derived import sql_with
from opsmill.plans.registry import r, register
from opsmill.tables import Tables

CAT_SQL = ("CASE category_no WHEN 0 THEN 'SPOOFING' WHEN 1 THEN 'TAMPERING' WHEN 2 THEN 'REPUDIATION' "
           "WHEN 3 THEN 'INFORMATION_DISCLOSURE' WHEN 4 THEN 'DENIAL_OF_SERVICE' ELSE 'ELEVATION_OF_PRIVILEGE' END")
LEVEL_SQL = "CASE WHEN s >= 12 THEN 'Critical' WHEN s >= 6 THEN 'High' WHEN s >= 3 THEN 'Medium' ELSE 'Low' END"
MULT_SQL = "CASE status_no WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.8 ELSE 1.0 END"


def _threats(t):
    th = t.derived.threats
    return th.withColumn("category", R._lookup(R.STRIDE, F.col("category_no")))


def _scored(t):
    return R.risk_score(_threats(t))


@register("r1_risk_score", sql=sql_with("threats") + f"""
SELECT threat_id, impact * likelihood AS risk_score, {LEVEL_SQL.replace('s ', '(impact * likelihood) ')} AS risk_level FROM threats
""")
def q_r1(spark, sf):
    return _scored(Tables(spark, sf)).select("threat_id", "risk_score", "risk_level")


@register("r2_threat_summary", sql=sql_with("threats") + f"""
, s AS (SELECT {LEVEL_SQL.replace('s ', '(impact * likelihood) ')} AS lvl FROM threats)
SELECT count(*) AS total_threats, CAST(count_if(lvl = 'Critical') AS BIGINT) AS critical_threats,
  CAST(count_if(lvl = 'High') AS BIGINT) AS high_threats FROM s
""")
def q_r2(spark, sf):
    return R.threat_summary(_scored(Tables(spark, sf)))


@register("r2_threats_by_category", sql=sql_with("threats") + f"""
SELECT c.category, count(t.threat_id) AS threats FROM (VALUES ('SPOOFING'), ('TAMPERING'), ('REPUDIATION'), ('INFORMATION_DISCLOSURE'),
  ('DENIAL_OF_SERVICE'), ('ELEVATION_OF_PRIVILEGE')) c(category)
LEFT JOIN (SELECT threat_id, {CAT_SQL} AS category FROM threats WHERE impact > 1) t USING (category) GROUP BY 1
""")
def q_r2c(spark, sf):
    scored = _scored(Tables(spark, sf)).filter(F.col("impact") > 1)
    return R.threats_by_category(spark, scored)


@register("r2_top_risks", sql=sql_with("threats") + """
SELECT threat_id, impact * likelihood AS risk_score FROM threats ORDER BY risk_score DESC, threat_id LIMIT 10
""")
def q_r2t(spark, sf):
    return R.top_risks(_scored(Tables(spark, sf)), "threat_id").select("threat_id", "risk_score")


def _requirements(spark, t):
    th = _threats(t).withColumn("target", F.concat(F.lit("order-"), F.col("threat_id").cast("string")))
    th = th.withColumn("impact_label", R._lookup(["LOW", "MEDIUM", "HIGH", "CRITICAL"], F.col("impact") - 1))
    th = th.withColumn("likelihood_label", R._lookup(["LOW", "MEDIUM", "HIGH", "CRITICAL"], F.col("likelihood") - 1))
    numbered = rel.ordered_batches(th, ["threat_id"], 1).withColumnRenamed("position", "input_no")
    return R.expand_requirements(spark, numbered, "input_no", "category", "target", "impact_label", "likelihood_label")


def _req_patterns_sql() -> str:
    rows = []
    for cat, (domains, pats) in R.STRIDE_REQUIREMENTS.items():
        for i, (title, _) in enumerate(pats):
            rows.append(f"('{cat}', {i}, '{title}', '{domains[i % len(domains)]}')")
    return "(VALUES " + ", ".join(rows) + ") p(category, i, title_pattern, domain)"


REQ_SQL = sql_with("threats") + f"""
, th AS (SELECT threat_id, {CAT_SQL} AS category, impact * likelihood AS s, row_number() OVER (ORDER BY threat_id) AS input_no FROM threats),
req AS (SELECT printf('SR-%03d', (input_no - 1) * 3 + i + 1) AS req_id, threat_id,
  replace(title_pattern, '{{target}}', 'order-' || CAST(threat_id AS VARCHAR)) AS title, domain, {LEVEL_SQL} AS priority
  FROM th JOIN {_req_patterns_sql()} USING (category))
"""


@register("r3_expand_requirements", sql=REQ_SQL + "SELECT req_id, threat_id, title, domain, priority FROM req")
def q_r3(spark, sf):
    return _requirements(spark, Tables(spark, sf)).select("req_id", "threat_id", "title", "domain", "priority")


@register("r4_traceability_matrix", sql=REQ_SQL + """
SELECT threat_id, string_agg(req_id, ',' ORDER BY req_id) AS requirement_ids FROM req GROUP BY 1
""")
def q_r4(spark, sf):
    return R.traceability(_requirements(spark, Tables(spark, sf)))


def _fc_sql() -> str:
    rows = [f"('{fw}', '{dom}', '{ctl}')" for fw, doms in R.FRAMEWORK_CONTROLS.items() for dom, ctls in doms.items() for ctl in ctls]
    return "(VALUES " + ", ".join(rows) + ") fc(framework, domain, control)"


@register("r5_compliance_matrix", sql=REQ_SQL + f"""
SELECT framework, domain, control, req_id FROM {_fc_sql()} JOIN req USING (domain)
""")
def q_r5(spark, sf):
    return R.compliance_matrix(spark, _requirements(spark, Tables(spark, sf)))


@register("r6_compliance_gaps", sql=REQ_SQL + f"""
, per_domain AS (SELECT domain, count(*) AS n, min(req_id) AS one FROM req GROUP BY 1),
per_control AS (SELECT framework, control, coalesce(sum(n), 0) AS matching, min(one) AS req_id FROM {_fc_sql()} LEFT JOIN per_domain USING (domain) GROUP BY 1, 2)
SELECT framework, domain, control, CASE WHEN matching = 0 THEN 'missing_controls' ELSE 'weak_coverage' END AS gap, req_id
FROM {_fc_sql()} JOIN per_control USING (framework, control) WHERE matching < 2
""")
def q_r6(spark, sf):
    return R.compliance_gaps(spark, _requirements(spark, Tables(spark, sf))).select("framework", "domain", "control", "gap", "req_id")


COVERAGE_SQL = sql_with("mappings", "controls") + f"""
, mc AS (SELECT m.threat_id, c.*, {MULT_SQL} AS multiplier FROM mappings m JOIN controls c USING (control_id)),
cov AS (SELECT threat_id, sum(effectiveness * multiplier) / (count(*) * 4) * 100 AS coverage, count(*) AS controls,
  count(DISTINCT CASE WHEN status_no <> 0 THEN layer_no END) AS layers, count(DISTINCT CASE WHEN status_no <> 0 THEN type_no END) AS types
  FROM mc GROUP BY 1),
gaps AS (SELECT threat_id, coverage, 1 AS gap_no, 'Insufficient control coverage' AS issue FROM cov WHERE coverage < 50
  UNION ALL SELECT threat_id, coverage, 2, 'No defense in depth' FROM cov WHERE layers < 2
  UNION ALL SELECT threat_id, coverage, 3, 'No control diversity' FROM cov WHERE types < 2)
"""


def _mc(t):
    return R.mapped_controls(t.derived.mappings, t.derived.controls)


@register("r7_control_coverage", sql=COVERAGE_SQL + """
SELECT threat_id, round(coverage, 4) AS coverage, controls, layers, types FROM cov
""")
def q_r7(spark, sf):
    c = R.control_coverage(_mc(Tables(spark, sf)))
    return c.select("threat_id", r("coverage", 4).alias("coverage"), "controls", "layers", "types")


@register("r8_mitigation_gaps", sql=COVERAGE_SQL + "SELECT threat_id, gap_no, issue FROM gaps")
def q_r8(spark, sf):
    return R.mitigation_gaps(R.control_coverage(_mc(Tables(spark, sf)))).select("threat_id", "gap_no", "issue")


def _with_threats(sql: str) -> str:
    return sql_with("mappings", "controls", "threats") + COVERAGE_SQL[len(sql_with("mappings", "controls")):] + sql


@register("r9_risk_reduction", sql=_with_threats("""
SELECT round(coalesce(sum(t.impact * t.likelihood * coverage) / nullif(sum(t.impact * t.likelihood), 0), 0), 6) AS risk_reduction
FROM cov JOIN threats t USING (threat_id)
"""))
def q_r9(spark, sf):
    t = Tables(spark, sf)
    rr = R.risk_reduction(R.control_coverage(_mc(t)), _scored(t))
    return rr.select(r("risk_reduction", 6).alias("risk_reduction"))


@register("r10_critical_gaps", sql=_with_threats("""
SELECT threat_id, gap_no, issue FROM gaps WHERE threat_id IN (SELECT threat_id FROM threats WHERE impact = 4)
"""))
def q_r10(spark, sf):
    t = Tables(spark, sf)
    gaps = R.mitigation_gaps(R.control_coverage(_mc(t)))
    return R.critical_gaps(gaps, t.derived.threats).select("threat_id", "gap_no", "issue")


def _control_categories(t):
    return t.derived.controls.select("control_id", (F.col("control_id") % 6).alias("category_no"))


@register("r11_recommend_controls", sql=sql_with("mappings", "controls", "threats") + """
, cc AS (SELECT control_id % 6 AS category_no, list_sort(list(DISTINCT control_id)) AS ids FROM controls GROUP BY 1),
own AS (SELECT threat_id, list(DISTINCT control_id) AS ids FROM mappings JOIN controls USING (control_id) GROUP BY 1)
SELECT t.threat_id, array_to_string(list_filter(coalesce(cc.ids, []), lambda x: NOT list_contains(coalesce(own.ids, []), x)), ',') AS recommended_ids
FROM threats t LEFT JOIN cc USING (category_no) LEFT JOIN own USING (threat_id)
""")
def q_r11(spark, sf):
    t = Tables(spark, sf)
    rec = R.recommend_controls(t.derived.threats, _mc(t), _control_categories(t))
    return rec.select("threat_id", F.array_join(F.col("recommended_ids").cast("array<string>"), ",").alias("recommended_ids"))


@register("r11_recommendation_parts", sql=sql_with("mappings", "controls", "threats") + """
, own AS (SELECT DISTINCT threat_id, control_id FROM mappings JOIN controls USING (control_id))
SELECT 'catalogue' AS part, control_id % 6 AS key, control_id FROM controls
UNION ALL SELECT 'exception', t.threat_id, own.control_id FROM own JOIN threats t USING (threat_id) WHERE own.control_id % 6 = t.category_no
UNION ALL SELECT 'asked', t.threat_id, c.control_id FROM threats t JOIN controls c ON c.control_id % 6 = t.category_no
  WHERE t.threat_id % 1000 = 0 AND NOT EXISTS (SELECT 1 FROM own WHERE own.threat_id = t.threat_id AND own.control_id = c.control_id)
""")
def q_r11_parts(spark, sf):
    """The two tables that hold every recommendation, and those of the threats asked for (one in a thousand)."""
    t = Tables(spark, sf)
    threats = t.derived.threats
    catalogue, exceptions = R.recommendation_parts(threats, _mc(t), _control_categories(t))
    asked = R.recommended_for(threats.filter("threat_id % 1000 = 0"), catalogue, exceptions)
    parts = [catalogue.select(F.lit("catalogue").alias("part"), F.col("category_no").cast("long").alias("key"), "control_id"),
             exceptions.select(F.lit("exception").alias("part"), F.col("threat_id").alias("key"), "control_id"),
             asked.select(F.lit("asked").alias("part"), F.col("threat_id").alias("key"), "control_id")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("r13_phase_roadmap", sql=_with_threats("""
, todo AS (SELECT control_id, control_id % 6 AS category_no FROM controls WHERE status_no = 0),
cand AS (SELECT g.threat_id, g.gap_no, todo.control_id, CASE WHEN t.impact = 4 THEN 1 ELSE 2 END AS phase
  FROM gaps g JOIN threats t USING (threat_id) JOIN todo ON todo.category_no = t.category_no WHERE t.impact IN (3, 4)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY threat_id, gap_no, control_id) AS rank FROM cand)
SELECT threat_id, control_id, phase, CASE WHEN phase = 1 THEN 'Critical' ELSE 'High' END AS priority, rank FROM ranked WHERE rank <= 5
"""))
def q_r13(spark, sf):
    t = Tables(spark, sf)
    gaps = R.mitigation_gaps(R.control_coverage(_mc(t)))
    rm = R.phase_roadmap(gaps, t.derived.threats, _control_categories(t), t.derived.controls)
    return rm.select("threat_id", "control_id", "phase", "priority", "rank")


@register("r14_layer_coverage", sql=sql_with("mappings", "controls") + """
, done AS (SELECT layer_no, count(*) AS entries, count(DISTINCT control_id) AS controls FROM mappings JOIN controls USING (control_id)
  WHERE status_no IN (2, 3) GROUP BY 1)
SELECT layer, coalesce(entries, 0) AS entries, coalesce(controls, 0) AS controls FROM (VALUES (0, 'network'), (1, 'application'),
  (2, 'data'), (3, 'endpoint'), (4, 'process'), (5, 'physical')) l(layer_no, layer) LEFT JOIN done USING (layer_no)
""")
def q_r14(spark, sf):
    return R.layer_coverage(spark, _mc(Tables(spark, sf)))


@register("r15_control_test_score", sql="""
SELECT l_partkey AS control_id, round(avg(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0.0 END) * 100, 6) AS effectiveness_score
FROM lineitem GROUP BY 1
""")
def q_r15(spark, sf):
    li = Tables(spark, sf).lineitem.select(F.col("l_partkey").alias("control_id"), (F.col("l_returnflag") != "R").alias("passed"))
    s = R.control_test_score(li)
    return s.select("control_id", r("effectiveness_score", 6).alias("effectiveness_score"))


# ----------------------------------------------------------------------------- attack trees
TREE_SQL = sql_with("tree_nodes", "tree_edges") + """
, leaves AS (SELECT e.tree_id, e.parent AS mid, e.child AS leaf, e.pos, n.difficulty, n.cost, n.mitigated FROM tree_edges e
  JOIN tree_nodes n ON n.tree_id = e.tree_id AND n.node_id = e.child WHERE e.parent <> 0),
mids AS (SELECT l.tree_id, l.mid, n.node_type AS mid_type, e.pos AS mid_pos, count(*) AS k,
    CASE WHEN n.node_type = 'or' THEN min(l.difficulty) ELSE max(l.difficulty) END AS d,
    CASE WHEN n.node_type = 'or' THEN min(l.cost) ELSE sum(l.cost) END AS c,
    CASE WHEN n.node_type = 'or' THEN min(l.difficulty) ELSE sum(l.difficulty) END AS best_score,
    CASE WHEN n.node_type = 'or' THEN CAST(l.mid AS VARCHAR) || ',' || CAST(arg_min(l.leaf, (l.difficulty, l.pos)) AS VARCHAR)
      ELSE CAST(l.mid AS VARCHAR) || ',' || string_agg(CAST(l.leaf AS VARCHAR), ',' ORDER BY l.pos) END AS best_path,
    CASE WHEN n.node_type = 'or' THEN count(*) ELSE 1 END AS n_paths
  FROM leaves l JOIN tree_nodes n ON n.tree_id = l.tree_id AND n.node_id = l.mid
  JOIN tree_edges e ON e.tree_id = l.tree_id AND e.child = l.mid AND e.parent = 0 GROUP BY l.tree_id, l.mid, n.node_type, e.pos),
roots AS (SELECT tree_id, node_type AS root_type FROM tree_nodes WHERE node_id = 0)
"""


def _tree(t):
    return t.derived.tree_nodes, t.derived.tree_edges


@register("r16_attack_tree_rollup", sql=TREE_SQL + """
SELECT r.tree_id, CAST(coalesce(CASE WHEN root_type = 'or' THEN min(d) ELSE max(d) END, 0) AS DOUBLE) AS difficulty,
  CAST(coalesce(CASE WHEN root_type = 'or' THEN min(c) ELSE sum(c) END, 0) AS DOUBLE) AS cost
FROM roots r LEFT JOIN mids m USING (tree_id) GROUP BY r.tree_id, root_type
""")
def q_r16(spark, sf):
    nodes, edges = _tree(Tables(spark, sf))
    roll = R.tree_rollup(nodes, edges)
    return roll.filter(F.col("node_id") == 0).select("tree_id", "difficulty", "cost")


@register("r18_best_path", sql=TREE_SQL + """
SELECT r.tree_id, CAST(coalesce(CASE WHEN root_type = 'or' THEN min(best_score) ELSE sum(best_score) END, 0) AS DOUBLE) AS score,
  CASE WHEN count(m.mid) = 0 THEN '0' WHEN root_type = 'or' THEN '0,' || arg_min(best_path, (best_score, mid_pos))
    ELSE '0,' || string_agg(best_path, ',' ORDER BY mid_pos) END AS path
FROM roots r LEFT JOIN mids m USING (tree_id) GROUP BY r.tree_id, root_type
""")
def q_r18(spark, sf):
    nodes, edges = _tree(Tables(spark, sf))
    bp = R.best_path(nodes, edges, "difficulty")
    return bp.filter(F.col("node_id") == 0).select("tree_id", "score", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


def _root_paths(t):
    nodes, edges = _tree(t)
    root, large = F.col("node_id") == 0, R.large_trees(t.derived.tree_sizes)
    paths = R.attack_paths(nodes, edges, large, wanted=root)
    return R.root_paths(paths, nodes.filter(root)), nodes, large


#: Every root path of the two-level trees: middle nodes give one path a leaf (or) or one of all
#: leaves (and); an and-root strings one path of each middle node together, in order.
PATH_SQL = TREE_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """
, midpaths AS (SELECT l.tree_id, l.mid, m.mid_pos, [l.mid, l.leaf] AS path FROM leaves l JOIN mids m ON m.tree_id = l.tree_id AND m.mid = l.mid WHERE mid_type = 'or'
  UNION ALL SELECT l.tree_id, l.mid, m.mid_pos, list_prepend(l.mid, list(l.leaf ORDER BY l.pos)) FROM leaves l JOIN mids m ON m.tree_id = l.tree_id AND m.mid = l.mid
    WHERE mid_type <> 'or' GROUP BY l.tree_id, l.mid, m.mid_pos),
placed AS (SELECT p.*, r.root_type, dense_rank() OVER (PARTITION BY p.tree_id ORDER BY mid_pos, mid) AS k FROM midpaths p JOIN roots r USING (tree_id)),
depth AS (SELECT tree_id, max(k) AS n FROM placed GROUP BY 1),
prod AS (SELECT tree_id, k, path FROM placed WHERE root_type <> 'or' AND k = 1
  UNION ALL SELECT p.tree_id, q.k, p.path || q.path FROM prod p JOIN placed q ON q.tree_id = p.tree_id AND q.k = p.k + 1),
allpaths AS (SELECT tree_id, list_prepend(0, path) AS path FROM placed WHERE root_type = 'or'
  UNION ALL SELECT p.tree_id, list_prepend(0, path) FROM prod p JOIN depth d ON d.tree_id = p.tree_id AND d.n = p.k
  UNION ALL SELECT r.tree_id, [0] FROM roots r WHERE r.tree_id NOT IN (SELECT tree_id FROM mids)),
paths AS (SELECT tree_id, sha256(array_to_string(path, ',')) AS path_id, path FROM allpaths),
steps AS (SELECT tree_id, path_id, unnest(path) AS node_id FROM paths)
"""


@register("r17_attack_paths", sql=PATH_SQL + "SELECT tree_id, path_id, array_to_string(path, ',') AS path FROM paths")
def q_r17(spark, sf):
    paths, *_ = _root_paths(Tables(spark, sf))
    return paths.select("tree_id", "path_id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@register("r19_path_metrics", sql=PATH_SQL + """
SELECT s.tree_id, path_id, count(*) AS steps, CAST(sum(difficulty) AS BIGINT) AS total_difficulty, round(avg(difficulty), 6) AS avg_difficulty,
  CAST(sum(cost) AS BIGINT) AS total_cost, round(sum(time_hours), 6) AS total_time_hours, max(detection_risk) AS max_detection_risk,
  bool_or(requires_insider) AS requires_insider, bool_or(requires_physical) AS requires_physical
FROM steps s JOIN tree_nodes n ON n.tree_id = s.tree_id AND n.node_id = s.node_id AND n.node_type = 'leaf' GROUP BY s.tree_id, path_id
""")
def q_r19(spark, sf):
    paths, nodes, large = _root_paths(Tables(spark, sf))
    m = R.path_metrics(paths, nodes, large)
    return m.withColumn("avg_difficulty", r("avg_difficulty", 6)).withColumn("total_time_hours", r("total_time_hours", 6))


@register("r20_critical_nodes", sql=TREE_SQL + """
, tot AS (SELECT r.tree_id, root_type, CASE WHEN count(m.mid) = 0 THEN 1 WHEN root_type = 'or' THEN sum(n_paths)
  ELSE round(exp(sum(ln(n_paths)))) END AS total FROM roots r LEFT JOIN mids m USING (tree_id) GROUP BY r.tree_id, root_type)
SELECT tree_id, CAST(0 AS BIGINT) AS node_id, CAST(total AS BIGINT) AS paths FROM tot
UNION ALL SELECT m.tree_id, m.mid, CAST(CASE WHEN root_type = 'or' THEN n_paths ELSE total END AS BIGINT) FROM mids m JOIN tot USING (tree_id)
UNION ALL SELECT l.tree_id, l.leaf, CAST(CASE WHEN root_type = 'or' THEN 1 WHEN mid_type = 'or' THEN round(total / k) ELSE total END AS BIGINT)
  FROM leaves l JOIN mids m ON m.tree_id = l.tree_id AND m.mid = l.mid JOIN tot ON tot.tree_id = l.tree_id
""")
def q_r20(spark, sf):
    paths, *_ = _root_paths(Tables(spark, sf))
    return R.critical_nodes(paths)


@register("r21_path_coverage", sql=PATH_SQL + """
, blocked AS (SELECT DISTINCT s.tree_id, s.path_id FROM steps s JOIN tree_nodes n ON n.tree_id = s.tree_id AND n.node_id = s.node_id
  WHERE n.node_type = 'leaf' AND n.mitigated),
p AS (SELECT p.tree_id, p.path_id, b.path_id IS NOT NULL AS blocked FROM paths p LEFT JOIN blocked b ON b.tree_id = p.tree_id AND b.path_id = p.path_id)
SELECT tree_id, count(*) AS total_paths, CAST(count_if(blocked) AS BIGINT) AS blocked_paths, CAST(count_if(NOT blocked) AS BIGINT) AS open_paths,
  round(count_if(blocked) / count(*) * 100, 4) AS coverage_percentage, CAST(least(5, count_if(NOT blocked)) AS INTEGER) AS n_open_listed FROM p GROUP BY 1
""")
def q_r21(spark, sf):
    paths, nodes, _ = _root_paths(Tables(spark, sf))
    mitigated = nodes.filter((F.col("node_type") == "leaf") & F.col("mitigated")).select("tree_id", "node_id")
    cov = R.path_coverage(paths, mitigated)
    return cov.select("tree_id", "total_paths", "blocked_paths", "open_paths", r("coverage_percentage", 4).alias("coverage_percentage"),
                      F.size("first_open_paths").alias("n_open_listed"))


@register("r22_mitigation_priority", sql=PATH_SQL + """
, total AS (SELECT tree_id, count(*) AS n FROM paths GROUP BY 1)
SELECT s.tree_id, s.node_id, count(*) AS paths_blocked, round(count(*) / any_value(t.n) * 100, 6) AS coverage_impact FROM steps s
JOIN tree_nodes n ON n.tree_id = s.tree_id AND n.node_id = s.node_id AND n.node_type = 'leaf' AND n.mitigated JOIN total t ON t.tree_id = s.tree_id GROUP BY 1, 2
""")
def q_r22(spark, sf):
    paths, nodes, _ = _root_paths(Tables(spark, sf))
    mitigable = nodes.filter((F.col("node_type") == "leaf") & F.col("mitigated")).select("tree_id", "node_id")
    return R.mitigation_priority(paths, mitigable).withColumn("coverage_impact", r("coverage_impact", 6))


@register("r23_unmitigated_leaves", sql=sql_with("tree_nodes") + """
SELECT tree_id, node_id FROM tree_nodes WHERE node_type = 'leaf' AND NOT mitigated
""")
def q_r23(spark, sf):
    nodes = Tables(spark, sf).derived.tree_nodes.withColumn(
        "mitigations", F.when(F.col("mitigated"), F.array(F.lit("patch"))).otherwise(F.array().cast("array<string>")))
    return R.unmitigated_leaves(nodes).select("tree_id", "node_id")
