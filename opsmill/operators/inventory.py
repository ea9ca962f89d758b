"""Code and document inventory jobs.

Input is a corpus DataFrame ``(repository, path, content)`` - one row per file, whole
text (``sources.files.read_text_corpus``). Every job is a set of regular expressions and
window functions over that corpus; results of the spec readers are rows of the endpoint
table ``(repository, method, path, auth, source_kind)``; the extractors of source files
(C2-C6) are in ``routes``. Line and key order inside a file comes from ``posexplode``
positions. The survey lists a YAML parser as not rebuilt: the YAML job covers ``key:`` lines.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmill.functions.structured import capped_score
from opsmill.functions.text import front_matter, quoted_phrases, spec_name
from opsmill.session import bounded, cut_lineage, spread

ENDPOINT_COLS = ["repository", "method", "path", "auth", "source_kind"]
HTTP_VERBS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]


def _rows(df: DataFrame) -> DataFrame:
    return df.select(*ENDPOINT_COLS)


# ----------------------------------------------------------------------------- C7 / C8 specs
def openapi_paths(corpus: DataFrame) -> DataFrame:
    """JSON OpenAPI specs: every (path, verb) of ``paths`` -> a row with auth
    'unspecified' and the spec's service name as repository."""
    f = corpus.filter(F.col("path").rlike(r"\.json$") & F.col("content").contains('"openapi"'))
    paths = F.from_json(F.get_json_object("content", "$.paths"), "map<string,string>")
    x = f.select(spec_name(F.regexp_extract("path", r"([^/]+)$", 1)).alias("repository"), F.explode(paths).alias("p", "item"))
    v = x.select("repository", "p", F.explode(F.json_object_keys("item")).alias("verb"))
    v = v.filter(F.upper("verb").isin(HTTP_VERBS))
    return _rows(v.select("repository", F.upper("verb").alias("method"), F.col("p").alias("path"), F.lit("unspecified").alias("auth"),
                          F.lit("OpenAPI spec").alias("source_kind")))


def asyncapi_channels(corpus: DataFrame) -> DataFrame:
    """AsyncAPI (JSON) operations joined to their channel (``$ref``) address -> WS rows."""
    f = corpus.filter(F.col("content").contains('"asyncapi"'))
    base = f.select(spec_name(F.regexp_extract("path", r"([^/]+)$", 1), service_code=False).alias("repository"), "content")
    ch = base.select("repository", F.explode(F.from_json(F.get_json_object("content", "$.channels"), "map<string,string>")).alias(
        "channel", "body")).select("repository", "channel", F.coalesce(F.get_json_object("body", "$.address"), F.col("channel")).alias("address"))
    ops = base.select("repository", F.explode(F.from_json(F.get_json_object("content", "$.operations"), "map<string,string>")).alias(
        "op", "body")).select("repository", F.regexp_extract(F.get_json_object("body", "$.channel['$ref']"), r"#/channels/(.+)$", 1).alias("channel"))
    j = ops.join(ch, ["repository", "channel"]).select("repository", F.lit("WS").alias("method"), F.col("address").alias("path"),
                                                       F.lit("unspecified").alias("auth"), F.lit("AsyncAPI spec").alias("source_kind"))
    return _rows(j.distinct())


# ----------------------------------------------------------------------------- C9 YAML keys
def yaml_key_scan(corpus: DataFrame) -> DataFrame:
    """Every ``key:`` line of a YAML file -> (path, line, indent, key, value,
    parent_line). The parent is the nearest earlier key line with a smaller indent. Lines are matched and
    linked inside the file's row, so nothing is shuffled and no depth is cut."""
    rx = r"^(\s*)(?:-\s+)?(\"[^\"]+\"|'[^']+'|[^\s:#][^:#]*?)\s*:(?:\s+(.*))?$"
    lines = F.transform(F.split("content", "\n"), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))
    found = F.filter(lines, lambda x: x["text"].rlike(rx) & ~F.trim(x["text"]).startswith("#"))
    cells = F.transform(found, lambda x: F.struct(
        x["line"].alias("line"), F.length(F.regexp_extract(x["text"], rx, 1)).alias("indent"),
        F.regexp_replace(F.regexp_extract(x["text"], rx, 2), r"^['\"]|['\"]$", "").alias("key"),
        F.trim(F.regexp_extract(x["text"], rx, 3)).alias("value")))
    files = spread(corpus.filter(F.col("path").rlike(r"\.ya?ml$")).select("repository", "path", "content"))
    k = files.select("repository", "path", cells.alias("cells")).filter(F.size("cells") > 0)
    k = k.withColumn("up", F.pandas_udf(_nearest_lower, "array<int>")(F.col("cells.line"), F.col("cells.indent")))
    return k.select("repository", "path", F.explode(F.arrays_zip("cells", "up")).alias("x")).select("repository", "path", "x.cells.*", F.col("x.up").alias("parent_line"))


def _nearest_lower(lines: pd.Series, indents: pd.Series) -> pd.Series:
    """For each row, and each of its lines in order: the nearest earlier line with a smaller indent, or None."""
    def one(lines, indents) -> list:
        out, above = [], []
        for line, indent in zip(lines, indents, strict=True):
            while above and above[-1][1] >= indent:
                above.pop()
            out.append(above[-1][0] if above else None)
            above.append((int(line), indent))
        return out

    return pd.Series([one(a, b) for a, b in zip(lines, indents, strict=True)], dtype=object)


def _at_own_level(rows: DataFrame, order: str, value: Column, before: bool, out: str) -> DataFrame:
    """``value`` over the earlier (or later) rows of a file, seen from a row's own indent.

    A row takes part at each indent of its file from its own upwards (as many rows as the file is deep), so
    every level is a window of its own and no row is compared with all others."""
    of_file = Window.partitionBy("repository", "path")
    spread = rows.withColumn("levels", F.collect_set("indent").over(of_file))
    spread = spread.withColumn("level", F.explode(F.filter("levels", lambda v: v >= F.col("indent")))).drop("levels")
    w = Window.partitionBy("repository", "path", "level").orderBy(order)
    w = w.rowsBetween(Window.unboundedPreceding, -1) if before else w.rowsBetween(1, Window.unboundedFollowing)
    return spread.withColumn(out, value.over(w)).filter("level = indent").drop("level")


def openapi_yaml_paths(corpus: DataFrame) -> DataFrame:
    """C7 (YAML): verbs under ``paths:`` found through the key scan's parent links."""
    keys = yaml_key_scan(corpus)
    specs = keys.filter((F.col("key") == "openapi") & (F.col("indent") == 0)).select("repository", "path").distinct()
    k = keys.join(specs, ["repository", "path"], "left_semi")
    paths_root = k.filter((F.col("key") == "paths") & (F.col("indent") == 0)).select("repository", "path", F.col("line").alias("root"))
    p = k.join(paths_root, ["repository", "path"]).filter(F.col("parent_line") == F.col("root")).select(
        "repository", "path", F.col("line").alias("pline"), F.col("key").alias("url"))
    v = k.join(p, ["repository", "path"]).filter((F.col("parent_line") == F.col("pline")) & F.upper("key").isin(HTTP_VERBS))
    return _rows(v.select(spec_name(F.regexp_extract("path", r"([^/]+)$", 1)).alias("repository"), F.upper("key").alias("method"),
                          F.col("url").alias("path"), F.lit("unspecified").alias("auth"), F.lit("OpenAPI spec").alias("source_kind")))


# ----------------------------------------------------------------------------- C1 / J8 / J9
def link_specs(rows: DataFrame, impl: DataFrame) -> DataFrame:
    """Spec rows with auth 'unspecified' take the auth of the implementer row
    (``impl``: repository = spec name, auth) - the last implementer by role name wins."""
    last = impl.groupBy(F.col("repository").alias("__spec")).agg(F.max_by("auth", "role").alias("__auth"))
    j = rows.join(last, rows["repository"] == last["__spec"], "left")
    return j.withColumn("auth", F.when(F.col("auth") == "unspecified", F.coalesce("__auth", "auth")).otherwise(F.col("auth"))).select(
        *ENDPOINT_COLS)


def reconcile_source_spec(source: DataFrame, spec: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Controller rows vs spec rows on (path, method): the source wins, spec-only rows
    stay (auth 'unspecified'), source-only rows are counted as stale spec entries."""
    s = source.select("path", "method", F.col("auth").alias("s_auth"), F.col("repository").alias("s_repo"),
                      F.col("source_kind").alias("s_kind"))
    p = spec.select("path", "method", F.col("auth").alias("p_auth"), F.col("repository").alias("p_repo"),
                    F.col("source_kind").alias("p_kind"))
    j = s.join(p, ["path", "method"], "full")
    rows = j.select(F.coalesce("s_repo", "p_repo").alias("repository"), "method", "path", F.coalesce("s_auth", "p_auth").alias("auth"),
                    F.coalesce("s_kind", "p_kind").alias("source_kind"))
    stale = j.filter(F.col("p_repo").isNull()).agg(F.count(F.lit(1)).alias("source_only"))
    return rows, stale


def endpoint_inventory(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of extractor outputs, de-duplicated, sorted (repository, path, method)."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.distinct().orderBy("repository", "path", "method")


def endpoint_counts(rows: DataFrame) -> DataFrame:
    """A8 on the inventory: rows per repository and per auth."""
    a = rows.groupBy(F.lit("repository").alias("dimension"), F.col("repository").alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    b = rows.groupBy(F.lit("auth").alias("dimension"), F.col("auth").alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    return a.unionByName(b)


# ----------------------------------------------------------------------------- C10 catalogue
# Catalogue categories in order with their name patterns (first match wins).
CATALOG_CATEGORIES = [
    ("Django", ["django-*", "django"]),
    ("Rails", ["rails-*"]),
    ("Laravel", ["laravel-*"]),
    ("Python", ["python-*", "fastapi-*"]),
    ("Frontend", ["vue-*", "react-*", "frontend-*"]),
    ("Code Quality", ["code-reviewer", "code-archaeologist"]),
    ("Performance", ["performance-*"]),
    ("Orchestration", ["*-orchestrator", "*-configurator", "project-analyst"]),
    ("Data & ML", ["ml-*", "web-scraping-*"]),
    ("DevOps & Quality", ["security-*", "testing-*", "devops-*"]),
    ("Backend & API", ["backend-*", "api-*"]),
    ("Other", ["documentation-*", "tailwind-*"]),
]


def catalog_docs(corpus: DataFrame, external_marker: str = "external/") -> DataFrame:
    """Markdown files with front matter -> catalogue rows (name, description, model,
    tools, category, triggers (first four quoted phrases), tags, external flag); files
    without front matter are skipped."""
    from opsmill.operators.relational import first_match_category

    md = corpus.filter(F.col("path").endswith(".md")).withColumn("fm", front_matter("content"))
    md = md.filter(F.size("fm") > 0)
    rules = [(p, cat) for cat, pats in CATALOG_CATEGORIES for p in pats]
    rows = md.select("path", F.coalesce(F.col("fm")["name"], F.regexp_extract("path", r"([^/]+)\.md$", 1)).alias("name"),
                     F.col("fm")["description"].alias("description"), F.col("fm")["model"].alias("model"),
                     F.col("fm")["tools"].alias("tools"), F.col("fm")["version"].alias("version"),
                     F.filter(F.transform(F.split(F.coalesce(F.col("fm")["tags"], F.lit("")), r"\s*,\s*"),
                                          lambda t: F.regexp_replace(t, r"[\[\]'\"]", "")), lambda t: t != "").alias("tags"),
                     quoted_phrases(F.coalesce(F.col("fm")["description"], F.lit(""))).alias("triggers"),
                     F.col("path").contains(external_marker).alias("is_external"))
    return first_match_category(rows, "name", rules)


# ----------------------------------------------------------------------------- C14-C22
def code_lines(corpus: DataFrame) -> DataFrame:
    """Source lines with 1-based numbers and indentation (posexplode keeps order)."""
    return corpus.select("repository", "path", F.posexplode(F.split("content", "\n")).alias("i", "text")).select(
        "repository", "path", (F.col("i") + 1).alias("line_no"), "text",
        F.length(F.regexp_extract("text", r"^(\s*)", 1)).alias("indent"))


def doc_coverage(corpus: DataFrame) -> DataFrame:
    """C14: Python functions and classes with a docstring as their first statement /
    all, per file; 100 when a file defines none."""
    # the first statement is captured inside a lookahead, so a nested def stays matchable
    defs = F.regexp_extract_all("content", F.lit(
        r"(?m)^[ \t]*(?:async\s+)?(?:def|class)\s+\w+[^\n]*:[ \t]*\n(?=(?:[ \t]*\n)*([ \t]*\S[^\n]*))"), 1)
    x = corpus.filter(F.col("path").endswith(".py")).select("repository", "path", defs.alias("firsts"))
    total = F.size("firsts")
    documented = F.size(F.filter("firsts", lambda s: F.trim(s).rlike(r"^(?:[rubRUB]{0,2})(\"\"\"|''')")))
    return x.select("repository", "path", total.alias("definitions"), documented.alias("documented"),
                    F.when(total == 0, 100.0).otherwise(documented / total * 100).alias("coverage_pct"))


# Branch keywords counted by the cyclomatic estimate.
BRANCH_KEYWORDS = ["if", "elif", "for", "while", "except", "and", "or", "case", "catch"]


def complexity_metrics(corpus: DataFrame) -> DataFrame:
    """Lines, non-blank lines, functions, classes, maximum nesting (indent / 4) and
    a cyclomatic *estimate* (1 + branch keywords) per file."""
    c = F.col("content")
    kw = "|".join(BRANCH_KEYWORDS)
    lines = F.split(c, "\n")
    return corpus.select(
        "repository", "path", F.size(lines).alias("lines"),
        F.size(F.filter(lines, lambda s: F.trim(s) != "")).alias("code_lines"),
        F.size(F.regexp_extract_all(c, F.lit(r"(?m)^\s*(?:async\s+)?(?:def|function)\s+\w+|=>"), 0)).alias("functions"),
        F.size(F.regexp_extract_all(c, F.lit(r"(?m)^\s*class\s+\w+"), 0)).alias("classes"),
        F.coalesce(F.array_max(F.transform(F.filter(lines, lambda s: F.trim(s) != ""),
                                           lambda s: F.floor(F.length(F.regexp_extract(s, r"^( *)", 1)) / 4))), F.lit(0)).alias("max_nesting"),
        (F.size(F.regexp_extract_all(c, F.lit(rf"\b(?:{kw})\b"), 0)) + 1).alias("cyclomatic_estimate"))


def quality_bands(metrics: DataFrame, bands: DataFrame, metric_cols: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Every metric value placed in its band (good / warning / critical) by a range
    join against a small threshold table (metric, lo, hi, band)."""
    long = metrics.select(*key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                                   for m in metric_cols])).alias("m")).select(*key, "m.*")
    b = bounded(bands, 1000)
    return long.join(b, (long["metric"] == b["metric"]) & (long["value"] >= b["lo"]) & (long["value"] < b["hi"])).drop(b["metric"]).drop(
        "lo", "hi")


def debt_priority(items: DataFrame, value: str, debt: str, effort: str, risk: str) -> DataFrame:
    """C17: (business value x debt) / (effort x risk)."""
    return items.withColumn("priority", F.col(value) * F.col(debt) / (F.col(effort) * F.col(risk)))


def debt_cost(items: DataFrame, hours_per_month: str, rate: float, fix_hours: str) -> DataFrame:
    """Yearly cost of the debt (hours x rate x 12), the fix cost and the ROI
    (yearly savings / fix cost)."""
    return (items.withColumn("annual_cost", F.col(hours_per_month) * rate * 12)
            .withColumn("fix_cost", F.col(fix_hours) * rate)
            .withColumn("roi", F.col("annual_cost") / F.nullif(F.col("fix_cost"), F.lit(0.0))))


def concept_tags(corpus: DataFrame, rules: dict[str, str], text: str = "content") -> DataFrame:
    """The set of concepts whose pattern occurs in each file / document."""
    tags = F.filter(F.array(*[F.when(F.col(text).rlike(rx), F.lit(name)) for name, rx in rules.items()]), lambda x: x.isNotNull())
    return corpus.withColumn("concepts", F.array_sort(tags))


def static_findings(lines: DataFrame, rules: Sequence[tuple[str, str, str, str]], text: str = "text") -> DataFrame:
    """C20: source lines against (rule_id, pattern, severity, cwe) rules -> findings.

    The rules are literals of the plan: each line is read once, every pattern is compiled
    once, and the rules that match are exploded - no join of lines with rules."""
    hits = [F.when(F.col(text).rlike(p), F.struct(F.lit(i).alias("rule_id"), F.lit(sev).alias("severity"), F.lit(cwe).alias("cwe"))) for i, p, sev, cwe in rules]
    if not hits:
        return lines.select("*", F.lit("").alias("rule_id"), F.lit("").alias("severity"), F.lit("").alias("cwe")).limit(0)
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return lines.select("*", F.explode(found).alias("__h")).select(*lines.columns, "__h.*")


# Finding weights per severity (unknown severities weigh 0 but are counted).
FINDING_WEIGHTS = {"CRITICAL": 10, "HIGH": 7, "MEDIUM": 4, "LOW": 1}


def finding_risk(findings: DataFrame, key: Sequence[str], severity: str = "severity") -> DataFrame:
    """Severity histogram (zero-filled), unknown-severity count and
    min(100, int(weighted total / 50 x 100))."""
    s = F.upper(F.col(severity))
    w = F.coalesce(F.create_map(*[x for k, v in FINDING_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])[s], F.lit(0))
    aggs = [F.count_if(s == k).alias(k.lower()) for k in FINDING_WEIGHTS]
    aggs.append(F.count_if(~s.isin(list(FINDING_WEIGHTS)) | s.isNull()).alias("unknown"))
    aggs.append(F.sum(w).alias("weighted"))
    g = findings.groupBy(*key).agg(*aggs)
    return g.withColumn("risk_score", capped_score(F.col("weighted")))


def large_functions(corpus: DataFrame, max_lines: int = 50) -> DataFrame:
    """Functions longer than ``max_lines``: a function runs from its ``def`` line to
    the line before the next ``def``/``class`` at the same or a lower indent, over nested
    definitions; the last runs to the end of the file."""
    lines = code_lines(corpus)
    total = lines.groupBy("repository", "path").agg(F.max("line_no").alias("last_line"))
    defs = lines.filter(F.col("text").rlike(r"^\s*(?:async\s+)?(?:def|class)\s+\w+")).select(
        "repository", "path", "line_no", "indent", F.regexp_extract("text", r"(?:def|class)\s+(\w+)", 1).alias("name"),
        F.col("text").rlike(r"^\s*class\s").alias("is_class"))
    d = _at_own_level(defs, "line_no", F.min("line_no"), before=False, out="next_line").join(total, ["repository", "path"])
    d = d.filter(~F.col("is_class")).withColumn("length", F.coalesce(F.col("next_line") - 1, F.col("last_line")) - F.col("line_no") + 1)
    return d.filter(F.col("length") > max_lines).select("repository", "path", "name", "line_no", "length")


def affected_projects(changed: DataFrame, projects: DataFrame, deps: DataFrame, file_col: str = "file", root_col: str = "root",
                      project_col: str = "project") -> DataFrame:
    """Changed files -> owning projects -> every project that depends on them,
    transitively. A file belongs to the project whose root
    (``a/b/``) is one of the file's directory prefixes: the prefixes are exploded (as
    many as the path is deep) and equi-joined to the roots - no prefix scan of the
    project table. Dependents come from a breadth-first search whose frontier starts at
    the changed projects."""
    parts = F.split(F.col(file_col), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1),
                           lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    pre = changed.select(F.explode(prefixes).alias(root_col)).distinct()
    direct = pre.join(projects.select(root_col, project_col), root_col).select(project_col).distinct()
    rev = deps.select(F.col("dependency").alias("src"), F.col("dependent").alias(project_col)).distinct()
    reached = frontier = cut_lineage(direct)
    while True:  # breadth first from the changed projects only; each edge is followed once
        step = (frontier.withColumnRenamed(project_col, "src").join(rev, "src").select(project_col).distinct()
                .join(reached, project_col, "left_anti"))
        frontier = cut_lineage(step)
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)
