"""Delivery analytics and dependency audit.

Package, advisory and pull-request tables are ordinary DataFrames; scoring rules are
column expressions, version comparison uses integer arrays (lexicographic order), and
transitive dependencies reuse the pair-doubling closure from ``relational``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmill.functions.text import issue_keys, trailer_int
from opsmill.session import bounded


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ----------------------------------------------------------------------------- J10 / D1 / D2
def correlate(prs: DataFrame, tickets: DataFrame, pr_id: str = "number", project: str = "PROJ",
              ticket_key: str = "ticket_key") -> DataFrame:
    """Keys from PR title and branch (union, distinct) matched to tickets ->
    correlated / pr_only / ticket_only rows; a PR may carry several keys and many PRs may
    point to one ticket."""
    keys = prs.select(pr_id, F.explode_outer(F.array_distinct(F.concat(issue_keys("title", project), issue_keys("branch", project))))
                      .alias(ticket_key))
    t = tickets.select(ticket_key, F.lit(True).alias("__t"))
    j = keys.join(t, ticket_key, "full")
    bucket = (F.when(F.col(pr_id).isNotNull() & F.col("__t").isNotNull(), "correlated")
              .when(F.col(pr_id).isNotNull(), "pr_only").otherwise("ticket_only"))
    return j.select(pr_id, ticket_key, bucket.alias("bucket"))


# Digest categories in output order.
DIGEST_CATEGORIES = ["New Features", "Bug Fixes", "Improvements", "Infrastructure / DevOps"]


def release_digest(items: DataFrame, issue_type: str, title: str, noise: Column) -> DataFrame:
    """Category per change (issue type as the hint, infrastructure words override),
    noise dropped, empty categories absent (only categories with rows are produced)."""
    t = F.lower(F.col(title))
    cat = (F.when(t.rlike(r"\b(ci|deploy|pipeline|infra|monitoring)\b"), "Infrastructure / DevOps")
           .when(F.col(issue_type) == "Bug", "Bug Fixes").when(F.col(issue_type) == "Story", "New Features")
           .otherwise("Improvements"))
    return items.filter(~F.coalesce(noise, F.lit(False))).withColumn("category", cat)


def truncate_text(col, limit: int = 500) -> Column:
    """At most ``limit`` characters."""
    return F.substring(_c(col), 1, limit)


# ----------------------------------------------------------------------------- D3-D10
def pr_stats(files: DataFrame, pr: str, insertions: str, deletions: str) -> DataFrame:
    """D3: files, insertions, deletions and net change per PR."""
    return files.groupBy(pr).agg(F.count(F.lit(1)).alias("files_changed"), F.sum(insertions).cast("long").alias("insertions"),
                                 F.sum(deletions).cast("long").alias("deletions")).withColumn(
        "net_change", F.col("insertions") - F.col("deletions"))


def pr_split(files: DataFrame, stats: DataFrame, pr: str, area: str, max_files: int = 20, max_lines: int = 1000,
             min_group: int = 5) -> DataFrame:
    """For PRs over 20 files or 1000 changed lines, the feature areas with at least 5
    files - each a suggested split."""
    large = stats.filter((F.col("files_changed") > max_files) | (F.col("insertions") + F.col("deletions") > max_lines)).select(pr)
    g = files.join(large, pr, "left_semi").groupBy(pr, area).agg(F.count(F.lit(1)).alias("files"))
    return g.filter(F.col("files") >= min_group)


def pr_risk(factors: Sequence) -> tuple[Column, Column]:
    """Overall risk = mean of the factor scores (0-10); < 3 Low, < 6 Medium, < 8 High,
    else Critical."""
    cols = [_c(f) for f in factors]
    overall = sum(cols[1:], cols[0]) / len(cols)
    level = F.when(overall < 3, "Low").when(overall < 6, "Medium").when(overall < 8, "High").otherwise("Critical")
    return overall, level


def coverage_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], metric: str = "metric", value: str = "coverage") -> DataFrame:
    """Before / after / change per metric; change direction as a word."""
    b = before.select(*keys, metric, F.col(value).alias("before"))
    a = after.select(*keys, metric, F.col(value).alias("after"))
    j = b.join(a, [*keys, metric], "full").withColumn("change", F.col("after") - F.col("before"))
    return j.withColumn("direction", F.when(F.col("change") > 0, "up").when(F.col("change") < 0, "down").otherwise("no change"))


def review_route(files, lines, security_sensitive, coverage_gap) -> Column:
    """Ordered routing rules: too large -> human; security -> security review;
    coverage gap > 20 -> test generation; otherwise the default reviewer."""
    return (F.when((_c(files) > 50) | (_c(lines) > 1000), "human").when(_c(security_sensitive), "security")
            .when(_c(coverage_gap) > 20, "test_generation").otherwise("default"))


FRONTEND_EXT = [".tsx", ".jsx", ".css", ".scss", ".vue"]
BACKEND_EXT = [".py", ".go", ".java", ".rb"]


def channel_route(files: DataFrame, pr: str, path: str, repo: str, share: float = 0.6) -> DataFrame:
    """A repo name naming the side wins; else >= 60 % frontend or backend files picks
    the channel; otherwise ask."""
    p = F.lower(F.col(path))
    fe = F.lit(False)
    for e in FRONTEND_EXT:
        fe = fe | p.endswith(e)
    be = F.lit(False)
    for e in BACKEND_EXT:
        be = be | p.endswith(e)
    g = files.groupBy(pr, repo).agg(F.avg(F.when(fe, 1.0).otherwise(0.0)).alias("frontend_share"),
                                    F.avg(F.when(be, 1.0).otherwise(0.0)).alias("backend_share"))
    r = F.lower(F.col(repo))
    ch = (F.when(r.contains("web") | r.contains("frontend"), "frontend").when(r.contains("api") | r.contains("backend"), "backend")
          .when(F.col("frontend_share") >= share, "frontend").when(F.col("backend_share") >= share, "backend").otherwise("ask"))
    return g.withColumn("channel", ch)


def impact_scores(messages: DataFrame, text: str, trailer: str = "Impact", lo: int = -3, hi: int = 3) -> DataFrame:
    """Integer trailer per message; values outside [lo, hi] are invalid (NULL)."""
    v = trailer_int(text, trailer)
    return messages.withColumn("impact_raw", v).withColumn("impact", F.when(v.between(lo, hi), v))


def new_since_last_report(work: DataFrame, reports: DataFrame, key: str, ts: str, report_ts: str) -> DataFrame:
    """Work items after the latest report of their issue (all items when the issue
    was never reported)."""
    last = reports.groupBy(key).agg(F.max(report_ts).alias("last_report"))
    return work.join(last, key, "left").filter(F.col("last_report").isNull() | (F.col(ts) > F.col("last_report")))


# ----------------------------------------------------------------------------- D11-D23
MANIFEST_SCHEMA = "struct<dependencies: map<string,string>, devDependencies: map<string,string>>"


def dependency_flatten(manifests: DataFrame, key: str, manifest: str) -> DataFrame:
    """JSON manifests -> one row per (section, name, version)."""
    m = manifests.select(key, F.from_json(F.col(manifest), MANIFEST_SCHEMA).alias("m"))
    deps = m.select(key, F.lit("dependencies").alias("section"), F.explode("m.dependencies").alias("name", "version"))
    dev = m.select(key, F.lit("devDependencies").alias("section"), F.explode("m.devDependencies").alias("name", "version"))
    return deps.unionByName(dev)


def version_parts(version) -> Column:
    """Semantic version -> array<int> (missing parts as 0), for lexicographic comparison."""
    p = F.split(F.regexp_extract(_c(version), r"^v?(\d+(?:\.\d+){0,2})", 1), r"\.")
    return F.array(*[F.coalesce(F.try_element_at(p, F.lit(i)).cast("int"), F.lit(0)) for i in (1, 2, 3)])


def vuln_match(packages: DataFrame, advisories: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """Packages whose version lies in an advisory's [introduced, fixed) range for
    the same package name (equi join on the name, then the range test)."""
    p = packages.withColumn("__v", version_parts(version))
    a = advisories.withColumn("__lo", version_parts("introduced")).withColumn("__hi", version_parts("fixed"))
    j = p.join(a, name)
    return j.filter((F.col("__v") >= F.col("__lo")) & ((F.col("fixed").isNull()) | (F.col("__v") < F.col("__hi")))).drop(
        "__v", "__lo", "__hi")


# Base score per advisory severity.
SEVERITY_SCORES = {"critical": 9.0, "high": 7.0, "moderate": 4.0, "low": 1.0}


def vuln_severity(df: DataFrame, severity: str = "severity", exploit: str = "exploit_available",
                  disclosed: str = "publicly_disclosed", description: str = "description") -> DataFrame:
    """Base score by severity ('medium' is read as 'moderate'), x1.5 with a known
    exploit, x1.2 when publicly disclosed (absent counts as disclosed), x2 for remote
    code execution; immediate action for critical/high or a score above 8."""
    sev = F.lower(F.col(severity))
    sev = F.when(sev == "medium", "moderate").otherwise(sev)
    base = F.coalesce(F.create_map(*[x for k, v in SEVERITY_SCORES.items() for x in (F.lit(k), F.lit(v))])[sev], F.lit(0.0))
    score = (base * F.when(F.coalesce(F.col(exploit), F.lit(False)), 1.5).otherwise(1.0)
             * F.when(F.coalesce(F.col(disclosed), F.lit(True)), 1.2).otherwise(1.0)
             * F.when(F.lower(F.coalesce(F.col(description), F.lit(""))).contains("remote_code_execution"), 2.0).otherwise(1.0))
    return df.withColumn("severity_norm", sev).withColumn("risk_score", score).withColumn(
        "immediate", sev.isin("critical", "high") | (F.col("risk_score") > 8.0))


def vuln_priority(cvss, exploit, fixed_in) -> Column:
    """round(cvss x 0.4 + (1 | 0.5) x 2 + (1 | 0.3), 2) - at most 7."""
    return F.round(F.coalesce(_c(cvss), F.lit(0.0)) * 0.4
                   + F.when(F.coalesce(_c(exploit), F.lit(False)), 1.0).otherwise(0.5) * 2.0
                   + F.when(_c(fixed_in).isNotNull() & (_c(fixed_in) != ""), 1.0).otherwise(0.3) * 1.0, 2)


def remediation_plan(vulns: DataFrame, order: Sequence[str], severity: str = "severity", n: int = 20) -> DataFrame:
    """The first n critical/high vulnerabilities (input order) as immediate actions."""
    ch = vulns.filter(F.upper(F.col(severity)).isin("CRITICAL", "HIGH"))
    return ch.orderBy(*order).limit(n).withColumn("priority", F.lit(1))


# Licences compatible with each project licence.
LICENSE_COMPATIBILITY = {
    "MIT": ["MIT", "BSD", "Apache-2.0", "ISC"],
    "Apache-2.0": ["Apache-2.0", "MIT", "BSD"],
    "GPL-3.0": ["GPL-3.0", "GPL-2.0"],
    "BSD-3-Clause": ["BSD-3-Clause", "MIT", "Apache-2.0"],
    "proprietary": [],
}
# Licences that need review and why.
LICENSE_RESTRICTIONS = {
    "GPL-3.0": "Copyleft - requires source code disclosure",
    "AGPL-3.0": "Strong copyleft - network use requires source disclosure",
    "proprietary": "Cannot be used without explicit license",
    "unknown": "License unclear - legal review required",
}


def license_issues(spark: SparkSession, packages: DataFrame, license_col: str = "license", project_license: str = "MIT") -> DataFrame:
    """One 'high' issue per package incompatible with the project licence and one
    'medium' issue per restricted licence - a package can raise both."""
    allowed = LICENSE_COMPATIBILITY.get(project_license, [])
    lic = F.coalesce(F.col(license_col), F.lit("unknown"))
    high = packages.filter(~lic.isin(allowed)).withColumn("severity", F.lit("high")).withColumn(
        "issue", F.lit(f"Incompatible with project license {project_license}"))
    rest = spark.createDataFrame(list(LICENSE_RESTRICTIONS.items()), "license_key string, issue string")
    med = packages.join(bounded(rest, 100), lic == F.col("license_key")).drop("license_key").withColumn("severity", F.lit("medium"))
    return high.unionByName(med.select(*high.columns))


def semver_diff(current, latest) -> Column:
    """Major / minor / patch / none between two versions."""
    c, l_ = version_parts(current), version_parts(latest)
    return (F.when(l_[0] != c[0], "major").when(l_[1] != c[1], "minor").when(l_[2] != c[2], "patch").otherwise("none"))


def outdated_priority(df: DataFrame, has_security_fix: str, diff_type: str, age_days: str, releases_behind: str) -> DataFrame:
    """100 for a security fix + 20/10/5 by update type + 30/20/10 by age (> 365 /
    180 / 90 days) + min(2 x releases behind, 20); > 80 critical, > 50 high, else medium."""
    from opsmill.functions.dates import age_points

    score = (F.when(F.coalesce(F.col(has_security_fix), F.lit(False)), 100).otherwise(0)
             + F.when(F.col(diff_type) == "major", 20).when(F.col(diff_type) == "minor", 10).otherwise(5)
             + age_points(F.col(age_days)) + F.least(F.col(releases_behind) * 2, F.lit(20)))
    return df.withColumn("priority_score", score).withColumn(
        "priority", F.when(F.col("priority_score") > 80, "critical").when(F.col("priority_score") > 50, "high").otherwise("medium"))


def size_report(packages: DataFrame, name: str, size: str, large: int = 1_000_000, top: int = 10) -> dict[str, DataFrame]:
    """Total size, top offenders and packages over 1 MB."""
    return {"total": packages.agg(F.sum(size).alias("total_size"), F.count(F.lit(1)).alias("packages")),
            "top": packages.orderBy(F.col(size).desc(), F.col(name)).limit(top),
            "large": packages.filter(F.col(size) > large)}


def typosquat(packages: DataFrame, name: str, popular: Sequence[str], max_distance: int = 2) -> DataFrame:
    """Names within edit distance 1..2 of a well-known package (first popular
    name in list order wins, as in the sample)."""
    n = F.lower(F.col(name))
    hit = None
    for p in popular:
        d = F.levenshtein(n, F.lit(p), max_distance)
        cond = (d > 0) & (d <= max_distance)
        hit = F.when(cond, F.struct(F.lit(p).alias("similar_to"), d.alias("distance"))) if hit is None else \
            hit.when(cond, F.struct(F.lit(p).alias("similar_to"), d.alias("distance")))
    return packages.withColumn("__h", hit).filter(F.col("__h").isNotNull()).select("*", "__h.*").drop("__h")


def purl(ecosystem, name, version) -> Column:
    """Package URL ``pkg:<ecosystem>/<name>@<version>``."""
    return F.concat(F.lit("pkg:"), _c(ecosystem), F.lit("/"), _c(name), F.lit("@"), _c(version))


def sbom_documents(components: DataFrame, group: str, ecosystem, name: str, version: str, timestamp: str) -> DataFrame:
    """One CycloneDX 1.5 document (JSON) for each value of ``group``, with its components in
    order of name and version. A document holds the components of one group by definition;
    for an inventory of all groups read the rows, not one document."""
    part = F.struct(F.col(name).alias("name"), F.col(version).alias("version"), F.lit("library").alias("type"), purl(ecosystem, name, version).alias("purl"))
    g = components.groupBy(group).agg(F.array_sort(F.collect_list(part)).alias("__c"))
    ordered = F.transform("__c", lambda c: F.struct(c["type"].alias("type"), c["name"].alias("name"), c["version"].alias("version"), c["purl"].alias("purl")))
    doc = F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version"),
                   F.struct(F.lit(timestamp).alias("timestamp")).alias("metadata"), ordered.alias("components"))
    return g.select(group, F.to_json(doc).alias("document"))


# Advisory severity -> SARIF level (anything else: warning).
SARIF_LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}


def sarif_level(severity) -> Column:
    m = F.create_map(*[x for k, v in SARIF_LEVELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.upper(_c(severity))], F.lit("warning"))


def sarif_results(vulns: DataFrame, rule_id: str, severity: str, package: str) -> DataFrame:
    """One SARIF result object (JSON) per vulnerability."""
    res = F.struct(F.coalesce(F.col(rule_id), F.lit("unknown")).alias("ruleId"), sarif_level(severity).alias("level"),
                   F.struct(F.concat(F.col(package), F.lit(" has known vulnerability")).alias("text")).alias("message"))
    return vulns.select(F.to_json(res).alias("result"))
