"""Text scalar functions. All return Columns built from Spark
built-ins, so they stay inside whole-stage code generation."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ----------------------------------------------------------------------------- F1
def issue_keys(text, project: str = "PROJ") -> Column:
    """every ``{PROJECT}-<digits>`` key in the text, in order of appearance."""
    return F.regexp_extract_all(_c(text), F.lit(rf"\b{project}-\d+\b"), 0)


def trailer_int(text, name: str) -> Column:
    """Integer of a ``Name: <int>`` trailer line (last one wins); NULL if absent
    or not an integer."""
    vals = F.regexp_extract_all(_c(text), F.lit(rf"(?m)^{name}:\s*(-?\d+)\s*$"), 1)
    return F.try_element_at(vals, F.lit(-1)).cast("int")


def shortstat(text) -> Column:
    """F1 / D3: ``N files changed, I insertions(+), D deletions(-)`` -> struct; missing
    parts count 0, no match gives zeros."""
    pat = r"(\d+) files? changed(?:, (\d+) insertions?\(\+\))?(?:, (\d+) deletions?\(-\))?"

    def grp(i):
        return F.coalesce(F.nullif(F.regexp_extract(_c(text), pat, i), F.lit("")).cast("int"), F.lit(0))

    return F.struct(grp(1).alias("files_changed"), grp(2).alias("insertions"), grp(3).alias("deletions"),
                    (grp(2) - grp(3)).alias("net_change"))


HTTP_VERBS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]


def exported_verbs(source) -> Column:
    """HTTP verbs exported by a route module (``export async function GET``,
    ``export const POST =``), distinct, in order of first appearance."""
    named = rf"\bexport(?:\s+[a-z]+){{1,2}}\s+({'|'.join(HTTP_VERBS)})\b"  # one or two keywords, then the name
    return F.array_distinct(F.regexp_extract_all(_c(source), F.lit(named), 1))


# ----------------------------------------------------------------------------- F2-F5
def normalize_path(path, prefix: str | None = None, exclude: Sequence[str] = ()) -> Column:
    """collapse ``//``, ensure a leading ``/``, drop a trailing ``/`` (root stays
    ``/``), ``:id`` -> ``{id}``; prepend ``prefix`` unless the path is excluded."""
    p = F.regexp_replace(_c(path), r"/{2,}", "/")
    p = F.regexp_replace(p, r":([A-Za-z_][A-Za-z0-9_]*)", "{$1}")
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    p = F.when((F.length(p) > 1) & p.endswith("/"), F.regexp_replace(p, "/+$", "")).otherwise(p)
    p = F.when(p == "", F.lit("/")).otherwise(p)
    if prefix:
        pre = "/" + prefix.strip("/")
        excluded = F.lit(False)
        for e in exclude:
            excluded = excluded | p.startswith(e)
        joined = F.when(p == "/", F.lit(pre)).otherwise(F.concat(F.lit(pre), p))
        p = F.when(excluded, p).otherwise(joined)
    return p


def file_route_to_path(route_dir) -> Column:
    """a file-system route folder to a URL path: ``(group)`` and ``@slot`` segments
    vanish, ``[id]`` -> ``{id}``, ``[...x]``/``[[...x]]`` -> ``{...x}``."""
    segs = F.split(_c(route_dir), "/")
    kept = F.filter(segs, lambda s: (s != "") & ~s.rlike(r"^\(.*\)$") & ~s.startswith("@"))
    conv = F.transform(kept, lambda s: F.regexp_replace(
        F.regexp_replace(s, r"^\[\[?\.\.\.(.+?)\]?\]$", "{...$1}"), r"^\[(.+)\]$", "{$1}"))
    return F.concat(F.lit("/"), F.array_join(conv, "/"))


def spec_name(name, service_code: bool = True) -> Column:
    """service name of a spec file: drop the extension and a trailing ``-vN``; with
    ``service_code`` (OpenAPI) also a trailing ``-api``, and a name made of a
    three-lowercase-letter code plus topic segments keeps only the code
    (``abc-strategies-v1.yaml`` -> ``abc``). AsyncAPI names only lose the version."""
    n = F.regexp_replace(_c(name), r"\.(json|ya?ml)$", "")
    n = F.regexp_replace(n, r"-v\d+$", "")
    if not service_code:
        return n
    n = F.regexp_replace(n, r"-api$", "")
    code = F.regexp_extract(n, r"^([a-z]{3})(?:[-_].*)?$", 1)
    return F.when(code != "", code).otherwise(n)


def glob_to_regex(pattern: str) -> str:
    """fnmatch pattern -> anchored Java regex (computed once, on the driver)."""
    rx = fnmatch.translate(pattern)  # (?s:...)\Z
    return "^" + rx.replace(r"\Z", "$")


def glob_match(col, patterns: Sequence[str]) -> Column:
    """true when the value matches any glob in the allow list."""
    if not patterns:
        return F.lit(False)
    return _c(col).rlike("|".join(f"(?:{glob_to_regex(p)})" for p in patterns))


# File categories tested in this order; a substring hit wins.
FILE_CATEGORIES = [
    ("source", [".js", ".ts", ".py", ".java", ".go", ".rs"]),
    ("test", ["test", "spec", ".test.", ".spec."]),
    ("config", ["config", ".json", ".yml", ".yaml", ".toml"]),
    ("docs", [".md", "README", "CHANGELOG", ".rst"]),
    ("styles", [".css", ".scss", ".less"]),
    ("build", ["Makefile", "Dockerfile", ".gradle", "pom.xml"]),
]


def categorize_file(name, mode: str = "compat") -> Column:
    """first category whose substring occurs in the file name.

    ``compat`` keeps the literal order (so ``package.json`` and ``a.test.js`` are
    "source" because ``.js`` is tested first); ``suffix`` tests tests/specs first and
    matches extensions only at the end of the name."""
    n = _c(name)
    cats = FILE_CATEGORIES
    if mode == "suffix":
        cats = [cats[1], cats[0]] + cats[2:]
    expr = None
    for cat, pats in cats:
        if mode == "suffix":
            cond = F.lit(False)
            for p in pats:
                cond = cond | (n.endswith(p) if p.startswith(".") and p.count(".") == 1 else n.contains(p))
        else:
            cond = F.lit(False)
            for p in pats:
                cond = cond | n.contains(p)
        expr = F.when(cond, cat) if expr is None else expr.when(cond, cat)
    return expr.otherwise("other")


# ----------------------------------------------------------------------------- F7-F10
def near_name(a, b, max_distance: int = 2) -> Column:
    """``0 < levenshtein(lower(a), b) <= max_distance`` (threshold form stops early)."""
    d = F.levenshtein(F.lower(_c(a)), _c(b), max_distance)
    return (d > 0) & (d <= max_distance)


def trigrams(text) -> Column:
    """F8: pg_trgm trigram set: lower-case words of letters/digits, each padded with two
    spaces in front and one behind, every 3-character window, distinct."""
    words = F.filter(F.split(F.lower(_c(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2),
                                                      lambda i: F.substring(w, i, 3)))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a, b) -> Column:
    """F8: |A & B| / |A | B| of the trigram sets (0 when both are empty)."""
    ta, tb = trigrams(a), trigrams(b)
    inter = F.size(F.array_intersect(ta, tb))
    union = F.size(F.array_union(ta, tb))
    return F.when(union == 0, F.lit(0.0)).otherwise(inter / union)


def tokens(text) -> Column:
    """lower-case word tokens (letters and digits) of the whole text."""
    return F.filter(F.split(F.lower(_c(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


EMAIL_RX = r"^[^@]+@[^@]+$"


def check_email(col) -> Column:
    """CHECK (email ~ '^[^@]+@[^@]+$'); NULL passes a CHECK."""
    return F.coalesce(_c(col).rlike(EMAIL_RX), F.lit(True))


def check_length(col, max_len: int, min_len: int = 0) -> Column:
    return F.coalesce((F.length(_c(col)) <= max_len) & (F.length(_c(col)) >= min_len), F.lit(True))


def check_allowed(col, values: Sequence) -> Column:
    return F.coalesce(_c(col).isin(list(values)), F.lit(True))


# ----------------------------------------------------------------------------- F23
def front_matter(content) -> Column:
    """the ``---`` block at the top of a document as a map of key -> value; quotes
    around values are stripped, comment lines (``#``) and lines without ``:`` skipped.
    Documents without front matter give an empty map."""
    block = F.regexp_extract(_c(content), r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    lines = F.filter(F.split(block, r"\r?\n"),
                     lambda l: (F.trim(l) != "") & ~F.trim(l).startswith("#") & l.contains(":"))
    entries = F.transform(lines, lambda l: F.struct(
        F.trim(F.regexp_extract(l, r"^([^:]+):", 1)).alias("key"),
        F.regexp_replace(F.trim(F.regexp_extract(l, r"^[^:]+:(.*)$", 1)), r"^(['\"])(.*)\1$", "$2").alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e: e["key"] != ""))


def quoted_phrases(text, limit: int = 4) -> Column:
    """trigger phrases = the first ``limit`` double-quoted phrases in a description."""
    return F.slice(F.regexp_extract_all(_c(text), F.lit(r'"([^"]+)"'), 1), 1, limit)
