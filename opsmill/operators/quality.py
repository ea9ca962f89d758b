"""Data-quality and migration checks.

Each check is one aggregate pass over the data (never a per-column loop of jobs) and
returns report rows; the same operators gate our own outputs in tests.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _stack(row: DataFrame, names: Sequence[str], cols: dict[str, str]) -> DataFrame:
    """Turn one wide aggregate row into one row per name (``stack``)."""
    parts = []
    for n in names:
        parts.append(F.struct(F.lit(n).alias("column"), *[F.col(p.format(n)).alias(k) for k, p in cols.items()]))
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def null_check(df: DataFrame, required: Sequence[str], severity: str = "CRITICAL") -> DataFrame:
    """Q1: NULLs in required columns -> one row per column with FAILED/PASSED."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in required])
    out = _stack(row, required, {"null_count": "n_{}"})
    return out.withColumn("status", F.when(F.col("null_count") > 0, "FAILED").otherwise("PASSED")).withColumn(
        "severity", F.lit(severity))


def duplicate_key_check(df: DataFrame, keys: Sequence[str], severity: str = "CRITICAL") -> DataFrame:
    """Q2: keys that occur more than once -> one summary row."""
    d = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return d.agg(F.count(F.lit(1)).alias("duplicate_keys"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows_involved")
                 ).withColumn("status", F.when(F.col("duplicate_keys") > 0, "FAILED").otherwise("PASSED")).withColumn(
        "severity", F.lit(severity))


def row_count_check(spark: SparkSession, tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """Q3: actual vs expected rows per table. The counts run as one union of aggregates."""
    parts = [df.agg(F.count(F.lit(1)).alias("actual")).select(F.lit(name).alias("table_name"), "actual")
             for name, df in tables.items()]
    actual = parts[0]
    for p in parts[1:]:
        actual = actual.unionByName(p)
    exp = spark.createDataFrame(list(expected.items()), "table_name string, expected long")
    return actual.join(exp, "table_name", "full").withColumn(
        "status", F.when(F.col("actual") == F.col("expected"), "PASS").otherwise("FAIL"))


def table_reconcile(source: DataFrame, target: DataFrame, key: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """Q4: source vs target by key -> rows tagged missing (only in source), extra (only in
    target) or changed (a compared column differs). Rows are compared through a 64-bit
    hash of the compared columns, so the join carries one long per side, not the rows."""
    h = lambda df: df.select(*key, F.xxhash64(*[F.col(c) for c in compare]).alias("__h"))
    s, t = h(source).withColumn("__s", F.lit(True)), h(target).withColumnRenamed("__h", "__t").withColumn("__in_t", F.lit(True))
    j = s.join(t, list(key), "full")
    status = (F.when(F.col("__in_t").isNull(), "missing").when(F.col("__s").isNull(), "extra")
              .when(F.col("__h") != F.col("__t"), "changed").otherwise("same"))
    return j.select(*key, status.alias("status"))


def gated_publish(df: DataFrame, path: str, checks: Sequence, mode: str = "overwrite") -> dict:
    """Q5: write to a new location, run the post-checks on what was written, and only then
    report it as published. A failing check leaves the previous location in use."""
    df.write.mode(mode).parquet(path)
    written = df.sparkSession.read.parquet(path)
    failures = [name for name, check in checks if not check(written)]
    return {"published": not failures, "path": path if not failures else None, "failed_checks": failures}


def backfill_column(df: DataFrame, col: str, derive: Column) -> DataFrame:
    """Q6: fill a new column for every row not yet migrated (NULL) from the source column."""
    if col not in df.columns:
        df = df.withColumn(col, F.lit(None).cast("boolean"))
    return df.withColumn(col, F.coalesce(F.col(col), derive))


def contract_errors(df: DataFrame, json_col: str, fields: dict[str, dict]) -> DataFrame:
    """Q7: JSON rows against a contract -> ``errors`` array<struct<type, path, message>>.

    ``fields`` maps a field to {type, required, minimum, maximum, enum}. The payload is
    parsed once with ``from_json`` and a declared schema; each rule is an expression."""
    spark_type = {"integer": T.LongType(), "number": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}
    schema = T.StructType([T.StructField(f, spark_type[r["type"]]) for f, r in fields.items()])
    parsed = F.from_json(F.col(json_col), schema)
    raw = lambda f: F.get_json_object(F.col(json_col), f"$.{f}")
    errs = [F.when(parsed.isNull(), F.struct(F.lit("parse").alias("type"), F.lit("$").alias("path"),
                                              F.lit("invalid JSON").alias("message")))]
    for f, rule in fields.items():
        v = parsed[f]
        path = F.lit(f"$.{f}")
        if rule.get("required"):
            errs.append(F.when(raw(f).isNull(), F.struct(F.lit("required").alias("type"), path.alias("path"),
                                                         F.lit(f"{f} is required").alias("message"))))
        errs.append(F.when(raw(f).isNotNull() & v.isNull(), F.struct(F.lit("type").alias("type"), path.alias("path"),
                                                                     F.lit(f"{f} must be {rule['type']}").alias("message"))))
        if "minimum" in rule:
            errs.append(F.when(v < rule["minimum"], F.struct(F.lit("minimum").alias("type"), path.alias("path"),
                                                             F.lit(f"{f} below {rule['minimum']}").alias("message"))))
        if "maximum" in rule:
            errs.append(F.when(v > rule["maximum"], F.struct(F.lit("maximum").alias("type"), path.alias("path"),
                                                             F.lit(f"{f} above {rule['maximum']}").alias("message"))))
        if "enum" in rule:
            errs.append(F.when(~v.isin(list(rule["enum"])), F.struct(F.lit("enum").alias("type"), path.alias("path"),
                                                                     F.lit(f"{f} not allowed").alias("message"))))
    return df.withColumn("errors", F.filter(F.array(*errs), lambda e: e.isNotNull()))


def collect_all_errors(df: DataFrame, rules: dict[str, Column], out: str = "errors") -> DataFrame:
    """Q8: every failed rule of a row (not just the first), as an array of rule names."""
    return df.withColumn(out, F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]),
                                       lambda x: x.isNotNull()))


def constraint_report(df: DataFrame, checks: dict[str, Column] = None, not_null: Sequence[str] = (),
                      unique: Sequence[Sequence[str]] = (), nulls_distinct: bool = True) -> DataFrame:
    """Q9: violation counts. A CHECK passes on NULL; UNIQUE ignores rows with a NULL key
    column unless ``nulls_distinct`` is False (NULLS NOT DISTINCT)."""
    checks = checks or {}
    aggs = [F.count_if(~F.coalesce(c, F.lit(True))).alias(f"check:{n}") for n, c in checks.items()]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"not_null:{c}") for c in not_null]
    rows = df.agg(*aggs) if aggs else None
    parts = []
    if rows is not None:
        names = [a for a in rows.columns]
        parts.append(rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("constraint"),
                                                                F.col(f"`{n}`").cast("long").alias("violations"))
                                                       for n in names])).alias("x")).select("x.*"))
    for keys in unique:
        src = df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)) if nulls_distinct else df
        dup = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        parts.append(dup.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("violations")).select(
            F.lit("unique:" + ",".join(keys)).alias("constraint"), "violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("status", F.when(F.col("violations") > 0, "FAIL").otherwise("PASS"))


def migration_anomalies(stats: DataFrame, key: str, rate: str, expected: str, error_rate: str,
                        low_factor: float = 0.5, max_error: float = 0.01) -> DataFrame:
    """Q10: rate < low_factor x expected -> low_throughput (warning); error rate > max_error
    -> high_error_rate (critical). One row per anomaly."""
    anomalies = F.filter(F.array(
        F.when(F.col(rate) < F.col(expected) * low_factor,
               F.struct(F.lit("low_throughput").alias("type"), F.lit("warning").alias("severity"))),
        F.when(F.col(error_rate) > max_error,
               F.struct(F.lit("high_error_rate").alias("type"), F.lit("critical").alias("severity")))),
        lambda x: x.isNotNull())
    return stats.select(key, F.explode(anomalies).alias("a")).select(key, "a.*")


DURATION_BUCKETS = [60, 300, 600, 1800, 3600]


def progress_metrics(runs: DataFrame, keys: Sequence[str], duration: str, rows: str, failed: Column,
                     buckets: Sequence[float] = DURATION_BUCKETS) -> DataFrame:
    """Q11: rows migrated, error count and a cumulative duration histogram (``le`` buckets,
    +Inf = count) per key, in one aggregate."""
    aggs = [F.sum(rows).alias("rows_migrated"), F.count_if(failed).alias("errors")]
    aggs += [F.count_if(F.col(duration) <= b).alias(f"le_{int(b)}") for b in buckets]
    aggs.append(F.count(F.lit(1)).alias("le_inf"))
    return runs.groupBy(*keys).agg(*aggs)


def lag_status(lag_seconds, yellow: int = 60, red: int = 300) -> Column:
    """Q12: green / yellow (>= 60 s) / red (>= 300 s)."""
    c = F.col(lag_seconds) if isinstance(lag_seconds, str) else lag_seconds
    return F.when(c >= red, "red").when(c >= yellow, "yellow").otherwise("green")


def index_usage_report(stats: DataFrame, min_seq_scan: int = 1, n: int = 10) -> dict[str, DataFrame]:
    """Q13: on an exported table-statistics frame: tables by average tuples read per
    sequential scan (top n), unused indexes (idx_scan = 0) by size."""
    seq = (stats.filter(F.col("seq_scan") >= min_seq_scan)
           .withColumn("avg_tuples_per_scan", F.col("seq_tup_read") / F.col("seq_scan"))
           .orderBy(F.col("avg_tuples_per_scan").desc(), "relname").limit(n))
    unused = stats.filter(F.col("idx_scan") == 0).orderBy(F.col("index_size").desc(), "relname")
    return {"seq_scans": seq, "unused_indexes": unused}


def normalize_sql(col) -> Column:
    """Q14: replace literals in a query text by ``?`` so equal templates compare equal."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.regexp_replace(c, r"'(?:[^']|'')*'", "?")
    c = F.regexp_replace(c, r"\b\d+(?:\.\d+)?\b", "?")
    return F.regexp_replace(F.lower(c), r"\s+", " ")


def n_plus_one(log: DataFrame, trace: str, query: str, min_repeats: int = 5) -> DataFrame:
    """Q14: the same query template issued more than ``min_repeats`` times in one trace."""
    return (log.groupBy(trace, normalize_sql(query).alias("template")).agg(F.count(F.lit(1)).alias("repeats"))
            .filter(F.col("repeats") > min_repeats))


def dataset_profile(df: DataFrame, cols: Sequence[str] | None = None, exact_distinct: bool = False) -> DataFrame:
    """Q15: one aggregate pass: rows, nulls, distinct (HyperLogLog unless exact), min and
    max (as text) per column; one output row per column. Exact distinct values are grouped
    column by column: a task holds values of one column, not a row for each value of all of them."""
    cols = list(cols or df.columns)
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        aggs += [F.count_if(F.col(c).isNull()).alias(f"nulls_{i}"), F.min(c).cast("string").alias(f"min_{i}"), F.max(c).cast("string").alias(f"max_{i}")]
        if not exact_distinct:
            aggs.append(F.approx_count_distinct(c).alias(f"distinct_{i}"))
    row = df.agg(*aggs)
    if exact_distinct:
        row = row.withColumns({f"distinct_{i}": df.select(F.col(c).alias("v")).distinct().select(F.count("v")).scalar() for i, c in enumerate(cols)})
    parts = [F.struct(F.lit(c).alias("column"), F.col("__rows").alias("rows"), F.col(f"nulls_{i}").alias("nulls"),
                      F.col(f"distinct_{i}").cast("long").alias("distinct"), F.col(f"min_{i}").alias("min"),
                      F.col(f"max_{i}").alias("max")) for i, c in enumerate(cols)]
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def profile_run(df: DataFrame, run: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Q15 / A2: one pass over a run's (or a partition's) rows: a row a column with counts, nulls, least and
    greatest value, and two mergeable sketches: HyperLogLog of the values, KLL of numeric ones.

    Append the rows to a history table; ``merged_profile`` profiles any union of runs from them without
    reading the data again. Each partition is sketched where it is and only sketches are merged."""
    cols = list(cols or df.columns)
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType,))}
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        aggs += [F.count_if(F.col(c).isNull()).alias(f"nulls_{i}"), F.min(c).cast("string").alias(f"min_{i}"), F.max(c).cast("string").alias(f"max_{i}"),
                 F.hll_sketch_agg(F.col(c).cast("string"), 14).alias(f"hll_{i}")]
        if c in numeric:
            aggs += [F.kll_sketch_agg_double(F.col(c).cast("double")).alias(f"kll_{i}"), F.min(F.col(c).cast("double")).alias(f"low_{i}"), F.max(F.col(c).cast("double")).alias(f"high_{i}")]
    none, gone = F.lit(None).cast("binary"), F.lit(None).cast("double")
    parts = [F.struct(F.lit(c).alias("column"), F.col("n").alias("rows"), F.col(f"nulls_{i}").alias("nulls"), F.col(f"min_{i}").alias("min"), F.col(f"max_{i}").alias("max"),
                      (F.col(f"low_{i}") if c in numeric else gone).alias("low"), (F.col(f"high_{i}") if c in numeric else gone).alias("high"),
                      F.col(f"hll_{i}").alias("hll"), (F.col(f"kll_{i}") if c in numeric else none).alias("kll")) for i, c in enumerate(cols)]
    return df.agg(*aggs).select(F.lit(run).alias("run"), F.explode(F.array(*parts)).alias("x")).select("run", "x.*")


def merged_profile(history: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75), runs: Sequence[str] | None = None) -> DataFrame:
    """Q15 / A2: the profile of a union of runs from their stored rows: exact counts, nulls and bounds,
    estimated distinct values (standard error about 1 %) and quantiles of numeric columns (rank error
    about 1 %). Bounds of numeric columns compare as numbers. The last row of a run and column that was written
    twice counts (an appended rerun replaces the run)."""
    h = history if runs is None else history.filter(F.col("run").isin(*runs))
    if "written_at" in history.columns:
        h = h.groupBy("run", "column").agg(F.max_by(F.struct(*[c for c in h.columns if c not in ("run", "column")]), "written_at").alias("x")).select("run", "column", "x.*")
    g = h.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("min").alias("min"), F.max("max").alias("max"), F.min("low").alias("low"), F.max("high").alias("high"),
                                F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("distinct"), F.kll_merge_agg_double("kll").alias("kll"), F.count("kll").alias("sketches"))
    known = (F.col("sketches") > 0) & (F.col("nulls") < F.col("rows"))
    marks = [F.when(known, F.kll_sketch_get_quantile_double(F.col("kll"), F.lit(float(q)))).alias(f"q{round(100 * q)}") for q in quantiles]
    return g.select("column", "rows", "nulls", "min", "max", "low", "high", "distinct", *marks)


def append_profile(df: DataFrame, run: str, path: str, cols: Sequence[str] | None = None) -> None:
    """Append a run's profile rows, with the time of writing, to the history table at ``path``."""
    profile_run(df, run, cols).withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


_SAFE = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
