"""Sources and sinks.

Every reader declares its schema (no inference on large inputs) and every writer is one
distributed job with one commit; loops of small inserts or batches become partitioning
and file sizing options.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# ----------------------------------------------------------------------------- S4 / S5
def bus_reader(spark: SparkSession, topic: str, bootstrap: str, fmt: str = "kafka", starting: str = "earliest", **options):
    """Streaming reader subscribed to a topic (key = aggregate id, value = JSON). The
    connector jar is not part of this image; tests pass ``fmt='parquet'`` or a file
    source with the same column names."""
    r = spark.readStream.format(fmt)
    if fmt == "kafka":
        r = r.option("kafka.bootstrap.servers", bootstrap).option("subscribe", topic).option("startingOffsets", starting)
    for k, v in options.items():
        r = r.option(k, v)
    return r


def decode_events(raw: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Bus records -> typed events (key as string, value parsed with a declared
    schema; unparseable values keep a NULL payload for the dead-letter path)."""
    return raw.select(F.col("key").cast("string").alias("key"), F.from_json(F.col("value").cast("string"), schema).alias("event"),
                      *[c for c in ("topic", "partition", "offset", "timestamp") if c in raw.columns])


def encode_events(events: DataFrame, type_col: str, key_col: str, payload_cols: Sequence[str]) -> DataFrame:
    """Events -> (topic, key, value) rows: topic = event type, key = aggregate id."""
    return events.select(F.col(type_col).alias("topic"), F.col(key_col).cast("string").alias("key"),
                         F.to_json(F.struct(*payload_cols)).alias("value"))


def bus_writer(df: DataFrame, bootstrap: str, checkpoint: str, fmt: str = "kafka", path: str | None = None):
    """Streaming writer publishing (topic, key, value) rows."""
    w = df.writeStream.format(fmt).option("checkpointLocation", checkpoint)
    if fmt == "kafka":
        w = w.option("kafka.bootstrap.servers", bootstrap)
    elif path:
        w = w.option("path", path)
    return w


# ----------------------------------------------------------------------------- S6-S8
def bulk_load_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, mode: str = "FAILFAST") -> DataFrame:
    """``COPY ... FROM csv HEADER``: one distributed read with a declared schema."""
    return spark.read.schema(schema).option("header", header).option("mode", mode).csv(path)


def append_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """One append job (one commit) instead of batches of INSERTs."""
    w = df.write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def id_ranges(df: DataFrame, key: str, range_size: int) -> DataFrame:
    """Fixed-size id ranges over [min(id), max(id)] with their row counts - the split
    the sample copies with four threads; Spark reads the ranges in parallel tasks."""
    lo = df.select(F.min(key)).scalar()
    r = F.floor((F.col(key) - lo) / F.lit(range_size)).cast("long")
    return (df.groupBy(r.alias("range_no")).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first_id"),
                                                F.max(key).alias("last_id")))


def jdbc_range_read(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int,
                    properties: dict | None = None) -> DataFrame:
    """Partitioned JDBC read (one task per id range)."""
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions,
                           properties=properties or {})


def chunked_copy(df: DataFrame, path: str, key: str, rows_per_file: int = 10_000, fmt: str = "parquet") -> None:
    """The keyset-cursor batch loop becomes one write; files are sorted by the key
    inside and capped at ``rows_per_file`` rows each."""
    (df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").format(fmt)
     .option("maxRecordsPerFile", rows_per_file).save(path))


# ----------------------------------------------------------------------------- S9
def read_text_corpus(spark: SparkSession, root: str, glob: str = "*", skip_names: Sequence[str] = ("README",),
                     skip_substrings: Sequence[str] = (".spec.", ".test.", "/test/", "/tests/")) -> DataFrame:
    """One row per file (path, content) under ``root`` (recursive), whole text; file
    names in ``skip_names`` and paths containing a skip substring are dropped."""
    # text() has its own wholetext parameter (default False) that overrides an option
    df = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
          .text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    cond = F.lit(True)
    for n in skip_names:
        cond = cond & ~base.startswith(n)
    for s in skip_substrings:
        cond = cond & ~F.col("path").contains(s)
    return df.filter(cond)


# ----------------------------------------------------------------------------- S10 / S11
def batch_rows(rows: DataFrame, order: Sequence[str], size: int = 50) -> DataFrame:
    """Batch number per row, consecutive ``size``-row chunks in a total order."""
    from opsmill.operators.relational import ordered_batches

    return ordered_batches(rows, order, size, "batch")


def write_batches(rows: DataFrame, path: str, order: Sequence[str], size: int = 50, upsert_keys: Sequence[str] = ()) -> DataFrame:
    """Rows -> ``batch=NN/`` JSON files, plus a one-row plan manifest (totals and
    upsert keys) written next to them. Returns the manifest."""
    b = batch_rows(rows, order, size)
    b.drop("position").write.mode("overwrite").partitionBy("batch").json(f"{path}/batches")
    manifest = b.agg(F.count(F.lit(1)).alias("total_rows"), F.countDistinct("batch").alias("batches")).withColumn(
        "batch_size", F.lit(size)).withColumn("upsert_keys", F.array(*[F.lit(k) for k in upsert_keys]))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/plan")
    return manifest


def write_json_report(rows: DataFrame, warnings: DataFrame, path: str, order: Sequence[str], generated_at: str) -> None:
    """Rows sorted for stable diffs plus warnings and metadata, each as JSON lines
    under ``path`` (a distributed write; no single in-memory document)."""
    rows.orderBy(*order).write.mode("overwrite").json(f"{path}/rows")
    warnings.write.mode("overwrite").json(f"{path}/warnings")
    rows.sparkSession.createDataFrame([(generated_at,)], "generated_at string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


# ----------------------------------------------------------------------------- S12
def export_user_data(requests: DataFrame, user: str, sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """For each requested user, one nested record with the rows of every source
    (profile, content, activity, consents ...) and its JSON text. Only requested users
    are gathered: sources are semi-joined to the request list before any grouping."""
    out = requests.select(user).distinct()
    for name, (df, key) in sources.items():
        rows = df.join(requests.select(F.col(user).alias(key)).distinct(), key, "left_semi")
        nested = rows.groupBy(F.col(key).alias(user)).agg(F.collect_list(F.struct(*[c for c in df.columns if c != key])).alias(name))
        empty = F.array().cast(nested.schema[name].dataType)
        out = out.join(nested, user, "left").withColumn(name, F.coalesce(F.col(name), empty))
    return out.withColumn("export_json", F.to_json(F.struct(*[c for c in out.columns])))


def export_user_parts(requests: DataFrame, user: str, sources: dict[str, tuple[DataFrame, str]], rows_per_part: int = 10_000) -> DataFrame:
    """(user, part, one array a source): the nested records of each requested user in parts of about
    ``rows_per_part`` rows, so no user's rows meet in one record or task. A row's part follows from its
    values; a user without rows has one part of empty arrays."""
    asked = requests.select(F.col(user)).distinct()
    kept = {}
    for name, (df, key) in sources.items():
        item = F.struct(*[c for c in df.columns if c != key])
        kept[name] = df.select(F.col(key).alias(user), item.alias("item")).join(asked, user, "left_semi")
    sizes = None
    for rows in kept.values():
        n = rows.groupBy(user).agg(F.count(F.lit(1)).alias("n"))
        sizes = n if sizes is None else sizes.unionByName(n)
    sizes = sizes.groupBy(user).agg(F.ceil(F.sum("n") / F.lit(rows_per_part)).cast("int").alias("parts"))
    out = asked.join(sizes, user, "left").select(user, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    for name, rows in kept.items():
        dealt = rows.join(sizes, user).withColumn("part", F.pmod(F.xxhash64(F.to_json("item")), F.col("parts")).cast("int"))
        nested = dealt.groupBy(user, "part").agg(F.sort_array(F.collect_list("item")).alias(name))  # about rows_per_part rows
        out = out.join(nested, [user, "part"], "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(nested.schema[name].dataType)))
    return out


def flat_user_rows(requests: DataFrame, user: str, sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(user, source, record, field, value): the same rows flattened, one line a field; ``record`` tells
    the rows of a source apart. Nothing is gathered, so a user may have any number of rows."""
    asked = requests.select(F.col(user)).distinct()
    out = None
    for name, (df, key) in sources.items():
        fields = [c for c in df.columns if c != key]
        cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields])
        rows = df.join(asked.select(F.col(user).alias(key)), key, "left_semi").withColumn("__record", F.xxhash64(*[F.col(c).cast("string") for c in fields], F.monotonically_increasing_id()))
        flat = rows.select(F.col(key).alias(user), F.lit(name).alias("source"), F.hex("__record").alias("record"), F.explode(cells).alias("x")).select(user, "source", "record", "x.field", "x.value")
        out = flat if out is None else out.unionByName(flat)
    return out


def write_user_export(requests: DataFrame, user: str, sources: dict[str, tuple[DataFrame, str]], path: str, fmt: str = "json", rows_per_part: int = 10_000) -> None:
    """Write the export as nested ``json`` or ``xml`` (an element a user part, an element a row) or flattened
    ``csv`` (a line a field, with a header), spread over files."""
    if fmt == "csv":
        flat_user_rows(requests, user, sources).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
        return
    parts = export_user_parts(requests, user, sources, rows_per_part)
    if fmt == "json":
        parts.write.mode("overwrite").json(path)
    elif fmt == "xml":
        parts.write.mode("overwrite").format("xml").option("rootTag", "users").option("rowTag", "user").save(path)
    else:
        raise ValueError(f"unknown export format {fmt!r}")
