"""Event-log scans.

An event log at scale is a parquet table partitioned by a coarse time or position range
and sorted by (stream_id, version) inside files, so the predicates below prune files by
min/max statistics. Ordering is applied only where the consumer needs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Event record of the log (one schema for batch and streaming reads).
EVENT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("stream_id", T.StringType()),
    T.StructField("stream_type", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("event_data", T.StringType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("version", T.LongType()),
    T.StructField("global_position", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
])


def read_event_log(spark: SparkSession, path: str, from_position: int = 0, schema: T.StructType | None = None) -> DataFrame:
    """Events after a global position. The filter is pushed to the parquet scan."""
    df = spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)
    return after_position(df, from_position)


def after_position(df: DataFrame, from_position: int, position: str = "global_position") -> DataFrame:
    """S1 on an existing DataFrame: ``global_position > p`` (consumers sort if they must)."""
    return df.filter(F.col(position) > F.lit(from_position))


def read_stream_of(df: DataFrame, stream_id: str, from_version: int = 0, limit: int = 1000,
                   stream_col: str = "stream_id", version: str = "version") -> DataFrame:
    """One aggregate's events from a version on, in version order, at most ``limit``."""
    return (df.filter((F.col(stream_col) == F.lit(stream_id)) & (F.col(version) >= F.lit(from_version)))
            .orderBy(version).limit(limit))


def category_of(stream_col: str = "stream_id"):
    """S3: the aggregate type of a stream id such as ``Order-<uuid>``."""
    return F.split_part(F.col(stream_col), F.lit("-"), F.lit(1))


def read_category(df: DataFrame, category: str, stream_col: str = "stream_id") -> DataFrame:
    """S3: all streams of one aggregate type (prefix filter, pushed down as StartsWith)."""
    return df.filter(F.col(stream_col).startswith(category + "-"))
