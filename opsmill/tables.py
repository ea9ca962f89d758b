"""Lazy access to the input tables of one scale-factor folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()


class Tables:
    """``Tables(spark, sf_dir).orders`` -> a parquet scan.

    Reads are lazy; Catalyst prunes columns and pushes filters into each scan, so a table
    is never read in full unless a query needs every column.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.read(name)
        raise AttributeError(name)

    @cached_property
    def derived(self):
        from opsmill.plans import derived

        return derived.Derived(self)
