"""Bounded training samples and fold columns shared by the trained operators.

A sample is cut by a hash of the id (and, where asked for, at a share for each class), so
the same rows come out on every run, no shuffle of texts is needed, and the expected size
is the documented bound whatever the size of the table. Classes cut at shares of their own
carry the inverse share as a weight, which gives back the class mix of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GRAIN = 1_000_003


def remainder(id_column: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids count as remainder -1 (in no fold)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(mod)), F.lit(-1))


def bounded(df: DataFrame, id_column: str | Sequence[str], by: str, rows_each: int, weight: str | None = None) -> DataFrame:
    """About ``rows_each`` rows of each value of ``by`` (all, where there are fewer). The id
    columns together should tell rows apart: equal ones are in or out together. ``weight``
    names a column for the number of rows that each sampled row stands for."""
    ids = [id_column] if isinstance(id_column, str) else list(id_column)
    sizes = {r[by]: r["n"] for r in df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(_GRAIN)
    for value, n in sorted(sizes.items(), key=lambda x: str(x[0])):
        if n > rows_each:
            share = F.when(F.col(by).eqNullSafe(F.lit(value)), F.lit(int(_GRAIN * rows_each / n))).otherwise(share)
    cut = df.filter(F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in ids], F.lit("sample")), F.lit(_GRAIN)) < share)
    return cut if weight is None else cut.withColumn(weight, F.lit(float(_GRAIN)) / share)


def weighted(sample: DataFrame) -> DataFrame:
    """``sample`` with ``__weight``; rows of a sample without one stand for themselves."""
    return sample if "__weight" in sample.columns else sample.withColumn("__weight", F.lit(1.0))


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_column: str, text: str, mod: int, held: int, rows_each: int) -> DataFrame:
    """(id, text, label, weight) of a bounded sample of the labelled rows outside the held-out fold.

    Only rows with a 0/1 label and an id count; the label side is at most twice
    ``rows_each`` rows, so it may be broadcast.
    """
    usable = labels.select(F.col(id_column).alias("__id"), F.col(label).cast("int").alias("__label")).filter("__label in (0, 1) and __id is not null")
    usable = bounded(usable.filter(remainder("__id", mod) != held), "__id", "__label", rows_each, "__weight")
    side = docs.select(F.col(id_column).alias("__id"), F.col(text).cast("string").alias("__text"))
    return side.join(F.broadcast(usable), "__id").select("__id", "__text", "__label", "__weight")
