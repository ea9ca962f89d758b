"""Synthetic rows and relations.

Generation is keyed by rows of an existing table (or ``spark.range`` sized from one), and
every value is a seeded hash of the key, so a rerun - or a retried task after an executor
loss - produces exactly the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seeded(salt: str, *key: Column) -> Column:
    """A non-negative 60-bit integer from the md5 of the key's parts and a salt: the same in any
    engine that knows md5."""
    text = F.concat_ws("|", *[k.cast("string") for k in key], F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _h(key: Column, salt: str) -> Column:
    return seeded(salt, key)


def pick(key: Column, salt: str, values: Sequence[str]) -> Column:
    """Enum value chosen by hash."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.pmod(_h(key, salt), F.lit(len(values))) + 1).cast("int"))


def int_between(key: Column, salt: str, lo: int, hi: int) -> Column:
    return (F.pmod(_h(key, salt), F.lit(hi - lo + 1)) + lo).cast("long")


def synthetic_rows(base: DataFrame, key: str, seed: str = "s0") -> DataFrame:
    """One typed synthetic record per base row: email, public id, status enum,
    amount in a range and a creation date in a one-year window."""
    k = F.col(key)
    digest = F.sha2(F.concat(k.cast("string"), F.lit(seed)), 256)
    return base.select(
        k.alias(key),
        F.concat(F.lit("user"), int_between(k, seed + "e", 0, 999999).cast("string"), F.lit("@example.com")).alias("email"),
        F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4)).alias("public_id"),
        pick(k, seed + "s", ["active", "inactive", "pending"]).alias("status"),
        (int_between(k, seed + "a", 100, 100000) / 100.0).alias("amount"),
        F.date_add(F.to_date(F.lit("2024-01-01")), int_between(k, seed + "d", 0, 364).cast("int")).alias("created_on"))


def synthetic_relations(base: DataFrame, key: str, targets: int, min_n: int = 1, max_n: int = 5, seed: str = "r0") -> DataFrame:
    """One-to-many: each base row links to ``min_n``..``max_n`` distinct targets in
    [0, targets); duplicates from hash collisions are dropped."""
    k = F.col(key)
    n = int_between(k, seed + "n", min_n, max_n)
    x = base.select(k.alias(key), F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("i"))
    tgt = F.pmod(seeded(seed, F.col(key), F.col("i")), F.lit(targets))
    return x.select(key, tgt.alias("target")).distinct()
