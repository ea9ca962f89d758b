"""Extension points: user hooks, handler registries, composition,
table functions and custom aggregates.

Built-in expressions come first; a Python hook is wrapped as an Arrow-batched pandas UDF
(never a row-at-a-time UDF), and custom aggregates are composed from sort-based windows
and built-in aggregates so a large group spills instead of being held in one Python
process. Per-key stateful folds live in ``folds.ordered_fold`` (X4).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# ----------------------------------------------------------------------------- X1
def vectorized(fn: Callable[[pd.Series], pd.Series], return_type: T.DataType) -> Callable[..., Column]:
    """Wrap a pandas Series -> Series function as an Arrow-batched pandas UDF."""
    return F.pandas_udf(fn, return_type)


def apply_hook(df: DataFrame, col: str, fn: Callable[[pd.Series], pd.Series], out: str,
               return_type: T.DataType = T.StringType()) -> DataFrame:
    """A user transform over one column, evaluated batch-wise."""
    return df.withColumn(out, vectorized(fn, return_type)(F.col(col)))


# ----------------------------------------------------------------------------- X2
class HandlerRegistry:
    """``register(event_type, handler)``; ``dispatch`` applies each handler to the rows
    of its type and unions the outputs; ``unhandled`` reports the types with no handler
    (the sample raises on an unknown type - here they become a report, not a crash)."""

    def __init__(self, type_col: str = "event_type"):
        self.type_col = type_col
        self.handlers: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, event_type: str, handler: Callable[[DataFrame], DataFrame]) -> "HandlerRegistry":
        if event_type in self.handlers:
            raise ValueError(f"handler for {event_type} already registered")
        self.handlers[event_type] = handler
        return self

    def dispatch(self, df: DataFrame) -> DataFrame:
        outs = [h(df.filter(F.col(self.type_col) == t)) for t, h in self.handlers.items()]
        if not outs:
            raise ValueError("no handlers registered")
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), outs)

    def unhandled(self, df: DataFrame) -> DataFrame:
        return (df.filter(~F.col(self.type_col).isin(list(self.handlers)) | F.col(self.type_col).isNull())
                .groupBy(self.type_col).agg(F.count(F.lit(1)).alias("events")))


# ----------------------------------------------------------------------------- X3
def pipe(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """``pipe(f, g, h)(df)`` = ``df.transform(f).transform(g).transform(h)`` - one
    logical plan, optimised as a whole."""
    def run(df: DataFrame) -> DataFrame:
        return functools.reduce(lambda acc, f: acc.transform(f), steps, df)
    return run


# ----------------------------------------------------------------------------- X5
def table_function(df: DataFrame, rows: Column, keep: Sequence[str] = ()) -> DataFrame:
    """One input row -> many output rows, JVM-side: ``rows`` is an array<struct>
    expression (e.g. ``transform`` over a pattern array); ``inline`` turns it into rows."""
    return df.select(*keep, F.inline(rows))


def python_table_function(df: DataFrame, udtf_cls, args: Sequence[str], keep: Sequence[str] = ()):
    """X5 (Python): a ``pyspark.sql.functions.udtf`` class applied laterally per row. Use
    only when the expansion cannot be written with built-in expressions."""
    spark = df.sparkSession
    base = getattr(udtf_cls, "func", udtf_cls)  # a @udtf object wraps the class in .func
    name = f"udtf_{getattr(base, '__name__', 'table_fn').lower()}"
    spark.udtf.register(name, udtf_cls)
    df.createOrReplaceTempView("__udtf_input")
    cols = ", ".join(keep)
    return spark.sql(f"SELECT {cols + ', ' if cols else ''}t.* FROM __udtf_input, LATERAL {name}({', '.join(args)}) t")


# ----------------------------------------------------------------------------- X6
def trimmed_mean(df: DataFrame, keys: Sequence[str], value: str, cut: float = 0.1, out: str = "trimmed_mean") -> DataFrame:
    """Mean after dropping ``floor(cut x n)`` values from each end of every group - a
    user-defined aggregate composed from a sort-based window (spillable) and ``avg``."""
    w = Window.partitionBy(*keys).orderBy(value)
    x = df.withColumn("__rn", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    k = F.floor(F.col("__n") * cut)
    return x.filter((F.col("__rn") > k) & (F.col("__rn") <= F.col("__n") - k)).groupBy(*keys).agg(F.avg(value).alias(out))


def mergeable_aggregate(df: DataFrame, keys: Sequence[str], value: str, partial: Callable[[pd.Series], object], merge: Callable[[object, object], object],
                     finish: Callable[[object], float], out: str) -> DataFrame:
    """X6 (Python): any grouped reduction with a mergeable state, over groups of any size.

    ``partial`` reduces the values of a group within one Arrow batch to a state, ``merge`` joins two
    states, ``finish`` gives the result. Only pickled states are shuffled, and those of a group
    are merged one after the other, so no task holds a group. Merging happens in no fixed order."""
    import pickle

    from opsmill.operators.folds import Fold, ordered_fold

    keys = list(keys)
    fields = [df.schema[k] for k in keys]

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        for pdf in batches:
            for key, rows in pdf.groupby(keys, dropna=False, sort=False)[value]:
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                state = partial(rows)
                states[key] = merge(states[key], state) if key in states else state
            if len(states) > 100_000:
                yield pd.DataFrame([(*k, pickle.dumps(s)) for k, s in states.items()], columns=[*keys, "state"])
                states = {}
        yield pd.DataFrame([(*k, pickle.dumps(s)) for k, s in states.items()], columns=[*keys, "state"])

    class Merge(Fold):
        def init(self, key):
            return {}

        def step(self, s, row):
            state = pickle.loads(bytes(row["state"]))
            s["row"], s["state"] = {k: row[k] for k in keys}, merge(s["state"], state) if "state" in s else state
            return s, None

        def finish(self, s):
            return [{**s["row"], out: float(finish(s["state"]))}]

    states = df.select(*keys, value).mapInPandas(reduce, T.StructType([*fields, T.StructField("state", T.BinaryType())]))
    return ordered_fold(states, keys, [], Merge(), T.StructType([*fields, T.StructField(out, T.DoubleType())]))


def pandas_aggregate(df: DataFrame, keys: Sequence[str], value: str, fn: Callable[[pd.Series], float], out: str,
                     max_group_rows: int = 5_000_000) -> DataFrame:
    """X6 (Python): grouped-aggregate pandas UDF for arbitrary reductions. Such a UDF sees a
    whole group at once, so the largest group is measured first and the call refuses
    groups above ``max_group_rows`` instead of risking an executor out of memory; a reduction with a
    mergeable state has no such bound in ``mergeable_aggregate``."""
    biggest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if biggest > max_group_rows:
        raise ValueError(f"largest group has {biggest} rows (bound {max_group_rows}); express the aggregate with built-ins")
    udf = F.pandas_udf(fn, T.DoubleType())  # grouped aggregate: Series -> scalar
    return df.groupBy(*keys).agg(udf(F.col(value)).alias(out))
