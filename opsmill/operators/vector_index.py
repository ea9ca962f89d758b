"""A persisted inverted-list index for vector search.

``build`` fits coarse centroids on a bounded sample, then indexes every vector: its list (the nearest
centroid) and its residual as one signed byte per dimension with a scale. The codes are written sorted by
list, so reading a few lists skips the row groups of all others; range partitioning by (list, id) splits
a list that holds a third of all vectors. ``search`` probes each query's nearest lists, estimates
similarities from centroid and code alone, and reads the full vectors of the best ``rerank`` candidates
a query for the exact ranking. Candidates are the best of all probed rows by (estimate, id): they do
not depend on tasks or batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmill.session import bounded, cut_lineage

#: Vectors that the centroids are fitted on, at most (those of the least hashes).
SAMPLE = 50_000
QUERY_BLOCK = 2_000
_ROUNDS = 12


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def coarse_centroids(vectors: DataFrame, vec_id: str, vec: str, lists: int, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Unit centroids by spherical k-means on a sample chosen by a hash of the id."""
    total = vectors.count()
    rows = vectors.select(F.col(vec_id).cast("string").alias("i"), F.col(vec).cast("array<double>").alias("v")).filter("v is not null")
    if total > sample:
        rows = rows.filter(F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1_000_003)) < int(1_000_003 * sample / total))
    got = sorted(rows.collect(), key=lambda r: (r["i"] is None, r["i"] or ""))  # about ``sample`` vectors
    if not got:
        return np.zeros((0, 0))
    x = _unit(np.array([r["v"] for r in got]))
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.permutation(len(x))[:lists])]
    for _ in range(_ROUNDS):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        full = np.bincount(near, minlength=len(c)) > 0
        c = np.where(full[:, None], _unit(np.where(full[:, None], sums, 1.0)), c)
    return c


def build(vectors: DataFrame, vec_id: str, vec: str, path: str, lists: int | None = None, sample: int = SAMPLE, seed: int = 7) -> None:
    """Write the index of ``vectors`` to ``path``: ``centroids`` and ``codes``. Null vectors are not indexed;
    an id that occurs twice has two rows. ``lists`` is about two square roots of the rows by default."""
    spark = vectors.sparkSession
    lists = lists or int(np.clip(2 * np.sqrt(vectors.count()), 8, 4096))
    c = coarse_centroids(vectors, vec_id, vec, lists, sample, seed)
    shared = spark.sparkContext.broadcast(c)  # at most ``lists`` vectors
    schema = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("id", vectors.schema[vec_id].dataType), T.StructField("scale", T.DoubleType()), T.StructField("code", T.BinaryType())])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cents = shared.value
        for pdf in batches:
            if pdf.empty:
                continue
            x = _unit(np.stack(pdf["v"].to_numpy()).astype(np.float64))
            near = np.argmax(x @ cents.T, axis=1)
            rest = x - cents[near]
            scale = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127
            code = np.rint(rest / scale[:, None]).astype(np.int8)
            yield pd.DataFrame({"list": near.astype(np.int32), "id": pdf["id"], "scale": scale, "code": [r.tobytes() for r in code]})

    rows = vectors.select(F.col(vec_id).alias("id"), F.col(vec).cast("array<double>").alias("v")).filter("v is not null")
    codes = rows.mapInPandas(encode, schema)
    codes.repartitionByRange("list", "id").sortWithinPartitions("list", "id").write.parquet(f"{path}/codes")
    spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(c)], "list int, centroid array<double>").write.parquet(f"{path}/centroids")


def _block(spark: SparkSession, path: str, ids: list, rows: list, q_type: T.DataType, id_type: T.DataType, cents: np.ndarray, probe_share: float, rerank: int) -> DataFrame:
    """(q, id, estimate): each task's best ``rerank`` of the probed rows for every query of a block."""
    q = _unit(np.array(rows, dtype=np.float64))
    probes = max(1, int(np.ceil(probe_share * len(cents))))
    order = np.argsort(-np.round(q @ cents.T, 9), axis=1, kind="stable")[:, :probes]
    asks = np.zeros((len(cents), len(q)), dtype=bool)
    asks[order, np.arange(len(q))[:, None]] = True
    wanted = np.flatnonzero(asks.any(axis=1)).tolist()
    shared = spark.sparkContext.broadcast((q, asks, cents))
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("id", id_type), T.StructField("estimate", T.DoubleType())])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, asks, cents = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            near, own = pdf["list"].to_numpy(), pdf["id"].to_numpy()
            code = np.frombuffer(b"".join(pdf["code"]), np.int8).reshape(len(pdf), -1)
            for one in np.unique(near):
                at = np.flatnonzero(near == one)
                x = cents[one] + code[at] * pdf["scale"].to_numpy()[at, None]
                asked = np.flatnonzero(asks[one])
                estimate = np.round(x @ q[asked].T, 9)
                for j, col in zip(asked.tolist(), estimate.T, strict=True):
                    old = best.get(j, (np.zeros(0), own[:0]))
                    s, i = np.concatenate([old[0], col]), np.concatenate([old[1], own[at]])
                    keep = np.lexsort((i, -s))[:rerank]
                    best[j] = s[keep], i[keep]
        for j, (s, i) in best.items():
            yield pd.DataFrame({"q": np.full(len(s), j), "id": i, "estimate": s})

    codes = spark.read.parquet(f"{path}/codes").filter(F.col("list").isin(wanted))
    found = codes.mapInPandas(scan, schema)
    w = Window.partitionBy("q").orderBy(F.col("estimate").desc(), "id")
    found = found.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= rerank).drop("n")
    names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("q", T.LongType()), T.StructField("query", q_type)]))
    vecs = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(q)], "q long, qv array<double>")
    return found.join(F.broadcast(names), "q").join(F.broadcast(vecs), "q")  # at most QUERY_BLOCK rows each


def search(path: str, vectors: DataFrame, queries: DataFrame, vec_id: str, vec: str, query_id: str, query_vec: str, k: int = 5, probe_share: float = 0.65,
           rerank: int = 40, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` most similar vectors of every query: (query, vector, similarity, rank, candidates).

    ``probe_share`` of the lists are read as codes, and ``rerank`` full vectors a query (``candidates``).
    Vectors that fall into clear clusters need few lists; without any structure (random directions) recall
    falls with the share of lists probed, whatever the index. Queries come in blocks of ``query_block``."""
    spark = vectors.sparkSession
    cents = np.array([r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()])  # at most ``lists`` rows
    q_type, v_type = queries.schema[query_id].dataType, vectors.schema[vec_id].dataType
    out, ids, rows = None, [], []

    def flush() -> None:
        nonlocal out, ids, rows
        if ids and len(cents):
            part = _block(spark, path, ids, rows, q_type, v_type, cents, probe_share, rerank)
            out = part if out is None else out.unionByName(part)
        ids, rows = [], []

    for r in queries.select(query_id, F.col(query_vec).cast("array<double>")).filter(F.col(query_vec).isNotNull()).toLocalIterator():  # a block at a time
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == query_block:
            flush()
    flush()
    if out is None:
        schema = T.StructType([T.StructField(query_id, q_type), T.StructField(vec_id, v_type), T.StructField("similarity", T.DoubleType()), T.StructField("rank", T.LongType()), T.StructField("candidates", T.LongType())])
        return spark.createDataFrame([], schema)
    full = vectors.select(F.col(vec_id).alias("id"), F.col(vec).cast("array<double>").alias("v")).filter("v is not null")

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    picked = bounded(cut_lineage(out.distinct()), 1_000_000)  # few rows: broadcast past the vectors, else a shuffled join
    exact = full.join(picked, "id").dropDuplicates(["q", "query", "id"]).withColumn("similarity", dot(F.col("v"), F.col("qv")) / F.greatest(F.sqrt(dot(F.col("v"), F.col("v"))), F.lit(1e-300)))
    w = Window.partitionBy("query")
    ranked = exact.withColumn("rank", F.row_number().over(w.orderBy(F.col("similarity").desc(), "id")).cast("long")).withColumn("candidates", F.count(F.lit(1)).over(w))
    return ranked.filter(F.col("rank") <= k).select(F.col("query").alias(query_id), F.col("id").alias(vec_id), "similarity", "rank", "candidates")
