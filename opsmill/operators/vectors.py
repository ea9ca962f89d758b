"""Vector retrieval and context operators.

Exact top-k similarity: the queries are broadcast in blocks of bounded size; every
partition of the vector table computes ``X @ Q.T`` with numpy inside ``mapInPandas`` and
keeps only its local top-k per query, and a window over those few candidates gives the
global top-k. No (vector, query) pair table is ever materialised. For large query sets
use the inverted-list index of ``vector_index`` (``ann_search`` builds and searches one).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY_BLOCK = 10_000


def centroids(df: DataFrame, key: str, vec: str, out: str = "embedding") -> DataFrame:
    """Mean vector per key: one vector-valued aggregate, combined before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = df.select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("__v"))
    return v.groupBy(key).agg(Summarizer.mean(F.col("__v")).alias("__m")).select(key, vector_to_array("__m").alias(out))


def cosine_topk(vectors: DataFrame, queries: DataFrame, vec_id: str, vec: str, query_id: str, query_vec: str, k: int = 5,
                min_similarity: float = 0.75, query_block: int = QUERY_BLOCK) -> DataFrame:
    """V1: for every query, the k most similar vectors (cosine, ties by vector id) with
    similarity >= min_similarity. Queries are broadcast in blocks of ``query_block``; each
    block is one scan of the vectors, so their number has no limit."""
    sc = vectors.sparkSession.sparkContext
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(vec_id, vectors.schema[vec_id].dataType),
                           T.StructField("similarity", T.DoubleType())])

    def block_topk(ids: list, rows: list) -> DataFrame:
        matrix = np.array(rows, dtype=np.float64)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        shared = sc.broadcast((ids, matrix))

        def local_topk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, q = shared.value
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for pdf in batches:
                if pdf.empty:
                    continue
                x = np.stack(pdf[vec].to_numpy()).astype(np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                own = pdf[vec_id].to_numpy()
                scores = x @ q.T
                for j in range(len(qids)):
                    s = scores[:, j]
                    at = np.flatnonzero(s >= min_similarity)
                    if len(at) > k:  # all at or above the k-th score: ties stay for the id order
                        at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
                    if len(at):
                        prev = best.get(j, (s[:0], own[:0]))
                        s_all, id_all = np.concatenate([prev[0], s[at]]), np.concatenate([prev[1], own[at]])
                        order = np.lexsort((id_all, -s_all))[:k]
                        best[j] = s_all[order], id_all[order]
            for j, (s, own) in best.items():
                yield pd.DataFrame({query_id: [qids[j]] * len(s), vec_id: own, "similarity": s})

        return vectors.select(vec_id, vec).mapInPandas(local_topk, schema)

    parts, ids, rows = [], [], []
    for r in queries.select(query_id, query_vec).toLocalIterator():  # a block at a time on the driver
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == query_block:
            parts.append(block_topk(ids, rows))
            ids, rows = [], []
    if ids:
        parts.append(block_topk(ids, rows))
    if not parts:
        return vectors.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0).cast("long"))
    local = parts[0]
    for p in parts[1:]:
        local = local.unionByName(p)
    w = Window.partitionBy(query_id).orderBy(F.col("similarity").desc(), F.col(vec_id).asc())
    return local.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def ann_search(vectors: DataFrame, queries: DataFrame, vec_id: str, vec: str, query_id: str, query_vec: str, k: int = 5, lists: int | None = None,
               probe_share: float = 0.65, rerank: int = 40) -> DataFrame:
    """V2: approximate neighbours: build an inverted-list index in the shared scratch folder and search it
    once. Keep the index (``vector_index.build`` and ``search``) where more queries follow. Recall is
    measured against ``cosine_topk``. Result: (query, vector, similarity, rank, candidates), the last
    being the number of full vectors that were read for the query."""
    from opsmill.operators import vector_index
    from opsmill.session import scratch_path

    path = scratch_path(vectors.sparkSession, "vector-index")
    vector_index.build(vectors, vec_id, vec, path, lists)
    return vector_index.search(path, vectors, queries, vec_id, vec, query_id, query_vec, k, probe_share, rerank)


def composite_rank(df: DataFrame, similarity: str, age_days: str, weight: str, w_sim: float = 0.6, w_age: float = 0.25,
                   w_decision: float = 0.15, half_life_days: float = 30.0) -> DataFrame:
    """V3: similarity, exponential age decay and decision weight combined (the weights
    and the half-life are parameters; the reference names the factors only)."""
    decay = F.exp(-F.col(age_days) * F.lit(np.log(2.0) / half_life_days))
    return df.withColumn("composite", F.lit(w_sim) * F.col(similarity) + F.lit(w_age) * decay + F.lit(w_decision) * F.col(weight))


def context_compress(items: DataFrame, importance: str, tokens: str, min_importance: float = 0.7,
                     max_tokens: int = 4000) -> DataFrame:
    """V5: keep important items that are not oversized (then pack with token_budget_pack)."""
    return items.filter((F.col(importance) >= min_importance) & (F.col(tokens) <= max_tokens))


def three_way_merge(base: DataFrame, left: DataFrame, right: DataFrame, key: str, value: str = "value") -> DataFrame:
    """V6: per key: unchanged, taken from the side that changed, equal changes, deleted,
    or a conflict when both sides changed differently (the base value is kept)."""
    b = base.select(key, F.col(value).alias("base"))
    l_ = left.select(key, F.col(value).alias("left"))
    r_ = right.select(key, F.col(value).alias("right"))
    j = b.join(l_, key, "full").join(r_, key, "full")
    lc = ~F.col("left").eqNullSafe(F.col("base"))
    rc = ~F.col("right").eqNullSafe(F.col("base"))
    status = (F.when(~lc & ~rc, "unchanged").when(lc & ~rc, "left").when(~lc & rc, "right")
              .when(F.col("left").eqNullSafe(F.col("right")), "both_same").otherwise("conflict"))
    merged = (F.when(status == "left", F.col("left")).when(status.isin("right"), F.col("right"))
              .when(status == "both_same", F.col("left")).otherwise(F.col("base")))
    return j.select(key, "base", "left", "right", status.alias("status"), merged.alias("merged"))


def vector_clusters(vectors: DataFrame, vec_id: str, vec: str, k: int = 10, seed: int = 1, max_iter: int = 20) -> DataFrame:
    """V7: k-means clusters of the vectors (Spark ML, distributed Lloyd iterations)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = vectors.select(vec_id, array_to_vector(vec).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="cluster").fit(x)
    return model.transform(x).select(vec_id, "cluster")


def reciprocal_rank_fusion(rankings: dict[str, DataFrame], key: str, k: int = 60) -> DataFrame:
    """V9: hybrid search: sum over rankings of 1 / (k + rank). Each ranking holds (key,
    rank); a key missing from a ranking contributes nothing."""
    parts = [df.select(key, (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("rrf"), F.lit(name).alias("source"))
             for name, df in rankings.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy(key).agg(F.sum("rrf").alias("rrf_score"), F.count(F.lit(1)).alias("sources"))


def rank_by(df: DataFrame, key: str, order: Sequence[Column], top: int) -> DataFrame:
    """Helper: 1-based rank of the first ``top`` rows of a total order (a top-k, then a window
    over those few rows; ranks of a whole table come from ``relational.ordered_batches``)."""
    w = Window.orderBy(*order)
    return df.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(w)).select(key, "rank")
