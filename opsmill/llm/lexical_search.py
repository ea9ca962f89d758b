"""Operator 11: ranked lexical search as a dense blocked matrix product.

A block of queries (items) has a compact vocabulary: the different terms of its texts. Two scans of
the documents follow. The first counts, for that vocabulary only, the documents that hold each
term, and over all terms the documents and their lengths. The second turns each slice of
documents into a tile of impacts (rows: documents, columns: the vocabulary terms that occur in the
slice) and multiplies it with the tile of term weights (rows: the same terms, columns: items) by
BLAS in float64. All factors are integers; vocabulary tiles are cut so that no item's partial
sum can reach 2**53, hence every product and sum is exact in any order, and the partial sums
of tiles are added as 64-bit integers.

Each task keeps the best ``k`` documents of each item. A document that ties with the last
of them stays until its id is compared, so the answer does not depend on slices or tasks. The
tasks' rows are ranked by (item, salt) and then by item: no group is larger than the number of
tasks times ``k`` over the salts.

The documents' vocabulary is never shuffled or collected. Items arrive in blocks of at most
``block_words`` words and ``block_items`` items (a longer item is a block of its own); one block is on
the driver at a time, each costs its own two scans. Document ids are 64-bit integers.

Score of a document with n terms, for terms with weight w and tf occurrences:
sum of w * ((10**9 * tf) div (1000 * tf + 8 * m)), m = 25 + (75 * n * N) div L,
w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))).

Defined results: null or empty texts and texts without terms have no terms, are not counted in N and
never match; an item without terms, or without a document over score 0, has no rows; repeated rows
(items or documents) are rows of their own; null document ids come after all others in ties; an
empty table on either side gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmill.llm import arrays as A

TOP = 10
BLOCK_WORDS = 100_000
BLOCK_ITEMS = 512
TILE_TERMS = 2048
SALTS = 32
EXACT = 1 << 53
#: Impacts are below this: 10**9 * tf / (1000 * tf + 8 * m) < 10**6.
MOST_IMPACT = 1_000_000
_BITS = 18


def terms_of(text: str | None) -> Counter:
    texts = A.texts_of(pa.array([text or ""], pa.string()))
    spans, data = texts.spans(A.ALNUM), A.LOWER[texts.data].tobytes()
    return Counter(data[a:b] for a, b in zip(spans.start.tolist(), spans.end.tolist(), strict=True))


class Vocabulary:
    """The different terms of a block of items, found in slices of texts by hash and verified by bytes."""

    def __init__(self, items: list[Counter]):
        self.n_items = len(items)
        terms = sorted({t for i in items for t in i})
        texts = A.texts_of(pa.array(terms, pa.binary()))
        hashes = texts.spans(A.ALNUM).hashes()
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.data = hashes[order], texts.data
        self.at, self.size = texts.at[:-1][order], np.diff(texts.at)[order]
        self.bitmap = np.zeros(1 << _BITS, dtype=bool)
        self.bitmap[self.hashes >> A.U64(64 - _BITS)] = True
        self.alike = int(np.unique(self.hashes, return_counts=True)[1].max()) if len(terms) else 0
        place = {terms[o]: k for k, o in enumerate(order.tolist())}
        cells = [(place[t], i, c) for i, item in enumerate(items) for t, c in item.items()]
        self.term, self.item, self.repeats = (np.array([c[k] for c in cells], dtype=np.int64) for k in range(3))

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, texts: A.Texts, spans: A.Spans) -> tuple[np.ndarray, np.ndarray]:
        """(row, term) of every occurrence of a vocabulary term."""
        hashes = spans.hashes(A.LOWER)
        maybe = np.flatnonzero(self.bitmap[hashes >> A.U64(64 - _BITS)])
        low = np.searchsorted(self.hashes, hashes[maybe])
        rows, found = [], []
        for j in range(self.alike):
            term = np.minimum(low + j, len(self) - 1)
            length = spans.end[maybe] - spans.start[maybe]
            ok = np.flatnonzero((self.hashes[term] == hashes[maybe]) & (self.size[term] == length))
            w, t, length = maybe[ok], term[ok], length[ok]
            if len(w):
                same = A.LOWER[texts.data[A.expand(spans.start[w], length)]] == self.data[A.expand(self.at[t], length)]
                good = np.logical_and.reduceat(same, A.sums(length)[:-1])
                rows.append(w[good])
                found.append(t[good])
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words = np.concatenate(rows)
        return np.searchsorted(spans.first, words, "right") - 1, np.concatenate(found)

    def weights(self, w: np.ndarray) -> np.ndarray:
        """Terms x items: the weight of a term times its repeats in the item."""
        out = np.zeros((len(self), self.n_items), dtype=np.int64)
        out[self.term, self.item] = self.repeats * w[self.term]
        return out


def tiles(weights: np.ndarray, lo: int, hi: int, width: int = TILE_TERMS, bound: int = EXACT // MOST_IMPACT) -> list[tuple[int, int, np.ndarray]]:
    """Vocabulary ranges with their weights in float64: at most ``width`` terms, and no item's weights
    sum to ``bound`` or more. A single weight over the bound is spread over several tiles."""
    if hi <= lo:
        return []
    part = weights[lo:hi]
    load = max(sum(int(x) for x in part[:, i]) for i in [int(np.argmax(part.sum(axis=0, dtype=np.float64)))])
    if hi - lo <= width and load < bound:
        return [(lo, hi, part.astype(np.float64))]
    if hi - lo > 1:
        mid = (lo + hi) // 2
        return tiles(weights, lo, mid, width, bound) + tiles(weights, mid, hi, width, bound)
    out, rest = [], part.copy()
    while rest.any():
        now = np.minimum(rest, bound - 1)
        out.append((lo, hi, now.astype(np.float64)))
        rest -= now
    return out


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    if 75 * int(n.max(initial=0)) * n_docs >= 1 << 63:
        m = np.array([25 + 75 * int(x) * n_docs // n_terms for x in n], dtype=np.int64)
    else:
        m = 25 + 75 * n * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Best:
    """The best ``k`` documents of each item so far; ties with the last of them are compared by id."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.null = np.zeros(0, bool)

    def offer(self, scores: np.ndarray, docs: np.ndarray, nulls: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[row, item]])
        doc, null = np.concatenate([self.doc, docs[row]]), np.concatenate([self.null, nulls[row]])
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        first = np.searchsorted(item, np.arange(len(self.least) + 1))
        keep = np.arange(len(item)) - first[item] < self.k
        order = order[keep]
        self.item, self.score, self.doc, self.null = item[keep], score[order], doc[order], null[order]
        full = np.flatnonzero(np.diff(first) >= self.k)
        at = np.searchsorted(self.item, full)
        self.least[full] = self.score[at + self.k - 1]


def _blocks(items: DataFrame, item: str, text: str, block_words: int, block_items: int) -> Iterator[list[tuple[object, Counter]]]:
    block, size = [], 0
    for r in items.select(items[item].alias("i"), items[text].cast("string").alias("t")).toLocalIterator():
        terms = terms_of(r["t"])
        if not terms:
            continue
        if block and (size + sum(terms.values()) > block_words or len(block) >= block_items):
            yield block
            block, size = [], 0
        block.append((r["i"], terms))
        size += sum(terms.values())
    if block:
        yield block


def _source(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return A.small_batches(docs.select(docs[doc].cast("long").alias("doc"), docs[text].cast("string").alias("text")))


def _each_slice(batches) -> Iterator[tuple[pa.RecordBatch, A.Texts]]:
    for batch in batches:
        for lo, hi in A.slices(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            yield part, A.texts_of(part.column(1))


def statistics(source: DataFrame, shared) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each vocabulary term."""
    def run(batches):
        vocabulary: Vocabulary = shared.value
        df = np.zeros(len(vocabulary), np.int64)
        n_docs = n_terms = 0
        for _, texts in _each_slice(batches):
            spans = texts.spans(A.ALNUM)
            n_docs += int((spans.n > 0).sum())
            n_terms += int(spans.n.sum())
            row, term = vocabulary.find(texts, spans)
            df += np.bincount(np.unique(row * len(vocabulary) + term) % len(vocabulary), minlength=len(vocabulary))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], held])), pa.array(np.concatenate([[n_docs, n_terms], df[held]]))], names=["term", "n"])

    found = source.mapInArrow(lambda b: A.released(run(b)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r["term"]: r["n"] for r in found.collect()}  # at most the block's vocabulary
    return counts.get(-2, 0), counts.get(-1, 0), np.array([counts.get(t, 0) for t in range(len(shared.value))], dtype=np.int64)


def candidates(source: DataFrame, shared, n_docs: int, n_terms: int, weights, k: int) -> DataFrame:
    """(item, doc, score): each task's best ``k`` documents of each item of the block."""
    def run(batches):
        vocabulary: Vocabulary = shared.value
        weight = vocabulary.weights(weights.value)
        parts = tiles(weight, 0, len(vocabulary))
        best = Best(vocabulary.n_items, k)
        for rows, texts in _each_slice(batches):
            spans = texts.spans(A.ALNUM)
            row, term = vocabulary.find(texts, spans)
            if not len(row):
                continue
            cell, tf = np.unique(term * texts.n + row, return_counts=True)
            term, row = cell // texts.n, cell % texts.n  # in order of term
            impact = impacts(tf, spans.n[row], n_docs, n_terms).astype(np.float64)
            scores = np.zeros((texts.n, vocabulary.n_items), np.int64)
            for lo, hi, part in parts:
                a, b = np.searchsorted(term, [lo, hi])
                if a == b:
                    continue
                present, column = np.unique(term[a:b], return_inverse=True)
                tile = np.zeros((texts.n, len(present)))
                tile[row[a:b], column] = impact[a:b]
                scores += np.rint(tile @ part[present - lo]).astype(np.int64)
            ids = rows.column(0)
            best.offer(scores, np.asarray(ids.fill_null(0), dtype=np.int64), np.asarray(ids.is_null()))
        yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.doc, mask=best.null), pa.array(best.score)], names=["item", "doc", "score"])

    return source.mapInArrow(lambda b: A.released(run(b)), "item long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", k: int = TOP,
           block_words: int = BLOCK_WORDS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item, rank, doc, score) of the ``k`` best documents of every item."""
    spark = docs.sparkSession
    source = _source(docs, doc, text)
    place = items.schema[item].dataType
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField(item, place)])
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    out = None
    for block in _blocks(items, item, text, block_words, block_items):
        shared = spark.sparkContext.broadcast(Vocabulary([c for _, c in block]))
        n_docs, n_terms, df = statistics(source, shared)
        if not n_terms:
            break
        w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
        found = candidates(source, shared, n_docs, n_terms, spark.sparkContext.broadcast(w), k)
        salt = F.pmod(F.xxhash64("doc", "score"), F.lit(SALTS))
        found = found.withColumn("salt", salt).withColumn("n", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("n") <= k)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
        names = F.broadcast(spark.createDataFrame([(i, v) for i, (v, _) in enumerate(block)], schema))  # at most block_items rows
        part = found.join(names, "item").select(item, "rank", F.col("doc").alias(doc), "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], T.StructType([T.StructField(item, place), T.StructField("rank", T.IntegerType()), T.StructField(doc, T.LongType()), T.StructField("score", T.LongType())]))
    return out
