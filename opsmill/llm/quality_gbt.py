"""Operator 2: quality classifier, histogram gradient-boosted trees over document statistics.

Each text becomes a row of statistics (lengths, symbol, case and digit shares, repetition),
computed for whole slices of texts at once. Spark ML's histogram trees (feature values in
``maxBins`` bins, gradient boosting on the logistic loss) are fitted on a bounded sample
of labelled rows, weighted back to the class mix of the table. The fitted trees are flattened into arrays (feature, threshold, left,
right, value), and all texts of a slice walk down all trees together in numpy.

Defined results: null and empty texts have all statistics zero and get the score of such
a text; without labels, or with one class only, the score is that class's share (0.5
without any); repeated rows each get a row; only id and text are read from documents.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmill.llm import arrays as A
from opsmill.llm import sampling
from opsmill.llm.quality_rules import ASCII_LETTERS, LETTERS, SYMBOLS, UPPER, base_counts

DIGITS = A.byte_class((0x30, 0x39))
STOPS = np.isin(np.arange(256), list(b".?,;:"))
SHOUTS = np.isin(np.arange(256), list(b"!"))
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeat_words", "upper", "digits", "stops", "shouts",
            "unlettered_words", "doubled_words", "distinct_words", "line_words")
SAMPLE_ROWS_EACH = 6000


def statistics(texts: A.Texts) -> np.ndarray:
    """One row of ``FEATURES`` a text (float64), zero where a text has no words."""
    base, words = base_counts(texts)
    n = np.maximum(base["n_words"], 1).astype(float)
    chars = np.maximum(base["word_chars"], 1).astype(float)
    letters = A.sums(LETTERS[texts.data])
    hashes = words.hashes(A.LOWER)
    row = words.row
    bare = np.bincount(row[letters[words.end] == letters[words.start]], minlength=texts.n)
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])) + 1
    _, seen = np.unique(A.keyed(hashes, row), return_index=True)
    lines = texts.spans(A.NOT_NEWLINE)
    return np.column_stack([
        np.log1p(base["n_words"]), base["word_chars"] / n, texts.count(SYMBOLS) / chars, base["n_dup_lines"] / n,
        base["n_repeat_words"] / n, texts.count(UPPER) / np.maximum(texts.count(ASCII_LETTERS), 1), texts.count(DIGITS) / chars,
        texts.count(STOPS) / n, texts.count(SHOUTS) / n, bare / n, np.bincount(row[same], minlength=texts.n) / n,
        np.bincount(row[seen], minlength=texts.n) / n, np.log1p(base["n_words"] / np.maximum(lines.n, 1))]).reshape(texts.n, len(FEATURES))


class Forest:
    """Boosted trees as flat arrays; ``root`` has the first node of each tree. Leaves point to themselves."""

    def __init__(self, feature, threshold, left, right, value, root, depth, constant=None):
        self.feature, self.threshold = np.array(feature, np.int64), np.array(threshold, float)
        self.left, self.right, self.value = np.array(left, np.int64), np.array(right, np.int64), np.array(value, float)
        self.root, self.depth, self.constant = np.array(root, np.int64), depth, constant

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        node = np.tile(self.root, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1.0 / (1.0 + np.exp(-2.0 * self.value[node].sum(axis=1)))


def flatten(model) -> Forest:
    feature, threshold, left, right, value, root = [], [], [], [], [], []

    def add(node, weight: float) -> int:
        at = len(feature)
        leaf = node.getClass().getSimpleName() == "LeafNode"
        split = None if leaf else node.split()
        feature.append(0 if leaf else split.featureIndex())
        threshold.append(0.0 if leaf else split.threshold())
        left.append(at)
        right.append(at)
        value.append(weight * node.prediction())
        if not leaf:
            left[at], right[at] = add(node.leftChild(), weight), add(node.rightChild(), weight)
        return at

    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        root.append(add(tree._java_obj.rootNode(), weight))
    return Forest(feature, threshold, left, right, value, root, max(t.depth for t in model.trees))


def featurised(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    def make():
        def fn(texts, rows):
            x = statistics(texts)
            return {f: x[:, i] for i, f in enumerate(FEATURES)}
        return fn

    return A.scan(df, keep, text, [(f, T.DoubleType()) for f in FEATURES], make)


def train(sample: DataFrame, trees: int = 12, depth: int = 4, bins: int = 64) -> Forest:
    """Fit on a bounded sample of (__text, __label) and, where classes were cut, __weight."""
    rows = featurised(sampling.weighted(sample), ["__label", "__weight"], "__text")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows).select(F.col("__label").cast("double").alias("y"), F.col("__weight").alias("weight"), "x").persist()
    try:
        sizes = {int(r["y"]): r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        if len(sizes) < 2:
            return Forest([], [], [], [], [], [], 0, float(next(iter(sizes))) if sizes else 0.5)
        model = GBTClassifier(featuresCol="x", labelCol="y", weightCol="weight", maxIter=trees, maxDepth=depth, maxBins=bins, stepSize=0.3,
                              minInstancesPerNode=5, seed=7, maxMemoryInMB=256).fit(rows.coalesce(4))
        return flatten(model)
    finally:
        rows.unpersist()


def classify(docs: DataFrame, forest: Forest, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and ``score``: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def make():
        return lambda texts, rows: {"score": shared.value.scores(statistics(texts))}

    return A.scan(docs, keep, text, [("score", T.DoubleType())], make)
