"""Operator 8: toxicity by maximum-scoring segments of token log-odds.

Training (on a bounded sample of labelled rows) counts words by class, a word once for
each different word that it follows, so that copies of a text count once. A word's share of
toxic-class occurrences is smoothed by a Dirichlet prior centred on the share of its stem
(the other words that start with the same four bytes), and a stem's by one centred on the share
of all words (a word's own counts left out of its stem); the log-odds against that global
share is the word's score. Only words and
stems with significant positive log-odds enter the lexicon; every other word costs the
same small amount, so the expected score of clean text is negative.

A text is scanned once: the linear-time all-maximal-segments algorithm runs over its
lexicon words with the gaps between them as penalties, and yields every passage whose
score cannot be raised by extending or cutting it. Clean text produces a segment of score
s or more at a rate of K exp(-lambda s) a word (extreme-value law; lambda solves
E[exp(lambda s)] = 1 over clean words, K comes from the segments of clean training texts),
so a segment's E-value in a text of n words is K n exp(-lambda s). Segments with an
E-value under ``SIGNIFICANT`` are passages; the text's evidence is the sum of their
-log(E-value), and a logistic curve fitted on the sample, weighted back to the class mix of
the table, turns it into a probability.

Defined results: null, empty and clean texts have no passages and get the score of zero
evidence; without labels, or with one class only, that score is the share of label 1 (0
without any); repeated rows each get a row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmill.llm import arrays as A
from opsmill.llm import sampling

SAMPLE_ROWS_EACH = 6_000
STEM = 4
PRIOR = 10.0  # pseudo-counts of the Dirichlet priors
LEAST_ODDS = 1.5
LEAST_Z = 3.5
LEAST_CONTEXTS = 4  # different words before it in toxic texts
SIGNIFICANT = 0.5


def tokens(texts: A.Texts) -> tuple[A.Spans, np.ndarray, np.ndarray]:
    """Words, their hashes and the hashes of their stems (a short word is its own stem)."""
    words = texts.spans(A.ALNUM)
    whole = words.hashes(A.LOWER)
    end = words.end
    words.end = np.minimum(end, words.start + STEM)
    stems = words.hashes(A.LOWER) ^ A.U64(0x5BD1E995)
    words.end = end
    return words, whole, stems


class Lexicon:
    def __init__(self, words: dict[int, float], stems: dict[int, float], gap: float, lam: float = 1.0, k: float = 1.0,
                 curve: tuple[float, float] = (0.0, 1.0)):
        self.words, self.stems = (self._sorted(t) for t in (words, stems))
        self.gap, self.lam, self.k, self.curve = gap, lam, k, curve

    @staticmethod
    def _sorted(table: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array(sorted(table), dtype=np.uint64)
        return keys, np.array([table[int(k)] for k in keys], dtype=float)

    @staticmethod
    def _find(table, keys: np.ndarray) -> np.ndarray:
        known, value = table
        if not len(known):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, value[at], 0.0)

    def scores(self, whole: np.ndarray, stems: np.ndarray) -> np.ndarray:
        """Per word its log-odds, or zero outside the lexicon."""
        own = self._find(self.words, whole)
        return np.where(own > 0, own, self._find(self.stems, stems))

    def evidence(self, segments: Sequence[tuple[int, int, float]], n_words: int) -> tuple[float, list[tuple[int, int, float]]]:
        """Summed -log(E-value) of the significant segments, and those with their E-values."""
        found = [(a, b, min(1.0, self.k * max(n_words, 1) * math.exp(-self.lam * s))) for a, b, s in segments]
        found = [(a, b, e) for a, b, e in found if e < SIGNIFICANT]
        return min(200.0, sum(-math.log(max(e, 1e-90)) for _, _, e in found)), found

    def probability(self, evidence: float) -> float:
        a, b = self.curve
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, a + b * evidence))))


def maximal_segments(at: Sequence[int], score: Sequence[float], gap: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments [first, last] of a sequence that scores ``score`` at the
    positions ``at`` and ``-gap`` elsewhere; linear time, and segments are disjoint."""
    kept: list[list[float]] = []  # first, last, sum before, sum with
    total, previous = 0.0, -1
    for p, s in zip(at, score, strict=True):
        total -= gap * (p - previous - 1)
        previous = p
        new = [p, p, total, total + s]
        total += s
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j -= 1
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:]
    return [(int(a), int(b), y - x) for a, b, x, y in kept]


def passages(texts: A.Texts, lexicon: Lexicon):
    """Per text with a lexicon word: (row, number of words, evidence, significant segments), and the words."""
    words, whole, stems = tokens(texts)
    score = lexicon.scores(whole, stems)
    hit = np.flatnonzero(score > 0)
    out = []
    if len(hit):
        row = words.row[hit]
        cuts = np.flatnonzero(np.diff(row)) + 1
        for own in np.split(hit, cuts):
            r = int(np.searchsorted(words.first, own[0], "right")) - 1
            segments = maximal_segments((own - words.first[r]).tolist(), score[own].tolist(), lexicon.gap)
            out.append((r, int(words.n[r]), segments, *lexicon.evidence(segments, int(words.n[r]))))
    return words, out


def _counts(sample: DataFrame) -> DataFrame:
    """Per word and class, the number of different words it follows.

    Copies of a text repeat its words in the same places, so they add nothing, while a word
    that is toxic in itself turns up after many different words.
    """
    def run(batches):
        for batch in batches:
            for lo, hi in A.slices(batch.column(0)):
                texts = A.texts_of(batch.column(0).slice(lo, hi - lo))
                label = np.asarray(batch.column(1).slice(lo, hi - lo)).astype(np.int64)
                words, whole, stems = tokens(texts)
                before = np.zeros(len(whole), np.uint64)
                before[1:] = whole[:-1]
                before[words.first[:-1][words.n > 0]] = 0
                toxic = label[words.row]
                _, once = np.unique(A.mix(whole + A.mix(before + toxic.astype(np.uint64))), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(x[once].view(np.int64)) for x in (whole, stems, before, toxic)], names=["word", "stem", "before", "toxic"])

    return (sample.select("__text", "__label").transform(A.small_batches).mapInArrow(run, "word long, stem long, before long, toxic long").distinct()
            .groupBy("word", "stem").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0")))


def _odds(counts: DataFrame, share: float) -> tuple[dict[int, float], dict[int, float]]:
    """Lexicon words and stems from counts, by the smoothed log-odds and its standard error."""
    base = math.log(share / (1 - share))

    def scored(df: DataFrame, prior) -> DataFrame:
        a1, a0 = F.col("n1") + PRIOR * prior, F.col("n0") + PRIOR * (1 - prior)
        return df.withColumn("odds", F.log(a1 / a0) - base).withColumn("z", F.col("odds") / F.sqrt(1 / a1 + 1 / a0))

    stems = scored(counts.groupBy("stem").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), F.lit(share))
    # of the stem's other words, so that a word does not vouch for itself
    centre = (F.col("s1") - F.col("n1") + PRIOR * share) / (F.col("s1") + F.col("s0") - F.col("n1") - F.col("n0") + PRIOR)
    words = scored(counts.join(stems.select("stem", F.col("n1").alias("s1"), F.col("n0").alias("s0")), "stem"), centre)
    keep = f"odds >= {LEAST_ODDS} and z >= {LEAST_Z} and n1 >= {LEAST_CONTEXTS}"
    as_table = lambda df, key: {r[0] & (2**64 - 1): float(r[1]) for r in df.filter(keep).select(key, "odds").collect()}
    return as_table(words, "word"), as_table(stems, "stem")


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """One-dimensional weighted logistic regression with a light ridge, by Newton steps."""
    w = np.zeros(2)
    z = np.column_stack([np.ones(len(x)), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + 0.01 * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def train(sample: DataFrame) -> Lexicon:
    """Fit on a bounded sample of (__text, __label) and, where classes were cut, __weight;
    everything collected is bounded by it."""
    sample = sampling.weighted(sample).persist()
    try:
        sizes = {r["__label"]: r["n"] for r in sample.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
        n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
        if not n1 or not n0:
            only = 1.0 if n1 else 0.0
            return Lexicon({}, {}, 1.0, curve=(40.0 * (2 * only - 1), 0.0))
        counts = _counts(sample).persist()
        try:
            t = counts.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).first()
            share = (t["n1"] + 1) / (t["n1"] + t["n0"] + 2)
            words, stems = _odds(counts, share)
        finally:
            counts.unpersist()
        raw = Lexicon(words, stems, gap=0.25)
        # clean texts: how often do lexicon words and segments come up by chance?
        found = A.scan(sample, ["__label", "__weight"], "__text", [("n", T.LongType()), ("s", T.ArrayType(T.DoubleType())), ("w", T.ArrayType(T.DoubleType()))],
                       lambda: lambda texts, rows: _segment_columns(texts, raw)).persist()
        try:
            clean = found.filter("__label = 0")
            n = clean.agg(F.sum("n").alias("n")).first()["n"] or 1
            words_found, segments = ([r["x"] for r in clean.select(F.explode(c).alias("x")).collect()] for c in ("w", "s"))
            raw.lam, raw.k = _extreme_value(words_found, segments, n, raw.gap)
            rows = found.select("__label", "__weight", "n", "s").collect()
        finally:
            found.unpersist()
        x = np.array([raw.evidence([(0, 0, s) for s in r["s"]], r["n"])[0] for r in rows])
        y = np.array([r["__label"] for r in rows], float)
        # classes were sampled at shares of their own: the weights undo that
        raw.curve = _fit_curve(x, y, np.array([r["__weight"] for r in rows], float))
        return raw
    finally:
        sample.unpersist()


def _segment_columns(texts: A.Texts, lexicon: Lexicon) -> dict:
    """Words, segment scores and lexicon-word scores of each text."""
    words, found = passages(texts, lexicon)
    _, whole, stems = tokens(texts)
    each = lexicon.scores(whole, stems)
    s: list[list] = [[] for _ in range(texts.n)]
    w: list[list] = [[] for _ in range(texts.n)]
    for r, _, segments, _, _ in found:
        s[r] = [x for _, _, x in segments]
        own = each[words.first[r]:words.first[r + 1]]
        w[r] = own[own > 0].tolist()
    return {"n": words.n.astype(np.int64), "s": pa.array(s, pa.list_(pa.float64())), "w": pa.array(w, pa.list_(pa.float64()))}


def _extreme_value(found: Sequence[float], segments: Sequence[float], n_words: int, gap: float) -> tuple[float, float]:
    """lambda and K of the rate K exp(-lambda s) of segments of score s or more a clean word.

    ``found`` are the scores of the lexicon words of clean texts, ``segments`` the scores of
    their segments. One pseudo-word and pseudo-segment of the least score keep both finite.
    """
    scores = np.array([*found, LEAST_ODDS], float)
    p = len(scores) / (n_words + 1)
    lo, hi = 1e-3, 5.0
    for _ in range(60):
        lam = (lo + hi) / 2
        value = p * np.exp(np.minimum(lam * scores, 600)).mean() + (1 - p) * math.exp(-lam * gap)
        lo, hi = (lam, hi) if value < 1 else (lo, lam)
    least = min([*segments, LEAST_ODDS])
    return lam, (len(segments) + 1) / (n_words + 1) * math.exp(min(lam * least, 600))


def score(docs: DataFrame, lexicon: Lexicon, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, ``score``, ``evidence`` and ``passages`` (byte ``from``, ``to`` and ``e_value`` of each)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("e_value", pa.float64())]))

    def make():
        lex = shared.value

        def fn(texts, rows):
            words, found = passages(texts, lex)
            evidence, spans = np.zeros(texts.n), [[] for _ in range(texts.n)]
            for r, _, _, e, segments in found:
                evidence[r] = e
                f, base = words.first[r], texts.at[r]
                spans[r] = [{"from": int(words.start[f + a] - base), "to": int(words.end[f + b] - base), "e_value": x} for a, b, x in segments]
            return {"score": np.array([lex.probability(e) for e in evidence.tolist()]), "evidence": evidence, "passages": pa.array(spans, kind)}
        return fn

    span = T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType()), T.StructField("e_value", T.DoubleType())])
    return A.scan(docs, keep, text, [("score", T.DoubleType()), ("evidence", T.DoubleType()), ("passages", T.ArrayType(span))], make)
