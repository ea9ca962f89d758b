"""Operator 10: language identification with error-correcting output codes.

Each language gets a codeword of +1/-1 bits: all 2**(k-1)-1 splits for up to six languages,
else ``BITS`` balanced columns chosen for the largest least Hamming distance. Each bit has
its own binary classifier over hashed n-grams (byte trigrams and whole words): log-odds of
the n-gram between the languages on either side of the split, each language weighing the
same. A text's margins are averaged per n-gram. Decoding sums, over the bits, the logistic loss of the
margin against each codeword's bit, weighted by the bit's reliability on the sample; the
nearest codeword wins, and a small lead over the second one flags the text as ambiguous.

The n-gram table comes from a bounded sample of each language.

Defined results: null texts, empty texts and texts without a letter are ``und`` with score
0; ties go to the language that sorts first; with no training rows every text is ``und``;
with a single language every text with a letter gets it with score 1; rows with a null
language are never learned from; repeated rows each get a row.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmill.llm import arrays as A

SAMPLE_ROWS_EACH = 3000
BUCKET_BITS = 15
BITS = 31
AMBIGUOUS = 0.2
SCALE = 8.0  # of margins (mean log-odds an n-gram) before the logistic loss
_ASCII_LETTER = A.byte_class((0x41, 0x5A), (0x61, 0x7A))


def codebook(k: int) -> np.ndarray:
    """k codewords of +1/-1 bits, one a row; no two are equal, no column is constant."""
    if k < 2:
        return np.ones((k, 1), np.int8)
    if k <= 6:
        columns = [(1, *c) for c in itertools.product((1, -1), repeat=k - 1) if -1 in c]
        return np.array(columns, np.int8).T
    rng = np.random.default_rng(k)
    best, most = None, -1
    for _ in range(200):
        columns = np.argsort(rng.random((BITS, k)), axis=1) < k // 2
        book = np.where(columns.T, 1, -1).astype(np.int8)
        least = min(int((a != b).sum()) for a, b in itertools.combinations(book, 2)) if k <= 64 else len({tuple(r) for r in book.tolist()}) == k
        if least > most:
            best, most = book, least
    return best


def ngrams(texts: A.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a slice, ordered by kind and then by row; with rows' bounds.

    Returns (buckets of trigrams, their row bounds) and the words' buckets with theirs, as
    ``(bucket, bounds)`` pairs. Trigrams see white space, so word ends count; they never
    cross rows.
    """
    low = A.LOWER[texts.data].astype(np.uint32)
    code = (low[:-2] * np.uint32(0x9E3779B1)) ^ (low[1:-1] * np.uint32(0x85EBCA77)) ^ (low[2:] * np.uint32(0xC2B2AE3D)) if len(low) > 2 else np.zeros(0, np.uint32)
    code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKET_BITS)
    inside = np.ones(len(code), bool)
    for back in (1, 2):
        cut = texts.at[1:-1] - back
        inside[cut[(cut >= 0) & (cut < len(code))]] = False
    bounds = A.sums(inside)[np.clip(texts.at, 0, len(code))]
    words = texts.spans(A.ALNUM)
    return (code[inside], bounds), ((words.hashes(A.LOWER) >> A.U64(64 - BUCKET_BITS)).astype(np.uint32), words.first)


def has_letter(texts: A.Texts) -> np.ndarray:
    out = texts.count(_ASCII_LETTER) > 0
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in texts.row(i).decode("utf-8", "replace"))
    return out


class Model:
    def __init__(self, languages: Sequence[str], counts: np.ndarray):
        """``counts``: languages x kinds (trigrams, words) x buckets."""
        self.languages = list(languages)
        self.book = codebook(len(self.languages))
        bits = self.book.shape[1]
        size = counts.shape[2]
        p = (counts + 0.5) / (counts.sum(axis=2, keepdims=True) + 0.5 * size) if len(languages) else counts
        self.weights = np.zeros((2, size, bits), np.float32)
        for b in range(bits if len(self.languages) > 1 else 0):
            up = self.book[:, b] > 0
            self.weights[:, :, b] = np.log(p[up].mean(axis=0)) - np.log(p[~up].mean(axis=0))
        self.reliability = np.ones(bits)

    def margins(self, texts: A.Texts) -> np.ndarray:
        """Per row and bit, the mean log-odds of its n-grams (zero without any)."""
        total = np.zeros((texts.n, self.book.shape[1]))
        count = np.zeros(texts.n)
        for kind, (bucket, bounds) in enumerate(ngrams(texts)):
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            if len(some):
                total[some] += np.add.reduceat(self.weights[kind][bucket], bounds[some], axis=0)
            count += n
        return total / np.maximum(count, 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword, its score and the lead over the second."""
        if len(self.languages) < 2:
            n = len(margins)
            return np.zeros(n, np.int64), np.ones(n), np.ones(n)
        # (rows, languages): loss-weighted distance to each codeword
        loss = np.einsum("rbs,b->rs", np.logaddexp(0.0, -SCALE * margins[:, :, None] * self.book.T[None]), self.reliability) / self.reliability.sum()
        best = loss.argmin(axis=1)
        weight = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        chance = weight / weight.sum(axis=1, keepdims=True)
        ranked = np.sort(chance, axis=1)
        return best, ranked[:, -1], ranked[:, -1] - ranked[:, -2]


def train(sample: DataFrame, text: str = "__text", lang: str = "__lang") -> Model:
    """Fit on a bounded sample; the counts collected are languages x buckets."""
    size = 1 << BUCKET_BITS

    def count(batches):
        for batch in batches:
            for lo, hi in A.slices(batch.column(0)):
                texts = A.texts_of(batch.column(0).slice(lo, hi - lo))
                langs = batch.column(1).slice(lo, hi - lo).to_pylist()
                names = sorted(set(langs))
                which = np.array([names.index(x) for x in langs])
                for kind, (bucket, bounds) in enumerate(ngrams(texts)):
                    key = np.repeat(which, np.diff(bounds)).astype(np.int64) * size + bucket
                    keys, n = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in keys // size], pa.string()), pa.array(np.full(len(keys), kind, np.int32)),
                                                      pa.array((keys % size).astype(np.int32)), pa.array(n.astype(np.int64))], names=["l", "k", "b", "n"])

    sample = sample.select(F.col(text).alias("__text"), F.col(lang).alias("__lang")).persist()
    try:
        rows = (A.small_batches(sample).mapInArrow(count, "l string, k int, b int, n long").groupBy("l", "k", "b").agg(F.sum("n").alias("n"))
                .groupBy("l", "k").agg(F.collect_list("b").alias("b"), F.collect_list("n").alias("n")).collect())
        languages = sorted({r["l"] for r in rows})
        counts = np.zeros((len(languages), 2, size))
        for r in rows:
            counts[languages.index(r["l"]), r["k"], r["b"]] = r["n"]
        model = Model(languages, counts)
        if len(languages) > 1:
            model.reliability = _reliability(sample, model)
        return model
    finally:
        sample.unpersist()


def _reliability(sample: DataFrame, model: Model) -> np.ndarray:
    """Per bit, the log-odds of its sign being right on the sample."""
    shared = sample.sparkSession.sparkContext.broadcast(model)
    bits = model.book.shape[1]

    def right(batches):
        m = shared.value
        at = {x: i for i, x in enumerate(m.languages)}
        for batch in batches:
            for lo, hi in A.slices(batch.column(0)):
                own = np.array([at[x] for x in batch.column(1).slice(lo, hi - lo).to_pylist()])
                margins = m.margins(A.texts_of(batch.column(0).slice(lo, hi - lo)))
                ok = (margins * m.book[own] > 0).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(bits, dtype=np.int32)), pa.array(ok.astype(np.int64)),
                                                  pa.array(np.full(bits, hi - lo, np.int64))], names=["b", "ok", "n"])

    rows = sample.mapInArrow(right, "b int, ok long, n long").groupBy("b").agg(F.sum("ok").alias("ok"), F.sum("n").alias("n")).collect()
    out = np.zeros(bits)
    for r in rows:
        out[r["b"]] = max(0.1, np.log((r["ok"] + 1) / (r["n"] - r["ok"] + 1)))
    return out


def identify(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` (chance of the chosen codeword) and ``ambiguous``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        names = np.array([*m.languages, "und"], object)

        def fn(texts, rows):
            best, chance, lead = m.decode(m.margins(texts))
            none = ~has_letter(texts) | (not m.languages)
            best = np.where(none, len(m.languages), best)
            return {"lang_pred": pa.array(names[best].tolist(), pa.string()), "score": np.where(none, 0.0, chance),
                    "ambiguous": ~none & (lead < AMBIGUOUS)}
        return fn

    return A.scan(docs, keep, text, [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("ambiguous", T.BooleanType())], make)
