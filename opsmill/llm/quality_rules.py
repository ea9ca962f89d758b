"""Operator 3: quality rules as a short-circuit cascade.

Every text gets the base counts (words, their code points, symbols, repeated lines,
repeated three-word windows) and the base test. Texts that pass it run through a cascade
of further rules; a text leaves the cascade at the first rule that rejects it. The order
comes from a sample: each rule's cost (seconds a text) and selectivity (share rejected)
are measured there, and rules run by rejections per second. A text is kept if no rule
rejects it, so the order changes the cost and never the verdict.

Defined results: a null or empty text has no words and fails the base test; repeated rows
each get a row; an empty table gives an empty result and the rules keep their declared
order; columns other than the id and the text are not read by ``judge``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmill.llm import arrays as A

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
LEAD = A.byte_class((0x80, 0xBF), invert=True)  # first byte of a code point
UPPER = A.byte_class((0x41, 0x5A))
LETTERS = A.byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
ASCII_LETTERS = A.byte_class((0x41, 0x5A), (0x61, 0x7A))

BASE = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()),
        ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType())]


def repeats(keys: np.ndarray) -> np.ndarray:
    """For each key, how often it occurs."""
    _, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[inverse]


def base_counts(texts: A.Texts) -> tuple[dict[str, np.ndarray], A.Spans]:
    words = texts.spans(A.NON_SPACE)
    n = words.n.astype(np.int64)
    inside = A.NON_SPACE[texts.data]
    chars = np.diff(A.sums(inside & LEAD[texts.data])[texts.at])
    # equal lines of a row that hold a word
    lines = texts.spans(A.NOT_NEWLINE)
    worded = A.sums(inside)
    real = worded[lines.end] > worded[lines.start]
    keys, rows = A.keyed(lines.hashes(), lines.row)[real], lines.row[real]
    _, seen = np.unique(keys, return_index=True)
    dup = np.bincount(rows, minlength=texts.n) - np.bincount(rows[seen], minlength=texts.n)
    # words inside three-word windows that occur again in the row
    h, at = words.windows(words.hashes(), 3)
    twice = at[repeats(A.keyed(h, words.row[at])) > 1]
    cover = np.zeros(len(words.start) + 1, dtype=bool)
    for k in range(3):
        cover[twice + k] = True
    rep = np.diff(A.sums(cover[:-1])[words.first])
    return {"n_words": n, "word_chars": chars.astype(np.int64), "n_symbols": texts.count(SYMBOLS).astype(np.int64),
            "n_dup_lines": dup.astype(np.int64), "n_repeat_words": rep.astype(np.int64),
            "base_failed": (n < 50) | (100 * rep > 50 * n)}, words


class View:
    """One text as the rules see it: its bytes, its word bounds and its base counts."""

    def __init__(self, texts: A.Texts, words: A.Spans, base: dict, i: int):
        a, b = texts.at[i], texts.at[i + 1]
        self.data = texts.data[a:b]
        f, t = words.first[i], words.first[i + 1]
        self.start, self.end = words.start[f:t] - a, words.end[f:t] - a
        self.n = {k: int(v[i]) for k, v in base.items()}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[View], bool]


def _lettered(v: View) -> bool:
    letters = A.sums(LETTERS[v.data])
    return 10 * int((letters[v.end] > letters[v.start]).sum()) < 7 * v.n["n_words"]


def _doubled(v: View) -> bool:
    """Over 30 % of the words equal the word before."""
    size = v.end - v.start
    same = np.flatnonzero(size[1:] == size[:-1])
    raw = v.data.tobytes()
    s, e = v.start.tolist(), v.end.tolist()
    n = sum(raw[s[i]:e[i]] == raw[s[i + 1]:e[i + 1]] for i in same.tolist())
    return 10 * n > 3 * v.n["n_words"]


def _shouting(v: View) -> bool:
    return 2 * int(UPPER[v.data].sum()) > int(ASCII_LETTERS[v.data].sum())


#: The rules beyond the base test, in declared order (also the tie order).
RULES: tuple[Rule, ...] = (
    Rule("word_length", lambda v: not 2 * v.n["n_words"] <= v.n["word_chars"] <= 20 * v.n["n_words"]),
    Rule("symbols", lambda v: 10 * v.n["n_symbols"] > v.n["word_chars"]),
    Rule("dup_lines", lambda v: 20 * v.n["n_dup_lines"] > v.n["n_words"]),
    Rule("shouting", _shouting),
    Rule("lettered_words", _lettered),
    Rule("doubled_words", _doubled),
)


def measure(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = 2000) -> dict:
    """Cost and selectivity of each rule on a sample of at most about ``sample_rows`` texts.

    Every sampled text that passes the base test runs through every rule (no short cut), in
    tasks; only one row of sums for each batch and rule is shuffled. Each row is in the sample
    by its own chance, so copies of a text cannot fill it.
    """
    total = df.count()
    picked = df.select(F.col(text).alias("__text"))
    if total > sample_rows:
        picked = picked.sample(fraction=sample_rows / total, seed=7)

    def run(batches):
        for batch in batches:
            got = np.zeros((len(rules), 3))
            for lo, hi in A.slices(batch.column(0)):
                texts = A.texts_of(batch.column(0).slice(lo, hi - lo))
                base, words = base_counts(texts)
                for i in np.flatnonzero(~base["base_failed"]):
                    view = View(texts, words, base, i)
                    for k, rule in enumerate(rules):
                        t = time.perf_counter()
                        out = rule.rejects(view)
                        got[k] += time.perf_counter() - t, out, 1
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), *(pa.array(got[:, j]) for j in range(3))],
                                             names=["rule", "cost", "hits", "n"])

    sums = A.small_batches(picked).mapInArrow(run, "rule int, cost double, hits double, n double").groupBy("rule").agg(
        *[F.sum(c).alias(c) for c in ("cost", "hits", "n")])
    return {rules[r["rule"]].name: {"cost": r["cost"] / max(r["n"], 1), "selectivity": r["hits"] / max(r["n"], 1)}
            for r in sums.collect()}


def order(figures: dict, rules: Sequence[Rule] = RULES) -> list[Rule]:
    """Rules by rejections per second, most first; unmeasured ones keep their place at the end."""
    worth = {n: f["selectivity"] / max(f["cost"], 1e-9) for n, f in figures.items()}
    return sorted(rules, key=lambda r: -worth.get(r.name, 0.0))


def judge(df: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", rules: Sequence[Rule] = RULES,
          sample_rows: int = 2000) -> DataFrame:
    """The ``keep`` columns, the base counts, ``base_failed`` and ``kept`` for every row."""
    cascade = order(measure(df, text, rules, sample_rows), rules)

    def make():
        def fn(texts: A.Texts, rows) -> dict:
            base, words = base_counts(texts)
            kept = ~base["base_failed"]
            for i in np.flatnonzero(kept):
                view = View(texts, words, base, i)
                kept[i] = not any(r.rejects(view) for r in cascade)
            return base | {"kept": kept}
        return fn

    return A.scan(df, keep, text, [*BASE, ("kept", T.BooleanType())], make)


def filter_documents(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``df``, all columns unchanged, whose text is kept."""
    flag = "__kept"
    while flag in df.columns:
        flag += "_"
    cascade = order(measure(df, text, **options), options.get("rules", RULES))
    at = df.columns.index(text)
    schema = df.schema

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            for lo, hi in A.slices(column):
                part = batch.slice(lo, hi - lo)
                texts = A.texts_of(part.column(at))
                base, words = base_counts(texts)
                kept = ~base["base_failed"]
                for i in np.flatnonzero(kept):
                    view = View(texts, words, base, i)
                    kept[i] = not any(r.rejects(view) for r in cascade)
                if kept.any():
                    yield part.filter(pa.array(kept))

    return A.small_batches(df).mapInArrow(lambda batches: A.released(run(batches)), schema)
