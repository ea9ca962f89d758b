"""Operator 12: secret scans by base patterns and a character convolutional network in numpy.

Base findings come from three patterns (``assign``, ``access``, ``hex``), matched on the bytes of the
whole text; only ASCII letters match in either case. They are the labels: a *candidate* is a maximal run
of ``[A-Za-z0-9+/_.=-]`` of at least 16 characters that holds a digit, or of at least 20, and is
positive if a base finding overlaps it. The network reads every candidate whole, with 24 bytes before
and 12 after it: one convolution of width 5 over characters (each character knows whether it is
in the candidate or around it), rectified, pooled by maximum over the window and by maximum
and mean over the candidate, then two dense layers. Copies of each training window without its
surroundings, cut to a random part of at least 16 characters, teach it to judge a candidate alone and
at any length. Scores are calibrated by a logistic curve on the quarter of the windows kept apart, and the
threshold is the highest one that still finds at least ``RECALL`` of the held-apart findings of every base kind, as
they are and as such copies. Candidates over it that no base finding overlaps are added as kind
``learned``; base findings always stay.

All different windows of all texts teach or calibrate; none is left out. They are dealt into shards of about
``SHARD_BYTES``; in each epoch every shard trains a copy of the network in a task of its own, and the copies are
averaged. All candidates of all texts are judged, in one scan, in blocks of positions, so a
candidate of any length needs bounded memory; one of more than ``PART_CHARS`` characters is taught by random parts.

Defined results: null and empty texts have no spans; spans count code points, end exclusive, over the
whole match; repeated rows each get a row; if the table shows no findings, or nothing but findings,
there is no network and only base spans come out; an empty table gives no rows; further columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmill.llm import arrays as A
from opsmill.operators.relational import rank_quantiles
from opsmill.session import cut_lineage

KINDS = ("assign", "access", "hex", "learned")
BEFORE, AFTER = 24, 12
LEAST = 16
PART_CHARS = 512
#: Bytes of windows in a shard, windows of each class in it at least, and partitions whose sums meet on the driver at most.
SHARD_BYTES, SHARD_LEAST, MOST_PARTS = 1 << 19, 16, 64
RECALL = 0.99
RADIUS, FILTERS, HIDDEN = 2, 24, 16
EPOCHS, BATCH = 12, 128
BLOCK_POSITIONS = 1 << 16

_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = A.byte_class((0x30, 0x39), (0x61, 0x66))
_DIGIT = A.byte_class((0x30, 0x39))
_TOKEN = A.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), *[(ord(c), ord(c)) for c in "+/_.=-"])
#: Symbols: 0 padding, 1-95 printable ASCII, 96 control, 97 any other byte.
_SYMBOL = np.full(256, 97, np.int64)
_SYMBOL[:0x80] = 96
_SYMBOL[0x20:0x7F] = np.arange(1, 96)
SYMBOLS = 98


def base_findings(texts: A.Texts) -> list[tuple[int, int, int, int]]:
    """(row, start, end, kind) in bytes of the slice, leftmost and non-overlapping within a kind."""
    out = []
    sign = A.byte_class((0x3A, 0x3A), (0x3D, 0x3D))
    for r in np.flatnonzero(texts.count(sign)).tolist():
        out += [(r, int(texts.at[r]) + m.start(), int(texts.at[r]) + m.end(), 0) for m in _ASSIGN.finditer(texts.row(r)) if len(m[1]) >= 8]
    if b"AKIA" in texts.data.tobytes():
        for r in range(texts.n):
            out += [(r, int(texts.at[r]) + m.start(), int(texts.at[r]) + m.end(), 1) for m in _ACCESS.finditer(texts.row(r)) if len(m[0]) >= 16]
    runs = texts.spans(_HEX)
    long = np.flatnonzero(runs.end - runs.start >= 32)
    rows = np.searchsorted(runs.first, long, "right") - 1
    return out + [(int(r), int(runs.start[i]), int(runs.end[i]), 2) for r, i in zip(rows, long.tolist(), strict=True)]


def candidates(texts: A.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the runs that the network judges."""
    runs = texts.spans(_TOKEN)
    size, digits = runs.end - runs.start, A.sums(_DIGIT[texts.data])
    at = np.flatnonzero((size >= 20) | (size >= LEAST) & (digits[runs.end] > digits[runs.start]))
    return np.searchsorted(runs.first, at, "right") - 1, runs.start[at], runs.end[at]


def kinds_of(start: np.ndarray, end: np.ndarray, found: Sequence[tuple[int, int, int, int]]) -> np.ndarray:
    """The first kind of base finding that overlaps each candidate, or -1. Positions are of one slice."""
    out = np.full(len(start), -1, np.int64)
    for kind in (2, 1, 0):
        spans = sorted((a, b) for _, a, b, k in found if k == kind)
        if spans:
            a, b = np.array(spans).T
            hit = np.searchsorted(b, start, "right") < np.searchsorted(a, end, "left")
            out[hit] = kind
    return out


@dataclass
class Windows:
    """Symbols of windows one after the other (padded on both sides), their places without the padding
    and the places of their candidates."""

    flat: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    start: np.ndarray
    end: np.ndarray


def windows(texts: A.Texts, row: np.ndarray, start: np.ndarray, end: np.ndarray, alone: np.ndarray | None = None) -> Windows:
    lo, hi = np.maximum(start - BEFORE, texts.at[row]), np.minimum(end + AFTER, texts.at[row + 1])
    size = hi - lo
    at = A.sums(size + 2 * RADIUS)
    flat = np.zeros(int(at[-1]), np.int64)
    flat[A.expand(at[:-1] + RADIUS, size)] = _SYMBOL[texts.data[A.expand(lo, size)]]
    first = at[:-1] + RADIUS + start - lo
    inside = A.expand(first, end - start)
    if alone is not None:
        kept = flat[inside]
        flat[A.expand(at[:-1][alone], np.diff(at)[alone])] = 0
        flat[inside] = kept
    flat[inside] += SYMBOLS
    return Windows(flat, at[:-1] + RADIUS, at[1:] - RADIUS, first, first + end - start)


@dataclass
class Network:
    """Convolution tables (offset x symbol x filter), dense layers, calibration and threshold."""

    table: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)
    threshold: float = 1.1

    def convolve(self, flat: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Rectified features of positions [lo, hi); places beyond the ends are padding."""
        total = np.repeat(self.bias[None], hi - lo, axis=0)
        for k in range(-RADIUS, RADIUS + 1):
            a, b = max(lo + k, 0), min(hi + k, len(flat))
            total[a - k - lo:b - k - lo] += self.table[k + RADIUS][flat[a:b]]
        return np.maximum(total, 0)

    def pooled(self, w: Windows) -> np.ndarray:
        """Windows x (maximum of the window, maximum and mean of the candidate), block by block."""
        n = len(w.start)
        top, own, mean = np.zeros((n, FILTERS)), np.zeros((n, FILTERS)), np.zeros((n, FILTERS))
        for lo in range(0, len(w.flat), BLOCK_POSITIONS):
            hi = min(lo + BLOCK_POSITIONS, len(w.flat))
            h = self.convolve(w.flat, lo, hi)
            for starts, ends, most, total in ((w.lo, w.hi, top, None), (w.start, w.end, own, mean)):
                i = np.flatnonzero((starts < hi) & (ends > lo))
                if not len(i):
                    continue
                a, b = np.maximum(starts[i], lo) - lo, np.minimum(ends[i], hi) - lo
                cut = np.stack([a, b], axis=1).ravel()
                padded = np.concatenate([h, np.zeros((1, FILTERS))])  # so that an end may be the block's
                most[i] = np.maximum(most[i], np.maximum.reduceat(padded, cut)[::2])
                if total is not None:
                    total[i] += np.add.reduceat(padded, cut)[::2]
        return np.concatenate([top, own, mean / (w.end - w.start)[:, None]], axis=1)

    def logits(self, w: Windows) -> np.ndarray:
        if not len(w.start):
            return np.zeros(0)
        return np.maximum(self.pooled(w) @ self.dense + self.dense_bias, 0) @ self.out + self.out_bias[0]

    def scores(self, w: Windows) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.logits(w) + b, -500, 500)))


def _gradients(net: Network, w: Windows, label: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean logistic loss, in the order table, bias, dense, dense_bias, out, out_bias."""
    h = net.convolve(w.flat, 0, len(w.flat))
    size = w.end - w.start
    cut = np.stack([w.start, w.end], axis=1).ravel()
    top, own = np.maximum.reduceat(h, np.stack([w.lo, w.hi], axis=1).ravel())[::2], np.maximum.reduceat(h, cut)[::2]
    pooled = np.concatenate([top, own, np.add.reduceat(h, cut)[::2] / size[:, None]], axis=1)
    hidden = np.maximum(pooled @ net.dense + net.dense_bias, 0)
    d = (1 / (1 + np.exp(-np.clip(hidden @ net.out + net.out_bias[0], -500, 500))) - label) / len(label)
    d_hidden = np.outer(d, net.out) * (hidden > 0)
    d_pool = d_hidden @ net.dense.T
    d_h = np.zeros_like(h)
    whole, around = np.repeat(np.arange(len(size)), w.hi - w.lo), A.expand(w.lo, w.hi - w.lo)
    inside, of = A.expand(w.start, size), np.repeat(np.arange(len(size)), size)
    for places, owner, most, grad in ((around, whole, top, d_pool[:, :FILTERS]), (inside, of, own, d_pool[:, FILTERS:2 * FILTERS])):
        is_top = (h[places] == most[owner]).astype(np.float64)
        share = grad / np.maximum(np.add.reduceat(is_top, np.searchsorted(owner, np.arange(len(size)))), 1)
        d_h[places] += is_top * share[owner]
    d_h[inside] += (d_pool[:, 2 * FILTERS:] / size[:, None])[of]
    d_h *= h > 0
    d_table = np.zeros_like(net.table)
    hot = np.zeros((len(w.flat), 2 * SYMBOLS), np.float32)
    hot[np.arange(len(w.flat)), w.flat] = 1
    for k in range(-RADIUS, RADIUS + 1):
        lo, hi = max(0, -k), len(w.flat) - max(0, k)
        d_table[k + RADIUS] = hot[lo + k:hi + k].T @ d_h[lo:hi].astype(np.float32)
    return [d_table, d_h.sum(axis=0), pooled.T @ d_hidden, d_hidden.sum(axis=0), hidden.T @ d, np.array([d.sum()])]


def _start(seed: int) -> Network:
    rng = np.random.default_rng(seed)
    return Network(rng.normal(0, 0.3, (2 * RADIUS + 1, 2 * SYMBOLS, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, (3 * FILTERS, HIDDEN)), np.zeros(HIDDEN),
                   rng.normal(0, 0.3, HIDDEN), np.zeros(1))


def _params(net: Network) -> list[np.ndarray]:
    return [net.table, net.bias, net.dense, net.dense_bias, net.out, net.out_bias]


def _part(start: np.ndarray, end: np.ndarray, alone: np.ndarray, size_draw: np.ndarray, place_draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the part that is read: the whole candidate, or for copies a part of at least ``LEAST`` and at most
    ``PART_CHARS`` characters, by two draws from [0, 1)."""
    whole = end - start
    most = np.minimum(whole, PART_CHARS)
    least = np.minimum(LEAST, most)
    size = np.where(alone, least + (size_draw * (most - least + 1)).astype(np.int64), whole)
    a = start + (place_draw * (whole - size + 1)).astype(np.int64)
    return a, a + size


def _epoch(net: Network, first: list, second: list, step: int, texts: Sequence[bytes], start: np.ndarray, end: np.ndarray, kind: np.ndarray, seed: Sequence[int]) -> tuple[list, int]:
    """Adam steps over one shard, from a shared network and moments: the three of them afterwards, and the number of
    steps. Each window counts once as it is (if it is not too long for that) and once alone; classes in equal shares."""
    net = replace(net, **{k: getattr(net, k).copy() for k in ("table", "bias", "dense", "dense_bias", "out", "out_bias")})
    params, first, second = _params(net), [x.copy() for x in first], [x.copy() for x in second]
    data = A.texts_of(pa.array(list(texts), pa.binary()))
    start, end, label = start + data.at[:-1], end + data.at[:-1], (kind >= 0).astype(np.float64)
    rows = np.arange(len(kind))
    pick, alone = np.concatenate([rows, rows]), np.repeat([False, True], len(rows))
    alone |= (end - start)[pick] > PART_CHARS
    n = [max((1 - label[pick]).sum(), 1), max(label[pick].sum(), 1)]
    chance = np.where(label[pick] == 1, 1 / n[1], 1 / n[0])
    chance /= chance.sum()
    rng = np.random.default_rng(list(seed))
    steps = max(1, len(pick) // BATCH)
    for t in range(step + 1, step + steps + 1):
        i = rng.choice(len(pick), min(BATCH, len(pick)), p=chance)
        a, b = _part(start[pick[i]], end[pick[i]], alone[i], rng.random(len(i)), rng.random(len(i)))
        w = windows(data, pick[i], a, b, alone[i])
        for p, g, m, v in zip(params, _gradients(net, w, label[pick[i]]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return [*params, *first, *second], steps


def _shards(taught: DataFrame, sizes: dict[int, tuple[int, int]]) -> tuple[DataFrame, int]:
    """(shard, rows): all windows dealt by hash into arrays of about ``SHARD_BYTES``. A class with too few windows
    for that is dealt to several shards, so that each shard has some of both."""
    n = max(1, -(-sum(b for _, b in sizes.values()) // SHARD_BYTES))
    place = F.pmod(F.xxhash64("key", "start"), F.lit(n))
    copies = F.lit(1)
    for label, (count, _) in sizes.items():
        copies = F.when(F.col("label") == label, F.lit(min(n, -(-SHARD_LEAST * n // count)) if count < SHARD_LEAST * n else 1)).otherwise(copies)
    dealt = taught.withColumn("__c", copies).withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__c") - 1)))
    dealt = dealt.withColumn("shard", F.pmod(place + F.col("__j") * F.floor(F.lit(n) / F.col("__c")), F.lit(n)).cast("long"))
    return dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("key", "start", "end", "kind", "window"))).alias("rows")), n


def _taught(taught: DataFrame, sizes: dict[int, tuple[int, int]], epochs: int, seed: int) -> Network:
    """The network after ``epochs`` rounds over all shards: each task trains its shards from the same network, and
    networks and moments are averaged by the number of windows."""
    net = _start(seed)
    shards, n = _shards(taught, sizes)
    dealt = cut_lineage(shards).rdd.map(lambda r: (r["shard"], r["rows"])).partitionBy(min(n, MOST_PARTS), int)  # stays shuffled from round to round
    sc = taught.sparkSession.sparkContext
    first, second = [np.zeros_like(p) for p in _params(net)], [np.zeros_like(p) for p in _params(net)]
    step = 0
    for epoch in range(epochs):
        shared = sc.broadcast((net, first, second, step))

        def run(part, shared=shared, epoch=epoch):
            total, weight, steps = None, 0, 0
            for shard, rows in sorted(part, key=lambda x: x[0]):
                place = [np.array([r[c] for r in rows], dtype=np.int64) for c in ("start", "end", "kind")]
                got, done = _epoch(*shared.value, [bytes(r["window"]) for r in rows], *place, seed=(seed, epoch, shard))
                got = [len(rows) * x for x in got]
                total = got if total is None else [x + y for x, y in zip(total, got, strict=True)]
                weight, steps = weight + len(rows), max(steps, done)
            return [] if total is None else [(total, weight, steps)]

        parts = dealt.mapPartitions(run).collect()  # at most MOST_PARTS sums, in the order of the partitions
        weight = sum(w for _, w, _ in parts)
        mean = [sum(x) / weight for x in zip(*(t for t, _, _ in parts), strict=True)]
        k = len(mean) // 3
        net, first, second, step = Network(*mean[:k]), mean[k:2 * k], mean[2 * k:], step + max(s for _, _, s in parts)
        shared.unpersist()
    return net


def _judged(held: DataFrame, net: Network) -> DataFrame:
    """(logit, label, kind) of each window as it is and of a part of it alone, drawn by the window's hash."""
    shared = held.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            for lo, hi in A.slices(batch.column(0)):
                b = batch.slice(lo, hi - lo)
                data = A.texts_of(b.column(0))
                start, end, kind = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
                start, end = start + data.at[:-1], end + data.at[:-1]
                draws = [np.array([int(k.as_py()[i:i + 8], 16) / 2**32 for k in b.column(4)]) for i in (8, 16)]
                for alone in (False, True):
                    flag = np.full(len(kind), alone)
                    x, y = _part(start, end, flag, *draws)
                    logit = shared.value.logits(windows(data, np.arange(len(kind)), x, y, flag))
                    yield pa.RecordBatch.from_arrays([pa.array(logit), pa.array((kind >= 0).astype(np.int64)), pa.array(kind)], names=["logit", "label", "kind"])

    return held.select("window", "start", "end", "kind", "key").mapInArrow(lambda b: A.released(run(b)), "logit double, label long, kind long")


def _curve(judged: DataFrame) -> tuple[float, float]:
    """Platt's logistic curve by Newton steps over all judged windows, with his smoothed targets and a non-negative slope."""
    n1, n0, top = judged.agg(F.sum("label"), F.sum(1 - F.col("label")), F.max(F.abs("logit"))).first()
    scale = max(1.0, float(top))
    x = F.col("logit") / F.lit(scale)
    target = F.when(F.col("label") == 1, F.lit((n1 + 1) / (n1 + 2))).otherwise(F.lit(1 / (n0 + 2)))
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x * F.lit(float(beta[0])) + F.lit(float(beta[1]))))
        d = judged.select(x.alias("x"), target.alias("t"), (1 / (1 + F.exp(-z))).alias("p")).withColumn("w", F.col("p") * (1 - F.col("p")) + F.lit(1e-9))
        off = F.col("t") - F.col("p")
        xx, x1, one, gx, g1 = d.agg(F.sum(F.col("x") * F.col("x") * F.col("w")), F.sum(F.col("x") * F.col("w")), F.sum("w"), F.sum(F.col("x") * off), F.sum(off)).first()
        move = np.linalg.solve(np.array([[xx, x1], [x1, one]]) + 1e-6 * np.eye(2), np.array([gx, g1]) - 1e-6 * beta)
        beta = beta + move * min(1.0, 5 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-9:
            break
    return max(float(beta[0]), 1e-9) / scale, float(beta[1])


def labelled_windows(docs: DataFrame, text: str = "text") -> DataFrame:
    """Different candidate windows of all texts: ``window``, the candidate's place in it and its ``kind``."""
    source = A.small_batches(docs.select(docs[text].cast("string").alias("text")))

    def run(batches):
        for batch in batches:
            for lo, hi in A.slices(batch.column(0)):
                texts = A.texts_of(batch.column(0).slice(lo, hi - lo))
                row, start, end = candidates(texts)
                kind = kinds_of(start, end, base_findings(texts))
                a, b = np.maximum(start - BEFORE, texts.at[row]), np.minimum(end + AFTER, texts.at[row + 1])
                made = [texts.data[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), pa.array(start - a), pa.array(end - a), pa.array(kind), pa.array((kind >= 0).astype(np.int64))],
                                                 names=["window", "start", "end", "kind", "label"])

    out = source.mapInArrow(lambda b: A.released(run(b)), "window binary, start long, end long, kind long, label long")
    return out.dropDuplicates(["window", "start"]).withColumn("key", F.sha2("window", 256))


def train(docs: DataFrame, text: str = "text", epochs: int = EPOCHS, recall: float = RECALL, seed: int = 13) -> Network | None:
    """A calibrated network from all different windows of all texts. A quarter of them, by hash of their bytes, is
    kept apart for the calibration; None without both classes in both parts."""
    found = cut_lineage(labelled_windows(docs, text).withColumn("apart", F.conv(F.substring("key", 1, 2), 16, 10).cast("int") % 4 == 0))
    sizes = {(r["apart"], r["label"]): (r["n"], r["b"]) for r in found.groupBy("apart", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("window")).alias("b")).collect()}
    if len(sizes) < 4:
        return None
    net = _taught(found.filter("not apart"), {k: sizes[False, k] for k in (0, 1)}, epochs, seed)
    judged = cut_lineage(_judged(found.filter("apart"), net))
    net.curve = _curve(judged)
    a, b = net.curve
    counts = {r["kind"]: r["n"] for r in judged.filter("kind >= 0").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranks = {f"of_{k}": (int(np.floor((1 - recall) * n)) + 0.5) / n for k, n in counts.items()}  # the next rank behind the share that may be missed
    least = min(r[f"of_{r['kind']}"] for r in rank_quantiles(judged.filter("kind >= 0"), ["kind"], "logit", ranks).collect())
    net.threshold = float(1 / (1 + np.exp(-np.clip(a * least + b, -500, 500))))
    return net


def scan(docs: DataFrame, net: Network | None, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns with ``findings``: an array of (kind, start, end, score) by start, then kind.

    Base findings have a null score.
    """
    entry = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few ten thousand numbers
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def make():
        net: Network | None = shared.value

        def run(texts: A.Texts, _rows) -> dict:
            found = base_findings(texts)
            spans = [(r, a, k, b, None) for r, a, b, k in found]
            if net is not None:
                row, start, end = candidates(texts)
                free = kinds_of(start, end, found) < 0
                row, start, end = row[free], start[free], end[free]
                score = net.scores(windows(texts, row, start, end))
                spans += [(int(row[i]), int(start[i]), 3, int(end[i]), float(score[i])) for i in np.flatnonzero(score >= net.threshold)]
            points = A.sums((texts.data & 0xC0) != 0x80)
            out: list[list[dict]] = [[] for _ in range(texts.n)]
            for r, a, k, b, s in sorted(spans, key=lambda x: x[:4]):
                base = points[texts.at[r]]
                out[r].append({"kind": KINDS[k], "start": int(points[a] - base), "end": int(points[b] - base), "score": s})
            return {"findings": pa.array(out, arrow)}

        return run

    return A.scan(docs, keep, text, [("findings", T.ArrayType(entry))], make)


def digest(found: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Counts by base kind, the hash of the base spans and all spans as text."""
    def joined(base: bool):
        of = F.filter("findings", lambda x: x["kind"] != "learned") if base else F.col("findings")
        return F.array_join(F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(*keep, *[count(k) for k in KINDS[:3]], F.sha2(joined(True), 256).alias("base_sha256"), joined(False).alias("spans"), count("learned"))
