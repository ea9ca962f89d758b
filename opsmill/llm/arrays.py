"""Whole-batch text primitives shared by the operators of this package.

A batch of texts arrives from Spark as one Arrow column: a byte buffer plus row offsets.
The helpers below find words and lines, hash them and hash word windows for all texts of
a slice at once, with numpy, so no operator loops over words in Python. Slices hold at
most ``SLICE_BYTES`` of text (a longer text is a slice of its own), which bounds the
temporaries of a task whatever the batch size. Texts are never cut.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 1 << 19
BATCH_BYTES = 4 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def byte_class(*ranges: tuple[int, int], invert: bool = False) -> np.ndarray:
    """A 256-entry membership table of byte ranges (both ends included)."""
    table = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return ~table if invert else table


#: `[^\x20\x09-\x0D]+`: everything but ASCII white space.
NON_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D), invert=True)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: ASCII digits and letters, all other bytes.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
NOT_NEWLINE = byte_class((0x0A, 0x0A), invert=True)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective), so that every bit of a hash depends on every input bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, factor in enumerate((_BASE, _INVERSE)):
            p = np.full(size, factor, U64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=U64)
    return _POWERS[0][:n], _POWERS[1][:n]


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums with a leading zero: the sum over [a, b) is ``out[b] - out[a]``."""
    out = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=out[1:])
    return out


class Texts:
    """A slice of texts: ``data`` (bytes) and ``at`` (row offsets into it, one more than rows)."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, self.n = data, at, len(at) - 1

    def row(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()

    def count(self, table: np.ndarray) -> np.ndarray:
        """Per row, the bytes that belong to a class."""
        return np.diff(sums(table[self.data])[self.at])

    def spans(self, table: np.ndarray) -> "Spans":
        return Spans(self, table)


class Spans:
    """Maximal runs of a byte class inside rows: words or lines.

    ``start`` and ``end`` are byte positions, ``first[r] .. first[r + 1]`` the runs of row r.
    """

    def __init__(self, texts: Texts, table: np.ndarray):
        self.texts = texts
        inside = table[texts.data]
        edge = np.zeros(len(inside) + 1, dtype=bool)
        edge[texts.at] = True  # a run never crosses rows
        before, after = inside.copy(), inside.copy()
        before[1:] &= ~inside[:-1] | edge[1:-1]
        after[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(before)
        self.end = np.flatnonzero(after) + 1
        self.first = np.searchsorted(self.start, texts.at)
        self.n = np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.n), self.n)

    def hashes(self, fold: np.ndarray = SAME) -> np.ndarray:
        """A 64-bit hash of each run's bytes after the byte map ``fold``."""
        data = self.texts.data
        up, down = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(_BYTE_CODE[fold][data] * up[: len(data)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U64))

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of k consecutive runs of a row, and the index of each window's
        first run. Rows with fewer runs have none."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        last = np.repeat(self.first[1:], self.n)[:n]  # where the row of the window's first run ends
        at = np.flatnonzero(np.arange(n) + k <= last)
        return mix(window_sum(hashes, at, k)), at


def window_sum(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = np.full(len(at), U64(k))
    for j in range(k):
        out = out * U64(_BASE) + hashes[at + j]
    return out


def keyed(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes made distinct by row, for per-row counting in one sort."""
    return mix(hashes + (rows.astype(U64) + U64(1)) * U64(0xA0761D6478BD642F))


def texts_of(column: pa.Array) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(data, at - at[0])


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row is a range of its own."""
    if not len(column):
        return
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    lo = total = 0
    for i, s in enumerate(size):
        if i > lo and total + s > limit:
            yield lo, i
            lo, total = i, 0
        total += s
    yield lo, len(size)


def scan(df: DataFrame, keep: Sequence[str], text: str, out: Sequence[tuple[str, T.DataType]],
         make: Callable[[], Callable[[Texts, pa.RecordBatch], dict]]) -> DataFrame:
    """Run ``make()(texts, rows)`` over slices of a text column; it returns the ``out`` columns.

    Only the ``keep`` columns and the text are read, so further columns of ``df`` neither
    travel nor clash. Null texts are seen as empty; ``rows`` still tells them apart.
    ``make`` is called once in each task (to open a broadcast value, for instance).
    """
    keep = list(keep)
    src = df.select(*[df[c] for c in keep], df[text].cast("string").alias("__text"))
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in out])
    names = [n for n, _ in out]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            column = batch.column(len(keep))
            for lo, hi in slices(column):
                part = batch.slice(lo, hi - lo)
                got = fn(texts_of(part.column(len(keep))), part)
                arrays = [part.column(i) for i in range(len(keep))]
                arrays += [v if isinstance(v, pa.Array) else pa.array(v) for v in (got[n] for n in names)]
                yield pa.RecordBatch.from_arrays(arrays, names=keep + names)

    return small_batches(src).mapInArrow(lambda batches: released(run(batches)), schema)


def ragged(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the number of values of each row."""
    return pa.ListArray.from_arrays(pa.array(sums(lengths).astype(np.int32)), pa.array(values, kind))


def expand(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Concatenated ranges [first[i], first[i] + n[i])."""
    return np.arange(int(n.sum())) + np.repeat(first - sums(n)[:-1], n)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding the bytes of an Arrow batch in its session.

    Texts are long rows: the default bound of a batch lets one hold tens of megabytes in the
    executor and again in its Python worker. A lower setting of the session stays.
    """
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(conf.get(name)) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def _bytes(text: str) -> int:
    number = text.strip().lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(number[-1:], 0)
    return int(number[:-1] if unit else number) << unit


def released(batches: Iterable) -> Iterator:
    """Pass batches on; after the last one, hand free memory back to the system, because Spark
    keeps Python workers for later tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
