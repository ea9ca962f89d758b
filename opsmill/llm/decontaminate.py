"""Operator 9: benchmark decontamination with a broadcast hash set of item n-grams.

Words are runs of ASCII letters and digits and of all bytes from 0x80 on, A-Z lower-cased.
A window is ``n`` consecutive words of an item; an item of fewer words (but not none) is
one window as a whole. Item windows are hashed into a set that is broadcast; documents are
scanned once, each window is looked up in a bitmap and then in the sorted hashes, and each
hit is verified word by word against the item's own words before it counts.

The item table is the bounded side: its windows are counted first and broadcast in blocks
of at most ``block_windows``. With one block (any real benchmark suite) the scan alone
gives the result; more blocks mean one scan each, and only documents with hits are merged
afterwards, so nothing is dropped at any size.

Defined results: null, empty or wordless texts have no words, no hits and are clean; a
null item id is reported as the string ``null``; items with equal text are all reported;
repeated rows each get a row; without items every document is clean.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmill.llm import arrays as A

WINDOW = 10
BLOCK_WINDOWS = 2_000_000
_BITS = 22


def words_of(text: str | None) -> list[bytes]:
    texts = A.texts_of(pa.array([text or ""], pa.string()))
    spans, data = texts.spans(A.ALNUM), A.LOWER[texts.data].tobytes()
    return [data[a:b] for a, b in zip(spans.start.tolist(), spans.end.tolist(), strict=True)]


class ItemWindows:
    """Windows of a block of items: sorted hashes by window length, and their words for verification."""

    def __init__(self, items: Sequence[tuple[object, str | None]], n: int):
        self.items = [i for i, _ in items]
        found: dict[int, dict[bytes, set[int]]] = {}
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            size = min(n, len(words))
            for a in range(len(words) - size + 1) if size else ():
                found.setdefault(size, {}).setdefault(b" ".join(words[a:a + size]), set()).add(k)
        self.by_size = {}
        for size, windows in found.items():
            grams = list(windows)
            texts = A.texts_of(pa.array(grams, pa.binary()))
            spans = texts.spans(A.ALNUM)
            hashes, _ = spans.windows(spans.hashes(), size)
            order = np.argsort(hashes, kind="stable")
            bitmap = np.zeros(1 << _BITS, dtype=bool)
            bitmap[hashes >> A.U64(64 - _BITS)] = True
            self.by_size[size] = hashes[order], bitmap, [grams[i] for i in order], [sorted(windows[grams[i]]) for i in order]


def find_hits(texts: A.Texts, windows: ItemWindows) -> tuple[A.Spans, list[tuple[int, int, int, list[int]]]]:
    """Verified hits (row, first word, number of words, item indexes)."""
    spans = texts.spans(A.ALNUM)
    hashes = spans.hashes(A.LOWER)
    hits = []
    row = None
    for size, (known, bitmap, grams, owners) in windows.by_size.items():
        h, at = spans.windows(hashes, size)
        maybe = np.flatnonzero(bitmap[h >> A.U64(64 - _BITS)])
        if not len(maybe):
            continue
        h, at = h[maybe], at[maybe]
        row = spans.row if row is None else row
        lo, hi = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
        for k in np.flatnonzero(hi > lo).tolist():
            f = int(at[k])
            a, b = spans.start[f:f + size], spans.end[f:f + size]
            low = A.LOWER[texts.data[a[0]:b[-1]]].tobytes()
            gram = b" ".join([low[x:y] for x, y in zip((a - a[0]).tolist(), (b - a[0]).tolist(), strict=True)])
            for j in range(int(lo[k]), int(hi[k])):
                if grams[j] == gram:
                    hits.append((int(row[f]), f, size, owners[j]))
    return spans, hits


def cover(hits, n_words: int) -> np.ndarray:
    hit = np.zeros(n_words, dtype=bool)
    for _, f, size, _ in hits:
        hit[f:f + size] = True
    return hit


def _blocks(benchmark: DataFrame, item: str, text: str, block_windows: int) -> Iterator[list[tuple[object, str | None]]]:
    """Item rows in blocks whose word count (a bound on their windows) is limited; a longer item
    is a block of its own. One block at a time is on the driver; there is at least one."""
    block, size, given = [], 0, False
    for r in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        n = len(words_of(r["t"]))
        if block and size + n > block_windows:
            yield block
            block, size, given = [], 0, True
        block.append(("null" if r["i"] is None else r["i"], r["t"]))
        size += n
    if block or not given:
        yield block


def mark(docs: DataFrame, benchmark: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text",
         item: str = "item_id", item_text: str = "text", n: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``keep`` columns, ``n_words``, ``hit_words`` (indexes of hit words) and ``items`` (ids as
    strings, sorted) of every document."""
    sc = docs.sparkSession.sparkContext
    out = [("n_words", T.LongType()), ("hit_words", T.ArrayType(T.IntegerType())), ("items", T.ArrayType(T.StringType()))]

    def one(block) -> DataFrame:
        shared = sc.broadcast(ItemWindows(block, n))

        def make():
            windows = shared.value

            def fn(texts: A.Texts, rows) -> dict:
                spans, hits = find_hits(texts, windows)
                hit = cover(hits, len(spans.start))
                where = np.flatnonzero(hit)
                row = spans.row[where] if len(where) else where
                ids: list[set] = [set() for _ in range(texts.n)]
                for r, _, _, owners in hits:
                    ids[r].update(windows.items[k] for k in owners)
                return {"n_words": spans.n.astype(np.int64),
                        "hit_words": A.ragged(where - spans.first[row], np.bincount(row, minlength=texts.n), pa.int32()),
                        "items": pa.array([sorted(s) for s in ids], pa.list_(pa.string()))}
            return fn
        return make

    makes = [one(b) for b in _blocks(benchmark, item, item_text, block_windows)]
    if len(makes) == 1:
        return A.scan(docs, keep, text, out, makes[0])
    # several blocks: number the rows by value-independent input position once, merge by that number
    flat = docs.select(*keep, text).withColumn("__row", F.monotonically_increasing_id()).checkpoint()
    parts = [A.scan(flat, [*keep, "__row"], text, out, m) for m in makes]
    hits = parts[0].select("__row", "hit_words", "items").filter("size(items) > 0")
    for p in parts[1:]:
        hits = hits.unionByName(p.select("__row", "hit_words", "items").filter("size(items) > 0"))
    merged = hits.groupBy("__row").agg(  # at most one row a block for each document
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("__hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items"))
    return (parts[0].join(merged, "__row", "left")
            .select(*keep, "n_words", F.coalesce("__hit", "hit_words").alias("hit_words"), F.coalesce("__items", "items").alias("items")))


def digest(marked: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The query's columns from what ``mark`` found."""
    return marked.select(*keep, "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                 n: int = WINDOW, drop_ratio: float = 0.5, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` without benchmark passages, all columns kept.

    Each run of hit words goes, from its first word to its last, with the text between. A
    document of which more than ``drop_ratio`` of the words are hit goes as a whole. Other
    rows, null texts included, pass unchanged. The number of blocks does not change the result.
    """
    sc = docs.sparkSession.sparkContext
    columns, at = docs.columns, docs.columns.index(text)
    blocks = [sc.broadcast(ItemWindows(b, n)) for b in _blocks(benchmark, item, item_text, block_windows)]

    def cut(part: pa.RecordBatch, texts: A.Texts, spans: A.Spans, hit: np.ndarray) -> pa.RecordBatch:
        kept = np.ones(texts.n, dtype=bool)
        column = part.column(at).to_pylist()
        for r in np.unique(spans.row[np.flatnonzero(hit)]).tolist():
            f, t = spans.first[r], spans.first[r + 1]
            own = hit[f:t]
            if own.sum() > drop_ratio * len(own):
                kept[r] = False
                continue
            edge = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
            left = bytearray(texts.row(r))
            base = texts.at[r]
            for a, b in reversed(list(zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True))):
                del left[spans.start[f + a] - base:spans.end[f + b - 1] - base]
            column[r] = left.decode()
        arrays = part.columns[:len(columns)]
        arrays[at] = pa.array(column, part.column(at).type)
        return pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(kept))

    if len(blocks) == 1:
        def run(batches):
            windows = blocks[0].value
            for batch in batches:
                for lo, hi in A.slices(batch.column(at)):
                    part = batch.slice(lo, hi - lo)
                    texts = A.texts_of(part.column(at))
                    spans, hits = find_hits(texts, windows)
                    yield cut(part, texts, spans, cover(hits, len(spans.start))) if hits else part

        return A.small_batches(docs).mapInArrow(run, docs.schema)

    # several blocks: the hits of all on the original texts, merged by row, then the ratio and the cuts once
    row, found = "__row", "__found"
    while {row, found} & set(columns):
        row, found = row + "_", found + "_"
    flat = docs.withColumn(row, F.monotonically_increasing_id()).checkpoint()

    def one(shared) -> DataFrame:
        def make():
            windows = shared.value

            def fn(texts: A.Texts, rows) -> dict:
                spans, hits = find_hits(texts, windows)
                where = np.flatnonzero(cover(hits, len(spans.start)))
                own = spans.row[where] if len(where) else where
                return {found: A.ragged(where - spans.first[own], np.bincount(own, minlength=texts.n), pa.int32())}
            return fn

        return A.scan(flat, [row], text, [(found, T.ArrayType(T.IntegerType()))], make).filter(F.size(found) > 0)

    parts = [one(b) for b in blocks]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    merged = hits.groupBy(row).agg(F.array_distinct(F.flatten(F.collect_list(found))).alias(found))  # at most one row a block for each document
    joined = flat.join(merged, row, "left").select(*(flat[c] for c in columns), found)

    def run_joined(batches):
        for batch in batches:
            for lo, hi in A.slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                texts = A.texts_of(part.column(at))
                spans, lists = texts.spans(A.ALNUM), part.column(len(columns))
                hit = np.zeros(len(spans.start), dtype=bool)
                for r in np.flatnonzero(np.asarray(lists.is_valid())).tolist():
                    hit[spans.first[r] + np.array(lists[r].as_py(), np.int64)] = True
                yield cut(part, texts, spans, hit)

    return A.small_batches(joined).mapInArrow(run_joined, docs.schema)
