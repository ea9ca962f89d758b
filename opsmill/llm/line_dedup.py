"""Operator 5: line dedup by site-relative frequency.

Rows are grouped by host. For each line (without white space at its ends) the pages of the
host that contain it are counted, once a page, and divided by the host's pages. Lines on
more than ``ratio`` of them, and on at least ``least_pages``, are boilerplate of that host
and are dropped from its pages, all of them, however much of a page that is. Exact copies of a page
(within a host) count as one page, in both numbers, so a group of copies does not lift its own lines
over the ratio; near copies are separate pages (finding them is another operator's matter). Counts
cover all rows; equal lines of a slice are summed before the shuffle, each with the weight 1 / copies
of its page, so a host or a line that holds a third of all rows is only a few partial sums for
each task. Lines travel as 64-bit hashes with their length.

At most 1 / ratio times the mean lines a page are boilerplate on a host, so the table of
one host is bounded by its page length. The table of all hosts is broadcast only when its
counted size is under ``broadcast_lines``; beyond it, each host's lines join its pages.

Defined results: null and empty texts pass unchanged but count as a page (one a host); rows with a
null host form one host of their own; blank lines are never counted or dropped; repeated rows
count as one page and each come out; a page of boilerplate alone has an empty text; other columns pass unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmill.llm import arrays as A
from opsmill.session import bounded

RATIO, LEAST_PAGES = 0.1, 3
BROADCAST_LINES = 500_000
BROADCAST_COPIED = 500_000


class Lines:
    """The non-blank lines of a slice: their trimmed bounds, hashes and lengths."""

    def __init__(self, texts: A.Texts):
        spans = texts.spans(A.NOT_NEWLINE)
        inside = A.NON_SPACE[texts.data]
        count = A.sums(inside)
        real = np.flatnonzero(count[spans.end] > count[spans.start])
        where = np.flatnonzero(inside)
        self.whole_start, self.whole_end, self.row = spans.start[real], spans.end[real], spans.row[real]
        spans.start, spans.end = where[count[self.whole_start]], where[count[self.whole_end] - 1] + 1
        self.hash = spans.hashes().view(np.int64)
        self.size = spans.end - spans.start


def pages_of(docs: DataFrame, host: str, text: str, broadcast_copied: int = BROADCAST_COPIED) -> DataFrame:
    """(host, text, copies): every row with the number of rows of its host that have its text.

    Only texts that occur more than once join; they travel as a hash and a count."""
    rows = docs.select(F.col(host).cast("string").alias("host"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.unhex(F.md5("text")))
    copied = rows.groupBy(F.col("host").alias("c_host"), F.col("mark").alias("c_mark")).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").checkpoint()
    return (rows.join(bounded(copied, broadcast_copied), F.col("host").eqNullSafe(F.col("c_host")) & (F.col("mark") == F.col("c_mark")), "left")
            .select("host", "text", F.coalesce("copies", F.lit(1)).cast("long").alias("copies")))


def line_counts(pages: DataFrame) -> DataFrame:
    """(host, line, size, pages): different pages of the host that contain the line."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in A.slices(batch.column(1)):
                lines = Lines(A.texts_of(batch.column(1).slice(lo, hi - lo)))
                hosts = batch.column(0).slice(lo, hi - lo).dictionary_encode()
                code = np.asarray(hosts.indices.fill_null(-1), np.int64)[lines.row]
                weight = 1.0 / np.asarray(batch.column(2).slice(lo, hi - lo), np.int64)[lines.row]
                _, once = np.unique(A.keyed(lines.hash.view(np.uint64), lines.row), return_index=True)  # once a page
                _, first, group = np.unique(A.keyed(lines.hash.view(np.uint64)[once], code[once] + 1), return_index=True, return_inverse=True)
                own = once[first]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(lines.row[own])), pa.array(lines.hash[own]), pa.array(lines.size[own]),
                     pa.array(np.bincount(group, weights=weight[once], minlength=len(own)))], names=["host", "line", "size", "pages"])

    return (A.small_batches(pages).mapInArrow(run, "host string, line long, size long, pages double")
            .groupBy("host", "line", "size").agg(F.round(F.sum("pages")).cast("long").alias("pages")))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, line, size, pages, host_pages): the lines of each host over the ratio."""
    pages = pages_of(docs, host, text)
    totals = pages.groupBy(F.col("host").alias("host_")).agg(F.round(F.sum(1.0 / F.col("copies"))).cast("long").alias("host_pages"))
    often = line_counts(pages).filter(F.col("pages") >= least_pages)
    return (often.join(totals, F.col("host").eqNullSafe(F.col("host_")))
            .filter(F.col("pages") > F.lit(float(ratio)) * F.col("host_pages")).drop("host_"))


def _clean(part: pa.RecordBatch, at: int, dropped_in) -> tuple[pa.Array, np.ndarray]:
    """The text column without dropped lines, and the lines dropped of each row."""
    texts = A.texts_of(part.column(at))
    lines = Lines(texts)
    drop = dropped_in(lines)
    n = np.bincount(lines.row[drop], minlength=texts.n)
    if not drop.any():
        return part.column(at), n
    # a dropped line goes with the line break after it (before it, for a last line)
    rows = np.flatnonzero(n)
    column = part.column(at).to_pylist()
    bad = np.flatnonzero(drop)
    cuts = np.split(bad, np.flatnonzero(np.diff(lines.row[bad])) + 1)
    for r, own in zip(rows.tolist(), cuts, strict=True):
        raw, base = texts.row(r), int(texts.at[r])
        starts = set((lines.whole_start[own] - base).tolist())
        kept, place = [], 0
        for piece in raw.split(b"\n"):
            if place not in starts or not piece:
                kept.append(piece)
            place += len(piece) + 1
        column[r] = b"\n".join(kept).decode()
    return pa.array(column, part.column(at).type), n


def drop_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES,
               broadcast_lines: int = BROADCAST_LINES, count_as: str | None = None) -> DataFrame:
    """``docs`` with boilerplate lines removed; ``count_as`` adds the number of lines dropped."""
    bad = boilerplate(docs, host, text, ratio, least_pages).select("host", "line", "size").checkpoint()
    columns, at, host_at = docs.columns, docs.columns.index(text), docs.columns.index(host)
    schema = docs.schema if count_as is None else docs.select("*", F.lit(0).cast("long").alias(count_as)).schema

    def rebuilt(part: pa.RecordBatch, dropped_in) -> pa.RecordBatch:
        cleaned, n = _clean(part, at, dropped_in)
        arrays = part.columns[:len(columns)]
        arrays[at] = cleaned
        return pa.RecordBatch.from_arrays(arrays + ([pa.array(n.astype(np.int64))] if count_as else []), names=schema.names)

    if bad.count() <= broadcast_lines:  # the size is measured; see below for the other way
        table: dict = {}
        for r in bad.collect():
            table.setdefault(r["host"], []).append(r["line"])
        shared = docs.sparkSession.sparkContext.broadcast({h: np.sort(np.array(v, np.int64)) for h, v in table.items()})

        def run(batches):
            known = shared.value
            for batch in batches:
                for lo, hi in A.slices(batch.column(at)):
                    part = batch.slice(lo, hi - lo)
                    hosts = part.column(host_at).cast(pa.string()).to_pylist()

                    def dropped_in(lines, hosts=hosts):
                        drop = np.zeros(len(lines.row), bool)
                        first = np.searchsorted(lines.row, np.arange(len(hosts) + 1))
                        for h in set(hosts) & known.keys():
                            rows = np.array([i for i, x in enumerate(hosts) if x == h])
                            own = A.expand(first[rows], first[rows + 1] - first[rows])
                            drop[own] = np.isin(lines.hash[own], known[h])
                        return drop

                    yield rebuilt(part, dropped_in)

        return A.small_batches(docs).mapInArrow(run, schema)

    flag = "__bad"
    while flag in columns:
        flag += "_"
    hosts = bad.groupBy(F.col("host").alias("__host")).agg(F.collect_list("line").alias(flag))  # bounded by page length / ratio
    joined = docs.join(hosts, docs[host].cast("string").eqNullSafe(F.col("__host")), "left").drop("__host")

    def run_joined(batches):
        for batch in batches:
            for lo, hi in A.slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                lists = part.column(len(columns))

                def dropped_in(lines, lists=lists):
                    first = np.searchsorted(lines.row, np.arange(len(lists) + 1))
                    return np.concatenate([np.zeros(0, bool)] + [np.isin(lines.hash[a:b], np.array(x.as_py() or [], np.int64))
                                                                 for a, b, x in zip(first, first[1:], lists, strict=False)])

                yield rebuilt(part, dropped_in)

    return A.small_batches(joined).mapInArrow(run_joined, schema)
