"""Structured Streaming forms of the event operators (SURVEY 2.9: E7, E8, E14, E18, E19,
E22-E27, E30).

The same column logic as the batch operators runs on streaming DataFrames: windows and
sessions carry a watermark so state is bounded, duplicates are dropped within the
watermark, projections are folded per micro-batch into a versioned table (idempotent by
batch id, so a replayed batch after a failure rewrites the same version), and
per-key state machines keep their state in the state store with event-time timeouts.
"""

from __future__ import annotations

import os
import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A file source with a declared schema (the bus source has the same shape).

    With ``max_files_per_trigger`` files are taken by modification time, ties in any order: a
    watermark then needs each file to be written (as one) after those with earlier events."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP; wall-clock TIMESTAMP_NTZ columns are read in the session
    time zone (UTC here), which keeps the instant unchanged."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df


# ----------------------------------------------------------------------------- E22-E24
def tumbling_counts(stream: DataFrame, ts: str, keys: Sequence[str], window: str, watermark: str,
                    value: str | None = None) -> DataFrame:
    """Counts (and sum of ``value``) per fixed window and key; final rows are emitted
    once the watermark passes the window end (append mode)."""
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    g = event_time(stream, ts).withWatermark(ts, watermark).groupBy(F.window(ts, window).alias("w"), *keys).agg(*aggs)
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *[a for a in
                                                                                                         (["n"] + (["total"] if value else []))])


def sliding_counts(stream: DataFrame, ts: str, keys: Sequence[str], window: str, slide: str, watermark: str) -> DataFrame:
    """``[window]`` look-back evaluated every ``slide``."""
    g = event_time(stream, ts).withWatermark(ts, watermark).groupBy(F.window(ts, window, slide).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(stream: DataFrame, ts: str, key: str, gap: str, watermark: str) -> DataFrame:
    """Activity sessions (a session closes after ``gap`` of silence)."""
    g = event_time(stream, ts).withWatermark(ts, watermark).groupBy(F.session_window(ts, gap).alias("s"), key).agg(
        F.count(F.lit(1)).alias("events"), F.max(ts).alias("last_event"))
    return g.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events", "last_event")


def debounce_stream(stream: DataFrame, ts: str, key: str, event_id: str, quiet_seconds: float, watermark: str) -> DataFrame:
    """The last event of each burst, with all its columns: a session of the key closes after
    ``quiet`` of silence and carries its latest event (by time, then id) as its state. On a batch
    table the same rows come out as from ``folds.debounce`` with ``emitted``; on a stream a burst's
    event comes once the watermark has passed its quiet time."""
    # a pause of exactly ``quiet`` ends a burst, and sessions that touch are merged: the gap is one microsecond less
    gap = f"{round(quiet_seconds * 1_000_000) - 1} microseconds"
    s = event_time(stream, ts)
    event = F.struct(*[F.col(c) for c in s.columns])
    s = s.withColumn("__event", event).withWatermark(ts, watermark)
    g = s.groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.max_by("__event", F.struct(F.col(ts), F.col(event_id))).alias("e"))
    return g.select("e.*")


# ----------------------------------------------------------------------------- E14 / E25-E27
def dedupe_stream(stream: DataFrame, id_col: str, ts: str, watermark: str) -> DataFrame:
    """At-least-once delivery made idempotent: a repeated id inside the watermark is
    dropped; state for an id is released once the watermark passes it."""
    if not stream.isStreaming:  # batch: no state to bound, plain de-duplication
        return stream.dropDuplicates([id_col])
    return event_time(stream, ts).withWatermark(ts, watermark).dropDuplicatesWithinWatermark([id_col])


def dropped_late_rows(query) -> int:
    """Rows dropped behind the watermark so far (from the state operators' progress)."""
    total = 0
    for p in query.recentProgress:
        for op in p.get("stateOperators", []) if isinstance(p, dict) else (p.stateOperators or []):
            total += (op.get("numRowsDroppedByWatermark", 0) if isinstance(op, dict) else op.numRowsDroppedByWatermark)
    return total


def correlated_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str,
                    left_wm: str, right_wm: str, how: str = "inner") -> DataFrame:
    """Stream-stream join on a correlation id, bounded by a time range so both sides'
    state can be evicted by the watermarks."""
    l_ = event_time(left, left_ts).withWatermark(left_ts, left_wm).alias("l")
    r_ = event_time(right, right_ts).withWatermark(right_ts, right_wm).alias("r")
    cond = ((F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col(f"r.{right_ts}") >= F.col(f"l.{left_ts}"))
            & (F.col(f"r.{right_ts}") <= F.col(f"l.{left_ts}") + F.expr(f"INTERVAL {within}")))
    return l_.join(r_, cond, how)


def alerts(stream: DataFrame, condition) -> DataFrame:
    """Events that must alert immediately (a stateless filter; the sink decides how
    the alert is delivered)."""
    return stream.filter(condition)


# ----------------------------------------------------------------------------- E30
def route_batches(routes: dict[str, Callable[[DataFrame], DataFrame]], sinks: dict[str, str], dlq: str,
                  route_col: str = "route", fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: each route's rows to its own sink, rows with no or an
    unknown route (poison messages) to the dead-letter sink. Output folders are keyed by
    the batch id, so a replayed batch overwrites its own files (idempotent)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        tagged = batch.persist()
        try:
            for name, transform in routes.items():
                transform(tagged.filter(F.col(route_col) == name)).write.mode("overwrite").format(fmt).save(
                    os.path.join(sinks[name], f"batch={batch_id}"))
            bad = tagged.filter(F.col(route_col).isNull() | ~F.col(route_col).isin(list(routes)))
            bad.write.mode("overwrite").format(fmt).save(os.path.join(dlq, f"batch={batch_id}"))
        finally:
            tagged.unpersist()
    return write


# ----------------------------------------------------------------------------- E7 / E8
class VersionedTable:
    """A read model stored as numbered versions (``v=<batch id>``). A micro-batch reads
    the newest version below its own id, merges its delta and writes ``v=<batch id>``;
    replaying a batch rewrites the same version, and readers always take the newest
    complete one (a ``_SUCCESS`` marker is written last by Spark). Once a version is
    complete, all but the newest ``keep`` are dropped: the one before it is what a replay
    of the last batch reads."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path, keep

    def versions(self) -> list[int]:
        jvm = self.spark._jvm
        hpath = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = hpath.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(hpath):
            return []
        out = []
        for st in fs.listStatus(hpath):
            name = st.getPath().getName()
            if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                out.append(int(name[2:]))
        return sorted(out)

    def read(self, below: int | None = None) -> DataFrame | None:
        vs = [v for v in self.versions() if below is None or v < below]
        return self.spark.read.parquet(f"{self.path}/v={vs[-1]}") if vs else None

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        jvm = self.spark._jvm
        fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for old in [v for v in self.versions() if v <= version][:-self.keep]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={old}"), True)


def projection_writer(table: VersionedTable, fold: Callable[[DataFrame], DataFrame],
                      merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: fold the micro-batch's events into a delta projection and
    merge it into the previous version. The streaming checkpoint remembers the last
    committed batch, so a restart resumes exactly after it (E8 rebuild = new checkpoint
    and a new table path, replaying with ``availableNow``)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        delta = fold(batch)
        prev = table.read(below=batch_id)
        table.write(delta if prev is None else merge(prev, delta), batch_id)
    return write


def run_available_now(stream_df: DataFrame, checkpoint: str, foreach_batch: Callable[[DataFrame, int], None] | None = None,
                      sink: str = "memory", name: str | None = None, output_mode: str = "append"):
    """Run a streaming query over everything available and stop (tests, backfills)."""
    w = stream_df.writeStream.option("checkpointLocation", checkpoint).outputMode(output_mode).trigger(availableNow=True)
    if foreach_batch is not None:
        w = w.foreachBatch(foreach_batch)
    else:
        w = w.format(sink)
        if name:
            w = w.queryName(name)
    q = w.start()
    q.awaitTermination()
    return q


# ----------------------------------------------------------------------------- E18 / E19
SAGA_OUT = T.StructType([T.StructField("saga_id", T.LongType()), T.StructField("state", T.StringType()),
                         T.StructField("steps", T.IntegerType()), T.StructField("failed_step", T.IntegerType())])
SAGA_STATE = T.StructType([T.StructField("steps_json", T.StringType()), T.StructField("started_ms", T.LongType())])


def _saga_fn(timeout_ms: int):
    import json

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saga_id = int(key[0])
        if state.hasTimedOut:
            steps = json.loads(state.get[0]) if state.exists else {}
            running = [int(s) for s, v in steps.items() if v == "executing"]
            settled = any(v == "failed" for v in steps.values()) or all(v == "completed" for v in steps.values())
            state.remove()  # a settled saga that has been quiet for the timeout just ends
            if settled:
                return
            yield pd.DataFrame([{"saga_id": saga_id, "state": "compensating", "steps": len(steps),
                                 "failed_step": min(running) if running else None}])
            return
        steps = json.loads(state.get[0]) if state.exists else {}
        for pdf in pdfs:
            for rec in pdf.sort_values(["ts", "step_no"]).to_dict("records"):
                steps[str(int(rec["step_no"]))] = rec["status"]
        failed = sorted(int(s) for s, v in steps.items() if v == "failed")
        if failed:
            st = "compensating"
        elif steps and all(v == "completed" for v in steps.values()):
            st = "completed"
        else:
            st = "running"
        state.update((json.dumps(steps), 0))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + timeout_ms)
        yield pd.DataFrame([{"saga_id": saga_id, "state": st, "steps": len(steps), "failed_step": failed[0] if failed else None}])
    return fn


def saga_stream(steps: DataFrame, watermark: str = "10 minutes", timeout_seconds: int = 300) -> DataFrame:
    """Saga state per saga from a stream of step updates (saga_id, step_no,
    status, ts), kept in the state store; a saga that stays running for ``timeout``
    beyond the watermark times out and turns compensating; the state of a completed or
    compensating one is dropped after the same quiet time."""
    return (event_time(steps, "ts").withWatermark("ts", watermark).groupBy("saga_id")
            .applyInPandasWithState(_saga_fn(timeout_seconds * 1000), SAGA_OUT, SAGA_STATE, "append",
                                    GroupStateTimeout.EventTimeTimeout))


# ----------------------------------------------------------------------------- streaming folds
FOLD_STATE = T.StructType([T.StructField("blob", T.StringType())])


def fold_stream(stream: DataFrame, keys: Sequence[str], order: Sequence[str], fold, schema: T.StructType,
                watermark: tuple[str, str] | None = None, idle_seconds: int | None = None) -> DataFrame:
    """Any ``folds.Fold`` (breaker, rate limit, throttle, budget, hash chain) on a stream:
    per key, each micro-batch's rows are sorted by ``order`` and stepped through the fold,
    starting from the state left by the previous micro-batch (kept in the state store).
    A key's rows of one micro-batch may come in several Arrow chunks; they are sorted
    together, so a task holds one key's share of a micro-batch. Rows of one key must arrive
    in order across micro-batches (a bus partitioned by the key gives that). With a
    watermark and ``idle_seconds`` the state of a key ends once it has been quiet so long;
    without them it is kept."""
    import base64
    import pickle

    keys, order = list(keys), list(order)
    out_cols = [f.name for f in schema.fields]
    if idle_seconds is not None and watermark is None:
        raise ValueError("idle_seconds needs a watermark")

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        st = pickle.loads(base64.b64decode(state.get[0])) if state.exists else fold.init(tuple(key))
        rows = []
        for rec in pd.concat(list(pdfs)).sort_values(order, kind="stable").to_dict("records"):
            st, out = fold.step(st, rec)
            rows += out if isinstance(out, list) else [] if out is None else [out]
        state.update((base64.b64encode(pickle.dumps(st)).decode(),))
        if idle_seconds is not None:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + idle_seconds * 1000)
        if rows:
            yield pd.DataFrame(rows, columns=out_cols)

    s = stream
    if watermark is not None:
        s = event_time(s, watermark[0]).withWatermark(*watermark)
    timeout = GroupStateTimeout.EventTimeTimeout if idle_seconds is not None else GroupStateTimeout.NoTimeout
    return s.groupBy(*keys).applyInPandasWithState(fn, schema, FOLD_STATE, "append", timeout)


# ----------------------------------------------------------------------------- E25 / X4: in order
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_typed_state(spark: SparkSession) -> None:
    """List and value states with timers need the RocksDB state store: set it for the queries that the
    session starts from now on."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name, "") != _ROCKS:
        spark.conf.set(name, _ROCKS)


class _Reorder(StatefulProcessor):
    """Keeps a key's rows until the watermark has passed them, then steps them through a fold in order."""

    def __init__(self, ts: str, order: Sequence[str], fold, columns: Sequence[str]):
        self.ts, self.order, self.fold, self.columns = ts, list(order), fold, list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, row binary")
        self.folded = handle.getValueState("folded", "state binary")

    def handleInputRows(self, key, rows, timerValues):
        now, late, kept = timerValues.getCurrentWatermarkInMs(), [], []
        for pdf in rows:
            for rec in pdf.to_dict("records"):
                us = None if pd.isna(rec["event_us"]) else int(rec["event_us"])
                if us is None or us < now * 1000:
                    late.append({c: rec.get(c) for c in self.columns} | {"late": True})
                else:
                    kept.append((us, pickle.dumps(rec)))
        if kept:
            self.waiting.appendList(kept)
            self._wake(kept)
        yield pd.DataFrame(late, columns=[*self.columns, "late"])

    def _wake(self, rows) -> None:
        """One timer, at the earliest of the rows: it steps every row that the watermark has passed by then and
        sets the next one, so a key has no timer for each of its rows."""
        self.handle.registerTimer(min(r[0] for r in rows) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in held if r[0] < now]
        rest = [tuple(r) for r in held if r[0] >= now]
        out: list[dict] = []
        if rest:
            self._wake(rest)
        if ready:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            st = pickle.loads(bytes(self.folded.get()[0])) if self.folded.exists() else self.fold.init(tuple(key))
            frame = pd.DataFrame([pickle.loads(bytes(r[1])) for r in ready])
            for rec in frame.sort_values(["event_us", *self.order], kind="stable").to_dict("records"):
                st, got = self.fold.step(st, rec)
                out += got if isinstance(got, list) else [] if got is None else [got]
            self.folded.update((pickle.dumps(st),))
        frame = pd.DataFrame(out, columns=self.columns)
        frame["late"] = False
        yield frame

    def close(self) -> None:
        pass


def ordered_stream(stream: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], fold, schema: T.StructType, watermark: str) -> DataFrame:
    """Any ``folds.Fold`` over events that arrive out of order: the fold's rows (and ``late``).

    A row waits in the key's list state until the watermark (the latest event time less
    ``watermark``) has passed it; an event-time timer then steps the waiting rows through the fold by (event
    time, ``order``), so any arrival order within the watermark gives the batch fold's rows. A row that
    arrives behind the watermark, or without an event time, is not folded: it comes out at once with
    ``late`` true and those of the fold's columns that it has (``split_late`` sends it to a table of its own).
    State of a key: its rows of the last ``watermark`` and the fold's state."""
    use_typed_state(stream.sparkSession)
    us = F.unix_micros(F.col(ts))
    # the watermark's own column stays behind, so that late rows are not dropped before the processor sees them
    s = event_time(stream, ts).withWatermark(ts, watermark)
    s = s.select(*[F.col(c) for c in s.columns if c != ts], F.timestamp_micros(us).alias(ts), us.alias("event_us"))
    out = T.StructType([*schema.fields, T.StructField("late", T.BooleanType())])
    processor = _Reorder(ts, order, fold, [f.name for f in schema.fields])
    return s.groupBy(*keys).transformWithStateInPandas(processor, out, "Append", "EventTime")


def split_late(folded: str, late: str, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer for ``ordered_stream``: folded rows to one table, late ones to another; a
    replayed batch overwrites its own files."""
    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            for path, rows in ((folded, held.filter("not late")), (late, held.filter("late"))):
                rows.drop("late").write.mode("overwrite").format(fmt).save(f"{path}/batch={batch_id}")
        finally:
            held.unpersist()
    return write
