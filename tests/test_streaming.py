"""Streaming forms agree with the batch operators; late rows, duplicates, replays."""

import datetime as dt
import os

from conftest import SF, rows
from pyspark.sql import functions as F

from opsmill.operators import eventlog as EV
from opsmill.streaming import jobs as J

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _split_events(spark, d):
    e = spark.read.parquet(f"{SF}/events.parquet")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    e.filter(F.col("ts") < cut).write.mode("overwrite").parquet(os.path.join(d, "in", "part1"))
    e.filter(F.col("ts") >= cut).write.mode("overwrite").parquet(os.path.join(d, "in", "part2"))
    return e


def test_tumbling_counts_match_batch(spark, tmpdir_path):
    e = _split_events(spark, tmpdir_path)
    s = J.file_stream(spark, os.path.join(tmpdir_path, "in", "*"), EVENT_SCHEMA)
    counts = J.tumbling_counts(s, "ts", ["event_type"], "1 day", "1 day")
    J.run_available_now(counts, os.path.join(tmpdir_path, "ck"), name="daily_counts")
    got = spark.sql("SELECT * FROM daily_counts")
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    batch = e.groupBy(w.start.alias("window_start"), w.end.alias("window_end"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    # append mode emits exactly the windows that end at or before the watermark (max event time - 1 day)
    wm = e.select(F.max(F.col("ts").cast("timestamp")) - F.expr("INTERVAL 1 DAY")).first()[0]
    expected = batch.filter(F.col("window_end") <= F.lit(wm))
    assert expected.count() > 0
    assert rows(got, "window_start", "event_type", "n") == rows(expected, "window_start", "event_type", "n")


def test_late_and_duplicate_events(spark, tmpdir_path):
    schema = "event_id long, ts timestamp_ntz"
    base = dt.datetime(2024, 1, 10, 12, 0, 0)
    first = [(1, base), (2, base + dt.timedelta(hours=5))]
    second = [(2, base + dt.timedelta(hours=5)),            # duplicate delivery
              (3, base - dt.timedelta(hours=3)),            # behind the 1-hour watermark
              (4, base + dt.timedelta(hours=6))]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(os.path.join(tmpdir_path, "in", "a"))
    s = J.file_stream(spark, os.path.join(tmpdir_path, "in", "*"), schema, max_files_per_trigger=1)
    out = J.dedupe_stream(s, "event_id", "ts", "1 hour")
    q = (out.writeStream.format("memory").queryName("dedup_out").option("checkpointLocation", os.path.join(tmpdir_path, "ck"))
         .outputMode("append").start())
    q.processAllAvailable()
    spark.createDataFrame(second, schema).coalesce(1).write.parquet(os.path.join(tmpdir_path, "in", "b"))
    q.processAllAvailable()
    q.stop()
    ids = sorted(r[0] for r in spark.sql("SELECT event_id FROM dedup_out").collect())
    assert ids == [1, 2, 4]
    assert J.dropped_late_rows(q) >= 1


def test_projection_rebuild_equals_incremental(spark, tmpdir_path):
    _split_events(spark, tmpdir_path)
    handlers = {"purchase": {"orders": F.lit(1), "spent": F.col("value")}, "signup": {"signups": F.lit(1)}}

    def fold(b):
        return EV.projection_fold(b, "user_id", handlers)

    def merge(prev, delta):
        return EV.incremental_merge(prev.withColumn("last_event_version", F.lit(0)), delta.withColumn("last_event_version", F.lit(0)),
                                    "user_id", ["orders", "spent", "signups", "events_applied"]).drop("last_event_version")

    table = J.VersionedTable(spark, os.path.join(tmpdir_path, "proj"))
    s = J.file_stream(spark, os.path.join(tmpdir_path, "in", "*"), EVENT_SCHEMA, max_files_per_trigger=1)
    J.run_available_now(s, os.path.join(tmpdir_path, "ck"), J.projection_writer(table, fold, merge))
    assert len(table.versions()) >= 2  # one version per micro-batch
    inc = table.read()
    full = fold(spark.read.parquet(f"{SF}/events.parquet"))
    cols = ["user_id", "orders", "signups", "events_applied"]
    assert rows(inc, *cols) == rows(full, *cols)
    a = {r["user_id"]: r["spent"] for r in inc.collect()}
    b = {r["user_id"]: r["spent"] for r in full.collect()}
    assert all(abs(a[k] - b[k]) < 1e-6 for k in b)


def test_saga_stream_timeout(spark, tmpdir_path):
    schema = "saga_id long, step_no int, status string, ts timestamp_ntz"
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    data = [(1, 1, "completed", t0), (1, 2, "completed", t0 + dt.timedelta(minutes=1)),
            (2, 1, "completed", t0), (2, 2, "failed", t0 + dt.timedelta(minutes=1)),
            (3, 1, "executing", t0),
            (9, 1, "completed", t0 + dt.timedelta(hours=2))]  # moves the watermark past saga 3's timeout
    spark.createDataFrame(data[:5], schema).write.parquet(os.path.join(tmpdir_path, "in", "a"))
    s = J.file_stream(spark, os.path.join(tmpdir_path, "in", "*"), schema)
    out = J.saga_stream(s, watermark="1 minute", timeout_seconds=300)
    q = (out.writeStream.format("memory").queryName("sagas").option("checkpointLocation", os.path.join(tmpdir_path, "ck"))
         .outputMode("append").start())
    q.processAllAvailable()
    spark.createDataFrame(data[5:], schema).write.parquet(os.path.join(tmpdir_path, "in", "b"))
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    res = spark.sql("SELECT saga_id, state FROM sagas").collect()
    last = {}
    for r in res:
        last.setdefault(r["saga_id"], []).append(r["state"])
    assert "completed" in last[1] and "compensating" in last[2]
    assert "compensating" in last[3]  # timed out while executing


def test_route_batches_dead_letter(spark, tmpdir_path):
    schema = "id long, route string, ts timestamp_ntz"
    now = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, "orders", now), (2, "billing", now), (3, None, now), (4, "bogus", now)], schema).write.parquet(
        os.path.join(tmpdir_path, "in", "a"))
    s = J.file_stream(spark, os.path.join(tmpdir_path, "in", "*"), schema)
    sinks = {"orders": os.path.join(tmpdir_path, "orders"), "billing": os.path.join(tmpdir_path, "billing")}
    writer = J.route_batches({"orders": lambda d: d, "billing": lambda d: d}, sinks, os.path.join(tmpdir_path, "dlq"))
    J.run_available_now(s, os.path.join(tmpdir_path, "ck"), writer)
    assert sorted(r["id"] for r in spark.read.parquet(os.path.join(tmpdir_path, "dlq")).collect()) == [3, 4]
    assert [r["id"] for r in spark.read.parquet(sinks["orders"]).collect()] == [1]


def test_breaker_fold_stream_equals_batch(spark, tmpdir_path):
    from opsmill.operators import folds

    e = spark.read.parquet(f"{SF}/events.parquet").select((F.col("user_id") % 4).alias("service"), "ts", "event_id",
                                                         (F.col("event_type") != "error").alias("ok"))
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    e.filter(F.col("ts") < cut).write.parquet(os.path.join(tmpdir_path, "in", "a"))
    e.filter(F.col("ts") >= cut).write.parquet(os.path.join(tmpdir_path, "in", "b"))
    schema = "service long, ts timestamp_ntz, event_id long, ok boolean"
    fold = folds.CircuitBreaker("ts", "ok", ["service", "event_id"], failure_threshold=3, timeout=3600.0)
    from pyspark.sql import types as T
    out_schema = T.StructType([T.StructField("service", T.LongType()), T.StructField("event_id", T.LongType()),
                               T.StructField("state", T.StringType()), T.StructField("allowed", T.BooleanType())])
    s = J.file_stream(spark, os.path.join(tmpdir_path, "in", "*"), schema, max_files_per_trigger=1)
    out = J.fold_stream(s, ["service"], ["ts", "event_id"], fold, out_schema)
    q = (out.writeStream.format("memory").queryName("breaker_stream").option("checkpointLocation", os.path.join(tmpdir_path, "ck"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.sql("SELECT * FROM breaker_stream")
    batch = folds.circuit_breaker(e, "service", "ts", "event_id", "ok", failure_threshold=3, timeout_seconds=3600.0)
    assert rows(got, "event_id", "state", "allowed") == rows(batch, "event_id", "state", "allowed")


def _shuffled_files(spark, rows, schema, folder, jitter, seed):
    """Rows in four files by a jittered time: within a file and across neighbours they are out of order."""
    import random
    rng = random.Random(seed)
    order = sorted(rows, key=lambda r: r[0] + dt.timedelta(seconds=rng.uniform(0, jitter)))
    size = (len(order) + 3) // 4
    for k in range(4):
        part = order[k * size:(k + 1) * size]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(os.path.join(folder, f"f{k}"))


def test_out_of_order_rows_are_folded_in_order(spark, tmpdir_path):
    from pyspark.sql import types as T

    from opsmill.operators import folds

    e = spark.read.parquet(f"{SF}/events.parquet").select("ts", (F.col("user_id") % 4).alias("service"), "event_id", (F.col("event_type") != "error").alias("ok"))
    data = [tuple(r) for r in e.collect()]
    last = max(r[0] for r in data)
    schema = "ts timestamp_ntz, service long, event_id long, ok boolean"
    _shuffled_files(spark, data, schema, os.path.join(tmpdir_path, "in"), 86400, 1)
    fold = folds.CircuitBreaker("ts", "ok", ["service", "event_id"], failure_threshold=3, timeout=3600.0)
    out_schema = T.StructType([T.StructField("service", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("state", T.StringType()), T.StructField("allowed", T.BooleanType())])
    s = J.file_stream(spark, os.path.join(tmpdir_path, "in", "*"), schema, max_files_per_trigger=1)
    out = J.ordered_stream(s, ["service"], "ts", ["event_id"], fold, out_schema, "15 days")
    folded, late = os.path.join(tmpdir_path, "folded"), os.path.join(tmpdir_path, "late")
    q = out.writeStream.option("checkpointLocation", os.path.join(tmpdir_path, "ck")).foreachBatch(J.split_late(folded, late)).outputMode("append").start()
    q.processAllAvailable()
    # the first row moves the watermark past all others; then one row behind it
    for k, extra in enumerate([[(last + dt.timedelta(days=40), 99, -1, True)], [(last, 2, -2, True), (None, 2, -3, True)]]):
        spark.createDataFrame(extra, schema).coalesce(1).write.parquet(os.path.join(tmpdir_path, "in", f"x{k}"))
        q.processAllAvailable()
    q.stop()
    batch = folds.circuit_breaker(e, "service", "ts", "event_id", "ok", failure_threshold=3, timeout_seconds=3600.0)
    got = spark.read.parquet(folded)
    assert rows(got, "event_id", "state", "allowed") == rows(batch, "event_id", "state", "allowed")
    assert sorted(r["event_id"] for r in spark.read.parquet(late).collect()) == [-3, -2]


def test_a_key_has_one_timer_for_its_waiting_rows():
    import pandas as pd

    from opsmill.operators import folds

    class State:
        def __init__(self):
            self.rows = []

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows) if isinstance(self.rows, list) else self.rows

        def put(self, rows):
            self.rows = list(rows)

        def appendList(self, rows):
            self.rows += rows

        def clear(self):
            self.rows = []

        def update(self, row):
            self.rows = row

    class Handle:
        def __init__(self):
            self.timers, self.calls = set(), 0

        def getListState(self, *_):
            return State()

        def getValueState(self, *_):
            return State()

        def registerTimer(self, ms):
            self.calls += 1
            self.timers.add(ms)

    class Times:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    base = dt.datetime(2024, 1, 1)
    p, h = J._Reorder("ts", ["event_id"], folds.ThrottleFirst("ts", ["user_id", "event_id"], 60.0), ["user_id", "event_id", "emitted"]), Handle()
    p.init(h)
    us = [1_000_000 * i for i in range(200, 0, -1)]
    frame = pd.DataFrame({"user_id": 1, "event_id": range(200), "ts": [base + dt.timedelta(microseconds=u) for u in us], "event_us": us})
    list(p.handleInputRows((1,), iter([frame]), Times(0)))
    assert h.timers == {1001} and h.calls == 1
    got = []
    for now in (50_000, 150_000, 300_000):
        for _ in sorted(t for t in h.timers if t <= now):
            got += pd.concat(list(p.handleExpiredTimer((1,), Times(now), None)))["event_id"].tolist()
        h.timers = {t for t in h.timers if t > now}
        assert len(h.timers) <= 1
    assert got == list(range(199, -1, -1)) and not h.timers


def test_debounced_stream_equals_batch(spark, tmpdir_path):
    from opsmill.operators import folds

    base = dt.datetime(2024, 1, 1)
    data = [(base + dt.timedelta(seconds=t), k, i) for i, (k, t) in enumerate([(1, 0), (1, 5), (1, 15), (1, 15), (1, 24), (2, 3), (2, 100), (1, 34), (1, 43.999999), (2, 109), (2, 119)])]
    schema = "ts timestamp_ntz, key long, event_id long"
    batch = folds.debounce(spark.createDataFrame(data, schema), "key", "ts", "event_id", 10.0).filter("emitted")
    direct = J.debounce_stream(spark.createDataFrame(data, schema), "ts", "key", "event_id", 10.0, "1 minute")
    assert rows(direct, "key", "event_id") == rows(batch, "key", "event_id")
    _shuffled_files(spark, data, schema, os.path.join(tmpdir_path, "in"), 30, 2)
    spark.createDataFrame([(base + dt.timedelta(days=1), 9, 99)], schema).coalesce(1).write.parquet(os.path.join(tmpdir_path, "in", "z"))
    s = J.file_stream(spark, os.path.join(tmpdir_path, "in", "*"), schema, max_files_per_trigger=1)
    J.run_available_now(J.debounce_stream(s, "ts", "key", "event_id", 10.0, "2 minutes"), os.path.join(tmpdir_path, "ck"), name="debounced")
    assert rows(spark.sql("SELECT * FROM debounced"), "key", "event_id") == rows(batch, "key", "event_id")
