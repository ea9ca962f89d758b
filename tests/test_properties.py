"""Property tests: identities that must hold for any input."""

from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opsmill.operators import relational as rel

keys = st.lists(st.tuples(st.integers(0, 30), st.integers(-5, 5)), min_size=0, max_size=40)


@settings(max_examples=6, deadline=None)
@given(keys)
def test_dedupe_idempotent_and_first_wins(spark, data):
    df = spark.createDataFrame(data or [(0, 0)], "k int, v int")
    once = rel.first_wins(df.withColumn("o", F.col("v")), ["k"], "o")
    twice = rel.first_wins(once, ["k"], "o")
    assert rows(once) == rows(twice)
    assert rows(once, "k", "v") == sorted({k: min(v for kk, v in (data or [(0, 0)]) if kk == k) for k, _ in (data or [(0, 0)])}.items())


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=60, unique=True), st.integers(1, 7))
def test_ordered_batches_are_consecutive(spark, ids, size):
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    out = {r["id"]: (r["position"], r["batch_no"]) for r in rel.ordered_batches(df, ["id"], size).collect()}
    for pos, i in enumerate(sorted(ids), start=1):
        assert out[i] == (pos, (pos - 1) // size)


@settings(max_examples=6, deadline=None)
@given(keys, keys)
def test_upsert_identities(spark, a, b):
    t = spark.createDataFrame(list({k: v for k, v in a}.items()) or [(0, 0)], "k int, v int")
    s = spark.createDataFrame(list({k: v for k, v in b}.items()) or [(0, 1)], "k int, v int")
    up = dict(rows(rel.upsert(t, s, "k")))
    expect = dict(rows(t)) | dict(rows(s))
    assert up == expect
    keep = dict(rows(rel.upsert(t, s, "k", do_nothing=True)))
    assert keep == dict(rows(s)) | dict(rows(t))


def test_closure_matches_python(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {(r["src"], r["dst"]): r["depth"] for r in rel.closure(df).collect()}
    # breadth-first shortest hop counts
    adj = {}
    for a, b in edges:
        adj.setdefault(a, []).append(b)
    want = {}
    for s0 in {a for a, _ in edges}:
        frontier, d, seen = [s0], 0, {}
        while frontier:
            d += 1
            nxt = []
            for n in frontier:
                for m in adj.get(n, []):
                    if (s0, m) not in want:
                        want[(s0, m)] = d
                        nxt.append(m)
            frontier = nxt
    assert got == want


def test_bucketed_as_of_join_equals_unbucketed(spark):
    import os
    from conftest import SF
    e = spark.read.parquet(os.path.join(SF, "events.parquet"))
    probes = e.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    views = e.filter(F.col("event_type") == "view").select("user_id", F.col("ts").alias("vts"), F.col("value").alias("v"))
    a = rel.as_of_join(probes, views, "user_id", "ts", "vts", ["v"])
    b = rel.as_of_join(probes, views, "user_id", "ts", "vts", ["v"], bucket_seconds=3 * 3600)
    assert rows(a, "event_id", "v") == rows(b, "event_id", "v")
    assert a.filter(F.col("v").isNotNull()).count() > 0


def test_bucketed_interval_conflicts_equal_unbucketed(spark):
    import os
    from conftest import SF
    li = spark.read.parquet(os.path.join(SF, "lineitem.parquet"))
    b = li.select(F.col("l_suppkey").alias("room"), F.col("l_orderkey").alias("bid"), F.col("l_linenumber").alias("ln"),
                  F.col("l_shipdate").cast("date").alias("s"), F.date_add(F.col("l_shipdate").cast("date"), F.col("l_quantity").cast("int")).alias("e"))
    x = rel.interval_conflicts(b, "room", "s", "e", ["bid", "ln"])
    y = rel.interval_conflicts(b, "room", "s", "e", ["bid", "ln"], bucket_days=30)
    assert rows(x, "room", "bid", "ln", "conflict") == rows(y, "room", "bid", "ln", "conflict")


def test_bucketed_islands_equal_unbucketed(spark):
    import os
    from conftest import SF
    e = spark.read.parquet(os.path.join(SF, "events.parquet")).withColumn("svc", F.col("user_id") % 3)
    cond = F.col("event_type").isin("error", "click")
    a = rel.islands(e, "svc", "ts", cond, tie="event_id")
    for width in (3600, 6 * 3600, 86400):
        b = rel.islands(e, "svc", "ts", cond, tie="event_id", bucket_seconds=width)
        assert rows(a, "svc", "start_ts", "end_ts", "n_rows") == rows(b, "svc", "start_ts", "end_ts", "n_rows")


def test_bucketed_counter_increase_equals_unbucketed(spark):
    import os
    from conftest import SF
    from opsmill.operators import metrics as M
    e = spark.read.parquet(os.path.join(SF, "events.parquet")).select((F.col("user_id") % 3).alias("svc"), "ts", "event_id",
                                                                    (F.col("event_id") % 37).alias("counter"))
    a = M.counter_increase(e, ["svc"], "ts", "counter", tie="event_id")
    for width in (1800, 86400):
        b = M.counter_increase(e, ["svc"], "ts", "counter", tie="event_id", bucket_seconds=width)
        assert rows(a, "event_id", "increase") == rows(b, "event_id", "increase")


def test_bucketed_scd_type2_equals_unbucketed(spark):
    import os
    from conftest import SF
    e = spark.read.parquet(os.path.join(SF, "events.parquet")).select((F.col("user_id") % 3).alias("k"), "ts", "event_id", "event_type")
    a = rel.scd_type2(e, "k", ["ts", "event_id"], ["event_type"])
    for width in (3600, 86400):
        b = rel.scd_type2(e, "k", ["ts", "event_id"], ["event_type"], bucket_seconds=width)
        assert rows(a, "k", "event_id", "valid_to", "is_current") == rows(b, "k", "event_id", "valid_to", "is_current")


def test_late_events_equal_global_window(spark):
    import os
    from conftest import SF
    from pyspark.sql import Window
    from opsmill.operators import eventlog as EV
    e = spark.read.parquet(os.path.join(SF, "events.parquet")).select(
        "event_id", "ts", ((F.col("user_id") % 4) * 1000000000 + F.col("event_id")).alias("arrival"))
    got = EV.late_events(e, "arrival", "ts", 3600)
    w = Window.orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)   # reference only: one partition
    ref = e.withColumn("seen", F.max(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)).withColumn(
        "late", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) < F.col("seen") - 3600 * 1000000, F.lit(False)))
    assert rows(got, "event_id", "late") == rows(ref, "event_id", "late")
    assert got.filter("late").count() > 0


def test_quantiles_are_exact_beyond_ten_thousand_values(spark):
    values = {"a": [(i * 7919) % 60_013 / 7 for i in range(60_000)], None: [float(i // 3) for i in range(1000)], "none": []}
    data = [(k, v) for k, vs in values.items() for v in vs] + [("none", None)] * 3 + [("a", None)] * 500
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    qs = [0.01, 0.2, 0.5, 0.77, 0.99]
    got = {r["k"]: list(r)[1:] for r in rel.percentiles(df, ["k"], "v", qs).collect()}
    want = {k: [sorted(vs)[-(-round(100 * q) * len(vs) // 100) - 1] if vs else None for q in qs] for k, vs in values.items()}
    assert got == want
    assert rel.percentiles(df.limit(0), ["k"], "v", qs).count() == 0
