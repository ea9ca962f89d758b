"""Literal cases from FIXTURES.md section 3: the places where a literal translation of
the samples would give other rows (SURVEY 2.18)."""

import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from opsmill.functions import dates as D
from opsmill.functions import structured as S
from opsmill.functions import text as T
from opsmill.operators import delivery as DL
from opsmill.operators import eventlog as EV
from opsmill.operators import folds
from opsmill.operators import quality as Q
from opsmill.operators import risk as R

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def ts(sec):
    return T0 + dt.timedelta(seconds=sec)


def test_budget_skips_then_takes_smaller(spark):
    items = spark.createDataFrame([(1, "a", 0.9, 5.0, 8.0), (1, "b", 0.8, 7.0, 8.0), (1, "c", 0.7, 3.0, 8.0)],
                                  "plan long, item string, value double, cost double, budget double")
    out = folds.greedy_budget(items, "plan", "item", "value", "cost", "budget")
    assert rows(out, "item", "selected") == [("a", True), ("b", False), ("c", True)]


def test_rate_limit_rejected_calls_not_recorded(spark):
    calls = spark.createDataFrame([("s", ts(0.0), 1), ("s", ts(0.1), 2), ("s", ts(0.2), 3), ("s", ts(1.05), 4)],
                                  "svc string, t timestamp_ntz, id long")
    out = folds.sliding_rate_limit(calls, "svc", "t", "id", max_rps=2, window_seconds=1.0)
    assert rows(out, "id", "accepted") == [(1, True), (2, True), (3, False), (4, True)]


def test_throttle_from_last_emitted(spark):
    ev = spark.createDataFrame([("k", ts(0.0), 1), ("k", ts(0.06), 2), ("k", ts(0.12), 3), ("k", ts(0.2), 4)],
                               "key string, t timestamp_ntz, id long")
    out = folds.throttle_first(ev, "key", "t", "id", 0.1)
    # a fixed 100 ms bucket would emit ids 1, 3; the rule "100 ms since the last emitted" emits 1, 3 only when 3 - 1 >= 0.1
    assert rows(out, "id", "emitted") == [(1, True), (2, False), (3, True), (4, False)]


def test_breaker_variants_differ(spark):
    seq = [False] * 5 + [True, False]
    times = [0, 1, 2, 3, 4, 65, 66]
    calls = spark.createDataFrame([("svc", ts(t), i, ok) for i, (t, ok) in enumerate(zip(times, seq))],
                                  "svc string, t timestamp_ntz, id long, ok boolean")
    counting = dict(rows(folds.circuit_breaker(calls, "svc", "t", "id", "ok", "counting"), "id", "state"))
    strict = dict(rows(folds.circuit_breaker(calls, "svc", "t", "id", "ok", "strict"), "id", "state"))
    assert counting[5] == "half_open" and strict[5] == "half_open"
    # counting: the half-open success zeroed the count, one failure does not reopen
    later = spark.createDataFrame([("svc", ts(67), 7, True)], "svc string, t timestamp_ntz, id long, ok boolean")
    c2 = dict(rows(folds.circuit_breaker(calls.unionByName(later), "svc", "t", "id", "ok", "counting"), "id", "state"))
    s2 = dict(rows(folds.circuit_breaker(calls.unionByName(later), "svc", "t", "id", "ok", "strict"), "id", "state"))
    assert c2[7] == "half_open"  # still half-open, no reopen
    assert s2[7] == "open"       # strict: the half-open failure reopened the circuit


def test_hash_chain_verification_detects_tamper(spark):
    log = spark.createDataFrame([("s", 1, "login", 1.5), ("s", 2, "view", 2.0), ("s", 3, "logout", 0.5)],
                                "stream string, pos long, event_type string, value double")
    chain = folds.hash_chain(log, "stream", ["pos"], ["event_type", "value"], "k")
    chained = chain.join(log, ["stream", "pos"])
    content = F.format_string('{"event_type": "%s", "value": %s}', "event_type", F.col("value").cast("string"))
    ok = folds.verify_chain(chained, "stream", ["pos"], content, "k")
    assert all(r["valid"] for r in ok.collect())
    tampered = chained.withColumn("value", F.when(F.col("pos") == 2, F.lit(9.0)).otherwise(F.col("value")))
    bad = folds.verify_chain(tampered, "stream", ["pos"], F.format_string('{"event_type": "%s", "value": %s}', "event_type",
                                                                           F.col("value").cast("string")), "k")
    assert [r["pos"] for r in bad.filter("NOT valid").collect()] == [2]


def test_order_projection_and_orphans(spark):
    ev = spark.createDataFrame([
        (1, "OrderCreated", 0.0, ts(0), 1), (1, "OrderItemAdded", 20.0, ts(1), 2), (1, "OrderItemAdded", 20.0, ts(2), 3),
        (1, "OrderItemRemoved", 10.0, ts(3), 4), (1, "OrderShipped", 0.0, ts(4), 5), (1, "OrderCompleted", 0.0, ts(5), 6),
        (2, "OrderCreated", 0.0, ts(0), 1), (2, "OrderCancelled", 0.0, ts(9), 2),
        (3, "OrderItemAdded", 5.0, ts(1), 1)], "o_orderkey long, event_type string, amount double, event_time timestamp_ntz, version long")
    out, orphans = EV.order_summary_projection(ev)
    got = {r["o_orderkey"]: r for r in out.collect()}
    assert set(got) == {1, 2}
    assert (got[1]["status"], got[1]["total_amount"], got[1]["item_count"]) == ("completed", 30.0, 1)
    assert got[2]["status"] == "cancelled" and got[2]["cancelled_at"] == ts(9)
    assert [r["o_orderkey"] for r in orphans.collect()] == [3]


def test_daily_sales_refund_without_sale_dropped(spark):
    comp = spark.createDataFrame([(ts(0), 100.0, 2)], "completed_at timestamp_ntz, total_amount double, item_count long")
    refunds = spark.createDataFrame([(ts(0), 30.0), (ts(5 * 86400), 10.0)], "original_completed_at timestamp_ntz, refund_amount double")
    out, dropped = EV.daily_sales_projection(comp, refunds)
    r = out.collect()
    assert len(r) == 1 and (r[0]["total_orders"], r[0]["total_revenue"], r[0]["total_refunds"]) == (0, 70.0, 30.0)
    assert dropped.count() == 1


def test_category_trap_compat_mode(spark):
    df = spark.createDataFrame([("package.json",), ("a.test.js",), ("README.md",), ("Dockerfile",)], "f string")
    assert rows(df.select("f", T.categorize_file("f").alias("c")), "f", "c") == [
        ("Dockerfile", "build"), ("README.md", "docs"), ("a.test.js", "source"), ("package.json", "source")]
    assert dict(rows(df.select("f", T.categorize_file("f", "suffix").alias("c")), "f", "c"))["a.test.js"] == "test"


def test_email_check_and_null_passes(spark):
    cases = [("a@b.c", True), ("user@host", True), ("no-at-sign", False), ("two@@x", False), ("@x", False), (None, True)]
    df = spark.createDataFrame(cases, "e string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", T.check_email("e").alias("got")).collect())


def test_near_names(spark):
    df = spark.createDataFrame([("raect",), ("react",), ("lodahs",), ("left-pad",)], "name string")
    out = DL.typosquat(df, "name", ["react", "express", "lodash"])
    assert rows(out, "name", "similar_to") == [("lodahs", "lodash"), ("raect", "react")]


def test_vuln_severity_defaults(spark):
    v = spark.createDataFrame([("medium", False, None, "x"), ("high", True, False, "remote_code_execution"), ("low", None, None, None)],
                              "severity string, exploit_available boolean, publicly_disclosed boolean, description string")
    out = [r["risk_score"] for r in DL.vuln_severity(v).orderBy("severity").collect()]
    assert [round(x, 6) for x in out] == [21.0, 1.2, 4.8]   # high x1.5 x2; low x1.2 (disclosed default); medium = moderate x1.2
    pr = spark.range(1).select(DL.vuln_priority(F.lit(10.0), F.lit(True), F.lit("1.2.3")).alias("p")).first()["p"]
    assert pr == 7.0


def test_migration_anomaly_boundaries(spark):
    st = spark.createDataFrame([("m1", 49.0, 100.0, 0.01), ("m2", 50.0, 100.0, 0.011)], "id string, rate double, expected double, err double")
    out = rows(Q.migration_anomalies(st, "id", "rate", "expected", "err"), "id", "type")
    assert out == [("m1", "low_throughput"), ("m2", "high_error_rate")]


def test_null_constraints(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 5)], "id int, v int")
    rep = dict(rows(Q.constraint_report(df, {"v_pos": F.col("v") > 0}, [], [["v"]]), "constraint", "violations"))
    assert rep["check:v_pos"] == 0 and rep["unique:v"] == 0
    rep2 = dict(rows(Q.constraint_report(df, {}, ["v"], [["v"]], nulls_distinct=False), "constraint", "violations"))
    assert rep2["not_null:v"] == 2 and rep2["unique:v"] == 1


def test_date_windows(spark):
    df = spark.range(1)
    for as_of, monday in [("2024-01-22", "2024-01-22"), ("2024-01-28", "2024-01-22"), ("2024-02-01", "2024-01-29")]:
        start, end = D.date_window("this_week", as_of)
        r = df.select(start.alias("s"), end.alias("e")).first()
        assert str(r["s"]) == monday and str(r["e"]) == str(dt.date.fromisoformat(as_of) + dt.timedelta(days=1))
    s, _ = D.date_window("this_month", "2024-02-01")
    assert str(df.select(s.alias("s")).first()["s"]) == "2024-02-01"


def test_json_cases(spark):
    df = spark.createDataFrame([('{"a": 1, "b": [1, 2]}',), ("{bad",), ('{"b": 2}',)], "js string")
    out = df.select("js", S.safe_parse("js")["ok"].alias("ok"), S.json_has_key("js", "a").alias("has_a"),
                    S.json_field("js", "$.b[1]", "int").alias("b1")).collect()
    got = {r["js"]: (r["ok"], r["has_a"], r["b1"]) for r in out}
    assert got['{"a": 1, "b": [1, 2]}'] == (True, True, 2)
    assert got["{bad"][0] is False
    assert got['{"b": 2}'] == (True, False, None)


def test_attack_tree_literal(spark):
    # OR root 0; left AND(1) over leaves 11, 12; right OR(2) over leaf 21 and AND(22) over leaf 221
    nodes = spark.createDataFrame([
        (1, 0, "or", 0, 0), (1, 1, "and", 0, 0), (1, 11, "leaf", 2, 1), (1, 12, "leaf", 3, 2),
        (1, 2, "or", 0, 0), (1, 21, "leaf", 4, 3), (1, 22, "and", 0, 0), (1, 221, "leaf", 1, 4)],
        "tree_id long, node_id long, node_type string, difficulty int, cost int")
    edges = spark.createDataFrame([(1, 0, 1, 1), (1, 0, 2, 2), (1, 1, 11, 1), (1, 1, 12, 2), (1, 2, 21, 1), (1, 2, 22, 2), (1, 22, 221, 1)],
                                  "tree_id long, parent long, child long, pos long")
    roll = {r["node_id"]: (r["difficulty"], r["cost"]) for r in R.tree_rollup(nodes, edges).collect()}
    assert roll[1] == (3.0, 3.0) and roll[2] == (1.0, 3.0) and roll[0] == (1.0, 3.0)
    best = {r["node_id"]: (r["score"], list(r["path"])) for r in R.best_path(nodes, edges).collect()}
    assert best[0] == (1.0, [0, 2, 22, 221])
    paths = R.attack_paths(nodes, edges)
    root = sorted(list(r["path"]) for r in paths.filter("node_id = 0").collect())
    assert root == [[0, 1, 11, 12], [0, 2, 21], [0, 2, 22, 221]]   # AND with one child passes its path through


def test_saga_cases(spark):
    rows_ = [(1, 1, "completed", ts(0)), (1, 2, "completed", ts(10)), (1, 3, "completed", ts(20)),
             (2, 1, "completed", ts(0)), (2, 2, "completed", ts(10)), (2, 3, "failed", ts(20)),
             (3, 1, "completed", ts(0)), (3, 2, "executing", ts(10))]
    steps = spark.createDataFrame(rows_, "saga long, step int, status string, started timestamp_ntz")
    st = {r["saga"]: r for r in folds.saga_state(steps, "saga", "step", "status", "started", as_of=str(ts(10 + 301))).collect()}
    assert st[1]["state"] == "completed"
    assert (st[2]["state"], st[2]["failed_step"], st[2]["to_compensate"]) == ("compensating", 3, 2)
    assert (st[3]["state"], st[3]["failed_step"], st[3]["timed_out"]) == ("compensating", 2, 1)   # step 2 timed out
    plan = rows(folds.compensation_plan(steps, "saga", "step", "status", "started", as_of=str(ts(10 + 301))), "saga", "step",
                "compensation_order")
    assert plan == [(2, 1, 2), (2, 2, 1), (3, 1, 1)]   # reverse order of completion


def test_text_and_structured_helpers(spark):
    df = spark.createDataFrame([("10 files changed, 450 insertions(+), 123 deletions(-)",), ("1 file changed, 2 deletions(-)",),
                                ("nothing here",)], "s string")
    st = [tuple(r["x"]) for r in df.select(T.shortstat("s").alias("x")).collect()]
    assert st == [(10, 450, 123, 327), (1, 0, 2, -2), (0, 0, 0, 0)]
    src = spark.createDataFrame([("export async function GET(){}\nexport const POST = x\nexport function GET(){}",)], "c string")
    assert src.select(T.exported_verbs("c").alias("v")).first()["v"] == ["GET", "POST"]
    arr = spark.range(1).select(F.array(*[F.lit(i) for i in range(1, 6)]).alias("a"))
    assert arr.select(S.pg_slice("a", 2, 4).alias("x")).first()["x"] == [2, 3, 4]
    js = spark.createDataFrame([('{"a": [1, 2], "b": "x"}',)], "j string")
    assert js.select(S.json_type("j", "$.a").alias("t")).first()["t"].startswith("ARRAY")
    d = spark.range(1).select(D.days_until(F.lit("2024-01-10").cast("timestamp_ntz"), "2024-01-01").alias("d")).first()["d"]
    assert d == 9
