"""Sources, sinks and write-side operators on temporary folders."""

import os

from conftest import rows
from pyspark.sql import functions as F

from opsmill.operators import extend as X
from opsmill.operators import quality as Q
from opsmill.sources import files as S


def test_bulk_load_csv_and_append(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "users.csv")
    with open(src, "w") as fh:
        fh.write("id,email,active\n1,a@x.io,true\n2,b@x.io,false\n")
    df = S.bulk_load_csv(spark, src, "id long, email string, active boolean")
    assert rows(df) == [(1, "a@x.io", True), (2, "b@x.io", False)]
    out = os.path.join(tmpdir_path, "users")
    S.append_table(df, out)
    S.append_table(df, out)
    assert spark.read.parquet(out).count() == 4


def test_chunked_copy_caps_file_rows(spark, tmpdir_path):
    df = spark.range(0, 2500).withColumnRenamed("id", "k")
    out = os.path.join(tmpdir_path, "copy")
    S.chunked_copy(df, out, "k", rows_per_file=1000)
    files = [f for f in os.listdir(out) if f.endswith(".parquet")]
    assert len(files) >= 3
    assert spark.read.parquet(out).count() == 2500


def test_read_text_corpus_skips(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "repo")
    os.makedirs(os.path.join(root, "src", "tests"))
    for name, body in [("src/a.ts", "export const GET = 1"), ("src/README.md", "docs"), ("src/b.spec.ts", "x"),
                       ("src/tests/c.ts", "y"), ("src/d.ts", "line1\nline2")]:
        with open(os.path.join(root, name), "w") as fh:
            fh.write(body)
    c = S.read_text_corpus(spark, root)
    got = sorted((os.path.basename(r["path"]), r["content"]) for r in c.collect())
    assert got == [("a.ts", "export const GET = 1"), ("d.ts", "line1\nline2")]


def test_write_batches_and_manifest(spark, tmpdir_path):
    df = spark.range(0, 120).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    out = os.path.join(tmpdir_path, "publish")
    man = S.write_batches(df, out, ["k"], size=50, upsert_keys=["k"]).first()
    assert (man["total_rows"], man["batches"], man["batch_size"], list(man["upsert_keys"])) == (120, 3, 50, ["k"])
    b = spark.read.json(os.path.join(out, "batches"))
    sizes = dict(rows(b.groupBy("batch").count()))
    assert sizes == {0: 50, 1: 50, 2: 20}
    first = b.filter("batch = 0").agg(F.min("k"), F.max("k")).first()
    assert tuple(first) == (0, 49)


def test_write_json_report(spark, tmpdir_path):
    r = spark.createDataFrame([("svc", "/b", "GET"), ("svc", "/a", "POST")], "repository string, path string, method string")
    w = spark.createDataFrame([("extractor x failed",)], "warning string")
    out = os.path.join(tmpdir_path, "report")
    S.write_json_report(r, w, out, ["repository", "path", "method"], "2024-01-01T00:00:00")
    assert spark.read.json(os.path.join(out, "rows")).count() == 2
    meta = spark.read.json(os.path.join(out, "meta")).first()
    assert meta["generated_at"] == "2024-01-01T00:00:00"


def test_bus_encode_decode_roundtrip(spark, tmpdir_path):
    ev = spark.createDataFrame([("OrderCreated", 7, 10.5), ("OrderShipped", 7, 0.0)], "event_type string, order_id long, amount double")
    enc = S.encode_events(ev, "event_type", "order_id", ["order_id", "amount"])
    assert rows(enc, "topic", "key") == [("OrderCreated", "7"), ("OrderShipped", "7")]
    dec = S.decode_events(enc, "order_id long, amount double")
    assert rows(dec.select("key", "event.amount"), "key", "amount") == [("7", 0.0), ("7", 10.5)]
    # the file form of the bus: same columns through a parquet stream
    enc.write.parquet(os.path.join(tmpdir_path, "bus"))
    stream = S.bus_reader(spark, "orders", "", fmt="parquet").schema(enc.schema).load(os.path.join(tmpdir_path, "bus"))
    q = S.bus_writer(stream, "", os.path.join(tmpdir_path, "ck"), fmt="parquet", path=os.path.join(tmpdir_path, "out")) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(os.path.join(tmpdir_path, "out")).count() == 2


def test_gated_publish(spark, tmpdir_path):
    df = spark.range(10)
    ok = Q.gated_publish(df, os.path.join(tmpdir_path, "v1"), [("rows", lambda d: d.count() == 10)])
    assert ok["published"] and ok["path"].endswith("v1")
    bad = Q.gated_publish(df, os.path.join(tmpdir_path, "v2"), [("rows", lambda d: d.count() == 11)])
    assert not bad["published"] and bad["failed_checks"] == ["rows"]


def test_index_usage_report(spark):
    stats = spark.createDataFrame([("orders", 10, 100000, 0, 5000), ("users", 1, 10, 3, 100), ("events", 4, 400, 0, 900)],
                                  "relname string, seq_scan long, seq_tup_read long, idx_scan long, index_size long")
    rep = Q.index_usage_report(stats, n=2)
    assert [r["relname"] for r in rep["seq_scans"].collect()] == ["orders", "events"]
    assert [r["relname"] for r in rep["unused_indexes"].collect()] == ["orders", "events"]


def test_python_table_function(spark):
    from pyspark.sql.functions import udtf

    @udtf(returnType="n int, label string")
    class Expand:
        def eval(self, k: int):
            for i in range(k):
                yield i, f"item-{i}"

    df = spark.createDataFrame([(2,), (3,)], "k int")
    out = X.python_table_function(df, Expand, ["k"], keep=["k"])
    assert sorted((r["k"], r["n"]) for r in out.collect()) == [(2, 0), (2, 1), (3, 0), (3, 1), (3, 2)]
