"""Vector index, entity linkage, positional search, network join, stored sketches and user exports."""

import ipaddress
import os
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from opsmill.operators import linkage as LK
from opsmill.operators import quality as Q
from opsmill.operators import relational as rel
from opsmill.operators import textsearch as TS
from opsmill.operators import vector_index as VI
from opsmill.sources import files as S


# ----------------------------------------------------------------------------- V2
def _vectors(rng, n=600, dim=16, groups=12):
    base = rng.standard_normal((groups, dim)) * 2
    return base[rng.integers(0, groups, n)] + rng.standard_normal((n, dim)) * 0.5


def test_index_finds_neighbours_whatever_the_batches(spark, tmpdir_path):
    x = _vectors(np.random.default_rng(1))
    x[500:520] = x[7]  # copies
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9000, None)]
    vectors = spark.createDataFrame(data, "id long, v array<double>").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", data[i * 50][1]) for i in range(12)] + [("none", None)], "q string, qv array<double>")
    path = os.path.join(tmpdir_path, "index")
    VI.build(vectors, "id", "v", path, lists=24)
    assert spark.read.parquet(f"{path}/codes").count() == 600
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was, found = spark.conf.get(name), []
    for size in ("10000", "7"):
        spark.conf.set(name, size)
        found.append(rows(VI.search(path, vectors, queries, "id", "v", "q", "qv", k=5, probe_share=0.3, rerank=30)))
    spark.conf.set(name, was)
    assert found[0] == found[1]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for i in range(12):
        exact = [j for _, j in sorted((-round(float(s), 12), j) for j, s in enumerate(unit @ unit[i * 50]))][:5]
        mine = [r[1] for r in found[0] if r[0] == f"q{i}"]
        assert len(mine) == 5
        hits += len(set(exact) & set(mine))
    assert hits >= 54  # of 60
    assert {r[4] for r in found[0]} == {30}


def test_index_of_nothing(spark, tmpdir_path):
    empty = spark.createDataFrame([], "id long, v array<double>")
    path = os.path.join(tmpdir_path, "index")
    VI.build(empty, "id", "v", path)
    assert VI.search(path, empty, spark.createDataFrame([(1, [1.0])], "q long, qv array<double>"), "id", "v", "q", "qv").count() == 0


# ----------------------------------------------------------------------------- V10
def test_blocks_are_refined_and_weights_are_learned(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(300)]
    a = [(i, n, "same" if i % 3 == 0 else f"t{i % 40}", float(i)) for i, n in enumerate(names)]  # a third in one town
    b = [(1000 + i, n if i % 4 else n[:3] + "x" + n[4:], t if i % 5 else None, v) for i, n, t, v in a if i % 2 == 0]
    b += [(5000 + i, "".join(rng.choice("klmnopqrst") for _ in range(8)), f"t{i % 40}", -float(i)) for i in range(200)] + [(None, names[0], "same", 0.0)]
    left = spark.createDataFrame(a, "aid long, name string, town string, amount double")
    right = spark.createDataFrame(b, "bid long, name string, town string, amount double")
    passes = [[F.col("town"), F.substring("name", 1, 2)], [F.substring("name", 5, 4)]]
    pairs = LK.candidate_pairs(left, right.filter("bid is not null"), "aid", "bid", passes, max_pairs=500)
    assert pairs.count() < 300 * 350 / 4
    links = LK.link_entities(left, right, "aid", "bid", {"name": "text", "town": "text", "amount": "number"}, passes, max_pairs=500)
    got = rows(links, "aid", "bid")
    right_ones = [g for g in got if g[1] == g[0] + 1000]
    assert len(right_ones) >= 0.9 * 150 and len(right_ones) >= 0.95 * len(got)
    assert LK.link_entities(left.limit(0), right, "aid", "bid", {"name": "text"}, passes).count() == 0


def test_learned_weights_of_a_known_mixture():
    rng = np.random.default_rng(3)
    match = rng.random(20000) < 0.1
    m, u = [0.05, 0.15, 0.8], [0.9, 0.08, 0.02]
    code = np.array([[1 + rng.choice(3, p=m if y else u) for _ in range(4)] for y in match])
    pats, counts = np.unique(code, axis=0, return_counts=True)
    gm, gu, share = LK.learn_weights([(p.tolist(), int(c)) for p, c in zip(pats, counts, strict=True)])
    assert abs(share - match.mean()) < 0.01 and np.allclose(gm[:, 1:], m, atol=0.05) and np.allclose(gu[:, 1:], u, atol=0.02)


# ----------------------------------------------------------------------------- F9
TEXTS = [(1, "The quick brown fox"), (2, "the fox is QUICK; the dog"), (3, "a dog a dog"), (4, ""), (5, None), (6, "brown the fox")]


@pytest.mark.parametrize("query,want", [
    ("quick & fox", {1: 2, 2: 2}), ("dog | !the", {2: 3, 3: 2, 4: 0, 5: 0}), ("the <-> fox", {2: 3, 6: 2}), ("the <2> quick", {}), ("brown <-> (fox | the)", {1: 3, 6: 3}),
    ("!(quick | dog) & brown", {6: 1}), ("a <2> a", {3: 2}), ("the <-> quick <-> brown", {1: 3}), ("(the | a) <-> dog", {2: 3, 3: 4})])
def test_boolean_and_phrase_search(spark, query, want):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    assert {r["doc_id"]: r["hits"] for r in TS.search(TS.postings(docs), query, docs).collect()} == want


def test_bad_searches_are_refused(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for bad in ("a &", "(a", "a)", "", "a b"):
        with pytest.raises(ValueError):
            TS.parse(bad)
    with pytest.raises(ValueError):
        TS.search(TS.postings(docs), "!a")


# ----------------------------------------------------------------------------- J16
def test_longest_prefix_equals_brute_force(spark):
    rng = random.Random(7)
    nets = ["0.0.0.0/0", "10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/24", "10.1.2.3/32", "192.168.0.0/17", "::/0", "2001:db8::/32", "2001:db8:0:1::/64", "2001:db8:0:1:8000::/65", "fe80::/10", "::1/128",
            "::ffff:0:0/96", "2001:db8::1", "bad/8", "10.0.0.0/40"]
    ips = [f"10.{rng.randrange(3)}.{rng.randrange(4)}.{rng.randrange(5)}" for _ in range(60)] + ["192.168.127.255", "192.168.128.0", "255.255.255.255", "0.0.0.0"]
    ips += [str(ipaddress.IPv6Address((0x20010DB8 << 96) + (rng.randrange(3) << 64) + rng.randrange(1 << 64))) for _ in range(40)]
    ips += ["::1", "::", "fe80::abcd", "febf:ffff::1", "fec0::1", "::ffff:10.1.2.3", "2001:DB8::1", "2001:db8:0:0:0:0:0:1", "64:ff9b::1.2.3.4"]
    broken = ["256.1.1.1", "1.2.3", "2001:db8:::1", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::1", ":1:2:3:4:5:6:7", "", None, "1::2::3"]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(ips + broken)], "i long, ip string")
    networks = spark.createDataFrame([(n, f"n{k}") for k, n in enumerate(nets)], "cidr string, name string")
    got = {r["i"]: r["name"] for r in rel.longest_prefix_join(table, networks, "ip", "cidr").collect()}
    known = []
    for k, n in enumerate(nets):
        try:
            known.append((ipaddress.ip_network(n), f"n{k}"))
        except ValueError:
            pass
    for i, x in enumerate(ips):
        at = ipaddress.ip_address(x)
        fits = [(net.prefixlen, name) for net, name in known if net.version == at.version and at in net]
        assert got[i] == (max(fits)[1] if fits else None), x
    assert all(got[len(ips) + k] is None for k in range(len(broken)))


# ----------------------------------------------------------------------------- Q15 / A2
def test_merged_sketches_equal_a_full_pass(spark, tmpdir_path):
    data = [(i % 5000, float(i % 977), f"s{i % 300}" if i % 10 else None) for i in range(40000)]
    df = spark.createDataFrame(data, "k long, v double, s string").repartition(4)
    path = os.path.join(tmpdir_path, "history")
    for part in range(4):
        Q.append_profile(df.filter(F.col("k") % 4 == part), f"run{part}", path)
    Q.append_profile(df.filter(F.col("k") % 4 == 1), "run1", path)  # a rerun replaces the run
    got = {r["column"]: r for r in Q.merged_profile(spark.read.parquet(path)).collect()}
    assert {c: (r["rows"], r["nulls"]) for c, r in got.items()} == {"k": (40000, 0), "v": (40000, 0), "s": (40000, 4000)}
    assert (got["v"]["low"], got["v"]["high"], got["s"]["q50"]) == (0.0, 976.0, None)
    for c, exact in (("k", 5000), ("v", 977), ("s", 270)):
        assert abs(got[c]["distinct"] / exact - 1) < 0.04
    for q in (25, 50, 75):
        assert abs(got["k"][f"q{q}"] / 5000 - q / 100) < 0.03
    one = {r["column"]: r["rows"] for r in Q.merged_profile(spark.read.parquet(path), runs=["run0", "run2"]).collect()}
    assert one["k"] == 20000


# ----------------------------------------------------------------------------- S12
def test_exports_in_all_formats(spark, tmpdir_path):
    req = spark.createDataFrame([(1,), (2,), (3,), (3,)], "user_id long")
    posts = spark.createDataFrame([(1, i, f'text "{i}", <b>&</b>\nline' if i % 3 else None) for i in range(500)] + [(2, 9, "é"), (7, 1, "no")], "author long, post long, body string")
    likes = spark.createDataFrame([(1, 5), (1, 5), (7, 6)], "user_id long, post long")
    sources = {"posts": (posts, "author"), "likes": (likes, "user_id")}
    parts = S.export_user_parts(req, "user_id", sources, rows_per_part=50)
    sizes = {}
    for r in parts.collect():
        sizes.setdefault(r["user_id"], []).append((len(r["posts"]), len(r["likes"])))
    assert sum(p for p, _ in sizes[1]) == 500 and sum(n for _, n in sizes[1]) == 2 and len(sizes[1]) == 11 and max(p for p, _ in sizes[1]) < 100
    assert sizes[2] == [(1, 0)] and sizes[3] == [(0, 0)] and 7 not in sizes
    for fmt in ("json", "xml"):
        path = os.path.join(tmpdir_path, fmt)
        S.write_user_export(req, "user_id", sources, path, fmt, rows_per_part=50)
        schema = "user_id long, part int, posts array<struct<post:long,body:string>>, likes array<struct<post:long>>"
        reader = spark.read.schema(schema)
        back = reader.json(path) if fmt == "json" else reader.format("xml").option("rowTag", "user").option("ignoreSurroundingSpaces", False).load(path)
        bodies = back.select("user_id", F.explode("posts").alias("p")).select("user_id", "p.*")
        assert rows(bodies.filter("body is not null")) == rows(posts.filter("author < 3 and body is not null"))
        assert back.select("user_id").distinct().count() == 3
    S.write_user_export(req, "user_id", sources, os.path.join(tmpdir_path, "csv"), "csv")
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(os.path.join(tmpdir_path, "csv"))
    assert back.count() == 2 * 501 + 2 and back.filter("source = 'likes'").select("record").distinct().count() == 2
    assert back.filter("field = 'body' and value like '%<b>&</b>%line'").count() == 333
    with pytest.raises(ValueError):
        S.write_user_export(req, "user_id", sources, tmpdir_path, "doc")


def test_links_are_worked_out_once_and_verified_in_blocks(spark, monkeypatch):
    import random

    import pandas as pd
    from opsmill.operators import documents as DOC

    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        first = [rng.choice(words) for _ in range(60)]
        texts += [" ".join(first[:k] + [rng.choice(words)] + first[k + 1:]) if k else " ".join(first) for k in (0, 0, 3, 30, 58, 59)]
    texts += [None, "", "one two", "one two", "...", " ".join(["same"] * 50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def grams(t):
        w = (t or "").split() if t != "..." else []
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = {i: grams(t) for i, t in enumerate(texts) if grams(t)}
    reps = {}
    for i, g in sets.items():
        reps.setdefault(g, i)
    want = {(reps[g], i, 1.0) for i, g in sets.items() if reps[g] != i}
    for g, a in reps.items():
        for f, b in reps.items():
            j = len(g & f) / len(g | f)
            if a < b and j >= 0.8:
                want.add((a, b, round(j, 9)))
    assert len(want) > 60
    for size in (1, 2, 32):
        monkeypatch.setattr(DOC, "BLOCK_DOCS", size)
        assert {(r["a"], r["b"], round(r["jaccard"], 9)) for r in DOC.near_duplicates(docs).collect()} == want
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(len(b))
            yield b

    edges = spark.createDataFrame(pd.DataFrame({"a": range(50), "b": range(1, 51)})).repartition(3).mapInPandas(counted, "a long, b long")
    assert DOC.connected_components(edges).filter("label = 0").count() == 51
    assert runs.value == 50


def test_postings_of_single_keys_need_no_shuffle(spark):
    """terms and places come from inside a text's row; a key that is given twice is merged as before."""
    data = [(1, "b a B, c a"), (2, ""), (3, None), (4, "..."), (5, "a"), (None, "c c")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    single = TS.postings(docs)
    want = {(1, "a"): [2, 5], (1, "b"): [1, 3], (1, "c"): [4], (5, "a"): [1], (None, "c"): [1, 2]}
    assert {(r.doc_id, r.term): r.places for r in single.collect()} == want
    assert "hashpartitioning" not in single._jdf.queryExecution().toString()
    twice = TS.postings(spark.createDataFrame([*data, (5, "x a a")], docs.schema))
    assert {(r.doc_id, r.term): r.places for r in twice.collect()} == {**want, (5, "a"): [1, 2, 3], (5, "x"): [1]}
