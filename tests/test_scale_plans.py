"""Plans without quadratic joins, size limits or fixed bucket counts."""

import math
import random

from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from opsmill.operators import extend as X
from opsmill.operators import relational as rel
from opsmill.operators import risk as R


def test_range_join_of_mixed_widths_without_a_nested_loop(spark):
    rng = random.Random(1)
    ranges = [(i, lo, lo + rng.choice([0.001, 0.5, 3.0, 40.0, 1000.0])) for i, lo in enumerate(rng.uniform(-50, 50) for _ in range(80))]
    ranges += [(900, -math.inf, 3.0), (901, 4.0, math.inf), (902, 5.0, 5.0), (903, 6.0, 2.0), (904, None, 1.0), (905, 0.0, None), (906, -8.0, 8.0)]
    points = [(i, round(rng.uniform(-60, 60), 2)) for i in range(300)] + [(1000, None), (1001, 0.0), (1002, 3.0), (1003, -8.0), (1004, 8.0)]
    p = spark.createDataFrame(points, "i long, v double")
    r = spark.createDataFrame(ranges, "k long, lo double, hi double")
    want = sorted((i, k) for i, v in points for k, lo, hi in ranges if None not in (v, lo, hi) and lo <= v < hi)
    j = rel.range_join(p, r, "v", "lo", "hi")
    assert rows(j, "i", "k") == want
    assert "BroadcastNestedLoopJoin Inner, (" not in j._jdf.queryExecution().toString()


def test_counted_ranges_make_no_pairs(spark):
    rng = random.Random(2)
    ranges = [(i, lo, lo + rng.choice([0.0, 0.5, 3.0, 40.0])) for i, lo in enumerate(round(rng.uniform(-50, 50), 1) for _ in range(200))]
    ranges += [(900, 6.0, 2.0), (901, None, 1.0), (902, 0.0, None), (903, -math.inf, math.inf)]
    points = [(i % 250, round(rng.uniform(-60, 60), 1)) for i in range(300)] + [(1000, None), (None, 0.0)]
    p = spark.createDataFrame(points, "i long, v double")
    r = spark.createDataFrame(ranges, "k long, lo double, hi double")
    got = rel.range_join(p, r, "v", "lo", "hi", bucket=7.0, count="n")
    want = [(i, v, sum(None not in (lo, hi) and lo <= v < hi for _, lo, hi in ranges)) for i, v in points if v is not None]
    key = str
    assert sorted(map(tuple, got.collect()), key=key) == sorted((x for x in want if x[2]), key=key)
    heavy = rel.range_join(spark.range(20000).select(F.col("id").cast("double").alias("v")), spark.range(20000).select((F.lit(-1.0) - F.col("id")).alias("lo"), F.lit(1e9).alias("hi")), "v", "lo", "hi", bucket=1e9, count="n")
    assert heavy.agg(F.sum("n")).first()[0] == 20000 * 20000  # as pairs: 400 million rows in one bucket


def test_closure_of_a_long_cycle_with_shortcuts(spark, monkeypatch):
    n = 60
    edges = [(i, (i + 1) % n) for i in range(n)] + [(0, 30), (5, None), (None, 3), (7, 7)]
    sizes = []
    import opsmill.session as session

    cut = session.cut_lineage

    def counted(df):
        out = cut(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(session, "cut_lineage", counted)
    got = {(r["src"], r["dst"]): (r["depth"], r["cycle"]) for r in rel.closure(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want: dict = {}
    for s in [*range(n), None]:
        level, seen, d = [s], {}, 0
        while level:
            d += 1
            level = sorted({b for a in level for x, b in edges if x == a and (a is not None or d == 1) and b not in seen}, key=str)
            seen.update(dict.fromkeys(level, d))
        want |= {(s, b): (d, None if None in (s, b) else s == b) for b, d in seen.items()}
    assert got == want
    assert sum(sizes) == len(want)  # every pair is written once


def test_buckets_follow_the_rows_and_keep_the_order(spark, monkeypatch):
    monkeypatch.setattr(rel, "BUCKET_ROWS", 100)
    df = spark.range(30000).select((F.col("id") * 7919 % 30011).alias("v"), (F.col("id") % 3).alias("w"))
    x = rel.value_buckets(df, ["v", "w"])
    per = x.groupBy("__bucket").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("__bucket").collect()
    assert len(per) > 200 and max(r["n"] for r in per) < 1500
    assert all(a["hi"] <= b["lo"] for a, b in zip(per, per[1:], strict=False))
    ranked = rel.ordered_batches(df, ["v", "w"], 50)
    wrong = ranked.withColumn("p", F.row_number().over(Window.orderBy("v", "w"))).filter("p <> position").count()
    assert wrong == 0
    same = spark.range(5000).select(F.lit(1).alias("v"))
    assert rel.ordered_batches(same, ["v"], 10).select("position").distinct().count() == 5000


def test_mergeable_aggregate_over_batches_and_null_keys(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, "13")
    data = [(None if i % 5 == 0 else i % 3, float(i)) for i in range(1000)]
    df = spark.createDataFrame(data, "k long, v double").repartition(6)
    got = {r["k"]: r["spread"] for r in X.mergeable_aggregate(df, ["k"], "v", lambda s: (s.min(), s.max()), lambda a, b: (min(a[0], b[0]), max(a[1], b[1])), lambda s: s[1] - s[0], "spread").collect()}
    spark.conf.set(name, was)
    want = {}
    for k, v in data:
        lo, hi = want.get(k, (v, v))
        want[k] = (min(lo, v), max(hi, v))
    assert got == {k: hi - lo for k, (lo, hi) in want.items()}


def test_roadmap_equals_ranking_all_pairs(spark):
    rng = random.Random(3)
    gaps = [(t, g) for t in range(60) for g in range(rng.randrange(3))]
    threats = [(t, rng.choice([1, 2, 3, 4]), rng.randrange(4)) for t in range(60)]
    controls = [(c, rng.randrange(2)) for c in range(40)]
    categories = [(c, c % 4) for c, _ in controls]
    got = R.phase_roadmap(spark.createDataFrame(gaps, "threat_id long, gap_no long"), spark.createDataFrame(threats, "threat_id long, impact int, category_no int"),
                          spark.createDataFrame(categories, "control_id long, category_no int"), spark.createDataFrame(controls, "control_id long, status_no int"), per_phase=7)
    info = {t: (i, c) for t, i, c in threats}
    want = []
    for phase, impact in ((1, 4), (2, 3)):
        pairs = sorted((t, g, c) for t, g in gaps if info[t][0] == impact for c, s in controls if s == 0 and c % 4 == info[t][1])
        want += [(t, c, phase, n + 1) for n, (t, _, c) in enumerate(pairs[:7])]
    assert rows(got, "threat_id", "control_id", "phase", "rank") == sorted(want)


def test_recommendations_from_their_two_tables(spark):
    threats = spark.createDataFrame([(1, 0), (2, 1), (3, 5)], "threat_id long, category_no int")
    mapped = spark.createDataFrame([(1, 10), (1, 21), (2, 20)], "threat_id long, control_id long")
    categories = spark.createDataFrame([(10, 0), (11, 0), (20, 1), (21, 1)], "control_id long, category_no int")
    catalogue, exceptions = R.recommendation_parts(threats, mapped, categories)
    assert rows(exceptions) == [(1, 0, 10), (2, 1, 20)] and catalogue.count() == 4
    assert rows(R.recommended_for(threats, catalogue, exceptions)) == [(1, 11), (2, 21)]


def test_recommendations_shuffle_no_row_for_each_pair(spark):
    threats = spark.range(40).select(F.col("id").alias("threat_id"), (F.col("id") % 2).alias("category_no"))
    categories = spark.range(4000).select(F.col("id").alias("control_id"), (F.col("id") % 2).alias("category_no"))
    mapped = threats.select("threat_id", (F.col("threat_id") * 50 % 4000).alias("control_id"))
    catalogue, exceptions = R.recommendation_parts(threats, mapped, categories)
    got = R.recommended_for(threats, catalogue, exceptions)
    own = {(r[0], r[1]) for r in mapped.collect()}
    assert {tuple(r) for r in got.collect()} == {(t, c) for t in range(40) for c in range(4000) if t % 2 == c % 2 and (t, c) not in own}
    steps = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(" in steps[:steps.index("Exchange")]  # the rows are made behind the last shuffle
    full = R.recommend_controls(threats, mapped, categories)
    assert {(r["threat_id"], c) for r in full.collect() for c in r["recommended_ids"]} == {tuple(r) for r in got.collect()}
    tree = full._jdf.queryExecution().optimizedPlan().toString()
    assert tree.index("strategy=broadcast") < tree.index("collect_set")  # the catalogue joins last


def test_wide_and_nodes_join_their_children_in_order(spark):
    kids = list(range(1, 12))
    nodes = [(0, 0, "and")] + [(0, k, "or" if k % 4 == 0 else "leaf") for k in kids] + [(0, 100 + 10 * k + j, "leaf") for k in kids if k % 4 == 0 for j in range(2)]
    edges = [(0, 0, k, p) for p, k in enumerate(kids)] + [(0, k, 100 + 10 * k + j, j) for k in kids if k % 4 == 0 for j in range(2)]
    n = spark.createDataFrame(nodes, "tree_id long, node_id long, node_type string")
    e = spark.createDataFrame(edges, "tree_id long, parent long, child long, pos int")
    got = sorted(r["path"] for r in R.attack_paths(n, e).filter("node_id = 0").collect())
    want = []
    for a in range(2):
        for b in range(2):
            path = [0]
            for k in kids:
                path += [k] if k % 4 else [k, 100 + 10 * k + (a if k == 4 else b)]
            want.append(path)
    assert got == sorted(want)


def test_deep_uneven_trees_roll_up_in_few_rounds(spark, monkeypatch):
    rng = random.Random(5)
    nodes, edges = [], []
    for t in range(8):
        ids = list(range(40))
        kids: dict = {}
        for i in ids[1:]:
            kids.setdefault(rng.randrange(max(0, i - 6), i), []).append(i)
        for i in ids:
            nodes.append((t, i, rng.choice(["and", "or"]) if i in kids or i % 9 == 8 else "leaf", rng.randrange(1, 6), rng.randrange(5)))
            edges += [(t, i, k, p) for p, k in enumerate(kids.get(i, []))]
    n = spark.createDataFrame(nodes, "tree_id long, node_id long, node_type string, difficulty int, cost int")
    e = spark.createDataFrame(edges, "tree_id long, parent long, child long, pos int")
    kind, kids = {(t, i): (k, d, c) for t, i, k, d, c in nodes}, {}
    for t, a, b, _ in edges:
        kids.setdefault((t, a), []).append(b)

    def roll(t, i):
        k, d, c = kind[t, i]
        below = [roll(t, x) for x in kids.get((t, i), [])]
        if not below:
            return (float(d), float(c)) if k == "leaf" else (0.0, 0.0)
        return tuple((min if k == "or" else f)(x[j] for x in below) for j, f in ((0, max), (1, sum)))

    want = sorted((t, i, *roll(t, i)) for t, i in kind)
    assert rows(R.tree_rollup(n, e), "tree_id", "node_id", "difficulty", "cost") == want
    # a two-level tree: the edges and the nodes are written, then two rounds of a level and what is left to do
    cuts = []
    monkeypatch.setattr(R, "cut_lineage", lambda df, cut=R.cut_lineage: cuts.append(1) or cut(df))
    flat_n = spark.createDataFrame([(1, 0, "or", 0, 0), (1, 10, "and", 0, 0), (1, 1, "leaf", 2, 3), (1, 2, "leaf", 4, 1)], n.schema)
    flat_e = spark.createDataFrame([(1, 0, 10, 0), (1, 10, 1, 0), (1, 10, 2, 1)], e.schema)
    assert rows(R.tree_rollup(flat_n, flat_e).filter("node_id = 0"), "difficulty", "cost") == [(4.0, 4.0)]
    assert len(cuts) == 6


def test_path_queries_make_rows_of_mitigated_steps_only(spark):
    paths = spark.createDataFrame([(1, "a", [0, 1]), (1, "b", [0, 2, 3]), (2, "c", [0, 1]), (3, "d", [0])], "tree_id long, path_id string, path array<long>")
    shut = spark.createDataFrame([(1, 3), (1, 9), (3, 7)], "tree_id long, node_id long")
    cover = R.path_coverage(paths, shut)
    assert rows(cover, "tree_id", "total_paths", "blocked_paths", "open_paths") == [(1, 2, 1, 1), (2, 1, 0, 1), (3, 1, 0, 1)]
    assert "explode" not in cover._jdf.queryExecution().toString()
    assert rows(R.mitigation_priority(paths, shut), "tree_id", "node_id", "paths_blocked", "coverage_impact") == [(1, 3, 1, 50.0)]


def test_places_in_statements_are_worked_out_once(spark):
    """a bracket's place is not searched again for every cell that it is held against, and files are
    spread over the cores before they are cut into tokens."""
    from opsmill.functions import source_code as S
    from opsmill.operators import routes

    assert str(S.inside(F.col("ts"), F.col("marker"))).count("marker") == 1
    assert str(routes._route_arguments(F.col("ts"), F.col("marker"))).count("marker") == 1
    one = spark.createDataFrame([("r", "a.controller.ts", "@Controller({ path: 'p' })\nclass A {\n  @Get(['x', 'y'])\n  f() { }\n}\n")], "repository string, path string, content string").coalesce(1)
    assert "RoundRobinPartitioning" in S.segments(one, "script")._jdf.queryExecution().toString()
    found = sorted((r.method, r.path, r.auth) for r in routes.nestjs_routes(one).collect())
    assert found == [("GET", "/p/x", "public"), ("GET", "/p/y", "public")]


def test_exact_profile_groups_values_column_by_column(spark):
    """no task holds a row for each value of all columns."""
    from opsmill.operators import quality as Q

    df = spark.createDataFrame([(1, "a", 0.0), (2, "b", -0.0), (2, None, float("nan")), (None, "a", float("nan"))], "k long, s string, x double")
    p = Q.dataset_profile(df, exact_distinct=True)
    assert [tuple(r) for r in p.collect()][:2] == [("k", 4, 1, 2, "1", "2"), ("s", 4, 1, 2, "a", "b")]
    assert p.filter("column = 'x'").first()[:4] == ("x", 4, 0, 2)
    assert [r.distinct for r in Q.dataset_profile(df.limit(0), exact_distinct=True).collect()] == [0, 0, 0]
    assert "Expand" not in p._jdf.queryExecution().toString()


def test_attack_paths_meet_their_edges_once(spark, monkeypatch):
    """once no parent waits, the next level reads the new paths only, not those resolved before."""
    n = spark.createDataFrame([(1, 0, "or"), (1, 10, "and"), (1, 11, "or"), (1, 1, "leaf"), (1, 2, "leaf"), (1, 3, "leaf")], "tree_id long, node_id long, node_type string")
    e = spark.createDataFrame([(1, 0, 10, 0), (1, 0, 11, 1), (1, 10, 1, 0), (1, 10, 2, 1), (1, 11, 3, 0)], "tree_id long, parent long, child long, pos long")
    cuts = []
    monkeypatch.setattr(R, "cut_lineage", lambda df, cut=R.cut_lineage: cuts.append(df) or cut(df))
    want = [[0, 10, 1, 2], [0, 11, 3]]
    assert sorted(r["path"] for r in R.attack_paths(n, e).filter("node_id = 0").collect()) == want
    levels = [df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") for df in cuts if "__paths" in df.columns]
    assert levels == [3, 3]
    # a root that also has a leaf of its own waits for the middle nodes: the leaf's path is kept for it
    mixed = e.unionByName(spark.createDataFrame([(1, 0, 4, 2)], e.schema))
    more = n.unionByName(spark.createDataFrame([(1, 4, "leaf")], n.schema))
    assert sorted(r["path"] for r in R.attack_paths(more, mixed).filter("node_id = 0").collect()) == sorted([[0, 4], *want])


def test_small_trees_are_resolved_in_a_row_as_in_rounds(spark, monkeypatch):
    """Odd trees give the same paths in one row as level by level, and lie by tree all the way."""
    rng = random.Random(11)
    nodes, edges = [(None, 1, "leaf", 1), (None, 0, "or", 1), (90, None, "leaf", 1)], [(None, 0, 1, 0), (90, 0, None, 0)]
    for t in range(60):
        size = rng.randrange(1, 9)
        rows = [(t, i, rng.choice(["and", "or", "and", "or", "xor", None]) if i == 0 or rng.random() < 0.4 else "leaf", rng.randrange(1, 5)) for i in range(size)]
        nodes += rows + ([rows[0]] if t % 5 == 0 else [(t, 0, "or", 2)] if t % 7 == 0 else []) + ([rows[-1]] if t % 11 == 0 else [])
        own = [(t, rng.randrange(i), i, rng.choice([None, 1, 2, 3])) for i in range(1, size)]
        edges += own + ([own[-1]] if own and t % 6 == 0 else []) + ([(t, 0, 77, 1)] if t % 13 == 0 else []) + ([(t, 0, size - 1, 9)] if size > 3 and t % 4 == 0 else [])
    n = spark.createDataFrame(nodes, "tree_id long, node_id long, node_type string, difficulty int")
    e = spark.createDataFrame(edges, "tree_id long, parent long, child long, pos long")
    for c in ("cost", "detection_risk"):
        n = n.withColumn(c, F.col("difficulty"))
    n = n.withColumn("time_hours", F.lit(0.5)).withColumn("requires_insider", F.lit(True)).withColumn("requires_physical", F.lit(False))

    def by_tree(df):  # without the order of rows or nulls in sorts
        return sorted((str(tuple(r)) for r in df.collect()))

    root, want = F.col("node_id") == 0, R.attack_paths(n, e)
    sizes = n.select("tree_id").unionByName(e.select("tree_id")).groupBy("tree_id").agg(F.count("*").alias("rows"))
    old = R.root_paths(want, n.filter(root))
    for most in (R.TREE_ROWS, 9, 0):  # all in a row, some, none
        monkeypatch.setattr(R, "TREE_ROWS", most)
        large = R.large_trees(sizes)
        assert by_tree(R.attack_paths(n, e, large)) == by_tree(want)
        found = R.root_paths(R.attack_paths(n, e, large, wanted=root), n.filter(root))
        assert by_tree(found) == by_tree(old)
        assert by_tree(R.path_metrics(found, n, large)) == by_tree(R.path_metrics(old, n))


def test_path_queries_shuffle_nodes_and_edges_once(spark):
    """Nodes and edges come from one exchange by tree, and only root paths make another."""
    import __spark_entry__ as entry

    sends = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in sends:  # as at size, where no side is small
        spark.conf.set(k, "-1")
    for name in ("r17_attack_paths", "r19_path_metrics", "r20_critical_nodes", "r21_path_coverage", "r22_mitigation_priority"):
        df = entry.queries()[name](spark, "/root/testdata/sf0.001")
        df.collect()
        made = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert len([x for x in made.splitlines() if " Exchange hashpartitioning" in x and "ReusedExchange" not in x]) <= 3, name
        assert "Scan ExistingRDD" not in made  # no level is written
    for k in sends:
        spark.conf.unset(k)


def test_tree_tables_number_lines_and_mark_flags(spark, tmpdir_path):
    from opsmill.tables import Tables

    lines = [(1, 5, 1, 2, 1.0, 9.0, "A", "F"), (1, 4, 1, 1, 2.0, 9.0, "A", None), (1, 3, 1, None, 3.0, 9.0, "N", "O"), (None, 2, 1, 1, 4.0, 9.0, None, "F"), (7, 2, 1, 1, 4.0, 9.0, "R", "F")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string").write.parquet(f"{tmpdir_path}/lineitem.parquet")
    spark.createDataFrame([(1, "F"), (1, None), (None, "F")], "o_orderkey long, o_orderstatus string").write.parquet(f"{tmpdir_path}/orders.parquet")
    d = Tables(spark, tmpdir_path).derived
    key = str
    assert sorted(map(tuple, d.tree_nodes.select("tree_id", "node_id", "node_type", "difficulty", "mitigated").collect()), key=key) == sorted([
        (1, 0, "and", 0, False), (1, 0, "or", 0, False), (None, 0, "and", 0, False), (1, 1001, "or", 0, False), (1, 1002, "and", 0, False), (7, 1003, "or", 0, False),
        (None, 1003, "or", 0, False), (1, 1, "leaf", 4, False), (1, 2, "leaf", 5, None), (1, 3, "leaf", 1, True), (None, 1, "leaf", 3, True), (7, 1, "leaf", 3, True)], key=key)
    assert sorted(map(tuple, d.tree_edges.collect()), key=key) == sorted([(1, 0, 1001, 1), (1, 0, 1002, 2), (1, 1002, 1, 1), (1, 1001, 2, 2), (1, 1001, 3, 3), (None, 0, 1003, 3),
                                                                          (None, 1003, 1, 1), (7, 0, 1003, 3), (7, 1003, 1, 1)], key=key)


def test_near_duplicates_write_the_sets_of_pairs_only(spark, monkeypatch):
    """the shingle sets of documents without a partner are neither written nor shuffled whole; no partner is lost."""
    from opsmill.operators import documents as DOC

    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(40)) for _ in range(300)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, f"{texts[i]} end") for i in range(5)] + [(2000 + i, texts[i]) for i in range(5)] + [(None, texts[9]), (3000, None), (3001, " . ")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    cuts = []
    monkeypatch.setattr(DOC, "cut_lineage", lambda df, cut=DOC.cut_lineage: cuts.append(cut(df)) or cuts[-1])
    got = {(r["a"], r["b"]): round(r["jaccard"], 6) for r in DOC.near_duplicates(df).collect()}
    assert got == {(i, 2000 + i): 1.0 for i in range(5)} | {(i, 1000 + i): round(36 / 37, 6) for i in range(5)}
    written = max(c.count() for c in cuts if "grams" in c.columns)
    assert written <= 30  # the ten of the pairs, five copies and what hashes as they do
    assert sorted(r[0] for r in DOC._perhaps_among(df, "doc_id", spark.range(400)).collect() if r[0] < 400) == list(range(300))
    monkeypatch.setattr(DOC, "MAP_BITS", 1 << 15)
    assert {r[0] for r in DOC._perhaps_among(df, "doc_id", spark.createDataFrame([(7,), (1003,), (None,)], "id long")).collect()} >= {7, 1003}
    plan = spark.createDataFrame(docs, df.schema)
    assert DOC.shingle_sets(plan, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
