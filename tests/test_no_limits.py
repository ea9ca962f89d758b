"""Whole tables, deep structures and null keys: nothing may be lost or cut."""

from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from opsmill.operators import documents as DOC
from opsmill.operators import eventlog as EV
from opsmill.operators import folds
from opsmill.operators import inventory as INV
from opsmill.operators import routes as R
from opsmill.operators import relational as REL
from opsmill.operators import risk
from opsmill.operators import vectors as VEC
from opsmill.sources import files

LARGE = "/root/testdata/sf0.1"


def test_batches_of_whole_orders_lose_no_row(spark, tmpdir_path):
    orders = spark.read.parquet(f"{LARGE}/orders.parquet")
    b = REL.ordered_batches(orders, ["o_orderkey"], 50)
    assert b.columns[:len(orders.columns)] == orders.columns
    want = orders.select("o_orderkey", F.row_number().over(Window.orderBy("o_orderkey")).alias("w"))
    joined = b.join(want, "o_orderkey")
    n = orders.count()
    got = joined.agg(F.count("*").alias("n"), F.countDistinct("position").alias("p"), F.max("position").alias("hi"), F.count_if(F.expr("position != w")).alias("bad")).first()
    assert tuple(got) == (n, n, n, 0)
    files.write_batches(orders.withColumn("o_orderdate", F.col("o_orderdate").cast("string")), f"{tmpdir_path}/out", ["o_orderkey"], size=5000)
    assert spark.read.json(f"{tmpdir_path}/out/batches").count() == n


def test_batches_by_strings_nulls_and_ties(spark):
    data = [(None, 1), ("b", 2), ("a", 3), ("b", 1), (None, 2)] + [("c", i) for i in range(300)]
    df = spark.createDataFrame(data, "k string, v int")
    got = [(r["k"], r["v"]) for r in REL.ordered_batches(df, ["k", "v"], 7).orderBy("position").collect()]
    assert got == sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1]))


def test_late_flags_of_whole_events_equal_a_global_window(spark):
    e = spark.read.parquet(f"{LARGE}/events.parquet").withColumn("arrival", (F.col("user_id") % 4) * 1000000000 + F.col("event_id"))
    late = EV.late_events(e, "arrival", "ts", 86400)
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    want = e.select("event_id", F.coalesce(t < F.max(t).over(w) - 86400000000, F.lit(False)).alias("want"))
    got = late.join(want, "event_id").agg(F.count("*").alias("n"), F.count_if(F.col("late") != F.col("want")).alias("bad"), F.count_if("late").alias("late")).first()
    assert got["n"] == e.count() and got["bad"] == 0 and got["late"] > 0


def test_router_chain_of_depth_20(spark):
    mods = [("r", "svc/main.py", "from fastapi import FastAPI\nfrom svc.m0 import router as r0\napp = FastAPI()\napp.include_router(r0, prefix='/a')\n")]
    for i in range(20):
        nxt = f"from svc.m{i + 1} import router as child\n" if i < 19 else ""
        inc = "router.include_router(child)\n" if i < 19 else ""
        mods.append(("r", f"svc/m{i}.py", f"from fastapi import APIRouter\n{nxt}router = APIRouter(prefix='/p{i}')\n{inc}@router.get('/x{i}')\nasync def f{i}():\n    pass\n"))
    got = R.fastapi_routes(spark.createDataFrame(mods, "repository string, path string, content string"))
    assert got.count() == 20
    assert got.filter(F.col("path").endswith("/p19/x19")).first()["path"] == "/a" + "".join(f"/p{i}" for i in range(20)) + "/x19"


def test_register_helpers_aliases_and_verifiers(spark):
    mods = [
        ("r", "svc/mount.py", "from svc import items\ndef register_routes(app):\n    app.include_router(items.router, prefix='/v1')\n"),
        ("r", "svc/items.py", "from fastapi import APIRouter, Depends\nAdminDep = Annotated[str, Depends(require_admin)]\nrouter = APIRouter(prefix='/items')\n"
         "@router.get('/a')\nasync def a(user: AdminDep):\n    pass\n"
         "@router.post('/b')\nasync def b(_=Depends(verify_anything)):\n    pass\n"
         "@router.post('/c')\nasync def c(_=Depends(check_webhook_secret)):\n    pass\n"
         "@router.get('/d')\nasync def d(key: str = Header(alias='X-Api-Key')):\n    pass\n"
         "@router.get('/e')\nasync def e(u=Depends(get_current_user)):\n    pass\n")]
    got = rows(R.fastapi_routes(spark.createDataFrame(mods, "repository string, path string, content string")), "path", "auth")
    assert got == [("/v1/items/a", "okta"), ("/v1/items/b", "signature"), ("/v1/items/c", "signature"), ("/v1/items/d", "api-key"), ("/v1/items/e", "jwt")]


def test_yaml_keys_at_any_depth(spark):
    text = "\n".join(" " * (4 * i) + f"k{i}:" for i in range(30))
    got = {r["line"]: r["parent_line"] for r in INV.yaml_key_scan(spark.createDataFrame([("r", "a.yaml", text)], "repository string, path string, content string")).collect()}
    assert got == {i + 1: (i or None) for i in range(30)}


def test_nest_guards_of_handler_replace_those_of_class(spark):
    code = """
@UseGuards(OktaAuthGuard)
@Controller('svc')
export class SvcController {
  constructor(private readonly x: X) {}

  @UseGuards(ServiceApiKeyGuard)
  @Get('a')
  a() { if (x) { y() } }

  @Get('b')
  b(): Promise<void> {}

  @Post('c')
  @UseGuards(
    AuthGuard('jwt'),
  )
  async c(@Body() dto: Dto) {
    return 1
  }
}
"""
    corpus = spark.createDataFrame([("r", "src/a.controller.ts", code), ("r", "src/a.controller.spec.ts", code.replace("svc", "spec")), ("r", "src/b.ts", code.replace("svc", "no"))],
                                   "repository string, path string, content string")
    assert rows(R.nestjs_routes(corpus), "method", "path", "auth") == [("GET", "/svc/a", "api-key"), ("GET", "/svc/b", "okta"), ("POST", "/svc/c", "jwt")]


def test_go_middleware_words_and_wrapped_handlers(spark):
    def auth(body):
        code = 'package main\nfunc main() {\n' + body + '\n  mux.HandleFunc("GET /x", x)\n}\n'
        return R.go_routes(spark.createDataFrame([("r", "main.go", code)], "repository string, path string, content string")).first()["auth"]

    assert auth("  r.Use(oktaMiddleware)") == "okta"
    assert auth("  r.Use(sessionMiddleware)") == "jwt"
    assert auth("  s := &http.Server{\n    Handler: sentry.Handle(corsMiddleware(jwtMiddleware(mux))),\n  }") == "jwt"
    assert auth("  wrapped := recoveryMiddleware(apiKeyMiddleware(mux))\n  s := &http.Server{\n    Handler: wrapped,\n  }") == "api-key"
    assert auth("  s := &http.Server{\n    Handler: corsMiddleware(mux),\n  }") == "public"


def _chain(spark, depth):
    nodes = [(1, i, "leaf" if i == depth else ("and" if i % 2 else "or"), 1, 1) for i in range(depth + 1)]
    edges = [(1, i, i + 1, 1) for i in range(depth)]
    return (spark.createDataFrame(nodes, "tree_id long, node_id long, node_type string, difficulty int, cost int"),
            spark.createDataFrame(edges, "tree_id long, parent long, child long, pos long"))


def test_attack_tree_of_depth_70(spark):
    nodes, edges = _chain(spark, 70)
    paths = risk.attack_paths(nodes, edges)
    assert paths.count() == 71
    assert paths.filter("node_id = 0").first()["path"] == list(range(71))


def test_and_nodes_combine_all_children_in_order(spark):
    nodes = spark.createDataFrame([(1, 0, "and"), (1, 1, "or"), (1, 2, "leaf"), (1, 3, "or"), (1, 11, "leaf"), (1, 12, "leaf"), (1, 31, "leaf"), (1, 32, "leaf"), (1, 33, "leaf")],
                                  "tree_id long, node_id long, node_type string")
    edges = spark.createDataFrame([(1, 0, 1, 1), (1, 0, 2, 2), (1, 0, 3, 3), (1, 1, 11, 1), (1, 1, 12, 2), (1, 3, 31, 1), (1, 3, 32, 2), (1, 3, 33, 3)],
                                  "tree_id long, parent long, child long, pos long")
    got = sorted(r["path"] for r in risk.attack_paths(nodes, edges).filter("node_id = 0").collect())
    assert got == sorted([0, 1, a, 2, 3, b] for a in (11, 12) for b in (31, 32, 33))


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5000, 5000), (None, 3), (7001, 7000)]
    got = {r["node"]: r["label"] for r in DOC.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(60)}, 5000: 5000, 7000: 7000, 7001: 7000}


def test_near_duplicates_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(w if rng.random() > 0.02 else f"x{rng.randrange(99)}" for w in base) for _ in range(30)] + ["a b", "A B", "", None, "... !"]
    docs = list(enumerate(texts))
    got = {(r["a"], r["b"]): r["jaccard"] for r in DOC.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = {}
    for i, t in docs:
        w = [x for x in __import__("re").split(r"[^\w]+", (t or "").lower()) if x]
        if w:
            sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])
    rep = {}
    for i, s in sets.items():
        rep.setdefault(s, i)
    want = {(rep[s], i): 1.0 for i, s in sets.items() if rep[s] != i}
    reps = sorted((i, s) for s, i in rep.items())
    for k, (i, s) in enumerate(reps):
        for j, t in reps[k + 1:]:
            x = len(s & t) / len(s | t)
            if x >= 0.8:
                want[i, j] = x
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_null_keys_are_one_key_in_folds(spark):
    items = [(None, i, 10.0 - i, 10.0, 25.0) for i in range(5)] + [(1, i, 1.0, 10.0, 25.0) for i in range(5)]
    df = spark.createDataFrame(items, "plan long, item long, value double, cost double, budget double")
    got = folds.greedy_budget(df, "plan", "item", "value", "cost", "budget")
    assert rows(got.filter("selected").groupBy("plan").count().select(F.coalesce("plan", F.lit(-1)).alias("p"), "count")) == [(-1, 2), (1, 2)]
    calls = spark.createDataFrame([(None, i, f"2024-01-01 00:00:0{i // 5}") for i in range(10)], "svc long, id long, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = folds.sliding_rate_limit(calls, "svc", "t", "id", 3)
    assert got.filter("accepted").count() == 3


def test_segments_cross_time_buckets(spark):
    import random

    rng = random.Random(5)
    data, t = [], 0
    for i in range(400):
        t += rng.choice([1, 5, 30, 70, 4000])
        data.append((rng.choice(["a", "b", None]), i, t))
    df = spark.createDataFrame(data, "k string, id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: (r["k"], r["segment"]) for r in folds.reset_segments(df, "k", "ts", 60, ["id"], bucket_seconds=300).collect()}
    last, seg = {}, {}
    for k, i, s in data:
        if k not in last or s - last[k] >= 60:
            seg[k] = seg.get(k, 0) + 1
        last[k] = s
        assert got[i] == (k, seg[k])


def test_cosine_topk_takes_queries_in_blocks(spark):
    import random

    rng = random.Random(2)
    vec = [(i, [rng.random() - 0.5 for _ in range(4)]) for i in range(50)]
    v = spark.createDataFrame(vec, "id long, v array<double>")
    q = spark.createDataFrame([(i, x) for i, x in vec[:11]], "q long, qv array<double>")
    one = rows(VEC.cosine_topk(v, q, "id", "v", "q", "qv", 3, 0.1), "q", "id", "rank")
    assert one == rows(VEC.cosine_topk(v, q, "id", "v", "q", "qv", 3, 0.1, query_block=4), "q", "id", "rank")
    assert VEC.cosine_topk(v, q.limit(0), "id", "v", "q", "qv", 3).count() == 0


def test_affected_projects_follow_dependents_only(spark):
    changed = spark.createDataFrame([("p0/src/a.ts",)], "file string")
    projects = spark.createDataFrame([(f"p{i}/", i) for i in range(130)], "root string, project long")
    deps = spark.createDataFrame([(i, i + 1) for i in range(99)] + [(5, 0), (120, 121)], "dependency long, dependent long")
    assert rows(INV.affected_projects(changed, projects, deps)) == [(i,) for i in range(100)]
