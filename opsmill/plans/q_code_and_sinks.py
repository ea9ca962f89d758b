"""Registered queries for the extractors (C2-C9, C14, C22) and for sources and sinks (S4-S6,
S8-S11, X4, Q5, Q13).

No given table holds source files, so each extractor runs on a corpus that Spark derives
from ``part``: one file for every part, whose text depends on the part's columns. The SQL
twins say what the extractor must find, straight from those columns. Sinks write whole
tables to a new folder beside the checkpoints, and the query returns what is read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmill.operators import folds
from opsmill.operators import inventory as INV
from opsmill.operators import routes
from opsmill.operators import quality as QUAL
from opsmill.plans.registry import register, ts_text
from opsmill.session import scratch_path
from opsmill.sources import files as S
from opsmill.tables import Tables


def _corpus(spark, sf: str, path: str, content: str) -> DataFrame:
    """One file a part: SQL templates over the part's columns (``k`` is its key as text)."""
    part = Tables(spark, sf).part.withColumn("k", F.col("p_partkey").cast("string"))
    return part.select(F.col("p_brand").alias("repository"), F.expr(path).alias("path"), F.expr(content).alias("content"))


# ----------------------------------------------------------------------------- C2-C6
@register("c2_nextjs_routes", sql="""
SELECT p_brand AS repository, m AS method, '/parts/' || CAST(p_partkey AS VARCHAR) || '/{id}' AS path,
  CASE p_partkey % 4 WHEN 0 THEN 'signature' WHEN 1 THEN 'api-key' WHEN 2 THEN 'jwt' ELSE 'public' END AS auth, 'Next.js' AS source_kind
FROM part, (VALUES ('GET'), ('POST')) v(m) WHERE m = 'GET' OR p_size % 2 = 1
""")
def q_c2(spark, sf):
    return routes.nextjs_routes(_corpus(spark, sf, "concat('web/app/(shop)/parts/', k, '/[id]/route.ts')", """concat(
      'export async function GET(req) { return ', CASE p_partkey % 4 WHEN 0 THEN 'checkHmac(req)' WHEN 1 THEN 'req.headers["x-service-api-key"]'
      WHEN 2 THEN 'getServerSession()' ELSE 'ok()' END, ' }\\n', CASE WHEN p_size % 2 = 1 THEN 'export const POST = async (req) => ok()\\n' ELSE '' END)"""))


@register("c3_nestjs_routes", sql="""
SELECT p_brand AS repository, m AS method, '/p' || CAST(p_partkey AS VARCHAR) || CASE m WHEN 'GET' THEN '/{id}' ELSE '' END AS path,
  CASE WHEN m = 'POST' AND p_partkey % 5 = 0 THEN 'api-key' ELSE CASE p_partkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'jwt' ELSE 'okta' END END AS auth,
  'NestJS' AS source_kind FROM part, (VALUES ('GET'), ('POST')) v(m)
""")
def q_c3(spark, sf):
    return routes.nestjs_routes(_corpus(spark, sf, "concat('src/p', k, '.controller.ts')", """concat(
      CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN "@UseGuards(AuthGuard('jwt'))\\n" ELSE '@UseGuards(OktaGuard)\\n' END,
      "@Controller('p", k, "')\\nexport class C", k, " {\\n  @Get(':id')\\n  find(id: string) { return this.x(id) }\\n\\n",
      CASE WHEN p_partkey % 5 = 0 THEN '  @UseGuards(ServiceApiKeyGuard)\\n' ELSE '' END, '  @Post()\\n  async create(@Body() dto: Dto): Promise<Dto> { return dto }\\n}\\n')"""))


@register("c4_go_routes", sql="""
SELECT p_brand AS repository, m AS method, CASE m WHEN 'GET' THEN '/p/' ELSE '/q/' END || CAST(p_partkey AS VARCHAR) || CASE m WHEN 'WS' THEN '/ws' ELSE '' END AS path,
  CASE p_partkey % 5 WHEN 0 THEN 'public' WHEN 1 THEN 'jwt' WHEN 2 THEN 'okta' WHEN 3 THEN 'api-key' ELSE 'jwt' END AS auth, 'Go net/http' AS source_kind
FROM part, (VALUES ('GET'), ('POST'), ('WS')) v(m)
""")
def q_c4(spark, sf):
    return routes.go_routes(_corpus(spark, sf, "concat('cmd/', k, '/main.go')", """concat('package main\\nfunc main() {\\n',
      CASE p_partkey % 5 WHEN 0 THEN '  r.Use(middleware.Logger)\\n' WHEN 1 THEN '  r.Use(sessionMiddleware)\\n' WHEN 2 THEN '  r.Use(oktaMiddleware)\\n'
      WHEN 3 THEN '  h := corsMiddleware(apiKeyMiddleware(mux))\\n  s := &http.Server{\\n    Handler: h,\\n  }\\n' ELSE '  s := &http.Server{Handler: jwtMiddleware(mux)}\\n' END,
      '  mux.HandleFunc("GET /p/', k, '", get)\\n  r.Post("/q/', k, '", post)\\n  r.HandleFunc("/q/', k, '/ws", ws)\\n}\\n')"""))


@register("c4_go_spec_mounts", sql="""
SELECT p_brand || '-' || CAST(p_partkey AS VARCHAR) AS repository, m AS method,
  CASE p_partkey % 3 WHEN 0 THEN '/lit' || CAST(p_size AS VARCHAR) WHEN 1 THEN '/const' || CAST(p_size AS VARCHAR) ELSE '' END || '/p/' || CAST(p_size AS VARCHAR) AS path,
  CASE p_partkey % 2 WHEN 0 THEN 'jwt' ELSE 'public' END AS auth, 'Go OpenAPI handler' AS source_kind
FROM part, (VALUES ('GET'), ('PUT')) v(m) WHERE m = 'GET' OR p_size % 3 = 0
""")
def q_c4_mounts(spark, sf):
    """One repository a part: a main file that mounts a generated handler, its constants in a package
    of their own, and the service's specification."""
    def files(path, content):
        return _corpus(spark, sf, path, content).withColumn("repository", F.concat_ws("-", "repository", F.regexp_extract("path", r"(\d+)", 1)))

    main = files("concat('svc', k, '/cmd/api/main.go')", """concat('package main\\n\\nimport (\\n  gen "example.org/common/api/s', k, '/v1"\\n  "example.org/svc/paths"\\n)\\n\\nfunc main() {\\n',
      CASE p_partkey % 2 WHEN 0 THEN '  r.Use(\\n    sessionMiddleware,\\n  )\\n' ELSE '  r.Use(middleware.Logger)\\n' END,
      CASE p_partkey % 3 WHEN 0 THEN concat('  h := gen.HandlerFromMuxWithBaseURL(\\n    newServer(a, b), r, "/lit', CAST(p_size AS string), '",\\n  )\\n')
      WHEN 1 THEN '  gen.HandlerWithOptions(srv, gen.ChiServerOptions{\\n    BaseURL: paths.Base,\\n    BaseRouter: r,\\n  })\\n' ELSE '' END, '}\\n')""")
    consts = files("concat('svc', k, '/internal/paths/paths.go')", """concat('package paths\\n\\nconst (\\n  Base = "/const', CAST(p_size AS string), '"\\n)\\n')""")
    specs = _corpus(spark, sf, "concat('specs/s', k, '-v1.json')", """concat('{"openapi": "3.0.0", "paths": {"/p/', CAST(p_size AS string), '": {"get": {}',
      CASE WHEN p_size % 3 = 0 THEN ', "put": {}' ELSE '' END, '}}}')""")
    return routes.mounted_spec_routes(INV.openapi_paths(specs), routes.go_spec_mounts(main.unionByName(consts)))


@register("c5_mcp_tools", sql="""
SELECT DISTINCT p_brand AS repository, m AS method, '/s' || CAST(p_size AS VARCHAR) || CASE m WHEN 'POST' THEN '/mcp' ELSE '/validate' END AS path,
  'api-key' AS auth, 'MCP HTTP' AS source_kind FROM part, (VALUES ('GET'), ('POST')) v(m)
UNION ALL SELECT DISTINCT p_brand, 'MCP', 'tool-' || CAST(p_partkey // 2 AS VARCHAR), 'api-key', 'MCP tool' FROM part
""")
def q_c5(spark, sf):
    return routes.mcp_tools(_corpus(spark, sf, "concat('servers/s', CAST(p_size AS string), '/src/tools/t', k, '.ts')",
                                 """concat("export const tools = [\\n  { name: 'tool-", CAST(p_partkey div 2 AS string), "', schema: { name: 'plain' } },\\n]\\n")"""))


@register("c6_fastapi_mounts", sql="""
SELECT p_brand AS repository, CASE v.i WHEN 1 THEN 'GET' ELSE 'POST' END AS method,
  '/v' || CAST(p_size AS VARCHAR) || '/items' || CAST(p_partkey AS VARCHAR) || CASE v.i WHEN 1 THEN '/a' ELSE '/b' END AS path,
  CASE WHEN v.i = 1 THEN CASE p_partkey % 3 WHEN 0 THEN 'okta' WHEN 1 THEN 'jwt' ELSE 'signature' END ELSE 'api-key' END AS auth, 'FastAPI' AS source_kind
FROM part, (VALUES (1), (2)) v(i)
""")
def q_c6(spark, sf):
    main = _corpus(spark, sf, "concat('svc/main', k, '.py')", """concat('from fastapi import FastAPI\\nfrom svc.r', k, ' import router as items\\n',
      CASE WHEN p_partkey % 2 = 0 THEN concat('app = FastAPI()\\napp.include_router(items, prefix="/v', CAST(p_size AS string), '")\\n')
      ELSE concat('def register_routes(app):\\n    app.include_router(items, prefix="/v', CAST(p_size AS string), '")\\n') END)""")
    parts = _corpus(spark, sf, "concat('svc/r', k, '.py')", """concat('from fastapi import APIRouter, Depends, Header\\nDep = Annotated[str, Depends(',
      CASE p_partkey % 3 WHEN 0 THEN 'require_admin' WHEN 1 THEN 'get_current_user' ELSE 'verify_request' END, ')]\\nrouter = APIRouter(prefix="/items', k, '")\\n',
      '@router.get("/a")\\nasync def a(who: Dep):\\n    pass\\n\\n@router.post("/b")\\nasync def b(key: str = Header(alias="X-Api-Key")):\\n    pass\\n')""")
    return routes.fastapi_routes(main.unionByName(parts))


# ----------------------------------------------------------------------------- C7-C9 specs
@register("c7_openapi_paths", sql="""
SELECT 'part' || CAST(p_partkey AS VARCHAR) AS repository, m AS method, '/p/' || CAST(p_size AS VARCHAR) AS path, 'unspecified' AS auth, 'OpenAPI spec' AS source_kind
FROM part, (VALUES ('GET'), ('PUT')) v(m) WHERE m = 'GET' OR p_size % 3 = 0
UNION ALL SELECT 'yaml' || CAST(p_partkey AS VARCHAR), 'DELETE', '/y/' || CAST(p_size AS VARCHAR), 'unspecified', 'OpenAPI spec' FROM part
""")
def q_c7(spark, sf):
    js = _corpus(spark, sf, "concat('specs/part', k, '-v1.json')", """concat('{"openapi": "3.0.0", "paths": {"/p/', CAST(p_size AS string), '": {"get": {}, "parameters": []',
      CASE WHEN p_size % 3 = 0 THEN ', "put": {}' ELSE '' END, '}}}')""")
    ym = _corpus(spark, sf, "concat('specs/yaml', k, '-v2.yaml')", "concat('openapi: 3.0.0\\ninfo:\\n  title: t\\npaths:\\n  /y/', CAST(p_size AS string), ':\\n    delete:\\n      summary: x\\n')")
    return INV.openapi_paths(js).unionByName(INV.openapi_yaml_paths(ym))


@register("c8_asyncapi_channels", sql="""
SELECT 'feed' || CAST(p_partkey AS VARCHAR) AS repository, 'WS' AS method, CASE WHEN p_size % 2 = 0 THEN '/ws/' || CAST(p_size AS VARCHAR) ELSE 'prices' END AS path,
  'unspecified' AS auth, 'AsyncAPI spec' AS source_kind FROM part
""")
def q_c8(spark, sf):
    return INV.asyncapi_channels(_corpus(spark, sf, "concat('specs/feed', k, '-v1.json')", """concat('{"asyncapi": "3.0.0", "channels": {"prices": {',
      CASE WHEN p_size % 2 = 0 THEN concat('"address": "/ws/', CAST(p_size AS string), '"') ELSE '' END,
      '}}, "operations": {"send": {"channel": {"$ref": "#/channels/prices"}}}}')"""))


@register("c9_yaml_key_scan", sql="""
SELECT p_brand AS repository, 'conf/' || CAST(p_partkey AS VARCHAR) || '.yaml' AS path, i AS line, (i - 1) * 3 AS indent, 'k' || CAST(i AS VARCHAR) AS key,
  CASE WHEN i = p_size % 20 + 1 THEN 'v' || CAST(p_size AS VARCHAR) ELSE '' END AS value, CASE WHEN i > 1 THEN i - 1 END IS NULL AS top, coalesce(i - 1, 0) AS parent
FROM (SELECT *, unnest(range(1, p_size % 20 + 2)) AS i FROM part)
""")
def q_c9(spark, sf):
    """Keys nested as deep as the part's size says, three blanks a level."""
    text = """array_join(transform(sequence(1, p_size % 20 + 1), i -> concat(repeat(' ', (i - 1) * 3), 'k', CAST(i AS string), ':',
      CASE WHEN i = p_size % 20 + 1 THEN concat(' v', CAST(p_size AS string)) ELSE '' END)), '\\n')"""
    k = INV.yaml_key_scan(_corpus(spark, sf, "concat('conf/', k, '.yaml')", text))
    return k.select("repository", "path", F.col("line").cast("long").alias("line"), F.col("indent").cast("long").alias("indent"), "key", "value",
                    F.col("parent_line").isNull().alias("top"), F.coalesce(F.col("parent_line").cast("long"), F.lit(0)).alias("parent"))


# ----------------------------------------------------------------------------- C14, C22
_PY = """concat('class A:\\n    \\"\\"\\"doc\\"\\"\\"\\n\\n    def f(self):\\n', CASE WHEN p_partkey % 2 = 0 THEN '        \\"\\"\\"does f\\"\\"\\"\\n' ELSE '' END,
  repeat('        x = 1\\n', p_size), '\\ndef g():\\n    return 2\\n')"""


@register("c14_doc_coverage", sql="""
SELECT p_brand AS repository, 'lib/m' || CAST(p_partkey AS VARCHAR) || '.py' AS path, 3 AS definitions, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS documented,
  round(CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END / 3.0 * 100, 4) AS coverage_pct FROM part
""")
def q_c14(spark, sf):
    c = INV.doc_coverage(_corpus(spark, sf, "concat('lib/m', k, '.py')", _PY))
    return c.withColumn("coverage_pct", F.round("coverage_pct", 4))


@register("c22_large_functions", sql="""
SELECT p_brand AS repository, 'lib/m' || CAST(p_partkey AS VARCHAR) || '.py' AS path, 'f' AS name, CAST(4 AS BIGINT) AS line_no,
  CAST(p_size + 2 + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS length FROM part WHERE p_size + 2 + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END > 30
""")
def q_c22(spark, sf):
    f = INV.large_functions(_corpus(spark, sf, "concat('lib/m', k, '.py')", _PY), max_lines=30)
    return f.select("repository", "path", "name", F.col("line_no").cast("long").alias("line_no"), F.col("length").cast("long").alias("length"))


# ----------------------------------------------------------------------------- S4-S11
ORDERS_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority"""


@register("s4_decode_bus_events", sql="SELECT CAST(user_id AS VARCHAR) AS key, event_type AS topic, event_id, value FROM events")
def q_s4(spark, sf):
    """Whole event table encoded for the bus, written, read as a stream and decoded (the file
    form of the bus; the connector jar is not installed here)."""
    raw = S.encode_events(Tables(spark, sf).events, "event_type", "user_id", ["event_id", "value"])
    place = scratch_path(spark, "bus")
    raw.write.parquet(f"{place}/in")
    stream = S.bus_reader(spark, "events", "", fmt="parquet").schema(raw.schema).load(f"{place}/in")
    decoded = S.decode_events(stream, "event_id long, value double").select("key", "topic", "event.*")
    S.bus_writer(decoded, "", f"{place}/checkpoint", fmt="parquet", path=f"{place}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/out")


@register("s5_encode_bus_events", sql="""
SELECT event_type AS topic, CAST(user_id AS VARCHAR) AS key, '{"event_id":' || CAST(event_id AS VARCHAR) || ',"event_type":"' || event_type || '"}' AS value FROM events
""")
def q_s5(spark, sf):
    return S.encode_events(Tables(spark, sf).events, "event_type", "user_id", ["event_id", "event_type"])


@register("s6_bulk_load_csv", sql=ORDERS_SQL + " FROM orders")
def q_s6(spark, sf):
    orders = Tables(spark, sf).orders.withColumn("o_orderdate", ts_text("o_orderdate"))
    place = scratch_path(spark, "csv")
    orders.write.option("header", True).csv(f"{place}/raw")
    S.append_table(S.bulk_load_csv(spark, f"{place}/raw", orders.schema), f"{place}/table")
    return spark.read.parquet(f"{place}/table")


@register("s8_chunked_copy", sql=ORDERS_SQL + " FROM orders")
def q_s8(spark, sf):
    place = scratch_path(spark, "copy")
    S.chunked_copy(Tables(spark, sf).orders.withColumn("o_orderdate", ts_text("o_orderdate")), place, "o_orderkey", rows_per_file=1000)
    return spark.read.parquet(place)


@register("s9_read_text_corpus", sql="SELECT s_suppkey, s_name || chr(10) || 'second line' || chr(10) AS content FROM supplier WHERE s_nationkey <> 3")
def q_s9(spark, sf):
    """One text file for each supplier, read back whole; files in a skipped folder are left out."""
    place = scratch_path(spark, "corpus")
    sup = Tables(spark, sf).supplier.select(F.when(F.col("s_nationkey") == 3, "test").otherwise("src").alias("folder"), "s_suppkey",
                                           F.explode(F.array(F.struct(F.lit(0).alias("i"), F.col("s_name").alias("value")), F.struct(F.lit(1).alias("i"), F.lit("second line").alias("value")))).alias("l"))
    rows = sup.select("folder", "s_suppkey", "l.i", "l.value").repartition("s_suppkey").sortWithinPartitions("s_suppkey", "i")
    rows.select("folder", "s_suppkey", "value").write.partitionBy("folder", "s_suppkey").text(place)
    got = S.read_text_corpus(spark, place, skip_substrings=("folder=test/",))
    return got.select(F.regexp_extract("path", r"s_suppkey=(\d+)", 1).cast("long").alias("s_suppkey"), "content")


@register("s10_write_batches", sql=ORDERS_SQL + ", CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 5000) AS INTEGER) AS batch FROM orders")
def q_s10(spark, sf):
    place = scratch_path(spark, "batches")
    orders = Tables(spark, sf).orders.withColumn("o_orderdate", ts_text("o_orderdate"))
    S.write_batches(orders, place, ["o_orderkey"], size=5000, upsert_keys=["o_orderkey"])
    back = spark.read.json(f"{place}/batches")
    return back.select(*orders.columns, F.col("batch").cast("int").alias("batch"))


@register("s11_write_json_report", sql="SELECT n_nationkey AS id, n_name AS what, 'rows' AS part FROM nation UNION ALL SELECT r_regionkey, r_name, 'warnings' FROM region")
def q_s11(spark, sf):
    t = Tables(spark, sf)
    place = scratch_path(spark, "report")
    S.write_json_report(t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("what")),
                        t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("what")), place, ["id"], "2001-09-01T00:00:00")
    parts = [spark.read.json(f"{place}/{p}").select(F.col("id").cast("int").alias("id"), "what", F.lit(p).alias("part")) for p in ("rows", "warnings")]
    return parts[0].unionByName(parts[1])


# ----------------------------------------------------------------------------- X4, Q5, Q13
class _RunningBalance(folds.Fold):
    """Balance that never falls below zero: a state that no window frame can carry."""

    def init(self, key):
        return 0.0

    def step(self, state, row):
        state = max(0.0, state + row["delta"])
        return state, {"user_id": row["user_id"], "event_id": row["event_id"], "balance": state}


@register("x4_grouped_state", sql="""
WITH RECURSIVE e AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN -50.0 ELSE 10.0 END::DOUBLE AS delta,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
walk AS (SELECT user_id, event_id, n, greatest(0.0, delta)::DOUBLE AS balance FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, greatest(0.0, w.balance + e.delta)::DOUBLE FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, event_id, balance FROM walk
""")
def q_x4(spark, sf):
    e = Tables(spark, sf).events.select("user_id", "event_id", F.when(F.col("event_type") == "purchase", -50.0).otherwise(10.0).alias("delta"))
    schema = T.StructType([e.schema["user_id"], e.schema["event_id"], T.StructField("balance", T.DoubleType())])
    return folds.ordered_fold(e, ["user_id"], ["event_id"], _RunningBalance(), schema)


@register("q5_gated_migration", sql="""
SELECT 'complete' AS attempt, true AS published, count(*) AS written, '' AS failed FROM customer
UNION ALL SELECT 'partial', false, count_if(c_acctbal >= 0)::BIGINT, 'row_count' FROM customer
""")
def q_q5(spark, sf):
    """Two migrations of the customer table to a new place: a whole one passes its post-checks
    and is published, one that leaves rows out is not."""
    c = Tables(spark, sf).customer
    n = c.count()
    checks = [("row_count", lambda d: d.count() == n), ("no_null_key", lambda d: d.filter("c_custkey is null").isEmpty())]
    out = []
    for name, df in (("complete", c), ("partial", c.filter("c_acctbal >= 0"))):
        place = scratch_path(spark, f"migration-{name}")
        done = QUAL.gated_publish(df, place, checks)
        out.append(spark.read.parquet(place).agg(F.count(F.lit(1)).alias("written")).select(
            F.lit(name).alias("attempt"), F.lit(done["published"]).alias("published"), "written", F.lit(",".join(done["failed_checks"])).alias("failed")))
    return out[0].unionByName(out[1])


@register("q13_index_usage_report", sql="""
WITH s AS (SELECT p_name || CAST(p_partkey AS VARCHAR) AS relname, p_size AS seq_scan, p_partkey * 10 AS seq_tup_read, p_partkey % 5 AS idx_scan, p_partkey * 7 AS index_size FROM part)
SELECT relname, 'seq' AS kind, round(seq_tup_read / seq_scan, 4) AS figure FROM (
  SELECT * FROM s WHERE seq_scan >= 1 ORDER BY seq_tup_read / seq_scan DESC, relname LIMIT 10)
UNION ALL SELECT relname, 'unused', CAST(index_size AS DOUBLE) FROM s WHERE idx_scan = 0
""")
def q_q13(spark, sf):
    p = Tables(spark, sf).part
    stats = p.select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("relname"), F.col("p_size").alias("seq_scan"), (F.col("p_partkey") * 10).alias("seq_tup_read"),
                     (F.col("p_partkey") % 5).alias("idx_scan"), (F.col("p_partkey") * 7).alias("index_size"))
    rep = QUAL.index_usage_report(stats)
    seq = rep["seq_scans"].select("relname", F.lit("seq").alias("kind"), F.round("avg_tuples_per_scan", 4).alias("figure"))
    return seq.unionByName(rep["unused_indexes"].select("relname", F.lit("unused").alias("kind"), F.col("index_size").cast("double").alias("figure")))
