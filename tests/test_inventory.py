"""Endpoint inventory, catalogue and code metrics on literal source files."""

from conftest import rows
from pyspark.sql import functions as F

from opsmill.operators import inventory as INV
from opsmill.operators import routes as R

NEXT_ROUTE = """
import { NextResponse } from 'next/server'
export async function GET(req) { return NextResponse.json({ok: true}) }
export const POST = async (req) => { const sig = req.headers.get('x-hmac'); return verifyHmac(sig) }
"""
NEST_CTRL = """
@Controller('users')
@UseGuards(AuthGuard('jwt'))
export class UsersController {
  @Get(':id')
  find() {}

  @Post()
  @UseGuards(OktaAuthGuard)
  create() {}
}

@Controller('api/stripe')
export class StripeController {
  @Post('webhook')
  hook() {}
}
"""
GO_MAIN = """
package main
func main() {
  r := chi.NewRouter()
  r.Use(middleware.Logger)
  r.Use(auth.JWTMiddleware)
  r.Get("/health", health)
  r.Post("/orders/{id}", create)
  mux.HandleFunc("GET /metrics", metrics)
  r.HandleFunc("/sbm/v1/ws", ws)
}
"""
MCP_TOOLS = """
export const tools = [
  { name: 'srv-list', description: 'x', inputSchema: { name: 'plain' } },
  { name: 'srv-get' },
  { name: 'srv-list' },
]
"""
PY_MAIN = """
from fastapi import FastAPI
from svc.routes import router as items_router
app = FastAPI()
app.include_router(items_router, prefix="/api")
"""
PY_ROUTES = """
from fastapi import APIRouter, Depends
from svc.admin import admin
router = APIRouter(prefix="/items")
router.include_router(admin, prefix="/admin")

@router.get("/{item_id}")
async def read(item_id: int, user=Depends(get_current_user)):
    return item_id

@router.post("/")
def create(body: dict):
    return body
"""
PY_ADMIN = """
from fastapi import APIRouter, Depends
from svc.routes import router
admin = APIRouter()
admin.include_router(router)

@admin.delete("/purge")
def purge(user=Depends(require_admin)):
    return 1
"""
OPENAPI_JSON = '{"openapi": "3.0.0", "paths": {"/pets": {"get": {}, "post": {}}, "/pets/{id}": {"get": {}, "parameters": []}}}'
OPENAPI_YAML = """openapi: 3.0.0
info:
  title: Billing
paths:
  /invoices:
    get:
      summary: list
    post:
      summary: create
  /invoices/{id}:
    delete:
      summary: remove
"""
ASYNCAPI = ('{"asyncapi": "3.0.0", "channels": {"prices": {"address": "/ws/prices"}, "orders": {"address": "/ws/orders"}}, '
            '"operations": {"sub": {"action": "receive", "channel": {"$ref": "#/channels/prices"}}}}')
AGENT_MD = """---
name: backend-architect
description: Use for "API design" and "service boundaries" questions
model: sonnet
tools: Read, Write
tags: [api, design]
---
# Backend architect
"""
PLAIN_MD = "# No front matter here\n"


def corpus(spark):
    data = [
        ("web", "apps/landing/app/(marketing)/api/[id]/route.ts", NEXT_ROUTE),
        ("web", "apps/landing/app/health/route.js", "export function GET() { return new Response('ok') }"),
        ("core", "src/users/users.controller.ts", NEST_CTRL),
        ("sbm", "cmd/server/main.go", GO_MAIN),
        ("mcp", "servers/pricing/src/tools/tools.ts", MCP_TOOLS),
        ("mcp", "servers/pricing/src/tools/tools.spec.ts", "{ name: 'srv-hidden' }"),
        ("py", "svc/main.py", PY_MAIN),
        ("py", "svc/routes.py", PY_ROUTES),
        ("py", "svc/admin.py", PY_ADMIN),
        ("specs", "specs/pet-store-api-v2.json", OPENAPI_JSON),
        ("specs", "specs/billing-v1.yaml", OPENAPI_YAML),
        ("specs", "specs/prices.json", ASYNCAPI),
        ("docs", "agents/backend-architect.md", AGENT_MD),
        ("docs", "agents/readme-like.md", PLAIN_MD),
    ]
    return spark.createDataFrame(data, "repository string, path string, content string")


def test_nextjs(spark):
    out = rows(R.nextjs_routes(corpus(spark)), "method", "path", "auth")
    assert out == [("GET", "/api/{id}", "signature"), ("GET", "/health", "public"), ("POST", "/api/{id}", "signature")]


def test_nestjs_guards_and_webhook(spark):
    out = rows(R.nestjs_routes(corpus(spark), webhook_paths=["/api/stripe/webhook"]), "method", "path", "auth")
    assert out == [("GET", "/users/{id}", "jwt"), ("POST", "/api/stripe/webhook", "signature"), ("POST", "/users", "okta")]


def test_go_routes(spark):
    out = rows(R.go_routes(corpus(spark)), "method", "path", "auth")
    assert out == [("GET", "/health", "jwt"), ("GET", "/metrics", "jwt"), ("POST", "/orders/{id}", "jwt"), ("WS", "/sbm/v1/ws", "jwt")]


def test_mcp(spark):
    out = rows(R.mcp_tools(corpus(spark)), "method", "path")
    assert out == [("GET", "/pricing/validate"), ("MCP", "srv-get"), ("MCP", "srv-list"), ("POST", "/pricing/mcp")]


def test_fastapi_prefixes_cycle_and_auth(spark):
    out = rows(R.fastapi_routes(corpus(spark)), "method", "path", "auth")
    assert ("GET", "/api/items/{item_id}", "jwt") in out
    assert ("POST", "/api/items", "jwt") in out
    assert ("DELETE", "/api/items/admin/purge", "okta") in out
    assert len(out) == 3  # the admin -> router back edge is a cycle and adds nothing


def test_specs(spark):
    c = corpus(spark)
    assert rows(INV.openapi_paths(c), "repository", "method", "path") == [
        ("pet", "GET", "/pets"), ("pet", "GET", "/pets/{id}"), ("pet", "POST", "/pets")]
    assert rows(INV.openapi_yaml_paths(c), "repository", "method", "path") == [
        ("billing", "DELETE", "/invoices/{id}"), ("billing", "GET", "/invoices"), ("billing", "POST", "/invoices")]
    assert rows(INV.asyncapi_channels(c), "method", "path") == [("WS", "/ws/prices")]


def test_yaml_parents(spark):
    k = INV.yaml_key_scan(corpus(spark)).filter(F.col("path").endswith("billing-v1.yaml"))
    by_key = {(r["key"], r["line"]): r["parent_line"] for r in k.collect()}
    assert by_key[("paths", 4)] is None
    assert by_key[("/invoices", 5)] == 4
    assert by_key[("post", 8)] == 5
    assert by_key[("delete", 11)] == 10


def test_yaml_lines_are_linked_without_a_shuffle(spark):
    import random

    rng = random.Random(6)
    texts = ["\n".join(" " * rng.randrange(8) + f"k{i}: v" if rng.random() < 0.8 else rng.choice(["# a: b", "", "plain"]) for i in range(60)) for _ in range(20)] + ["", None, "plain", "a: 1"]
    files = spark.createDataFrame([("r", f"f{i}.yaml", t) for i, t in enumerate(texts)] + [("r", "f0.yaml", texts[0])], "repository string, path string, content string")
    k = INV.yaml_key_scan(files)
    want = []
    for i, t in [*enumerate(texts), (0, texts[0])]:
        seen = []
        for n, line in enumerate((t or "").split("\n"), 1):
            if ":" in line and not line.strip().startswith("#"):
                indent = len(line) - len(line.lstrip())
                up = [a for a, b in seen if b < indent]
                want.append((f"f{i}.yaml", n, indent, up[-1] if up else None))
                seen.append((n, indent))
    got = [tuple(r) for r in k.select("path", "line", "indent", "parent_line").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert "Exchange" not in k._jdf.queryExecution().executedPlan().toString()


def test_link_and_reconcile(spark):
    spec = spark.createDataFrame([("ecm", "GET", "/a", "unspecified", "OpenAPI spec"), ("ecm", "GET", "/b", "unspecified", "OpenAPI spec")],
                                 ",".join(f"{c} string" for c in INV.ENDPOINT_COLS))
    impl = spark.createDataFrame([("ecm", "jwt", "role_a"), ("ecm", "okta", "role_b")], "repository string, auth string, role string")
    assert rows(INV.link_specs(spec, impl), "path", "auth") == [("/a", "okta"), ("/b", "okta")]
    src = spark.createDataFrame([("core", "GET", "/a", "jwt", "NestJS"), ("core", "GET", "/c", "jwt", "NestJS")],
                                ",".join(f"{c} string" for c in INV.ENDPOINT_COLS))
    merged, stale = INV.reconcile_source_spec(src, spec)
    assert rows(merged, "path", "auth") == [("/a", "jwt"), ("/b", "unspecified"), ("/c", "jwt")]
    assert stale.first()["source_only"] == 1


def test_catalog(spark):
    cat = INV.catalog_docs(corpus(spark)).collect()
    assert len(cat) == 1
    r = cat[0]
    assert r["name"] == "backend-architect" and r["category"] == "Backend & API"
    assert r["triggers"] == ["API design", "service boundaries"] and r["tags"] == ["api", "design"]


def test_code_metrics(spark):
    src = "def a():\n    '''doc'''\n    if x and y:\n        return 1\n\nclass B:\n    def c(self):\n        pass\n" + "\n".join(
        ["def big():"] + ["    x = 1"] * 60)
    c = spark.createDataFrame([("r", "m.py", src)], "repository string, path string, content string")
    cov = INV.doc_coverage(c).first()
    assert (cov["definitions"], cov["documented"]) == (4, 1)
    m = INV.complexity_metrics(c).first()
    assert m["classes"] == 1 and m["functions"] == 3 and m["cyclomatic_estimate"] == 3 and m["max_nesting"] == 2
    big = INV.large_functions(c).collect()
    assert [(b["name"], b["length"]) for b in big] == [("big", 61)]


def test_finding_risk_unknown_severity(spark):
    f = spark.createDataFrame([("a", "CRITICAL"), ("a", "HIGH"), ("a", "weird"), ("b", "LOW")], "doc string, severity string")
    out = {r["doc"]: r for r in INV.finding_risk(f, ["doc"]).collect()}
    assert out["a"]["risk_score"] == 34 and out["a"]["unknown"] == 1 and out["b"]["risk_score"] == 2


def test_affected_projects_prefix_join_and_dependents(spark):
    changed = spark.createDataFrame([("libs/core/src/a.py",), ("docs/readme.md",)], "file string")
    projects = spark.createDataFrame([("core", "libs/core/"), ("api", "apps/api/"), ("web", "apps/web/"), ("tools", "libs/tools/")],
                                     "project string, root string")
    deps = spark.createDataFrame([("core", "api"), ("api", "web"), ("tools", "web")], "dependency string, dependent string")
    got = sorted(r["project"] for r in INV.affected_projects(changed, projects, deps).collect())
    assert got == ["api", "core", "web"]
