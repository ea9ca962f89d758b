"""Endpoint extractors on the shapes that real source files take."""

from conftest import rows

from opsmill.operators import inventory as INV
from opsmill.operators import routes as R


def corpus(spark, *files):
    return spark.createDataFrame([f if len(f) == 3 else ("r", *f) for f in files], "repository string, path string, content string")


def test_next_exports_of_every_form(spark):
    code = """
// export function DELETE() {}
const text = `export const PUT = 1`
async function handler(req) { return ok() }
export { handler as GET, handler as POST }
export const { PATCH, HEAD: OPTIONS } = make({ a: 1 })
export
  async function PUT(req: Request): Promise<{ ok: boolean }> { return ok() }
export default function page() {}
"""
    got = rows(R.nextjs_routes(corpus(spark, ("app/x/route.ts", code), ("app/y/page.ts", code))), "method", "path")
    assert got == [("GET", "/x"), ("OPTIONS", "/x"), ("PATCH", "/x"), ("POST", "/x"), ("PUT", "/x")]


def test_nest_long_headers_and_literal_types(spark):
    wide = ", ".join(f"Contract{i}<{{ a: string }}>".replace("<{ a: string }>", "") for i in range(60))
    code = f"""
@Controller({{ path: 'a', version: '1' }})
@UseGuards(OktaGuard)
export class A extends Base implements {wide} {{
  private readonly max = 3;
  constructor(@Inject(X) private readonly x: X, private y = {{ z: 1 }}) {{}}

  @Get('x')
  async x(@Query() q: Q): Promise<{{ items: {{ id: string }}[]; next?: string }}> {{
    const s = "@Get('inside')"; // @Post('comment')
    return this.run({{ a: () => {{ return 1; }} }});
  }}

  @Post(['y', 'z']) @UseGuards(AuthGuard('jwt'), Other)
  y(): Promise<void> {{}}

  @Delete(
    ':id',
  )
  gone(@Param('id') id: string)
  {{
  }}
}}
"""
    got = rows(R.nestjs_routes(corpus(spark, ("src/a.controller.ts", code))), "method", "path", "auth")
    assert got == [("DELETE", "/a/{id}", "okta"), ("GET", "/a/x", "okta"), ("POST", "/a/y", "jwt"), ("POST", "/a/z", "jwt")]


def test_go_routes_over_lines_and_once(spark):
    code = """
package main
func main() {
  // mux.HandleFunc("/commented", h)
  mux.HandleFunc(
    "POST /a/{id}",
    func(w http.ResponseWriter, r *http.Request) { r.Get("not a path") },
  )
  mux.HandleFunc("/b", b)
  router.Delete(`/c`, c)
  db.Get("/not/a/route", d)
  r.Route("/v1", func(r chi.Router) {
    r.Put("/d", d)
  })
}
"""
    got = rows(R.go_routes(corpus(spark, ("main.go", code))), "method", "path", "auth")
    assert got == [("DELETE", "/c", "public"), ("GET", "/b", "public"), ("POST", "/a/{id}", "public"), ("PUT", "/d", "public")]


def test_go_mounts_of_two_services(spark):
    one = """
package main
import (
  "net/http"
  ordersapi "git.example.org/common/api/orders/v2"
  "git.example.org/common/api/stock/v1"
  "one/internal/conf"
)
func main() {
  r.Use(auth.JWTMiddleware)
  ordersapi.HandlerWithOptions(srv, ordersapi.ChiServerOptions{BaseURL: conf.OrdersBase, BaseRouter: r})
  h := stock.HandlerFromMuxWithBaseURL(
    srv,
    r,
    basePath,
  )
}
"""
    two = """
package main
import ordersapi "git.example.org/common/api/orders/v2"
func main() {
  s := &http.Server{Handler: apiKeyMiddleware(ordersapi.HandlerFromMux(srv, mux)), Addr: ":80"}
}
"""
    files = [("one", "cmd/api/main.go", one), ("one", "cmd/api/base.go", 'package main\nconst basePath string = "/stock/v1"\n'), ("one", "cmd/job/main.go", "package main\nfunc main() {}\n"),
             ("one", "internal/conf/conf.go", 'package conf\nconst (\n  OrdersBase = "/orders/v2"\n  Other = "/no"\n)\n'), ("one", "internal/else/e.go", 'package e\nvar OrdersBase = "/wrong"\n'),
             ("two", "cmd/main.go", two), ("two", "cmd/main_test.go", one), ("three", "cmd/main.go", 'package main\nimport "git.example.org/common/api/stock/v1"\n')]
    mounts = R.go_spec_mounts(corpus(spark, *files))
    assert rows(mounts, "repository", "service", "base_url", "auth") == [
        ("one", "orders", "/orders/v2", "jwt"), ("one", "stock", "/stock/v1", "jwt"), ("three", "stock", "", "public"), ("two", "orders", "", "api-key")]
    spec = '{"openapi": "3.0.0", "paths": {"/items/{id}": {"get": {}, "put": {}}}}'
    specs = INV.openapi_paths(corpus(spark, ("specs", "specs/orders-api-v2.json", spec)))
    got = rows(R.mounted_spec_routes(specs, mounts), "repository", "method", "path", "auth")
    assert got == [("one", "GET", "/orders/v2/items/{id}", "jwt"), ("one", "PUT", "/orders/v2/items/{id}", "jwt"),
                   ("two", "GET", "/items/{id}", "api-key"), ("two", "PUT", "/items/{id}", "api-key")]


def test_go_websocket_origins(spark):
    loose = "package main\nvar up = websocket.Upgrader{\n  ReadBufferSize: 1024,\n  CheckOrigin: func(r *http.Request) bool {\n    return true\n  },\n}\n"
    strict = "package main\nvar up = websocket.Upgrader{CheckOrigin: func(r *http.Request) bool { return ok(r) }}\n"
    got = rows(R.go_websocket_origins(corpus(spark, ("a.go", loose), ("b.go", strict), ("c.go", "package main\n"))), "path", "permissive")
    assert got == [("a.go", True), ("b.go", False)]


def test_fastapi_decorators_over_lines(spark):
    main = """
from fastapi import FastAPI
from svc.api import (
    items,  # a module
    users as people,
)
from .shop import router as shop
app = FastAPI(
    title="x",
)
app.include_router(items.router, prefix="/v1", tags=["a"])
app.include_router(people.router)
app.include_router(
    router=shop,
    prefix="/shop",
)
"""
    items = '''
from fastapi import APIRouter, Depends
Admin = Annotated[str, Depends(require_admin)]
router: APIRouter = APIRouter(
    prefix="/items", tags=["items"],
    responses={404: {"description": "no (really)"}},
)

@router.get(
    "/a",
    response_model=X,
    responses={404: {"model": Y}},
)
async def a(who: Admin) -> dict[str, int]:
    """@router.get("/docstring")"""
    return {}

@cached(ttl=60)
@router.post(status_code=201, path="/b", dependencies=[Depends(verify_hook)])
@traced
def b(
    body: dict = Body(...),
):
    # @router.get("/comment")
    return 1

class Service:
    @router.websocket("/ws")
    async def ws(self, key: str = Header(..., alias="X-Api-Key")): ...

@router.get("/plain")
def plain(page: str = Header(alias="X-Page"), q: int = Query(1, alias="token")): return 1
'''
    users = "from fastapi import APIRouter\nrouter = APIRouter()\n@router.delete('/users/{id}',\n  name='x')\ndef f(u=Depends(get_current_user)): pass\n"
    files = [("svc/main.py", main), ("svc/api/__init__.py", ""), ("svc/api/items.py", items), ("svc/api/users.py", users),
             ("svc/shop/__init__.py", "from .routes import router\n"), ("svc/shop/routes.py", "from fastapi import APIRouter\nrouter = APIRouter()\n@router.get('/')\ndef f(): pass\n")]
    got = rows(R.fastapi_routes(corpus(spark, *files), allow_public=["/shop"]), "method", "path", "auth", "source_kind")
    assert got == [("DELETE", "/users/{id}", "jwt", "FastAPI"), ("GET", "/shop", "public", "FastAPI"), ("GET", "/v1/items/a", "okta", "FastAPI"), ("GET", "/v1/items/plain", "jwt", "FastAPI"),
                   ("POST", "/v1/items/b", "signature", "FastAPI"), ("WS", "/v1/items/ws", "api-key", "FastAPI WS")]


def test_mcp_names_in_strings_and_comments_do_not_count(spark):
    code = "// { name: 'no-comment' }\nexport const t = { name: `srv-a`, description: \"name: 'not-this'\" }\nregister({ name : \"srv-b\", x: { name: 'plain' } })\n"
    got = rows(R.mcp_tools(corpus(spark, ("servers/s/src/tools/t.ts", code))), "method", "path")
    assert got == [("GET", "/s/validate"), ("MCP", "srv-a"), ("MCP", "srv-b"), ("POST", "/s/mcp")]


def test_functions_with_nested_definitions_keep_their_length(spark):
    code = "def outer():\n" + "    x = 1\n" * 30 + "    def inner():\n        return 1\n" + "    y = 2\n" * 30 + "def after():\n    pass\nclass K:\n    def m(self):\n" + "        z = 1\n" * 55 + "    def n(self):\n        pass\n"
    got = rows(INV.large_functions(corpus(spark, ("m.py", code))), "name", "length")
    assert got == [("m", 56), ("outer", 63)]
