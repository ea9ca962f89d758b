"""Endpoint extractors over source files.

Input is a corpus ``(repository, path, content)``; results are rows of the endpoint table
``(repository, method, path, auth, source_kind)``. Files are cut into statements of tokens
(``functions.source_code``), so an argument list may run over any number of lines, a class header
may have any length, and comments and strings never look like code. Names are resolved across files
by joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmill.functions import source_code as S
from opsmill.functions.text import file_route_to_path, glob_match, normalize_path
from opsmill.session import cut_lineage

ENDPOINT_COLS = ["repository", "method", "path", "auth", "source_kind"]
HTTP_VERBS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]
# Access-gate labels, weakest to strongest.
AUTH_PRIORITY = {"unspecified": 0, "public": 1, "jwt": 2, "okta": 3, "api-key": 4, "signature": 5}
_FILE = ["repository", "path"]


def _has_any(col: Column, words: Sequence[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | col.contains(w)
    return cond


def _rows(df: DataFrame) -> DataFrame:
    return df.select(*ENDPOINT_COLS)


# ----------------------------------------------------------------------------- C2 Next.js
# Keywords that reveal a handler-level check in a route module.
NEXT_SIGNATURE = ["hmac"]
NEXT_API_KEY = ["x-service-api-key", "service_api_key", "landingapikey"]
NEXT_JWT = ["requireauth", "getserversession", "verify_jwt"]
_BETWEEN = ["async", "function", "*", "const", "let", "var"]


def nextjs_routes(corpus: DataFrame, app_dir: str = "app") -> DataFrame:
    """``<app>/**/route.(ts|tsx|js|mjs)`` files -> one row per exported HTTP verb.

    URL from the folder path (groups and slots dropped, ``[id]`` -> ``{id}``). A verb is exported by
    name (a function or a variable) or in a brace list, by its last name (``{ a as GET }``, ``const {
    GET } = handlers``); auth from keywords anywhere in the file (hmac > api-key header >
    session/JWT > public)."""
    rx = rf"(?:^|/){app_dir}/(.*?)/?route\.(?:ts|tsx|js|mjs)$"
    files = corpus.filter(F.col("path").rlike(rx))
    w = Window.partitionBy(*_FILE).orderBy("seg")
    parts = S.segments(files, "script").withColumn("next", F.lead("ts").over(w))
    parts = parts.filter(F.exists("ts", lambda x: x["t"] == "export"))
    ts, after = F.col("ts"), F.col("next")
    at = F.get(S.places(ts, lambda i: S.tok(ts, i) == "export"), F.lit(0))
    name = F.get(S.places(ts, lambda i: (i > at) & ~S.tok(ts, i).isin(*_BETWEEN)), F.lit(0))
    listed = F.transform(S.places(after, lambda i: S.tok(after, i + 1).isin(",", "}")), lambda i: S.tok(after, i))
    names = F.when(S.tok(ts, name) == "{", F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.array(S.tok(ts, name)))
    verbs = parts.select(*_FILE, F.explode(F.filter(names, lambda v: v.isin(*HTTP_VERBS))).alias("method")).distinct()
    low = F.lower("content")
    auth = (F.when(_has_any(low, NEXT_SIGNATURE), "signature").when(_has_any(low, NEXT_API_KEY), "api-key")
            .when(_has_any(low, NEXT_JWT), "jwt").otherwise("public"))
    files = files.select(*_FILE, auth.alias("auth"), file_route_to_path(F.regexp_extract("path", rx, 1)).alias("url"))
    out = verbs.join(files, _FILE).select("repository", "method", F.col("url").alias("path"), "auth", F.lit("Next.js").alias("source_kind"))
    return _rows(out)


# ----------------------------------------------------------------------------- C3 NestJS
NEST_VERBS = ["Get", "Post", "Put", "Patch", "Delete"]
# Parts of a guard's name that mark an API-key check.
NEST_KEY_GUARDS = ["agenticapikey", "landingapikey", "serviceapikey", "apikey"]


def nest_guard_auth(guards: Column, path: Column, webhook_paths: Sequence[str] = ()) -> Column:
    """Classify the guards protecting a route; routes of ``webhook_paths`` check a signature inside."""
    low = F.lower(F.array_join(guards, ", "))
    signed = path.isin(*webhook_paths) if webhook_paths else F.lit(False)
    return (F.when(signed, "signature").when(F.size(guards) == 0, "public").when(low.contains("okta"), "okta")
            .when(_has_any(low, NEST_KEY_GUARDS), "api-key").otherwise("jwt"))


def _decorators(ts: Column, names: Sequence[str]) -> Column:
    """Places of the names of decorators outside of any bracket."""
    return S.places(ts, lambda i: (S.tok(ts, i - 1) == "@") & S.tok(ts, i).isin(*names) & (S.depth(ts, i) <= 0))


def _route_arguments(ts: Column, i: Column) -> Column:
    """Paths in a decorator's argument: a string, the ``path`` of an object, or a list of strings; '' without."""
    def paths(args: Column) -> Column:
        one = F.coalesce(S.keyword(args, "path", ":"), F.when(S.is_string(S.tok(args, 0)), S.unquote(S.tok(args, 0))), F.lit(""))
        many = F.when(S.tok(args, 0) == "[", S.strings(S.inside(args, F.lit(0))))
        return S.let(many, lambda m: F.when(F.size(m) > 0, m).otherwise(F.array(one)))

    return S.let(i, lambda p: F.when(S.tok(ts, p + 1) == "(", S.let(S.inside(ts, p + 1), paths)).otherwise(F.array(F.lit(""))))


def nestjs_routes(corpus: DataFrame, global_prefix: str = "", exclude: Sequence[str] = (), webhook_paths: Sequence[str] = ()) -> DataFrame:
    """``@Controller(base)`` classes and ``@Get/@Post/...`` handlers -> endpoint rows.

    Decorators stand in front of what they decorate, in any order. Braces and semicolons outside
    of parentheses end a statement, so one statement holds a class header, or a handler's
    signature up to its body, with all decorators, whatever their length. Guards of a handler replace those
    of its class. Only ``*.controller.ts`` files count, not their specs. Duplicate (path,
    method) keep the last handler by (file, position)."""
    files = corpus.filter(F.col("path").rlike(r"\.controller\.ts$") & F.col("content").contains("@Controller"))
    ts = F.col("ts")
    guards = F.transform(_decorators(ts, ["UseGuards"]), lambda i: S.text_of(S.inside(ts, i + 1)))
    head = F.get(_decorators(ts, ["Controller"]), F.lit(0))
    decorated = S.segments(files, "script").filter(F.exists(ts, lambda c: c["t"] == "@"))  # the other statements hold no route
    x = decorated.select(*_FILE, "seg", head.isNotNull().alias("is_class"), F.get(_route_arguments(ts, head), F.lit(0)).alias("base"), guards.alias("guards"),
                                           F.transform(_decorators(ts, NEST_VERBS), lambda i: F.struct(S.tok(ts, i).alias("verb"), _route_arguments(ts, i).alias("paths"))).alias("routes"))
    x = x.filter(F.col("is_class") | (F.size("routes") > 0))
    w = Window.partitionBy(*_FILE).orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    header = F.last(F.when(F.col("is_class"), F.struct("base", "guards")), ignorenulls=True).over(w)
    r = x.withColumn("c", header).filter(~F.col("is_class") & F.col("c").isNotNull())
    r = r.select("repository", F.col("path").alias("file"), "seg", "c", "guards", F.explode("routes").alias("r")).select("*", F.explode("r.paths").alias("sub"))
    full = normalize_path(F.concat_ws("/", F.col("c.base"), F.col("sub")), prefix=global_prefix or None, exclude=exclude)
    used = F.when(F.size("guards") > 0, F.col("guards")).otherwise(F.col("c.guards"))
    r = r.select("repository", F.upper("r.verb").alias("method"), full.alias("path"), "file", "seg", used.alias("g"))
    r = r.withColumn("auth", nest_guard_auth(F.col("g"), F.col("path"), webhook_paths))
    last = r.groupBy("repository", "method", "path").agg(F.max_by("auth", F.struct("file", "seg")).alias("auth"))
    return _rows(last.withColumn("source_kind", F.lit("NestJS")))


# ----------------------------------------------------------------------------- C4 Go
# Middleware names that indicate authentication.
GO_AUTH_KEYWORDS = ["auth", "jwt", "bearer", "token", "apikey", "api_key", "api-key", "authorization", "authz", "okta", "privy", "session"]
GO_ROUTERS = ["r", "R", "router", "mux"]
GO_PLAIN = ["Handle", "HandleFunc"]
# Functions by which generated OpenAPI handlers are mounted, and the option that holds their base path.
GO_MOUNTS = ["HandlerFromMux", "HandlerFromMuxWithBaseURL", "HandlerWithOptions", "RegisterHandlers", "RegisterHandlersWithOptions"]
GO_BASE_OPTION = "BaseURL"


def _go_auth(hits: Column) -> Column:
    low = F.lower(F.array_join(hits, ", "))
    return (F.when(F.size(hits) == 0, "public").when(low.contains("okta") | low.contains("admin"), "okta")
            .when(_has_any(low, ["apikey", "api_key", "api-key"]), "api-key").otherwise("jwt"))


def go_file_auth(parts: DataFrame) -> DataFrame:
    """(repository, path, auth) of each file of Go statements, by the names of its middleware: what
    routers ``Use`` and what wraps the ``Handler`` of the server (also by a local variable)."""
    ts, none = F.col("ts"), F.array().cast("array<string>")
    uses = F.transform(S.calls(ts, ["Use"], lambda i: (S.tok(ts, i - 1) == ".") & S.tok(ts, i - 2).isin(*GO_ROUTERS)), lambda i: S.text_of(S.inside(ts, i + 1)))
    wraps = F.transform(S.places(ts, lambda i: F.lower(S.tok(ts, i)).endswith("middleware") & (S.tok(ts, i + 1) == "(")), lambda i: S.tok(ts, i))
    field = F.get(S.places(ts, lambda i: (S.tok(ts, i) == "Handler") & (S.tok(ts, i + 1) == ":")), F.lit(0))
    bare = F.when(S.tok(ts, field + 3).isNull() | ~S.tok(ts, field + 3).isin("(", "."), S.tok(ts, field + 2))
    x = parts.select(*_FILE, uses.alias("uses"), F.when(field.isNotNull(), wraps).otherwise(none).alias("wraps"), bare.alias("held"),
                     F.when(S.tok(ts, 1) == ":=", F.struct(S.tok(ts, 0).alias("name"), wraps.alias("wraps"))).alias("local"))
    x = x.groupBy(*_FILE).agg(F.flatten(F.collect_list("uses")).alias("uses"), F.flatten(F.collect_list("wraps")).alias("wraps"), F.collect_set("held").alias("held"),
                              F.collect_list("local").alias("locals"))  # the statements of one file
    followed = F.flatten(F.transform(F.filter("locals", lambda v: F.array_contains("held", v["name"])), lambda v: v["wraps"]))
    hits = F.filter(F.concat("uses", "wraps", followed), lambda u: F.exists(F.array(*[F.lit(k) for k in GO_AUTH_KEYWORDS]), lambda k: F.lower(u).contains(k)))
    return x.select(*_FILE, _go_auth(hits).alias("auth"))


def go_routes(corpus: DataFrame) -> DataFrame:
    """C4: inline Go routes: a verb method, ``Handle`` or ``HandleFunc`` of a router (one of
    ``GO_ROUTERS``) with a literal path. The verb is the method's name or stands before the path
    (``"GET /x"``), else GET; a path that ends in ``/ws`` is a WebSocket route. Auth from the file's
    middleware: okta/admin -> okta, api key -> api-key, other auth words -> jwt, none -> public."""
    parts = S.segments(corpus.filter(F.col("path").endswith(".go")), "go")
    ts = F.col("ts")
    named = [v.capitalize() for v in HTTP_VERBS[:5]] + GO_PLAIN
    found = F.transform(S.calls(ts, named, lambda i: (S.tok(ts, i - 1) == ".") & S.tok(ts, i - 2).isin(*GO_ROUTERS) & S.is_string(S.tok(ts, i + 2))),
                        lambda i: F.struct(S.tok(ts, i).alias("name"), S.tok(ts, i - 2).alias("on"), F.split(F.trim(S.unquote(S.tok(ts, i + 2))), r"\s+", 2).alias("words")))
    x = parts.select(*_FILE, F.explode(found).alias("c"))
    two = (F.size("c.words") == 2) & F.get("c.words", F.lit(0)).isin(*HTTP_VERBS[:5])
    url = F.when(two, F.get("c.words", F.lit(1))).otherwise(F.array_join("c.words", " "))
    verb = F.when(two, F.get("c.words", F.lit(0))).when(F.col("c.name").isin(*GO_PLAIN), "GET").otherwise(F.upper("c.name"))
    x = x.select(*_FILE, verb.alias("verb"), url.alias("url"), "c.on").filter(F.col("url").startswith("/") | (F.col("on") == "mux"))
    x = x.select(*_FILE, F.when(F.col("url").endswith("/ws"), "WS").otherwise(F.col("verb")).alias("method"), "url").join(go_file_auth(parts), _FILE)
    strongest = F.max_by("auth", F.create_map(*[v for k, p in AUTH_PRIORITY.items() for v in (F.lit(k), F.lit(p))])[F.col("auth")])
    x = x.groupBy("repository", "path", "method", "url").agg(strongest.alias("auth"))
    return _rows(x.select("repository", "method", F.col("url").alias("path"), "auth", F.lit("Go net/http").alias("source_kind")))


def _folder(path: str) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def go_spec_mounts(corpus: DataFrame, spec_import: str = r"/api/([\w-]+)/v\d+$", main_files: str = r"(?:^|/)cmd/.*main\.go$") -> DataFrame:
    """C4: (repository, service, base_url, auth): the OpenAPI services that Go repositories implement.

    A service is an import whose path matches ``spec_import``. Where a mount function (``GO_MOUNTS``)
    of that import, by its alias or package name, is called, the base path is the third argument of the
    ``...WithBaseURL`` form or the ``BaseURL`` option: a literal or a constant, looked up in the same file,
    then the same folder, then the folder that its qualifier names. A bare mount call (a generated
    package of the repository) stands for all services of its file; a service that is never
    mounted has an empty base. Auth is the strongest of the repository's ``main`` files."""
    parts = cut_lineage(S.segments(corpus.filter(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go")), "go"))
    ts = F.col("ts")
    imported = F.transform(S.places(ts, lambda i: S.is_string(S.tok(ts, i))), lambda i: F.struct(
        S.unquote(S.tok(ts, i)).alias("target"), F.when(~S.tok(ts, i - 1).isin("import", "(") & ~S.is_string(S.tok(ts, i - 1)), S.tok(ts, i - 1)).alias("alias")))
    service = F.regexp_extract("m.target", spec_import, 1)
    imports = parts.filter(S.tok(ts, 0) == "import").select(*_FILE, F.explode(imported).alias("m")).select(*_FILE, service.alias("service"), F.coalesce("m.alias", service).alias("alias"))
    imports = imports.filter(F.col("service") != "").distinct()

    # mount calls with the cells of their base path
    calls = F.transform(S.calls(ts, GO_MOUNTS, lambda i: S.tok(ts, i - 1).isNull() | (S.tok(ts, i - 1) != "func")), lambda i: F.struct(
        F.when(S.tok(ts, i - 1) == ".", S.tok(ts, i - 2)).alias("on"), S.tok(ts, i).alias("name"), S.inside(ts, i + 1).alias("args")))
    x = parts.select(*_FILE, F.explode(calls).alias("c")).select(*_FILE, "c.on", "c.name", "c.args")
    args = F.col("args")
    option = F.get(S.places(args, lambda i: (S.tok(args, i) == GO_BASE_OPTION) & (S.tok(args, i + 1) == ":")), F.lit(0))
    comma = F.get(S.places(args, lambda i: (S.tok(args, i) == ",") & (S.depth(args, i) == S.depth(args, 0))), F.lit(1))
    start = F.when(option.isNotNull(), option + 2).when(F.col("name").endswith("WithBaseURL"), comma + 1)
    x = x.withColumn("b", start).select(*_FILE, "on", F.when(S.is_string(S.tok(args, F.col("b"))), S.unquote(S.tok(args, F.col("b")))).alias("literal"),
                                        F.when(S.tok(args, F.col("b") + 1) == ".", S.tok(args, F.col("b"))).alias("package"),
                                        F.when(S.tok(args, F.col("b") + 1) == ".", S.tok(args, F.col("b") + 2)).otherwise(S.tok(args, F.col("b"))).alias("constant"))
    # constants of the repository, the nearest first
    held = F.transform(S.places(ts, lambda i: S.tok(ts, i).isin("=", ":=") & S.is_string(S.tok(ts, i + 1))), lambda i: F.struct(
        F.when(S.tok(ts, i - 1).isin("string"), S.tok(ts, i - 2)).otherwise(S.tok(ts, i - 1)).alias("constant"), S.unquote(S.tok(ts, i + 1)).alias("value")))
    consts = parts.select("repository", F.col("path").alias("c_path"), F.explode(held).alias("h")).select("repository", "c_path", "h.constant", "h.value")
    mounts = x.withColumn("id", F.monotonically_increasing_id())
    mounts = cut_lineage(mounts)
    folder = F.element_at(F.split(_folder("c_path"), "/"), -1)
    near = F.when(F.col("package").isNotNull(), F.when(folder == F.col("package"), 0)).when(F.col("c_path") == F.col("path"), 0).when(_folder("c_path") == _folder("path"), 1)
    value = (mounts.filter("literal is null and constant is not null").join(consts, ["repository", "constant"]).withColumn("near", near).filter("near is not null")
             .groupBy("id").agg(F.min_by("value", F.struct("near", "c_path", "value")).alias("value")))
    mounts = mounts.join(value, "id", "left").select(*_FILE, "on", F.coalesce("literal", "value", F.lit("")).alias("base_url"))
    own = imports.join(mounts.filter("on is not null").withColumnRenamed("on", "alias"), [*_FILE, "alias"]).select("repository", "service", "base_url")
    aliases = imports.select(*_FILE, F.col("alias").alias("on")).distinct()
    other = mounts.join(aliases, [*_FILE, "on"], "left_anti")  # through a package of the repository itself
    bare = imports.join(other, _FILE).select("repository", "service", "base_url")
    mounted = own.unionByName(bare).distinct()
    rest = imports.select("repository", "service").distinct().join(mounted, ["repository", "service"], "left_anti").withColumn("base_url", F.lit(""))
    found = mounted.unionByName(rest)
    rank = F.create_map(*[v for k, p in AUTH_PRIORITY.items() for v in (F.lit(k), F.lit(p))])
    auth = go_file_auth(parts.filter(F.col("path").rlike(main_files))).groupBy("repository").agg(F.max_by("auth", rank[F.col("auth")]).alias("auth"))
    return found.join(auth, "repository", "left").select("repository", "service", "base_url", F.coalesce("auth", F.lit("public")).alias("auth"))


def mounted_spec_routes(specs: DataFrame, mounts: DataFrame) -> DataFrame:
    """C4: rows of specs (``repository`` = service) under each repository that implements them, with its
    base path and its auth; a service that two repositories implement has rows under both."""
    s = specs.select(F.col("repository").alias("service"), "method", F.col("path").alias("url"))
    j = s.join(mounts, "service")
    return _rows(j.select("repository", "method", normalize_path(F.concat("base_url", "url")).alias("path"), "auth", F.lit("Go OpenAPI handler").alias("source_kind")).distinct())


def go_websocket_origins(corpus: DataFrame) -> DataFrame:
    """C4: (repository, path, permissive): files that set up a WebSocket upgrader, and whether its
    ``CheckOrigin`` accepts every origin (returns true at once)."""
    parts = S.segments(corpus.filter(F.col("path").endswith(".go")), "go")
    w = Window.partitionBy(*_FILE).orderBy("seg")
    ts, after = F.col("ts"), F.col("next")
    opened = F.exists(S.places(ts, lambda i: S.tok(ts, i) == "Upgrader"), lambda i: (S.tok(ts, i - 2) == "websocket") & (S.tok(ts, i + 1) == "{"))
    check = F.exists(S.places(ts, lambda i: S.tok(ts, i) == "CheckOrigin"), lambda i: S.tok(ts, i + 1) == ":")
    x = parts.withColumn("next", F.lead("ts").over(w)).select(*_FILE, opened.alias("opened"), (check & (S.tok(after, 0) == "return") & (S.tok(after, 1) == "true")).alias("loose"))
    return x.groupBy(*_FILE).agg(F.max("opened").alias("opened"), F.coalesce(F.max("loose"), F.lit(False)).alias("permissive")).filter("opened").drop("opened")


# ----------------------------------------------------------------------------- C5 MCP
def mcp_tools(corpus: DataFrame, servers_dir: str = "servers") -> DataFrame:
    """Two HTTP rows per server folder (POST /<server>/mcp, GET /<server>/validate) plus one row per
    tool: a ``name`` property whose text is words joined by hyphens (``srv-action``), in the
    server's tool files; a tool name already seen in the repository is skipped."""
    rx = rf"(?:^|/){servers_dir}/([^/]+)/"
    f = corpus.filter(F.col("path").rlike(rx)).withColumn("server", F.regexp_extract("path", rx, 1))
    servers = f.select("repository", "server").distinct()
    http = servers.select("repository", F.explode(F.array(F.struct(F.lit("POST").alias("method"), F.lit("mcp").alias("end")),
                                                          F.struct(F.lit("GET").alias("method"), F.lit("validate").alias("end")))).alias("e"), "server")
    http = http.select("repository", "e.method", F.concat_ws("/", F.lit(""), "server", "e.end").alias("path"), F.lit("MCP HTTP").alias("source_kind"))
    tool_files = f.filter(F.col("path").rlike(r"/src/tools/.*\.ts$|tool[^/]*\.ts$") & ~F.col("path").rlike(r"\.(spec|test)\.ts$"))
    ts = F.col("ts")
    named = F.transform(S.places(ts, lambda i: (S.tok(ts, i) == "name") & (S.tok(ts, i + 1) == ":") & S.is_string(S.tok(ts, i + 2))), lambda i: S.unquote(S.tok(ts, i + 2)))
    slugs = F.filter(named, lambda v: (F.size(F.split(v, "-")) > 1) & F.forall(F.split(v, "-"), lambda p: p.rlike("^[A-Za-z0-9_]+$")))
    tools = S.segments(tool_files, "script").select("repository", F.explode(slugs).alias("path")).distinct()
    tools = tools.select("repository", F.lit("MCP").alias("method"), "path", F.lit("MCP tool").alias("source_kind"))
    return _rows(http.unionByName(tools).withColumn("auth", F.lit("api-key")))


# ----------------------------------------------------------------------------- C6 FastAPI
# Parts of a dependency's name that mark a signature or shared-secret check,
# and parts of a header's name that mark an API key.
FASTAPI_VERIFIERS = ["_secret", "_signature", "_hmac", "_webhook"]
FASTAPI_HEADERS = ["api-key", "api_key", "apikey", "authorization", "token", "secret", "signature"]
_MODULE = ["repository", "module"]


def _depends(ts: Column) -> Column:
    """Names in ``Depends(name)``, in lower case."""
    return F.transform(S.calls(ts, ["Depends"]), lambda i: F.lower(S.first_argument(ts, i)))


def _python_imports(parts: DataFrame) -> DataFrame:
    """(repository, module, alias, target): the dotted name that each imported alias stands for;
    relative imports are counted from the module's package."""
    ts = F.col("ts")
    at = F.get(S.places(ts, lambda i: S.tok(ts, i) == "import"), F.lit(0))
    taken = S.places(ts, lambda i: (i > at) & ~S.tok(ts, i).isin(",", "(", ")", "as", ".") & (S.tok(ts, i - 1) != "as") & (S.tok(ts, i - 1) != "."))
    aliased = F.transform(taken, lambda i: F.struct(S.tok(ts, i).alias("name"), F.when(S.tok(ts, i + 1) == "as", S.tok(ts, i + 2)).otherwise(S.tok(ts, i)).alias("alias")))
    source = S.text_of(F.slice(ts, 2, at - 1))
    x = parts.filter((S.tok(ts, 0) == "from") & at.isNotNull()).select(*_MODULE, "package", source.alias("source"), F.explode(aliased).alias("n"))
    dots = F.length(F.regexp_extract("source", r"^(\.*)", 1))
    levels = F.split("package", r"\.")
    base = F.array_join(F.slice(levels, 1, F.greatest(F.size(levels) - dots + 1, F.lit(0))), ".")
    tail = F.regexp_replace("source", r"^\.+", "")
    module = F.when(dots == 0, F.col("source")).otherwise(F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(tail, F.lit(""))))
    named = x.select(*_MODULE, F.col("n.alias").alias("alias"), F.concat_ws(".", F.nullif(module, F.lit("")), F.col("n.name")).alias("target"))
    # import a.b as c
    as_at = F.get(S.places(ts, lambda i: S.tok(ts, i) == "as"), F.lit(0))
    whole = parts.filter((S.tok(ts, 0) == "import") & as_at.isNotNull()).select(*_MODULE, S.tok(ts, as_at + 1).alias("alias"), S.text_of(F.slice(ts, 2, as_at - 1)).alias("target"))
    return named.unionByName(whole).distinct()


def _resolve(refs: DataFrame, objs: DataFrame, imports: DataFrame) -> DataFrame:
    """``refs`` (repository, module, expr, ...) with ``obj``, the ``module:name`` of the router or app that the
    expression names: one of the module, or one reached through imports, re-exports included."""
    objs = objs.select("repository", F.col("module").alias("o_module"), F.col("var").alias("o_var")).distinct()
    imports = cut_lineage(imports)
    open_refs = cut_lineage(refs.select("*", F.concat_ws(".", "module", "expr").alias("dotted"), F.array().cast("array<string>").alias("seen")))
    done = None
    while True:  # a reference that has been seen is not followed again
        cut = open_refs.withColumn("o_module", F.regexp_replace("dotted", r"\.\w+$", "")).withColumn("o_var", F.regexp_extract("dotted", r"(\w+)$", 1))
        hit = cut.join(objs, ["repository", "o_module", "o_var"])
        hit = hit.select(*refs.columns, F.concat_ws(":", "o_module", "o_var").alias("obj"))
        done = hit if done is None else done.unionByName(hit)
        # the rest: M.alias or M.alias.attr, where module M imports alias
        split = F.split("dotted", r"\.")
        miss = cut.join(objs, ["repository", "o_module", "o_var"], "left_anti")
        tries = miss.withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(F.size(split) - 1, F.lit(1))))).withColumn("holder", F.array_join(F.slice(split, 1, F.col("k")), "."))
        tries = tries.withColumn("name", F.get(split, F.col("k"))).withColumn("rest", F.array_join(F.slice(split, F.col("k") + 2, F.size(split)), "."))
        known = imports.select("repository", F.col("module").alias("holder"), F.col("alias").alias("name"), "target")
        step = tries.join(known, ["repository", "holder", "name"]).withColumn("seen", F.array_append("seen", F.col("dotted")))
        step = step.withColumn("dotted", F.concat_ws(".", "target", F.nullif("rest", F.lit("")))).filter(~F.array_contains("seen", F.col("dotted")))
        open_refs = cut_lineage(step.select(*refs.columns, "dotted", "seen").distinct())
        if open_refs.isEmpty():
            return done.distinct()


def fastapi_routes(corpus: DataFrame, allow_public: Sequence[str] = ()) -> DataFrame:
    """FastAPI apps and routers in Python modules.

    Objects: ``x = FastAPI(...)`` (roots) and ``x = APIRouter(prefix='/p')``; edges:
    ``parent.include_router(child, prefix='/q')`` where ``child`` is a local name, an imported one (absolute,
    relative, aliased, or re-exported by a package) or an attribute of an imported module;
    routes: ``@obj.get('/path', ...)`` or ``path='/path'``, the decorator over any number of lines and stacked
    with others. Full prefixes are composed from the roots along the edges (iterative join;
    a router already on the path is not entered again). A function whose first parameter is
    ``app`` mounts at the root. Auth precedence per route, by the names in ``Depends(...)`` of the
    decorators and the signature with the module's aliases expanded: ``require_admin`` -> okta, a signature
    verifier -> signature, an API-key ``Header(...)`` -> api-key, ``get_current_user`` -> jwt,
    path on the allow list -> public, otherwise jwt."""
    dotted = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".")
    parts = S.segments(corpus.filter(F.col("path").endswith(".py")), "python")
    package = F.when(dotted.rlike(r"(?:^|\.)__init__$"), F.regexp_replace(dotted, r"\.?__init__$", "")).otherwise(F.regexp_replace(dotted, r"\.?[^.]*$", ""))
    parts = cut_lineage(parts.select("repository", F.regexp_replace(dotted, r"\.?__init__$", "").alias("module"), package.alias("package"), "path", "seg", "ts"))
    ts = F.col("ts")

    made = F.get(S.calls(ts, ["FastAPI", "APIRouter"]), F.lit(0))
    equals = F.get(S.places(ts, lambda i: (S.tok(ts, i) == "=") & (S.depth(ts, i) == 0)), F.lit(0))
    objs = parts.withColumn("i", made).filter(F.col("i").isNotNull() & (equals < F.col("i")) & S.tok(ts, 1).isin("=", ":")).select(
        *_MODULE, S.tok(ts, 0).alias("var"), (S.tok(ts, F.col("i")) == "FastAPI").alias("is_app"), F.coalesce(S.keyword(S.inside(ts, F.col("i") + 1), "prefix"), F.lit("")).alias("own_prefix"))
    included = F.transform(S.calls(ts, ["include_router"], lambda i: S.tok(ts, i - 1) == "."), lambda i: F.struct(
        S.tok(ts, i - 2).alias("parent"), F.regexp_replace(S.first_argument(ts, i), "^router=", "").alias("expr"), S.keyword(S.inside(ts, i + 1), "prefix").alias("inc_prefix")))
    inc = parts.select(*_MODULE, F.explode(included).alias("e")).select(*_MODULE, "e.parent", "e.expr", F.coalesce("e.inc_prefix", F.lit("")).alias("inc_prefix"))
    # a helper whose first parameter is the app mounts routers on it: that name is a root too
    helper = F.exists(S.places(ts, lambda i: S.tok(ts, i) == "def"), lambda i: (S.tok(ts, i + 2) == "(") & (S.tok(ts, i + 3) == "app"))
    helpers = parts.filter(helper).select(*_MODULE).distinct().join(inc.filter("parent = 'app'").select(*_MODULE).distinct(), _MODULE, "left_semi")
    helpers = helpers.join(objs.filter("var = 'app'").select(*_MODULE), _MODULE, "left_anti").select(*_MODULE, F.lit("app").alias("var"), F.lit(True).alias("is_app"), F.lit("").alias("own_prefix"))
    objs = cut_lineage(objs.unionByName(helpers).distinct())
    imports = _python_imports(parts)

    o = objs.select("repository", F.concat_ws(":", "module", "var").alias("obj"), "is_app", "own_prefix")
    edges = _resolve(inc, objs, imports).select("repository", F.concat_ws(":", "module", "parent").alias("src"), F.col("obj").alias("dst"), "inc_prefix").distinct()
    # prefix walk from the apps: (obj, prefix, visited)
    frontier = o.filter("is_app").select("repository", "obj", F.col("own_prefix").alias("prefix"), F.array("obj").alias("visited"))
    reach = frontier
    while True:  # ends when no router is entered any more: a path never visits one twice
        step = (frontier.join(edges.withColumnRenamed("src", "obj"), ["repository", "obj"])
                .filter(~F.array_contains("visited", F.col("dst")))
                .join(o.select("repository", F.col("obj").alias("dst"), "own_prefix"), ["repository", "dst"])
                .select("repository", F.col("dst").alias("obj"), F.concat("prefix", "inc_prefix", "own_prefix").alias("prefix"),
                        F.concat("visited", F.array("dst")).alias("visited")))
        step = cut_lineage(step)
        if step.isEmpty():
            break
        reach = reach.unionByName(step)
        frontier = step

    # a decorator statement, and the definition that it decorates
    w = Window.partitionBy("repository", "path").orderBy("seg")
    is_def = (S.tok(ts, 0) == "def") | ((S.tok(ts, 0) == "async") & (S.tok(ts, 1) == "def"))
    is_deco = S.tok(ts, 0) == "@"
    block = F.sum(F.when(~is_deco, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))  # decorators and what follows them
    x = parts.filter(F.size("ts") > 0).withColumn("block", F.coalesce(block, F.lit(0)))
    x = x.groupBy(*_MODULE, "path", "block").agg(F.array_sort(F.collect_list(F.struct("seg", "ts"))).alias("s"), F.max(is_def).alias("has_def"), F.max(is_deco).alias("has_deco"))
    x = x.filter("has_def and has_deco").withColumn("sig", F.flatten(F.transform("s", lambda v: v["ts"])))
    sig = F.col("sig")
    verbs = [v.lower() for v in HTTP_VERBS] + ["websocket"]
    routed = F.transform(F.filter("s", lambda v: (S.tok(v["ts"], 0) == "@") & (S.tok(v["ts"], 2) == ".") & S.tok(v["ts"], 3).isin(*verbs) & (S.tok(v["ts"], 4) == "(")), lambda v: F.struct(
        S.tok(v["ts"], 1).alias("expr"), S.tok(v["ts"], 3).alias("verb"),
        F.coalesce(F.when(S.is_string(S.tok(v["ts"], 5)), S.unquote(S.tok(v["ts"], 5))), S.keyword(v["ts"], "path")).alias("sub")))
    def parameter(i: Column) -> Column:
        """Text of the parameter that holds place ``i``, up to the end of the call there."""
        comma = F.array_max(S.places(sig, lambda j: (j < i) & (S.depth(sig, j) == 1) & (S.tok(sig, j) == ",")))
        opened = F.array_max(S.places(sig, lambda j: (j < i) & (S.depth(sig, j) == 0) & (S.tok(sig, j) == "(")))
        return S.let(F.greatest(comma, opened), lambda start: S.text_of(F.slice(sig, start + 2, S.close_of(sig, i + 1) - start)))

    headers = F.transform(S.calls(sig, ["Header"]), lambda i: F.lower(parameter(i)))
    typed = F.transform(S.places(sig, lambda i: (S.tok(sig, i - 1) == ":") & (S.depth(sig, i) == 1)), lambda i: F.lower(S.tok(sig, i)))
    x = x.select(*_MODULE, F.explode(routed).alias("r"), _depends(sig).alias("named"), typed.alias("typed"), headers.alias("headers")).filter("r.sub is not null")
    # aliases of the module: ``Admin = Annotated[..., Depends(require_admin)]``
    alias = parts.filter(S.tok(ts, 1).isin("=", ":") & (F.size(_depends(ts)) > 0) & (S.tok(ts, 0) != "@")).select(*_MODULE, F.struct(F.lower(S.tok(ts, 0)).alias("name"), _depends(ts).alias("deps")).alias("a"))
    alias = alias.groupBy(*_MODULE).agg(F.collect_set("a").alias("aliases"))  # the aliases of one file
    x = x.join(alias, _MODULE, "left")
    expanded = F.flatten(F.transform(F.filter(F.coalesce("aliases", F.array().cast("array<struct<name:string,deps:array<string>>>")), lambda a: F.array_contains("typed", a["name"])), lambda a: a["deps"]))
    x = x.select(*_MODULE, "r.expr", "r.verb", "r.sub", "headers", F.concat("named", expanded).alias("deps"))
    routes = _resolve(x, objs, imports)
    full = normalize_path(F.concat("prefix", "sub"))
    allowed = glob_match(full, allow_public) if allow_public else F.lit(False)
    verifier = F.exists("deps", lambda d: d.startswith("verify_") | _has_any(d, FASTAPI_VERIFIERS))
    header = F.exists("headers", lambda h: _has_any(h, FASTAPI_HEADERS))
    auth = (F.when(F.array_contains("deps", "require_admin"), "okta").when(verifier, "signature").when(header, "api-key")
            .when(F.array_contains("deps", "get_current_user"), "jwt").when(allowed, "public").otherwise("jwt"))
    ws = F.col("verb") == "websocket"
    out = reach.join(routes, ["repository", "obj"]).select("repository", F.when(ws, "WS").otherwise(F.upper("verb")).alias("method"), full.alias("path"), auth.alias("auth"),
                                                           F.when(ws, "FastAPI WS").otherwise(F.lit("FastAPI")).alias("source_kind"))
    return _rows(out.distinct())
