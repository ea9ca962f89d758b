"""Domain tables derived from the driver's parquet (see FIXTURES.md section 2).

Each table has two definitions with the same rows: a DataFrame builder used by the Spark
queries and a SQL text used by the DuckDB twins (``sql_with``). Operators never depend on
these shapes; they take column names as parameters.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SQL = {
    "user_event_log": """
SELECT event_id AS global_position, concat('User-', CAST(user_id AS VARCHAR)) AS stream_id, event_type,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, ts AS created_at, value, user_id
FROM events""",
    "order_event_log": """
SELECT o_orderkey, kind, event_type, amount, qty, event_time,
  row_number() OVER (PARTITION BY o_orderkey ORDER BY kind, amount, qty, event_time) AS version FROM (
  SELECT o_orderkey, 0 AS kind, 'OrderCreated' AS event_type, CAST(0 AS DOUBLE) AS amount, CAST(0 AS DOUBLE) AS qty, o_orderdate AS event_time FROM orders
  UNION ALL SELECT l_orderkey, 1, 'OrderItemAdded', l_extendedprice, l_quantity, l_shipdate FROM lineitem
  UNION ALL SELECT l_orderkey, 2, 'OrderItemRemoved', l_extendedprice, l_quantity, l_shipdate FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1
  UNION ALL SELECT o_orderkey, 3, CASE o_orderstatus WHEN 'F' THEN 'OrderCompleted' WHEN 'O' THEN 'OrderShipped' ELSE 'OrderCancelled' END,
    o_totalprice, CAST(0 AS DOUBLE), o_orderdate FROM orders) x""",
    "cdc_feed": """
SELECT event_id, user_id AS pk, CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op, value, ts,
  'app' AS source_db, 'users' AS table_name FROM events""",
    "metric_samples": """
SELECT user_id % 8 AS service, ts, event_id, CAST(floor(epoch(ts) / 60) AS BIGINT) % 100 AS counter_value, value AS latency,
  CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS code FROM events""",
    "spans": """
SELECT user_id AS trace_id, event_id AS span_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent_id,
  user_id % 8 AS service, ts, value AS duration FROM events""",
    "trace_spans": """
SELECT a.trace_id, a.span_id, b.span_id AS parent_id, a.service, a.start_ms, a.end_ms FROM (
  SELECT *, (length(bin(rn)) - 1) * 100 + span_id % 90 + (rn % 2) * (span_id % 400) AS start_ms,
    (length(bin(rn)) - 1) * 100 + span_id % 90 + (rn % 2) * (span_id % 400) + 100 + (span_id * 7) % 600 + CASE WHEN rn = 1 THEN 2000 ELSE 0 END AS end_ms FROM (
    SELECT user_id AS trace_id, event_id AS span_id, user_id % 8 AS service, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)) a
LEFT JOIN (SELECT user_id AS trace_id, event_id AS span_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) b
  ON a.trace_id = b.trace_id AND b.rn = a.rn // 2""",
    "threats": """
SELECT o_orderkey AS threat_id, o_orderkey % 6 AS category_no, o_orderkey % 4 + 1 AS impact, o_custkey % 4 + 1 AS likelihood FROM orders""",
    "controls": """
SELECT p_partkey AS control_id, p_size % 5 AS effectiveness, p_partkey % 4 AS status_no, p_partkey % 6 AS layer_no,
  p_partkey % 3 AS type_no, p_retailprice AS cost FROM part""",
    "mappings": """
SELECT DISTINCT l_orderkey AS threat_id, l_partkey AS control_id FROM lineitem""",
    "attack_nodes": """
SELECT o_orderkey AS tree_id, CAST(0 AS BIGINT) AS node_no, CASE WHEN o_orderstatus = 'F' THEN 'and' ELSE 'or' END AS node_type,
  0 AS difficulty, 0 AS cost FROM orders
UNION ALL SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity),
  'leaf', CAST(l_partkey % 5 + 1 AS INT), CAST(l_suppkey % 5 AS INT) FROM lineitem""",
    "packages": """
SELECT p_partkey AS package_id, p_name AS name,
  concat(CAST(p_size % 5 AS VARCHAR), '.', CAST(p_partkey % 10 AS VARCHAR), '.', CAST(p_partkey % 7 AS VARCHAR)) AS version,
  CASE p_partkey % 6 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Apache-2.0' WHEN 2 THEN 'BSD-3-Clause' WHEN 3 THEN 'ISC' WHEN 4 THEN 'GPL-3.0' ELSE 'unknown' END AS license
FROM part""",
    "pull_requests": """
SELECT o_orderkey AS number,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Tidy up' ELSE concat('PROJ-', CAST(o_custkey AS VARCHAR), ': change') END AS title,
  CASE WHEN o_orderkey % 2 = 1 THEN concat('feature/PROJ-', CAST(o_custkey AS VARCHAR), '_x') ELSE '' END AS branch,
  o_orderdate AS merged_at, o_custkey AS author_id FROM orders""",
    "tickets": """
SELECT concat('PROJ-', CAST(c_custkey AS VARCHAR)) AS ticket_key, c_name AS summary,
  CASE c_custkey % 3 WHEN 0 THEN 'Bug' WHEN 1 THEN 'Story' ELSE 'Task' END AS issue_type FROM customer WHERE c_custkey % 4 <> 0""",
    "consents": """
SELECT event_id, user_id,
  CASE event_id % 4 WHEN 0 THEN 'marketing_emails' WHEN 1 THEN 'analytics_tracking' WHEN 2 THEN 'third_party_sharing' ELSE 'profiling' END AS consent_type,
  value > 100 AS granted, event_type = 'error' AS withdrawn, ts FROM events""",
    "bookings": """
SELECT l_suppkey AS room_id, l_orderkey AS booking_id, l_linenumber AS line_no, l_partkey AS part_no, CAST(l_shipdate AS DATE) AS start_day,
  CAST(l_quantity AS INT) AS days FROM lineitem""",
    "usage_cost": """
SELECT l_partkey AS resource_id, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS cost_center,
  CAST(l_shipdate AS DATE) AS day, l_extendedprice AS amount FROM lineitem""",
    "tree_nodes": """
SELECT o_orderkey AS tree_id, CAST(0 AS BIGINT) AS node_id, CASE WHEN o_orderstatus = 'F' THEN 'and' ELSE 'or' END AS node_type,
  0 AS difficulty, 0 AS cost, 0 AS detection_risk, CAST(0 AS DOUBLE) AS time_hours, false AS requires_insider, false AS requires_physical, false AS mitigated
FROM orders
UNION ALL SELECT DISTINCT l_orderkey, CAST(1000 + CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS BIGINT),
  CASE WHEN l_returnflag = 'N' THEN 'and' ELSE 'or' END, 0, 0, 0, CAST(0 AS DOUBLE), false, false, false FROM lineitem
UNION ALL SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity),
  'leaf', CAST(l_partkey % 5 + 1 AS INT), CAST(l_suppkey % 5 AS INT), CAST((l_partkey + l_suppkey) % 5 AS INT), l_quantity,
  l_partkey % 7 = 0, l_suppkey % 11 = 0, l_linestatus = 'F' FROM lineitem""",
    "tree_edges": """
SELECT DISTINCT l_orderkey AS tree_id, CAST(0 AS BIGINT) AS parent, CAST(1000 + CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS BIGINT) AS child,
  CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS BIGINT) AS pos FROM lineitem
UNION ALL SELECT l_orderkey, CAST(1000 + CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS BIGINT),
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity),
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) FROM lineitem""",
    "advisories": """
SELECT 'ADV-' || CAST(p_partkey AS VARCHAR) AS advisory_id, p_name AS name, '0.0.0' AS introduced, CAST(p_size % 5 AS VARCHAR) || '.5.0' AS fixed,
  CASE p_partkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'moderate' END AS severity,
  p_partkey % 3 = 0 AS exploit_available, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey % 4 = 1 END AS publicly_disclosed,
  CASE WHEN p_partkey % 6 = 0 THEN 'remote_code_execution in parser' ELSE 'denial of service' END AS description,
  (p_partkey % 100) / 10.0 AS cvss, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size % 5 AS VARCHAR) || '.5.0' ELSE '' END AS fixed_in
FROM part WHERE p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_name)""",
    "call_log": """
SELECT user_id % 8 AS service, ts, event_id, event_type <> 'error' AS ok FROM events""",
}


def sql_with(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` prefix for a DuckDB twin."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n"


class Derived:
    def __init__(self, t):
        self.t = t

    @cached_property
    def user_event_log(self) -> DataFrame:
        e = self.t.events
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return e.select(
            F.col("event_id").alias("global_position"),
            F.concat(F.lit("User-"), F.col("user_id").cast("string")).alias("stream_id"),
            "event_type",
            F.row_number().over(w).cast("long").alias("version"),
            F.col("ts").alias("created_at"),
            "value",
            "user_id",
        )

    @cached_property
    def order_event_log(self) -> DataFrame:
        """One scan per table: each order row yields its created and final events, each
        line row its added (and, for returned first lines, removed) event, via ``inline``.
        (Four separate scans are faster on single-row-group files - four parallel tasks -
        but read lineitem and orders twice; at scale the single scan wins.)"""
        o, li = self.t.orders, self.t.lineitem
        zero = F.lit(0.0).cast("double")

        def ev(kind, etype, amount, qty, ts):
            return F.struct(F.lit(kind).alias("kind"), etype.alias("event_type"), amount.alias("amount"), qty.alias("qty"),
                            ts.alias("event_time"))

        final_type = (F.when(F.col("o_orderstatus") == "F", "OrderCompleted").when(F.col("o_orderstatus") == "O", "OrderShipped")
                      .otherwise("OrderCancelled"))
        from_orders = o.select("o_orderkey", F.inline(F.array(
            ev(0, F.lit("OrderCreated"), zero, zero, F.col("o_orderdate")),
            ev(3, final_type, F.col("o_totalprice"), zero, F.col("o_orderdate")))))
        returned_first = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)
        from_lines = li.select(F.col("l_orderkey").alias("o_orderkey"), F.inline(F.filter(F.array(
            ev(1, F.lit("OrderItemAdded"), F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_shipdate")),
            F.when(returned_first, ev(2, F.lit("OrderItemRemoved"), F.col("l_extendedprice"), F.col("l_quantity"),
                                      F.col("l_shipdate")))), lambda x: x.isNotNull())))
        allev = from_orders.unionByName(from_lines)
        w = Window.partitionBy("o_orderkey").orderBy("kind", "amount", "qty", "event_time")
        return allev.withColumn("version", F.row_number().over(w).cast("long"))

    @cached_property
    def cdc_feed(self) -> DataFrame:
        e = self.t.events
        return e.select("event_id", F.col("user_id").alias("pk"),
                        F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d")
                        .otherwise("u").alias("op"), "value", "ts",
                        F.lit("app").alias("source_db"), F.lit("users").alias("table_name"))

    @cached_property
    def metric_samples(self) -> DataFrame:
        e = self.t.events.withColumn("service", F.col("user_id") % 8)
        # a counter of minutes that starts again every hundred
        return e.select("service", "ts", "event_id",
                        (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).cast("long") % 100).alias("counter_value"),
                        F.col("value").alias("latency"),
                        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("code"))

    @cached_property
    def spans(self) -> DataFrame:
        e = self.t.events
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return e.select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"),
                        F.lag("event_id").over(w).alias("parent_id"), (F.col("user_id") % 8).alias("service"),
                        "ts", F.col("value").alias("duration"))

    @cached_property
    def trace_spans(self) -> DataFrame:
        """Events of a user as a binary tree of overlapping spans: the parent of the n-th is the (n / 2)-th."""
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        e = self.t.events.select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), (F.col("user_id") % 8).alias("service"), F.row_number().over(w).cast("long").alias("rn"))
        start = (F.length(F.bin("rn")) - 1) * 100 + F.col("span_id") % 90 + (F.col("rn") % 2) * (F.col("span_id") % 400)
        x = e.withColumn("start_ms", start).withColumn("end_ms", F.col("start_ms") + 100 + (F.col("span_id") * 7) % 600 + F.when(F.col("rn") == 1, 2000).otherwise(0))
        p = e.select("trace_id", F.col("rn").alias("up"), F.col("span_id").alias("parent_id"))
        return x.withColumn("up", F.floor(F.col("rn") / 2).cast("long")).join(p, ["trace_id", "up"], "left").select("trace_id", "span_id", "parent_id", "service", "start_ms", "end_ms")

    @cached_property
    def threats(self) -> DataFrame:
        o = self.t.orders
        return o.select(F.col("o_orderkey").alias("threat_id"), (F.col("o_orderkey") % 6).alias("category_no"),
                        (F.col("o_orderkey") % 4 + 1).alias("impact"),
                        (F.col("o_custkey") % 4 + 1).alias("likelihood"))

    @cached_property
    def controls(self) -> DataFrame:
        p = self.t.part
        return p.select(F.col("p_partkey").alias("control_id"), (F.col("p_size") % 5).alias("effectiveness"),
                        (F.col("p_partkey") % 4).alias("status_no"), (F.col("p_partkey") % 6).alias("layer_no"),
                        (F.col("p_partkey") % 3).alias("type_no"), F.col("p_retailprice").alias("cost"))

    @cached_property
    def mappings(self) -> DataFrame:
        return self.t.lineitem.select(F.col("l_orderkey").alias("threat_id"),
                                      F.col("l_partkey").alias("control_id")).distinct()

    @cached_property
    def attack_nodes(self) -> DataFrame:
        o, li = self.t.orders, self.t.lineitem
        roots = o.select(F.col("o_orderkey").alias("tree_id"), F.lit(0).cast("long").alias("node_no"),
                         F.when(F.col("o_orderstatus") == "F", "and").otherwise("or").alias("node_type"),
                         F.lit(0).alias("difficulty"), F.lit(0).alias("cost"))
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey",
                                                     "l_extendedprice", "l_quantity")
        leaves = li.select(F.col("l_orderkey").alias("tree_id"), F.row_number().over(w).cast("long").alias("node_no"),
                           F.lit("leaf").alias("node_type"), (F.col("l_partkey") % 5 + 1).cast("int").alias("difficulty"),
                           (F.col("l_suppkey") % 5).cast("int").alias("cost"))
        return roots.unionByName(leaves)

    @cached_property
    def packages(self) -> DataFrame:
        p = self.t.part
        lic = (F.when(F.col("p_partkey") % 6 == 0, "MIT").when(F.col("p_partkey") % 6 == 1, "Apache-2.0")
               .when(F.col("p_partkey") % 6 == 2, "BSD-3-Clause").when(F.col("p_partkey") % 6 == 3, "ISC")
               .when(F.col("p_partkey") % 6 == 4, "GPL-3.0").otherwise("unknown"))
        ver = F.concat_ws(".", (F.col("p_size") % 5).cast("string"), (F.col("p_partkey") % 10).cast("string"),
                          (F.col("p_partkey") % 7).cast("string"))
        return p.select(F.col("p_partkey").alias("package_id"), F.col("p_name").alias("name"),
                        ver.alias("version"), lic.alias("license"))

    @cached_property
    def pull_requests(self) -> DataFrame:
        o = self.t.orders
        key = F.concat(F.lit("PROJ-"), F.col("o_custkey").cast("string"))
        return o.select(F.col("o_orderkey").alias("number"),
                        F.when(F.col("o_orderkey") % 5 == 0, "Tidy up")
                        .otherwise(F.concat(key, F.lit(": change"))).alias("title"),
                        F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit("feature/"), key, F.lit("_x")))
                        .otherwise("").alias("branch"),
                        F.col("o_orderdate").alias("merged_at"), F.col("o_custkey").alias("author_id"))

    @cached_property
    def tickets(self) -> DataFrame:
        c = self.t.customer
        return (c.filter(F.col("c_custkey") % 4 != 0)
                .select(F.concat(F.lit("PROJ-"), F.col("c_custkey").cast("string")).alias("ticket_key"),
                        F.col("c_name").alias("summary"),
                        F.when(F.col("c_custkey") % 3 == 0, "Bug").when(F.col("c_custkey") % 3 == 1, "Story")
                        .otherwise("Task").alias("issue_type")))

    @cached_property
    def consents(self) -> DataFrame:
        e = self.t.events
        m = F.col("event_id") % 4
        ctype = (F.when(m == 0, "marketing_emails").when(m == 1, "analytics_tracking")
                 .when(m == 2, "third_party_sharing").otherwise("profiling"))
        return e.select("event_id", "user_id", ctype.alias("consent_type"), (F.col("value") > 100).alias("granted"),
                        (F.col("event_type") == "error").alias("withdrawn"), "ts")

    @cached_property
    def bookings(self) -> DataFrame:
        li = self.t.lineitem
        return li.select(F.col("l_suppkey").alias("room_id"), F.col("l_orderkey").alias("booking_id"),
                         F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("part_no"),
                         F.col("l_shipdate").cast("date").alias("start_day"),
                         F.col("l_quantity").cast("int").alias("days"))

    @cached_property
    def usage_cost(self) -> DataFrame:
        li = self.t.lineitem
        return li.select(F.col("l_partkey").alias("resource_id"),
                         F.when(F.col("l_returnflag") == "R", F.lit(None)).otherwise(F.col("l_returnflag"))
                         .alias("cost_center"),
                         F.col("l_shipdate").cast("date").alias("day"), F.col("l_extendedprice").alias("amount"))

    def _tree_rows(self, *more: str) -> DataFrame:
        """Orders and their lines by tree, in one shuffle that nodes and edges read alike: (tree_id, code, leaf_no, first, *more).
        ``code`` is 0 or 1 for a root (1: and), a hundred times the flag's number for a line, and 10 more if it is mitigated, 20 if nobody knows;
        ``first`` marks one line of each flag."""
        flag = F.when(F.col("l_returnflag") == "A", 100).when(F.col("l_returnflag") == "N", 200).otherwise(300)
        known = F.when(F.col("l_linestatus").isNull(), 20).when(F.col("l_linestatus") == "F", 10).otherwise(0)
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
        lines = self.t.lineitem.select(F.col("l_orderkey").alias("tree_id"), (flag + known).alias("code"), *order)
        types = lines.schema
        roots = self.t.orders.select(F.col("o_orderkey").alias("tree_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("code"),
                                     *[F.lit(None).cast(types[c].dataType).alias(c) for c in order])
        rows = roots.unionByName(lines).repartition("tree_id").withColumn("flag_code", F.floor(F.col("code") / 100).cast("long"))
        w = Window.partitionBy("tree_id").orderBy(F.col("code") < 100, *order)  # lines first; all is numbered in one pass
        so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        first = F.greatest(*[F.when(F.col("flag_code") == f, F.count_if(F.col("flag_code") == f).over(so_far) == 1) for f in (1, 2, 3)])
        return rows.select("tree_id", "code", F.row_number().over(w).cast("long").alias("leaf_no"), "flag_code", first.alias("first"), *more)

    @cached_property
    def tree_nodes(self) -> DataFrame:
        def node(node_id, node_type, *values):
            named = zip(("difficulty", "cost", "detection_risk", "time_hours", "requires_insider", "requires_physical", "mitigated"), values, strict=True)
            return F.struct(node_id.cast("long").alias("node_id"), F.lit(node_type).alias("node_type") if isinstance(node_type, str) else node_type.alias("node_type"),
                            *[v.alias(n) for n, v in named])

        no = [F.lit(0), F.lit(0), F.lit(0), F.lit(0.0), F.lit(False), F.lit(False), F.lit(False)]
        known = F.col("code") % 100
        leaf = node(F.col("leaf_no"), "leaf", (F.col("l_partkey") % 5 + 1).cast("int"), (F.col("l_suppkey") % 5).cast("int"),
                    ((F.col("l_partkey") + F.col("l_suppkey")) % 5).cast("int"), F.col("l_quantity"), F.col("l_partkey") % 7 == 0,
                    F.col("l_suppkey") % 11 == 0, F.when(known == 20, F.lit(None)).otherwise(known == 10))
        mid = node(F.lit(1000) + F.col("flag_code"), F.when(F.col("flag_code") == 2, "and").otherwise("or"), *no)
        root = node(F.lit(0), F.when(F.col("code") == 1, "and").otherwise("or"), *no)
        found = F.when(F.col("code") < 100, F.array(root)).when(F.col("first"), F.array(leaf, mid)).otherwise(F.array(leaf))
        return self._tree_rows("l_partkey", "l_suppkey", "l_quantity").select("tree_id", F.explode(found).alias("n")).select("tree_id", "n.*")

    @cached_property
    def tree_edges(self) -> DataFrame:
        mid = F.lit(1000) + F.col("flag_code")

        def edge(parent, child, pos):
            return F.struct(parent.cast("long").alias("parent"), child.cast("long").alias("child"), pos.cast("long").alias("pos"))

        low, top = edge(mid, F.col("leaf_no"), F.col("leaf_no")), edge(F.lit(0), mid, F.col("flag_code"))
        found = F.when(F.col("first"), F.array(low, top)).otherwise(F.array(low))
        return self._tree_rows().filter("code >= 100").select("tree_id", F.explode(found).alias("e")).select("tree_id", "e.*")

    @cached_property
    def tree_sizes(self) -> DataFrame:
        """(tree_id, rows): at least as many as a tree has nodes and edges: two a line and two for each of its flags."""
        keys = self.t.orders.select(F.col("o_orderkey").alias("tree_id"), F.lit(1).alias("roots"), F.lit(0).alias("lines"))
        keys = keys.unionByName(self.t.lineitem.select(F.col("l_orderkey").alias("tree_id"), F.lit(0).alias("roots"), F.lit(1).alias("lines")))
        n = keys.groupBy("tree_id").agg(F.sum("roots").alias("roots"), F.sum("lines").alias("lines"))
        return n.select("tree_id", (F.col("roots") + 2 * F.col("lines") + 2 * F.least(F.col("lines"), F.lit(3))).alias("rows"))

    @cached_property
    def advisories(self) -> DataFrame:
        # one advisory per package name: the name's lowest part key
        part = self.t.part
        first = part.groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
        p = part.join(first, ["p_name", "p_partkey"], "left_semi")
        k = F.col("p_partkey")
        fixed = F.concat((F.col("p_size") % 5).cast("string"), F.lit(".5.0"))
        return p.select(F.concat(F.lit("ADV-"), k.cast("string")).alias("advisory_id"), F.col("p_name").alias("name"),
                        F.lit("0.0.0").alias("introduced"), fixed.alias("fixed"),
                        F.when(k % 5 == 0, "critical").when(k % 5 == 1, "high").when(k % 5 == 2, "medium").when(k % 5 == 3, "low")
                        .otherwise("moderate").alias("severity"),
                        (k % 3 == 0).alias("exploit_available"),
                        F.when(k % 4 == 0, F.lit(None).cast("boolean")).otherwise(k % 4 == 1).alias("publicly_disclosed"),
                        F.when(k % 6 == 0, "remote_code_execution in parser").otherwise("denial of service").alias("description"),
                        ((k % 100) / 10.0).alias("cvss"), F.when(k % 2 == 0, fixed).otherwise("").alias("fixed_in"))

    @cached_property
    def call_log(self) -> DataFrame:
        e = self.t.events
        return e.select((F.col("user_id") % 8).alias("service"), "ts", "event_id",
                        (F.col("event_type") != "error").alias("ok"))
