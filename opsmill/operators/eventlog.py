"""Event-sourced projections, CDC and event-log checks in batch form.

A projection that the samples apply event by event (UPDATE ... per event) is expressed
as one aggregation per key: the fold of additive handlers is a sum of signed
contributions, and "last writer wins" fields are ``max_by`` over the event version. The
aggregation is partial (map-side) and the result is exactly the sequential fold. The
streaming forms live in ``opsmill.streaming``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _is(t: str, col: str = "event_type") -> Column:
    return F.col(col) == F.lit(t)


# ----------------------------------------------------------------------------- E1
def append_with_expected_version(batch: DataFrame, log: DataFrame, stream: str = "stream_id",
                                 expected: str = "expected_version", order: Sequence[str] = ("created_at",),
                                 version: str = "version") -> tuple[DataFrame, DataFrame]:
    """Optimistic concurrency. Each stream's batch is accepted only if the stream's
    current max version equals the expected one; accepted events get the next versions,
    a conflicting batch is rejected whole. Returns (accepted, conflicts)."""
    cur = log.groupBy(stream).agg(F.max(version).alias("current_version"))
    b = batch.join(cur, stream, "left").withColumn("current_version", F.coalesce("current_version", F.lit(0)).cast("long"))
    # a batch is one expected version per stream; any mismatch rejects all its events
    ok = F.min((F.col(expected) == F.col("current_version")).cast("int")).over(Window.partitionBy(stream)) == 1
    b = b.withColumn("__ok", ok)
    w = Window.partitionBy(stream).orderBy(*order)
    accepted = (b.filter("__ok").withColumn(version, (F.col("current_version") + F.row_number().over(w)).cast("long"))
                .drop("__ok"))
    conflicts = b.filter(~F.col("__ok")).drop("__ok")
    return accepted, conflicts


# ----------------------------------------------------------------------------- E2-E6
def projection_fold(events: DataFrame, key: str, handlers: dict[str, dict[str, Column]],
                    type_col: str = "event_type") -> DataFrame:
    """Apply additive handlers to a read model. ``handlers`` maps an event type to
    {field: contribution}; unhandled types are filtered first (``handles()``). The read
    model field is the sum of its contributions - identical to applying them in order."""
    handled = list(handlers)
    fields = sorted({f for h in handlers.values() for f in h})
    ev = events.filter(F.col(type_col).isin(handled))
    aggs = []
    for f in fields:
        expr = None
        for t, h in handlers.items():
            if f in h:
                expr = F.when(_is(t, type_col), h[f]) if expr is None else expr.when(_is(t, type_col), h[f])
        aggs.append(F.coalesce(F.sum(expr.otherwise(0)), F.lit(0)).alias(f))
    return ev.groupBy(key).agg(*aggs, F.count(F.lit(1)).alias("events_applied"))


# Status set by each lifecycle event of an order.
ORDER_STATUS = {"OrderCreated": "pending", "OrderShipped": "shipped", "OrderCompleted": "completed",
                "OrderCancelled": "cancelled"}


def order_summary_projection(events: DataFrame, key: str = "o_orderkey", amount: str = "amount",
                             ts: str = "event_time", version: str = "version",
                             reason: str | None = None) -> tuple[DataFrame, DataFrame]:
    """order_summaries read model.

    created -> status pending, total 0, items 0; item added/removed -> total +/- amount
    (price x quantity), items +/- 1; shipped / completed / cancelled set the status and
    their timestamp (cancel also the reason). Item events of an order without
    OrderCreated would be no-op UPDATEs in the sample: such orders produce no row and are
    returned in the second DataFrame (orphans) instead of vanishing."""
    et = F.col("event_type")
    status_map = F.create_map(*[x for k, v in ORDER_STATUS.items() for x in (F.lit(k), F.lit(v))])
    status_ev = et.isin(list(ORDER_STATUS))
    agg = events.groupBy(key).agg(
        F.count_if(et == "OrderCreated").alias("__created"),
        F.max_by(F.when(status_ev, status_map[et]), F.when(status_ev, F.col(version))).alias("status"),
        F.coalesce(F.sum(F.when(et == "OrderItemAdded", F.col(amount)).when(et == "OrderItemRemoved", -F.col(amount))),
                   F.lit(0.0)).alias("total_amount"),
        (F.count_if(et == "OrderItemAdded") - F.count_if(et == "OrderItemRemoved")).alias("item_count"),
        F.min(F.when(et == "OrderCreated", F.col(ts))).alias("created_at"),
        F.max_by(F.when(et == "OrderShipped", F.col(ts)), F.when(et == "OrderShipped", F.col(version))).alias("shipped_at"),
        F.max_by(F.when(et == "OrderCompleted", F.col(ts)), F.when(et == "OrderCompleted", F.col(version))).alias("completed_at"),
        F.max_by(F.when(et == "OrderCancelled", F.col(ts)), F.when(et == "OrderCancelled", F.col(version))).alias("cancelled_at"),
        (F.max_by(F.when(et == "OrderCancelled", F.col(reason)), F.when(et == "OrderCancelled", F.col(version)))
         if reason else F.lit(None).cast("string")).alias("cancellation_reason"),
        F.max(version).alias("last_event_version"))
    rows = agg.filter(F.col("__created") > 0).drop("__created")
    orphans = agg.filter(F.col("__created") == 0).select(key, "item_count", "last_event_version")
    return rows, orphans


def daily_sales_projection(completed: DataFrame, refunds: DataFrame, day_of=lambda c: F.to_date(c)) -> tuple[DataFrame, DataFrame]:
    """daily_sales. ``completed`` rows (completed_at, total_amount, item_count) add one
    order, revenue and items to their day; ``refunds`` (original_completed_at,
    refund_amount) subtract an order and revenue and add to refunds *on the original
    completed day*. The refund is an UPDATE in the sample, so a refund whose day has no
    sale changes nothing: it is left out and returned as the second DataFrame."""
    sales = completed.select(day_of(F.col("completed_at")).alias("date"), F.lit(1).alias("d_orders"),
                             F.col("total_amount").alias("d_revenue"), F.col("item_count").cast("long").alias("d_items"),
                             F.lit(0.0).alias("d_refunds"))
    sale_days = sales.select("date").distinct()
    rf = refunds.select(day_of(F.col("original_completed_at")).alias("date"), F.lit(-1).alias("d_orders"),
                        (-F.col("refund_amount")).alias("d_revenue"), F.lit(0).cast("long").alias("d_items"),
                        F.col("refund_amount").alias("d_refunds"))
    applied = rf.join(sale_days, "date", "left_semi")
    dropped = rf.join(sale_days, "date", "left_anti")
    out = sales.unionByName(applied).groupBy("date").agg(
        F.sum("d_orders").cast("long").alias("total_orders"), F.sum("d_revenue").alias("total_revenue"),
        F.sum("d_items").cast("long").alias("total_items"), F.sum("d_refunds").alias("total_refunds"))
    return out, dropped


def customer_activity_projection(events: DataFrame, key: str, ts: str, version: str, type_map: dict[str, str],
                                 amount: str, tier_col: str) -> dict[str, DataFrame]:
    """E5: three read models from one event DataFrame.

    ``type_map`` names which source type plays CustomerCreated, OrderCompleted,
    ReviewSubmitted and CustomerTierChanged. customers: tier = last tier change (by
    version) else 'standard'; summary: orders, spent, reviews, last order / review time;
    order history: one row per completed order."""
    inv = {v: k for k, v in type_map.items()}
    et = F.col("event_type")
    created, order, review, tier = (inv["CustomerCreated"], inv["OrderCompleted"], inv["ReviewSubmitted"],
                                    inv["CustomerTierChanged"])
    agg = events.groupBy(key).agg(
        F.min(F.when(et == created, F.col(ts))).alias("created_at"),
        F.max_by(F.when(et == tier, F.col(tier_col)), F.when(et == tier, F.col(version))).alias("__tier"),
        F.count_if(et == order).alias("total_orders"),
        F.coalesce(F.sum(F.when(et == order, F.col(amount))), F.lit(0.0)).alias("total_spent"),
        F.count_if(et == review).alias("total_reviews"),
        F.max(F.when(et == order, F.col(ts))).alias("last_order_at"),
        F.max(F.when(et == review, F.col(ts))).alias("last_review_at"))
    customers = agg.filter(F.col("created_at").isNotNull()).select(
        key, "created_at", F.coalesce("__tier", F.lit("standard")).alias("tier"))
    summary = agg.filter(F.col("created_at").isNotNull()).select(
        key, "total_orders", "total_spent", "total_reviews", "last_order_at", "last_review_at")
    history = events.filter(et == order).select(key, F.col(ts).alias("completed_at"), F.col(amount).alias("total_amount"))
    return {"customers": customers, "summary": summary, "history": history}


def search_document_projection(events: DataFrame, key: str, order: Sequence[str], fields: Sequence[str],
                               create: str, delete: str, type_col: str = "event_type") -> DataFrame:
    """Search documents. Create starts a document, partial updates set the fields
    they carry (NULL = not carried), delete removes it. The document exists when its last
    lifecycle event is a create; each field is the last non-NULL value since that create.
    One shuffle on ``key``: the window and the aggregate share the partitioning."""
    o = F.struct(*[F.col(c) for c in order])
    w = Window.partitionBy(key)
    ev = events.withColumn("__o", o).withColumn(
        "__last_create", F.max(F.when(F.col(type_col) == create, F.col("__o"))).over(w))
    live = ev.filter(F.col("__o") >= F.col("__last_create"))
    aggs = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("__o"))).alias(f) for f in fields]
    doc = live.groupBy(key).agg(F.max_by(F.col(type_col), F.when(F.col(type_col).isin(create, delete), F.col("__o")))
                                .alias("__lifecycle"), *aggs)
    return doc.filter(F.col("__lifecycle") == create).drop("__lifecycle")


# ----------------------------------------------------------------------------- E7-E12
def incremental_merge(previous: DataFrame, delta: DataFrame, key: str, additive: Sequence[str],
                      latest: Sequence[str] = (), version: str = "last_event_version") -> DataFrame:
    """Merge a projection built from new events into the stored one. Additive
    fields add; ``latest`` fields take the side with the higher version. Rebuild from
    scratch and (snapshot + tail) give the same rows - the property tests check it."""
    p = previous.select(key, *[F.col(c).alias(f"__p_{c}") for c in [*additive, *latest, version]])
    d = delta.select(key, *[F.col(c).alias(f"__d_{c}") for c in [*additive, *latest, version]])
    j = p.join(d, key, "full")
    newer = F.coalesce(F.col(f"__d_{version}"), F.lit(-1)) > F.coalesce(F.col(f"__p_{version}"), F.lit(-1))
    cols = [F.col(key)]
    for c in additive:
        cols.append((F.coalesce(F.col(f"__p_{c}"), F.lit(0)) + F.coalesce(F.col(f"__d_{c}"), F.lit(0))).alias(c))
    for c in latest:
        cols.append(F.when(newer, F.col(f"__d_{c}")).otherwise(F.col(f"__p_{c}")).alias(c))
    cols.append(F.greatest(F.col(f"__p_{version}"), F.col(f"__d_{version}")).alias(version))
    return j.select(*cols)


def checkpoint_position(log: DataFrame, position: str = "global_position") -> DataFrame:
    """The watermark row a batch run stores after projecting ``log``."""
    return log.agg(F.max(position).alias("last_position"), F.count(F.lit(1)).alias("events"))


def split_valid(events: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Events failing a rule go to a dead-letter DataFrame with every failed rule
    named; later valid events still advance (nothing is skipped silently)."""
    reasons = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]), lambda x: x.isNotNull())
    x = events.withColumn("errors", reasons)
    return x.filter(F.size("errors") == 0).drop("errors"), x.filter(F.size("errors") > 0)


def with_staleness(projection: DataFrame, expected: DataFrame, key: str, version: str = "last_event_version",
                   expected_col: str = "expected_version") -> DataFrame:
    """Read-your-writes without waiting: every row carries its version and a
    ``stale`` flag against the version the reader expects."""
    return (projection.join(expected.select(key, expected_col), key, "left")
            .withColumn("stale", F.coalesce(F.col(version) < F.col(expected_col), F.lit(False))))


def projection_lag(log: DataFrame, checkpoint: DataFrame, position: str = "global_position", ts: str = "created_at") -> DataFrame:
    """Events not yet projected and the event-time lag in seconds (one row, one scan
    of the log; the checkpoint position enters as a scalar subquery)."""
    lp = checkpoint.select(F.max("last_position")).scalar()
    done = F.col(position) <= lp
    return (log.agg(F.max(position).alias("head_position"), F.max(ts).alias("head_time"),
                    F.max(F.when(done, F.col(ts))).alias("checkpoint_time"), F.count_if(done).alias("projected"))
            .withColumn("last_position", lp)
            .withColumn("lag_events", F.col("head_position") - F.col("last_position"))
            .withColumn("lag_seconds", F.unix_timestamp("head_time") - F.unix_timestamp("checkpoint_time")))


def upcast(events: DataFrame, version_col: str, payload: str, upcasters: dict[int, dict[str, Column]],
           target_fields: Sequence[str]) -> DataFrame:
    """Bring every schema version to the newest field set. ``upcasters[v]`` gives
    the expression of each field for version v (defaults for added fields, renames)."""
    out = events
    for f in target_fields:
        expr = None
        for v, fields in sorted(upcasters.items()):
            if f in fields:
                cond = F.col(version_col) == v
                expr = F.when(cond, fields[f]) if expr is None else expr.when(cond, fields[f])
        out = out.withColumn(f, expr if expr is not None else F.lit(None))
    return out


# ----------------------------------------------------------------------------- E14-E17
def idempotent(events: DataFrame, id_col: str = "event_id") -> DataFrame:
    """E14 (batch): duplicate deliveries collapse to one (streaming form drops duplicates
    within the watermark)."""
    return events.dropDuplicates([id_col])


def cdc_apply(changes: DataFrame, pk: str, order: Sequence[str], op: str = "op", delete_ops=("d",),
              target: DataFrame | None = None) -> DataFrame:
    """Newest change per primary key wins; deletes remove the row. With a target
    table the result is target rows not touched + surviving changed rows (one full join
    worth of shuffle on ``pk``)."""
    others = [c for c in changes.columns if c != pk]
    last = changes.groupBy(pk).agg(F.max_by(F.struct(*others), F.struct(*[F.col(c) for c in order])).alias("__r")).select(
        pk, "__r.*")
    alive = last.filter(~F.col(op).isin(list(delete_ops)))
    if target is None:
        return alive
    untouched = target.join(last.select(pk), pk, "left_anti")
    return untouched.unionByName(alive.select(*target.columns))


def cdc_metrics(changes: DataFrame, keys: Sequence[str] = ("source_db", "table_name", "op")) -> DataFrame:
    """events_total by (source, table, op)."""
    return changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("events_total"))


def replication_lag(source: DataFrame, target: DataFrame, table_col: str, ts: str) -> DataFrame:
    """Per table, newest source change minus newest applied change, in seconds."""
    s = source.groupBy(table_col).agg(F.max(ts).alias("source_ts"))
    t = target.groupBy(table_col).agg(F.max(ts).alias("target_ts"))
    return s.join(t, table_col, "left").withColumn(
        "lag_seconds", F.unix_timestamp("source_ts") - F.unix_timestamp(F.coalesce("target_ts", F.lit("1970-01-01").cast("timestamp"))))


def dual_write(source: DataFrame, mirror: DataFrame, key_map: dict[str, str], pk: str) -> DataFrame:
    """Mirror table with renamed columns kept in sync by upsert."""
    renamed = source.select(*[F.col(s).alias(t) for s, t in key_map.items()])
    return mirror.join(renamed.select(pk), pk, "left_anti").unionByName(renamed.select(*mirror.columns))


def late_events(events: DataFrame, arrival: str, ts: str, lateness_seconds: int) -> DataFrame:
    """Flag events that arrive behind the watermark: event time earlier than the
    latest event time seen so far (in arrival order) minus the allowed lateness - the rows
    a watermarked stream would drop, reported in batch.

    The running maximum over the global arrival order needs no single-partition window:
    rows fall into value buckets of the arrival order, each bucket keeps a running maximum,
    and the maxima of earlier buckets (one row a bucket) are carried in by a prefix maximum."""
    from opsmill.operators.relational import value_buckets

    t = F.unix_micros(F.col(ts).cast("timestamp"))
    # rows that arrive together count by event time, so equal ones get equal flags in any order
    x = value_buckets(events, [arrival, ts]).withColumn("__t", t)
    before = Window.partitionBy("__bucket").orderBy(arrival, ts).rowsBetween(Window.unboundedPreceding, -1)
    per = x.groupBy("__bucket").agg(F.max("__t").alias("__pmax"))
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(F.col("__bucket").alias("__b"), F.max("__pmax").over(earlier).alias("__carry"))
    x = x.withColumn("__run", F.max("__t").over(before)).join(F.broadcast(carry), F.col("__bucket") == F.col("__b"))  # a row a bucket
    seen = F.greatest(F.col("__run"), F.col("__carry"))
    return (x.withColumn("watermark_us", seen - F.lit(lateness_seconds * 1_000_000))
            .withColumn("late", F.coalesce(F.col("__t") < F.col("watermark_us"), F.lit(False)))
            .drop("__bucket", "__b", "__t", "__run", "__carry"))
