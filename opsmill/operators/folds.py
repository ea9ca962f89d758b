"""Ordered folds: per-key state machines over ordered rows (SURVEY 2.9 E18-E21, E28,
E29; 2.10 X4; 2.13 R12; 2.14 G10; 2.17 V4).

These operators are sequential by definition (the next decision depends on the state
left by the previous row), so Spark cannot express them with a window frame. The plan is:

1. hash-partition on the key (or on (key, segment) where the state provably resets),
2. sort within partitions on (key, order),
3. stream each partition through ``mapInPandas`` in Arrow batches, carrying only the
   fold state between rows and batches.

A key is never collected into one array or one pandas frame: memory is bounded by the
state (a few scalars, or the last second of accepted calls), whatever the key size. A hot
key still runs in one task, which is inherent to a sequential fold; for the rate limit
and throttle, quiet gaps at least as long as the window reset the state exactly, and the
segment id then spreads one hot key over many tasks.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Fold:
    """A per-key state machine: ``init(key)`` -> state; ``step(state, row)`` -> (state,
    output dict, list of them or None); ``finish(state)`` -> outputs after the key's last row."""

    def init(self, key):  # pragma: no cover - interface
        raise NotImplementedError

    def step(self, state, row: dict):  # pragma: no cover - interface
        raise NotImplementedError

    def finish(self, state) -> list[dict]:
        return []


def _outputs(out) -> list[dict]:
    return out if isinstance(out, list) else [] if out is None else [out]


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold, schema: T.StructType | str,
                 partition_by: Sequence[str] | None = None, num_partitions: int | None = None) -> DataFrame:
    """Run ``fold`` over each key's rows in ``order``; see the module docstring."""
    keys, order = list(keys), list(order)
    part_cols = list(partition_by or keys)
    parted = df.repartition(num_partitions, *part_cols) if num_partitions else df.repartition(*part_cols)
    ordered = parted.sortWithinPartitions(*part_cols, *keys, *order)
    out_schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    out_cols = [f.name for f in out_schema.fields]

    key_cols = part_cols + [c for c in keys if c not in part_cols]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur_key, state = None, None
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                # null keys are one key: they arrive as None, NaN or NaT, and NaN != NaN
                k = tuple(None if pd.isna(v) else v for v in (rec[c] for c in key_cols))
                if k != cur_key:
                    if cur_key is not None:
                        rows += fold.finish(state)
                    cur_key, state = k, fold.init(k)
                state, out = fold.step(state, rec)
                rows += _outputs(out)
            if rows:
                yield pd.DataFrame(rows, columns=out_cols)
        rows = [] if cur_key is None else fold.finish(state)
        if rows:
            yield pd.DataFrame(rows, columns=out_cols)

    return ordered.mapInPandas(run, out_schema)


def reset_segments(df: DataFrame, key: str, ts: str, gap_seconds: float, order: Sequence[str] = (), out: str = "segment",
                   bucket_seconds: int = 3600) -> DataFrame:
    """Segment id that increases whenever the gap to the previous row of the key is at
    least ``gap_seconds``; folds whose state is empty after such a gap can process
    segments independently (and in parallel).

    No window spans a whole key: ``lag`` and the running count stay inside (key, time
    bucket), and the last time and the number of segment starts of earlier buckets are
    carried in from one row for each bucket. Null times form a bucket of their own in
    front of the others."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    x = df.withColumn("__us", us).withColumn("__b", F.coalesce(F.floor(F.col("__us") / F.lit(bucket_seconds * 1_000_000)).cast("long"), F.lit(-(2**62))))
    inside = Window.partitionBy(key, "__b").orderBy(F.col(ts), *[F.col(c) for c in order])
    limit = round(gap_seconds * 1_000_000)
    x = x.withColumn("__lag", F.lag("__us").over(inside)).withColumn("__first", F.row_number().over(inside) == 1)
    x = x.withColumn("__new", F.when(F.col("__first"), 0).when(F.col("__lag").isNull() | (F.col("__us") - F.col("__lag") >= limit), 1).otherwise(0))
    x = x.withColumn("__local", F.sum("__new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    per = x.groupBy(key, "__b").agg(F.min("__us").alias("__lo"), F.max("__us").alias("__hi"), F.sum("__new").alias("__n"))
    across = Window.partitionBy(key).orderBy("__b")
    start = F.lag("__hi").over(across).isNull() | (F.col("__lo") - F.lag("__hi").over(across) >= limit)
    per = per.withColumn("__start", start.cast("int")).withColumn(
        "__offset", F.coalesce(F.sum(F.col("__n") + F.col("__start")).over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("__start"))
    per = per.select(F.col(key).alias("__k"), F.col("__b").alias("__kb"), "__offset")
    return (x.join(per, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__b") == F.col("__kb")))
            .withColumn(out, F.col("__offset") + F.col("__local")).drop("__us", "__b", "__lag", "__first", "__new", "__local", "__k", "__kb", "__offset"))


def _secs(v) -> float:
    if isinstance(v, pd.Timestamp):
        return v.value / 1e9
    if hasattr(v, "timestamp"):
        return pd.Timestamp(v).value / 1e9
    return float(v)


# ----------------------------------------------------------------------------- R12 / V4
class GreedyBudget(Fold):
    """Take items in the given order while they fit; an item that does not fit is
    skipped and later, cheaper items may still be taken."""

    def __init__(self, budget_col: str, cost_col: str, id_cols: Sequence[str]):
        self.budget_col, self.cost_col, self.id_cols = budget_col, cost_col, list(id_cols)

    def init(self, key):
        return {"left": None}

    def step(self, s, row):
        if s["left"] is None:
            s["left"] = float(row[self.budget_col])
        cost = float(row[self.cost_col])
        take = cost <= s["left"]
        if take:
            s["left"] -= cost
        return s, {**{c: row[c] for c in self.id_cols}, "selected": bool(take), "remaining": float(s["left"])}


def greedy_budget(items: DataFrame, key: str, item_id: str, value: str, cost: str, budget: str) -> DataFrame:
    """Per plan, controls by value (desc, ties by id) taken while the budget allows.
    Items costing more than the whole budget are never candidates (as in the sample)."""
    cand = items.filter(F.col(cost) <= F.col(budget))
    cand = cand.withColumn("__neg_value", -F.col(value))
    schema = T.StructType([items.schema[key], items.schema[item_id], T.StructField("selected", T.BooleanType()),
                           T.StructField("remaining", T.DoubleType())])
    return ordered_fold(cand, [key], ["__neg_value", item_id], GreedyBudget(budget, cost, [key, item_id]), schema)


def token_budget_pack(items: DataFrame, key: str, item_id: str, priority: str, tokens: str, budget: int = 8192) -> DataFrame:
    """V4: context items by priority (desc, ties by id) packed into a token budget with the
    same take-if-it-fits rule."""
    cand = items.withColumn("__budget", F.lit(float(budget))).withColumn("__neg_p", -F.col(priority)).withColumn(
        "__tok", F.col(tokens).cast("double"))
    schema = T.StructType([items.schema[key], items.schema[item_id], T.StructField("selected", T.BooleanType()),
                           T.StructField("remaining", T.DoubleType())])
    return ordered_fold(cand, [key], ["__neg_p", item_id], GreedyBudget("__budget", "__tok", [key, item_id]), schema)


# ----------------------------------------------------------------------------- E21 / E29 / E28
class SlidingRateLimit(Fold):
    """Accept a call when fewer than ``max_rps`` accepted calls lie in the last
    ``window`` seconds (calls exactly ``window`` old still count); rejected calls are
    not recorded."""

    def __init__(self, ts: str, ids: Sequence[str], max_rps: int, window: float = 1.0):
        self.ts, self.ids, self.max_rps, self.window = ts, list(ids), max_rps, window

    def init(self, key):
        return deque()

    def step(self, q, row):
        t = _secs(row[self.ts])
        while q and q[0] < t - self.window:
            q.popleft()
        ok = len(q) < self.max_rps
        if ok:
            q.append(t)
        return q, {**{c: row[c] for c in self.ids}, "accepted": ok}


def sliding_rate_limit(calls: DataFrame, key: str, ts: str, call_id: str, max_rps: int, window_seconds: float = 1.0) -> DataFrame:
    """Exact replay of a sliding-window limiter. A gap longer than the window empties
    the accepted-call queue, so segments split at such gaps are folded independently."""
    seg = reset_segments(calls, key, ts, window_seconds + 1e-6, [call_id])
    schema = T.StructType([calls.schema[key], calls.schema[call_id], T.StructField("accepted", T.BooleanType())])
    return ordered_fold(seg, [key, "segment"], [ts, call_id], SlidingRateLimit(ts, [key, call_id], max_rps, window_seconds),
                        schema, partition_by=[key, "segment"])


class ThrottleFirst(Fold):
    def __init__(self, ts: str, ids: Sequence[str], interval: float):
        self.ts, self.ids, self.interval = ts, list(ids), interval

    def init(self, key):
        return {"last": None}

    def step(self, s, row):
        t = _secs(row[self.ts])
        emit = s["last"] is None or t - s["last"] >= self.interval
        if emit:
            s["last"] = t
        return s, {**{c: row[c] for c in self.ids}, "emitted": emit}


def throttle_first(events: DataFrame, key: str, ts: str, event_id: str, interval_seconds: float) -> DataFrame:
    """Emit an event, then drop the rest until ``interval`` has passed since the last
    *emitted* one. A gap of at least the interval always emits, so it starts a segment."""
    seg = reset_segments(events, key, ts, interval_seconds, [event_id])
    schema = T.StructType([events.schema[key], events.schema[event_id], T.StructField("emitted", T.BooleanType())])
    return ordered_fold(seg, [key, "segment"], [ts, event_id], ThrottleFirst(ts, [key, event_id], interval_seconds), schema,
                        partition_by=[key, "segment"])


def debounce(events: DataFrame, key: str, ts: str, event_id: str, quiet_seconds: float) -> DataFrame:
    """The last event of each burst - emitted when the next event of the key comes
    at least ``quiet`` later (or never). Pure window function: no fold needed."""
    w = Window.partitionBy(key).orderBy(F.col(ts), F.col(event_id))
    nxt = F.lead(ts).over(w)
    gap = F.unix_micros(nxt.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return events.withColumn("emitted", nxt.isNull() | (gap >= round(quiet_seconds * 1_000_000)))


# ----------------------------------------------------------------------------- W11
def pattern_positions(pattern: str) -> tuple[list[str], bool, set[int], set[int], dict[int, set[int]]]:
    """Glushkov automaton of a row pattern: symbols by position, whether it matches no rows, the first and
    the last positions, and what may follow each.

    A pattern has symbol names, ``( )``, ``|``, and ``*``, ``+``, ``?``, ``{m}``, ``{m,}``, ``{m,n}`` behind a
    part; parts beside each other follow each other."""
    tokens = re.findall(r"\w+|\{\s*\d+\s*(?:,\s*\d*\s*)?\}|[()|*+?]", pattern)
    if "".join(tokens).replace(" ", "") != re.sub(r"\s", "", pattern):
        raise ValueError(f"not a row pattern: {pattern!r}")
    names: list[str] = []
    follow: dict[int, set[int]] = {}
    at = 0

    def leaf(name: str):
        names.append(name)
        follow[len(names) - 1] = set()
        return False, {len(names) - 1}, {len(names) - 1}

    def join(a, b):
        for p in a[2]:
            follow[p] |= b[1]
        return a[0] and b[0], a[1] | (b[1] if a[0] else set()), b[2] | (a[2] if b[0] else set())

    def loop(a):
        for p in a[2]:
            follow[p] |= a[1]
        return a

    def either():
        nonlocal at
        out = sequence()
        while at < len(tokens) and tokens[at] == "|":
            at += 1
            b = sequence()
            out = out[0] or b[0], out[1] | b[1], out[2] | b[2]
        return out

    def sequence():
        out = (True, set(), set())
        while at < len(tokens) and tokens[at] not in "|)":
            out = join(out, repeated())
        return out

    def part():
        nonlocal at
        if tokens[at] == "(":
            at += 1
            out = either()
            if at >= len(tokens):
                raise ValueError(f"missing ) in {pattern!r}")
            at += 1
            return out
        if not re.fullmatch(r"\w+", tokens[at]):
            raise ValueError(f"nothing to repeat in {pattern!r}")
        at += 1
        return leaf(tokens[at - 1])

    def repeated():
        nonlocal at
        start = at
        out = part()
        while at < len(tokens) and tokens[at][0] in "*+?{":
            sign, after = tokens[at], at + 1
            if sign[0] == "{":
                low, *high = [int(x) if x.strip() else None for x in sign[1:-1].split(",")]
                most = high[0] if high else low
                copies = [out]
                for _ in range(max(low, most or 0, 1) - 1):
                    at = start
                    copies.append(part())
                if most is None:
                    copies[-1] = loop(copies[-1])
                if low == 0 and most is None:
                    copies[-1] = (True, *copies[-1][1:])
                copies = [c if i < low else (True, *c[1:]) for i, c in enumerate(copies)]
                out = copies[0]
                for c in copies[1:]:
                    out = join(out, c)
            else:
                out = loop(out) if sign in "*+" else out
                out = (out[0] or sign in "*?", out[1], out[2])
            at = after
        return out

    empty, first, last = either()
    if at < len(tokens):
        raise ValueError(f"unexpected {tokens[at]!r} in {pattern!r}")
    return names, empty, first, last, follow


class RowPattern(Fold):
    """Leftmost-longest, non-overlapping matches of a pattern over a key's consecutive rows.

    One thread for each automaton position holds the earliest row that can have led there; a later one in
    the same position has the same future and would only overlap. A match is final once no thread
    that began as early is left; rows after its end are kept until then and read again. Empty
    matches do not count."""

    def __init__(self, pattern: str, symbol: str, keys: Sequence[str], measures: Sequence[tuple[str, str, str, str | None]]):
        self.names, _, self.first, self.last, follow = pattern_positions(pattern)
        self.before = {p: [q for q in follow if p in follow[q]] for p in follow}
        self.symbol, self.keys, self.measures = symbol, list(keys), list(measures)

    def init(self, key):
        return {"n": 0, "threads": {}, "best": None, "kept": [], "matches": 0}

    def _measured(self, old, row) -> tuple:
        out = []
        for i, (_, agg, column, only) in enumerate(self.measures):
            was = old[i] if old else None
            if only is not None and row[self.symbol] != only:
                out.append(was if was is not None or agg != "count" else 0)
                continue
            v = None if agg == "count" or pd.isna(row[column]) else row[column]
            if agg == "count":
                out.append((was or 0) + 1)
            elif agg == "first":
                out.append(was if was is not None else v)
            elif agg == "last":
                out.append(v if v is not None else was)
            elif v is None or was is None:
                out.append(was if v is None else v)
            else:
                out.append(was + v if agg == "sum" else min(was, v) if agg == "min" else max(was, v))
        return tuple(out)

    def _feed(self, s, row) -> bool:
        """One row; true if the best match has become final."""
        no, symbol, old = s["n"], row[self.symbol], s["threads"]
        s["n"] += 1
        threads = {}
        for p, name in enumerate(self.names):
            if name != symbol:
                continue
            came = [old[q] for q in self.before[p] if q in old]
            start, measured = min(came, key=lambda t: t[0]) if came else (no, None)
            if came or p in self.first:
                threads[p] = (start, self._measured(measured, row))
        s["threads"] = threads
        s["kept"].append((no, row))
        done = [threads[p] for p in self.last if p in threads]
        if done:
            start, measured = min(done, key=lambda t: t[0])
            if s["best"] is None or start <= s["best"][0]:
                s["best"], s["kept"] = (start, no, measured), []
        if s["best"] is None:
            s["kept"] = []
            return False
        return all(t[0] > s["best"][0] for t in threads.values())

    def _close(self, s) -> tuple[dict, list]:
        start, end, measured = s["best"]
        s["matches"] += 1
        again = [row for _, row in s["kept"]]
        s.update(threads={}, best=None, kept=[], n=end + 1)
        out = {**s["key"], "match_no": s["matches"], "first_row": start + 1, "last_row": end + 1, **{m[0]: v for m, v in zip(self.measures, measured, strict=True)}}
        return out, again

    def step(self, s, row):
        s["key"] = {k: row[k] for k in self.keys}
        return s, self._read(s, deque([row]))

    def _read(self, s, todo: deque) -> list[dict]:
        out = []
        while todo:
            if self._feed(s, todo.popleft()):
                match, again = self._close(s)
                out.append(match)
                todo.extendleft(reversed(again))
        return out

    def finish(self, s):
        out = []
        while s["best"] is not None:
            match, again = self._close(s)
            out += [match, *self._read(s, deque(again))]
        return out


def match_rows(df: DataFrame, key: str, order: Sequence[str], symbols: dict[str, Column], pattern: str, measures: Sequence[tuple[str, str, str, str | None]] = (),
               ts: str | None = None, max_gap_seconds: float | None = None) -> DataFrame:
    """Row pattern recognition: all non-overlapping matches of ``pattern`` over each key's rows.

    ``symbols`` names conditions; a row has the first that holds, or none, which ends any match.
    ``measures`` are (name, aggregate, column, symbol or None for all rows of the match) with the
    aggregates first, last, sum, min, max and count. One row a match: the key, its segment, ``match_no``,
    ``first_row`` and ``last_row`` in the segment, and the measures. With ``max_gap_seconds`` (and ``ts``) a
    pause of that length ends any match too: the automaton starts anew there, so a hot key is
    dealt out by its pauses; no row is compared across them."""
    label = F.lit(None).cast("string")
    for name, condition in reversed(symbols.items()):
        label = F.when(condition, name).otherwise(label)
    x = df.withColumn("__symbol", label)
    seg = "__segment"
    if max_gap_seconds is not None:
        x = reset_segments(x, key, ts, max_gap_seconds, [c for c in order if c != ts], out=seg)
    else:
        x = x.withColumn(seg, F.lit(0).cast("long"))
    fields = [df.schema[key], T.StructField("segment", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("match_no", "first_row", "last_row")]]
    kinds = {"count": T.LongType()}
    for name, agg, column, _ in measures:
        kind = kinds.get(agg, df.schema[column].dataType if agg != "count" else None)
        fields.append(T.StructField(name, T.LongType() if agg == "sum" and isinstance(kind, T.IntegerType) else kind))
    x = x.withColumnRenamed(seg, "segment")
    used = list(dict.fromkeys([key, "segment", *order, "__symbol", *[m[2] for m in measures if m[1] != "count"]]))
    return ordered_fold(x.select(*used), [key, "segment"], order, RowPattern(pattern, "__symbol", [key, "segment"], measures), T.StructType(fields), partition_by=[key, "segment"])


# ----------------------------------------------------------------------------- E20
class CircuitBreaker(Fold):
    """closed / open / half_open over ordered call outcomes.

    ``counting`` variant: failures accumulate in closed (successes do not reset them);
    threshold failures open the circuit; after ``timeout`` the next call is tried in
    half-open; a half-open success zeroes the failure count and, after
    ``success_threshold`` successes, closes; a half-open failure adds to the count and
    re-opens once it reaches the threshold again. ``strict`` variant: any half-open
    failure re-opens, and success counting continues across half-open entries."""

    def __init__(self, ts: str, ok: str, ids: Sequence[str], failure_threshold: int = 5, timeout: float = 60.0,
                 success_threshold: int = 2, variant: str = "counting"):
        self.ts, self.ok, self.ids = ts, ok, list(ids)
        self.ft, self.timeout, self.st, self.variant = failure_threshold, timeout, success_threshold, variant

    def init(self, key):
        return {"state": "closed", "failures": 0, "successes": 0, "opened": None}

    def step(self, s, row):
        t, ok = _secs(row[self.ts]), bool(row[self.ok])
        if s["state"] == "open":
            if t - s["opened"] >= self.timeout:
                s["state"] = "half_open"
                if self.variant == "counting":
                    s["successes"] = 0
            else:
                return s, {**{c: row[c] for c in self.ids}, "state": "open", "allowed": False}
        state_seen = s["state"]
        if ok:
            if s["state"] == "half_open":
                s["successes"] += 1
                if self.variant == "counting":
                    s["failures"] = 0
                if s["successes"] >= self.st:
                    s.update(state="closed", failures=0, successes=0)
            elif self.variant == "strict":
                s["failures"] = 0
        else:
            s["failures"] += 1
            if s["state"] == "half_open" and self.variant == "strict":
                s.update(state="open", opened=t)
            elif s["failures"] >= self.ft:
                s.update(state="open", opened=t)
        return s, {**{c: row[c] for c in self.ids}, "state": state_seen, "allowed": True}


def circuit_breaker(calls: DataFrame, key: str, ts: str, call_id: str, ok: str, variant: str = "counting",
                    failure_threshold: int = 5, timeout_seconds: float = 60.0, success_threshold: int = 2) -> DataFrame:
    """Replay call outcomes through a breaker per service; each call gets the state
    it met and whether it was let through."""
    schema = T.StructType([calls.schema[key], calls.schema[call_id], T.StructField("state", T.StringType()),
                           T.StructField("allowed", T.BooleanType())])
    fold = CircuitBreaker(ts, ok, [key, call_id], failure_threshold, timeout_seconds, success_threshold, variant)
    return ordered_fold(calls, [key], [ts, call_id], fold, schema)


# ----------------------------------------------------------------------------- E18 / E19
def saga_state(steps: DataFrame, saga: str, step_no: str, status: str, started_at: str, as_of: str | None = None,
               timeout_seconds: int = 300) -> DataFrame:
    """Saga status from its step log (one row per step, latest status).

    completed when every step completed; a failed step (or one still executing
    ``timeout`` after it started, evaluated at ``as_of``) makes the saga compensating -
    the steps to compensate are the completed ones *before* the failure, in reverse
    order (``compensation_plan`` lists them as rows); compensated when none is left.
    Aggregates and one join only: no saga's steps are collected into one value."""
    s = _flag_failures(steps, status, started_at, as_of, timeout_seconds)
    g = s.groupBy(saga).agg(
        F.count(F.lit(1)).alias("steps"), F.count_if(F.col(status) == "completed").alias("completed"),
        F.min(F.when(F.col("__failed"), F.col(step_no))).alias("failed_step"), F.count_if(F.col("__timed_out")).alias("timed_out"))
    before = (s.join(g.select(saga, "failed_step"), saga).filter(F.col(step_no) < F.col("failed_step"))
              .groupBy(saga).agg(F.count_if(F.col(status) == "completed").alias("to_compensate"),
                                 F.max(F.when(F.col(status) == "completed", F.col(step_no))).alias("first_to_compensate")))
    g = g.join(before, saga, "left").withColumn("to_compensate", F.coalesce("to_compensate", F.lit(0)))
    state = (F.when(F.col("failed_step").isNotNull() & (F.col("to_compensate") == 0), "compensated")
             .when(F.col("failed_step").isNotNull(), "compensating")
             .when(F.col("completed") == F.col("steps"), "completed")
             .when(F.col("completed") > 0, "running").otherwise("pending"))
    return g.select(saga, "steps", "completed", "failed_step", "timed_out", state.alias("state"), "to_compensate", "first_to_compensate")


def compensation_plan(steps: DataFrame, saga: str, step_no: str, status: str, started_at: str, as_of: str | None = None,
                      timeout_seconds: int = 300) -> DataFrame:
    """One row per step to compensate (completed before the first failure), numbered
    in compensation order (latest step first)."""
    s = _flag_failures(steps, status, started_at, as_of, timeout_seconds)
    failed = s.groupBy(saga).agg(F.min(F.when(F.col("__failed"), F.col(step_no))).alias("__f"))
    todo = s.join(failed, saga).filter((F.col(step_no) < F.col("__f")) & (F.col(status) == "completed"))
    w = Window.partitionBy(saga).orderBy(F.col(step_no).desc())
    return todo.select(saga, step_no, F.row_number().over(w).cast("long").alias("compensation_order"))


def _flag_failures(steps: DataFrame, status: str, started_at: str, as_of: str | None, timeout_seconds: int) -> DataFrame:
    timed_out = F.lit(False)
    if as_of is not None:
        timed_out = (F.col(status) == "executing") & (
            F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp(F.col(started_at)) >= timeout_seconds)
    return steps.withColumn("__timed_out", timed_out).withColumn("__failed", (F.col(status) == "failed") | timed_out)


# ----------------------------------------------------------------------------- G10
class HashChain(Fold):
    """checksum = sha256(previous checksum + canonical JSON + secret); genesis = ''."""

    def __init__(self, fields: Sequence[str], secret: str, ids: Sequence[str]):
        self.fields, self.secret, self.ids = list(fields), secret, list(ids)

    def init(self, key):
        return {"prev": ""}

    @staticmethod
    def _val(v):
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, pd.Timestamp):
            v = v.isoformat()
        return v

    def step(self, s, row):
        content = json.dumps({f: self._val(row[f]) for f in self.fields}, sort_keys=True)
        h = hashlib.sha256(f"{s['prev']}{content}{self.secret}".encode()).hexdigest()
        s["prev"] = h
        return s, {**{c: row[c] for c in self.ids}, "checksum": h}


def hash_chain(log: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], secret: str) -> DataFrame:
    """Tamper-evident chain per stream, in log order."""
    ids = [key] + [c for c in order if c != key]
    schema = T.StructType([log.schema[c] for c in ids] + [T.StructField("checksum", T.StringType())])
    return ordered_fold(log, [key], order, HashChain(fields, secret, ids), schema)


def verify_chain(log: DataFrame, key: str, order: Sequence[str], content: Column, secret: str, checksum: str = "checksum") -> DataFrame:
    """G10 verify: recompute each row from the *stored* previous checksum - a window
    ``lag``, so verification is parallel (no fold). Rows whose stored checksum differs
    are tampered (and every row after an edited one fails too)."""
    w = Window.partitionBy(key).orderBy(*order)
    prev = F.coalesce(F.lag(checksum).over(w), F.lit(""))
    expect = F.sha2(F.concat(prev, content, F.lit(secret)), 256)
    return log.withColumn("valid", F.col(checksum) == expect)
