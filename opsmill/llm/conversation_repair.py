"""Operator 13: conversation structure repair by Hirschberg's divide and conquer over four states.

A conversation's rows, in order of turn, are edited at the least cost so that the roles read
``(s?(ua)+)?`` by their initials: Keep (K) costs 0, Rerole to user or assistant (R) 1, Delete (D) 2,
Insert of an empty user or assistant turn (I) 5; a truncated row that is not deleted adds 5, and
blank or repeated rows must be deleted. Among the cheapest edits the one whose letters are least in
ASCII order is taken. The four states are: nothing yet, after system, after user, after assistant.

* ``damage`` is the seeded damage of the exercise; ``repair`` takes any conversation table.
* Rows become one byte each (role initial and fault). The order is a range partitioning by
  (conversation, turn, role, hash of the text); equal rows are counted before, and whether a text
  was seen earlier is an aggregate joined back on a key that is unique, so neither a hot
  conversation nor a hot text meets in one task.
* A conversation that lies inside a partition is solved there. Pieces of others (cut by a partition's
  edge or after ``block`` rows) are reduced to a 4 x 4 matrix of costs and the lexical order of the best
  letters into each state. Forward and backward cost vectors over these matrices meet at every cut,
  where the cheapest and then audit-least crossing is chosen; each piece is then solved between its
  two crossings by the same division, down to single rows. Vectors hold four costs and four ranks, so
  space is linear in the rows of a piece, and no piece is larger than ``block``.
* Ranks are enough to break ties: at a cut, best letters into two different states use up the same rows
  and end in a row's letter, so they differ before either ends.
* The repaired text is streamed in order into its rows or its hash; a conversation's hash is
  sequential by definition, its memory is the audit (a byte a row).

Defined results: null role and text count as one space (blank, an initial that fits nowhere); null
turns come first; a null conversation id is a conversation; equal turns are in order of role, then
of the SHA-256 of the text; a row whose first character is none of s, u, a can be reroled or deleted only;
the first fault of blank, duplicate, truncated counts; without rows a conversation has zeros, an empty
audit and the hash of the empty string; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmill.llm import arrays as A
from opsmill.session import cut_lineage

BLOCK = 1 << 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NEVER = 1 << 60
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATES = range(4)
#: Role initials by class; class 3 is any other.
INITIALS = "sua"
_OK, _BLANK, _DUPLICATE, _CUT = range(4)
#: State after a role with the given class, or None.
_NEXT = {(_START, 0): _SYSTEM, (_START, 1): _USER, (_SYSTEM, 1): _USER, (_ASSISTANT, 1): _USER, (_USER, 2): _ASSISTANT}
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _inserted(s: int) -> int:
    """Class of the only turn that may be inserted (or reroled to) in a state."""
    return 2 if s == _USER else 1


def _inserts() -> list[list[int]]:
    """Number of inserts that lead from one state to another (NEVER if none do)."""
    out = [[NEVER] * 4 for _ in _STATES]
    for s in _STATES:
        at = s
        for k in range(3):
            out[s][at] = min(out[s][at], k)
            at = _NEXT[at, _inserted(at)]
    return out


_INSERTS = _inserts()


def _row_edits(code: int) -> list[list[tuple[int, str]]]:
    """For a row's code: cheapest cost and least letters from each state to each state, inserts first."""
    kind, fault = divmod(code, 4)
    out = [[(NEVER, "")] * 4 for _ in _STATES]
    for s in _STATES:
        for at in _STATES:
            n = _INSERTS[s][at]
            if n == NEVER:
                continue
            ways = [(DELETE, "D", at)]
            if fault not in (_BLANK, _DUPLICATE):
                extra = TRUNCATED if fault == _CUT else 0
                if (at, kind) in _NEXT:
                    ways.append((KEEP + extra, "K", _NEXT[at, kind]))
                ways.append((REROLE + extra, "R", _NEXT[at, _inserted(at)]))
            for cost, letter, t in ways:
                out[s][t] = min(out[s][t], (n * INSERT + cost, "I" * n + letter)) if out[s][t][0] < NEVER else (n * INSERT + cost, "I" * n + letter)
    return out


_EDITS = [_row_edits(c) for c in range(16)]
_CLOSE = [min((_INSERTS[s][t] * INSERT, "I" * _INSERTS[s][t]) for t in (_START, _ASSISTANT) if _INSERTS[s][t] < NEVER) for s in _STATES]
Vector = tuple[tuple[int, ...], tuple[int, ...]]


@functools.lru_cache(maxsize=1 << 14)
def _step(code: int, relative: tuple[int, ...], ranks: tuple[int, ...]) -> tuple[int, Vector]:
    edits = _EDITS[code]
    found = []
    for t in _STATES:
        ways = [(relative[s] + edits[s][t][0], ranks[s], edits[s][t][1]) for s in _STATES if relative[s] < NEVER and edits[s][t][0] < NEVER]
        found.append(min(ways) if ways else (NEVER, 9, ""))
    order = sorted(_STATES, key=lambda t: found[t][1:])
    low = min(f[0] for f in found)
    return low, (tuple(f[0] - low if f[0] < NEVER else NEVER for f in found), tuple(order.index(t) for t in _STATES))


def forward(codes: bytes, runs: np.ndarray, lo: int, hi: int, start: int) -> Vector:
    """Least cost into each state after units [lo, hi), and the lexical ranks of their letters."""
    base, relative, ranks = 0, tuple(0 if s == start else NEVER for s in _STATES), (0, 1, 2, 3)
    for i in range(lo, hi):
        left = int(runs[i])
        while left:
            low, (costs, new) = _step(codes[i], relative, ranks)
            base, left = base + low, left - 1
            if left and (costs, new) == (relative, ranks):  # a run of one code has settled
                base, left = base + low * left, 0
            relative, ranks = costs, new
    return tuple(base + c if c < NEVER else NEVER for c in relative), ranks


@functools.lru_cache(maxsize=1 << 14)
def _step_back(code: int, relative: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    edits = _EDITS[code]
    found = [min((edits[s][t][0] + relative[t] for t in _STATES if relative[t] < NEVER and edits[s][t][0] < NEVER), default=NEVER) for s in _STATES]
    low = min(found)
    return low, tuple(f - low if f < NEVER else NEVER for f in found)


def backward(codes: bytes, runs: np.ndarray, lo: int, hi: int, end: int) -> tuple[int, ...]:
    """Least cost from each state before units [lo, hi) into one state after them."""
    base, relative = 0, tuple(0 if s == end else NEVER for s in _STATES)
    for i in range(hi - 1, lo - 1, -1):
        left = int(runs[i])
        while left:
            low, costs = _step_back(codes[i], relative)
            base, left = base + low, left - 1
            if left and costs == relative:
                base, left = base + low * left, 0
            relative = costs
    return tuple(base + c if c < NEVER else NEVER for c in relative)


def crossing(costs: Iterable[int], ranks: Iterable[int], rest: Iterable[int]) -> int:
    """The state of the cheapest way, the audit-least of equal ones, through a cut."""
    return min((c + b, r, t) for t, (c, r, b) in enumerate(zip(costs, ranks, rest, strict=True)) if c < NEVER and b < NEVER)[2]


def between(codes: bytes, runs: np.ndarray, start: int, end: int) -> str:
    """Audit-least cheapest letters that lead from one state to another over all units."""
    out: list[str] = []
    todo = [(0, len(codes), start, end)]
    while todo:
        lo, hi, s, t = todo.pop()
        if hi - lo == 1:
            n = int(runs[lo])
            # in a run only deletions are possible, and D comes before I: inserts go last
            out.append(_EDITS[codes[lo]][s][t][1] if n == 1 else "D" * (n - 1) + _EDITS[codes[lo]][s][t][1])
            continue
        mid = (lo + hi) // 2
        at = crossing(*forward(codes, runs, lo, mid, s), backward(codes, runs, mid, hi, t))
        todo += [(mid, hi, at, t), (lo, mid, s, at)]
    return "".join(out)


_ONES = np.ones(1 << 16, np.int64)


def solve(codes: bytes, runs: np.ndarray) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    costs, ranks = forward(codes, runs, 0, len(codes), _START)
    end = crossing(costs, ranks, [c for c, _ in _CLOSE])
    return costs[end] + _CLOSE[end][0], (between(codes, runs, _START, end) if codes else "") + _CLOSE[end][1]


@functools.lru_cache(maxsize=1 << 14)
def _solve_short(codes: bytes) -> tuple[int, str]:
    return solve(codes, _ONES)


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows dropped, emptied, stripped of their ends, repeated or given the role user, by a hash of
    conversation and turn. Columns: the four named ones; null role and text are one space."""
    def spaced(c: str) -> Column:
        return F.coalesce(df[c].cast("string"), F.lit(" "))

    act = F.pmod(F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")), F.lit(20))
    rows = df.select(df[conv].alias(conv), df[turn].alias(turn), spaced(role).alias(role), spaced(text).alias(text), act.alias("__act")).filter("__act <> 0")
    rows = rows.withColumn(text, F.when(F.col("__act") == 1, "").when(F.col("__act") == 2, F.translate(text, ".!?", "")).otherwise(F.col(text)))
    rows = rows.withColumn(role, F.when(F.col("__act") == 4, "user").otherwise(F.col(role)))
    return rows.withColumn("__act", F.explode(F.when(F.col("__act") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("__act")


def _renamed(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return df.select(df[conv].alias("conv"), df[turn].cast("long").alias("turn"), F.coalesce(df[role].cast("string"), F.lit(" ")).alias("role"),
                     F.coalesce(df[text].cast("string"), F.lit(" ")).alias("text")).withColumn("th", F.unhex(F.sha2("text", 256)))


_KEYS = ["conv", "turn", "role", "th"]


def _units(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, th, code, n): equal rows as one, with the fault of the first of them."""
    light = rows.select(*_KEYS, (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
                        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"))
    units = light.groupBy(*_KEYS, "blank", "cut").agg(F.count(F.lit(1)).alias("n"))
    seen = (units.groupBy("conv", "role", "th").agg(F.min("turn").alias("low"), F.max(F.col("turn").isNull()).alias("none"))
            .select(F.col("conv").alias("c"), F.when(~F.col("none"), F.col("low")).alias("t"), F.col("role").alias("r"), F.col("th").alias("h")))
    units = units.join(seen, F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("th") == F.col("h")), "left")
    first = F.substring("role", 1, 1)
    kind = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    fault = F.when(F.col("blank"), _BLANK).when(F.col("h").isNull(), _DUPLICATE).when(F.col("cut"), _CUT).otherwise(_OK)
    return units.select(*_KEYS, (kind * 4 + fault).cast("int").alias("code"), "n")


_COUNTS = ["blank", "duplicate", "truncated", "illegal"]


class _Piece:
    """Rows of one conversation that follow each other inside a partition."""

    def __init__(self, conv, key: tuple, opened: bool):
        self.conv, self.key, self.opened = conv, key, opened
        self.codes, self.runs = bytearray(), []
        self.first_turn = self.last_turn = None
        self.n_turns = self.illegal = 0
        self.faults = [0, 0, 0, 0]

    def add(self, turn, code: int, n: int) -> None:
        kind, fault = divmod(code, 4)
        if turn is not None:
            if self.n_turns == 0:
                self.first_turn = turn
            if self.n_turns == 0 or turn != self.last_turn:
                self.n_turns += 1
                self.last_turn = turn
        if self.codes and (self.codes[-1] // 4, kind) not in _LEGAL:
            self.illegal += 1
        self.codes.append(code)
        self.runs.append(1)
        self.faults[fault] += 1
        if n > 1:  # the other copies are deleted in any case
            again = fault if fault == _BLANK else _DUPLICATE
            self.codes.append(kind * 4 + again)
            self.runs.append(n - 1)
            self.faults[again] += n - 1
            self.illegal += n - 1

    def row(self, whole: bool) -> dict:
        codes, runs = bytes(self.codes), np.asarray(self.runs, dtype=np.int64)
        out = {"conv": self.conv, "whole": whole, "k_turn": self.key[0], "k_role": self.key[1], "k_th": self.key[2], "first_turn": self.first_turn,
               "last_turn": self.last_turn, "n_turns": self.n_turns, "blank": self.faults[_BLANK], "duplicate": self.faults[_DUPLICATE],
               "truncated": self.faults[_CUT], "illegal": self.illegal, "first_kind": codes[0] // 4, "last_kind": codes[-1] // 4}
        if whole:
            short = len(codes) <= 32 and int(runs.max()) == 1
            cost, audit = _solve_short(codes) if short else solve(codes, runs)
            return out | {"cost": cost, "audit": audit, "codes": None, "runs": None, "costs": None, "ranks": None}
        vectors = [forward(codes, runs, 0, len(codes), s) for s in _STATES]
        return out | {"cost": None, "audit": None, "codes": codes, "runs": runs.tobytes(), "costs": [c for v in vectors for c in v[0]],
                      "ranks": [r for v in vectors for r in v[1]]}


def _long(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def _flush(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _pieces(units: DataFrame, block: int) -> DataFrame:
    conv = units.schema["conv"]
    schema = T.StructType([conv, T.StructField("whole", T.BooleanType()), *_long("k_turn"), T.StructField("k_role", T.StringType()), T.StructField("k_th", T.BinaryType()),
                           *_long("first_turn", "last_turn", "n_turns", *_COUNTS, "first_kind", "last_kind", "cost"), T.StructField("audit", T.StringType()),
                           T.StructField("codes", T.BinaryType()), T.StructField("runs", T.BinaryType()), T.StructField("costs", T.ArrayType(T.LongType())),
                           T.StructField("ranks", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        done: list[dict] = []
        piece = None
        for batch in batches:
            for c, turn, role, th, code, n in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                if piece is None:
                    piece = _Piece(c, (turn, role, th), True)  # may have begun in the partition before
                elif c != piece.conv:
                    done.append(piece.row(not piece.opened))
                    piece = _Piece(c, (turn, role, th), False)
                elif len(piece.codes) >= block:
                    done.append(piece.row(False))
                    piece = _Piece(c, (turn, role, th), True)
                piece.add(turn, code, n)
                if len(done) >= 2000:
                    yield _flush(done, arrow)
                    done = []
        if piece is not None:
            done.append(piece.row(False))  # may go on in the next partition
        if done:
            yield _flush(done, arrow)

    ordered = units.repartitionByRange("conv", "turn", "role", "th").sortWithinPartitions("conv", "turn", "role", "th")
    return ordered.mapInArrow(lambda b: A.released(run(b)), schema)


def _crossings(parts: DataFrame) -> DataFrame:
    """For each piece of a cut conversation the states at its ends, and on its first piece the totals."""
    schema = T.StructType([parts.schema["conv"], *_long("k_turn"), T.StructField("k_role", T.StringType()), T.StructField("k_th", T.BinaryType()),
                           *_long("place", "start", "end"), T.StructField("last", T.BooleanType()), *_long("gaps", *_COUNTS, "cost")])
    names = ["conv", "k_turn", "k_role", "k_th", "first_turn", "last_turn", "n_turns", *_COUNTS, "first_kind", "last_kind", "costs", "ranks"]

    def solve_group(group: list[dict]) -> list[dict]:
        costs, ranks = [0, NEVER, NEVER, NEVER], [0, 1, 2, 3]
        met = []
        for p in group:
            found = []
            for t in _STATES:
                ways = [(costs[s] + p["costs"][4 * s + t], ranks[s], p["ranks"][4 * s + t]) for s in _STATES if costs[s] < NEVER and p["costs"][4 * s + t] < NEVER]
                found.append(min(ways) if ways else (NEVER, 9, t))
            order = sorted(_STATES, key=lambda t: found[t][1:])
            costs, ranks = [f[0] for f in found], [order.index(t) for t in _STATES]
            met.append((costs, ranks))
        rest = [c for c, _ in _CLOSE]
        ends = [0] * len(group)
        for i in range(len(group) - 1, -1, -1):
            ends[i] = crossing(*met[i], rest)
            if i == len(group) - 1:
                total = met[i][0][ends[i]] + rest[ends[i]]
            p = group[i]
            rest = [min((p["costs"][4 * s + t] + rest[t] for t in _STATES if p["costs"][4 * s + t] < NEVER and rest[t] < NEVER), default=NEVER) for s in _STATES]
        sums = {k: sum(p[k] for p in group) for k in _COUNTS}
        sums["illegal"] += sum((a["last_kind"], b["first_kind"]) not in _LEGAL for a, b in zip(group, group[1:], strict=False))
        turned = [p for p in group if p["n_turns"]]
        turns = sum(p["n_turns"] for p in turned) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(turned, turned[1:], strict=False))
        gaps = turned[-1]["last_turn"] - turned[0]["first_turn"] + 1 - turns if turned else 0
        blank = dict.fromkeys(["gaps", *_COUNTS, "cost"], 0)
        return [{k: p[k] for k in names[:4]} | {"place": i, "start": ends[i - 1] if i else _START, "end": ends[i], "last": i == len(group) - 1}
                | ({"gaps": gaps, "cost": total, **sums} if i == 0 else blank) for i, p in enumerate(group)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, group = _arrow(schema), []
        for batch in batches:
            for p in batch.to_pylist():
                if group and p["conv"] != group[0]["conv"]:
                    yield _flush(solve_group(group), arrow)
                    group = []
                group.append(p)
        if group:
            yield _flush(solve_group(group), arrow)

    return parts.select(*names).repartition("conv").sortWithinPartitions("conv", "k_turn", "k_role", "k_th").mapInArrow(run, schema)


def _letters(parts: DataFrame, ends: DataFrame) -> DataFrame:
    """(conv, place, letters) of each piece, solved between its crossings."""
    schema = T.StructType([parts.schema["conv"], *_long("place"), T.StructField("letters", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        for batch in batches:
            rows = []
            for p in batch.to_pylist():
                letters = between(p["codes"], np.frombuffer(p["runs"], np.int64), p["start"], p["end"])
                rows.append({"conv": p["conv"], "place": p["place"], "letters": letters + (_CLOSE[p["end"]][1] if p["last"] else "")})
            yield _flush(rows, arrow)

    e = ends.select(*[F.col(c).alias(f"e_{c}") for c in ("conv", "k_turn", "k_role", "k_th")], "place", "start", "end", "last")
    same = F.col("conv").eqNullSafe(F.col("e_conv")) & F.col("k_turn").eqNullSafe(F.col("e_k_turn")) & (F.col("k_role") == F.col("e_k_role")) & (F.col("k_th") == F.col("e_k_th"))
    return parts.select("conv", "k_turn", "k_role", "k_th", "codes", "runs").join(e, same).select("conv", "codes", "runs", "place", "start", "end", "last").mapInArrow(run, schema)


_DIGEST = ["gaps", *_COUNTS, "cost"]


def _audits(rows: DataFrame, block: int) -> DataFrame:
    """(conv, counts, cost, audit) of every conversation that has rows."""
    pieces = cut_lineage(_pieces(_units(rows), block))
    whole = pieces.filter("whole").select("conv", F.when(F.col("n_turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns")).otherwise(F.lit(0)).cast("long").alias("gaps"),
                                          *_COUNTS, "cost", "audit")
    parts = pieces.filter("not whole")
    ends = cut_lineage(_crossings(parts))
    texts = _letters(parts, ends).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("place", "letters"))).alias("a"))
    texts = texts.select(F.col("conv").alias("c"), F.array_join(F.transform("a", lambda x: x["letters"]), "").alias("audit"))
    cut = ends.filter("place = 0").join(texts, F.col("conv").eqNullSafe(F.col("c"))).select("conv", *_DIGEST, "audit")
    return whole.unionByName(cut)


def _replay(rows: DataFrame, audits: DataFrame, schema: T.StructType, make) -> DataFrame:
    """Stream each conversation's audit, then its rows in order, through ``make()``."""
    head = audits.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                         F.lit(None).cast("binary").alias("th"), F.lit(None).cast("string").alias("text"), *_DIGEST, "audit")
    body = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", "th", "text", *[F.lit(None).cast("long").alias(c) for c in _DIGEST], F.lit(None).cast("string").alias("audit"))
    both = head.unionByName(body).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "th")
    return A.small_batches(both.drop("th")).mapInArrow(lambda b: A.released(_walk(b, _arrow(schema), make())), schema)


def _walk(batches: Iterable[pa.RecordBatch], arrow: pa.Schema, sink) -> Iterator[pa.RecordBatch]:
    audit, at, state, head = "", 0, _START, None
    out: list[dict] = []

    def inserts() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            kind = _inserted(state)
            sink.turn(out, head, None, "user" if kind == 1 else "assistant", "")
            state, at = _NEXT[state, kind], at + 1

    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == 0:
                if head is not None:
                    inserts()
                    sink.close(out, head)
                audit, at, state, head = r["audit"], 0, _START, r
                sink.open(head)
                continue
            inserts()
            letter, at = audit[at], at + 1
            if letter == "K":
                state = _NEXT[state, INITIALS.index(r["role"][0])]
                sink.turn(out, head, r["turn"], r["role"], r["text"])
            elif letter == "R":
                kind = _inserted(state)
                state = _NEXT[state, kind]
                sink.turn(out, head, r["turn"], "user" if kind == 1 else "assistant", r["text"])
        if out:
            yield _flush(out, arrow)
            out.clear()
    if head is not None:
        inserts()
        sink.close(out, head)
        if out:
            yield _flush(out, arrow)


class _Hashes:
    """One row a conversation: its counts, audit and the hash of its repaired text."""

    def open(self, head: dict) -> None:
        self.hash, self.empty = hashlib.sha256(), True

    def turn(self, out, head, turn, role, text) -> None:
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def close(self, out, head) -> None:
        out.append({k: head[k] for k in ("conv", *_DIGEST, "audit")} | {"repaired_sha256": self.hash.hexdigest()})


class _Rows:
    """The repaired rows, numbered from 0; inserted ones have no old turn."""

    def open(self, head: dict) -> None:
        self.n = 0

    def turn(self, out, head, turn, role, text) -> None:
        out.append({"conv": head["conv"], "turn": self.n, "old_turn": turn, "role": role, "text": text})
        self.n += 1

    def close(self, out, head) -> None:
        pass


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per conversation with rows: gaps, faults, cost, audit and the hash of the repaired text."""
    rows = _renamed(df, conv, turn, role, text)
    schema = T.StructType([rows.schema["conv"], *_long(*_DIGEST), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return _replay(rows, _audits(rows, block), schema, _Hashes).withColumnRenamed("conv", conv)


def repaired(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The repaired rows: conversation, new turn, old turn (null if inserted), role, text."""
    rows = _renamed(df, conv, turn, role, text)
    schema = T.StructType([rows.schema["conv"], *_long("turn", "old_turn"), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    return _replay(rows, _audits(rows, block), schema, _Rows).withColumnRenamed("conv", conv)


def digest(original: DataFrame, fixed: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``repair``'s rows for every conversation of the original table; one that lost all rows has zeros."""
    ids = original.select(original[conv].alias("c")).distinct()
    got = ids.join(fixed, F.col("c").eqNullSafe(fixed[conv]), "left")
    return got.select(F.col("c").alias(conv), *[F.coalesce(F.col(k), F.lit(0)).cast("long").alias(k) for k in _DIGEST], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
