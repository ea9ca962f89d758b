import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from opsmill.llm import conversation_repair as R

ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                     T.StructField("text", T.StringType()), T.StructField("conv", T.StringType()), T.StructField("audit", T.StringType())])
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        act = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if act == 0:
            continue
        text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
        out += [(conv, turn, "user" if act == 4 else role, text)] * (2 if act == 3 else 1)
    return out


def brute(rows):
    """One conversation by a plain table of (cost, letters, repaired) for each state."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, faults, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in rows:
        body = text.strip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        if fault:
            count[fault] += 1
    best = {"": (0, "", ())}

    def offer(table, state, entry):
        if state not in table or entry < table[state]:
            table[state] = entry

    def after(state, initial):
        return initial if (state, initial) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")} else None

    def inserted(table):
        for _ in range(3):
            for state, (c, a, t) in list(table.items()):
                role = "assistant" if state == "u" else "user"
                offer(table, role[0], (c + 5, a + "I", (*t, f"{role}:")))
        return table

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        table = {}
        for state, (c, a, t) in inserted(best).items():
            offer(table, state, (c + 2, a + "D", t))
            if fault in ("blank", "duplicate"):
                continue
            late = 5 if fault else 0
            if after(state, role[:1]):
                offer(table, role[0], (c + late, a + "K", (*t, f"{role}:{text}")))
            for new in ("user", "assistant"):
                if after(state, new[0]):
                    offer(table, new[0], (c + 1 + late, a + "R", (*t, f"{new}:{text}")))
        best = table
    inserted(best)
    cost, audit, parts = min(best[s] for s in ("", "a") if s in best)
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(parts).encode()).hexdigest()), parts


def make(rng, n_conv, longest):
    rows = []
    for c in range(n_conv):
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "", " \n", "Is it?", "Go on!  ", "naïve… \U0001f389", None, f"text {rng.randrange(4)}.", f"cut {t}", f"whole {t}."])
            rows.append((None if c == 0 else c, None if rng.random() < 0.05 else t * rng.choice([1, 1, 2]), role, text))
    return rows


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], ROWS).repartition(parts)


def as_dict(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


@pytest.mark.parametrize("block", [R.BLOCK, 3])
def test_repair_matches_a_plain_table(spark, block):
    rows = make(random.Random(block), 60, 14)
    source = table(spark, rows)
    want = {c: brute(g)[0] for c, g in grouped([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]).items()}
    assert as_dict(R.repair(source, block=block)) == want


@pytest.mark.parametrize("block", [R.BLOCK, 4])
def test_damage_then_repair(spark, block):
    rows = make(random.Random(7), 80, 9)
    source = table(spark, rows)
    after = grouped(damaged(rows))
    want = {c: brute(after.get(c, []))[0] for c in grouped(rows)}
    assert as_dict(R.digest(source, R.repair(R.damage(source), block=block))) == want


def test_repaired_rows_are_well_formed(spark):
    rows = make(random.Random(11), 40, 10)
    got = grouped([tuple(r) for r in R.repaired(table(spark, rows)).orderBy("conv_id", "turn").collect()])
    for c, g in grouped([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]).items():
        mine = got.get(c, [])
        assert tuple(f"{r[3]}:{r[4]}" for r in mine) == brute(g)[1]
        assert [r[1] for r in mine] == list(range(len(mine)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[3][0] for r in mine))


def test_one_long_conversation_in_many_pieces(spark):
    rng = random.Random(3)
    rows = [(9, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["ok.", f"t {t}.", "cut", ""])) for t in range(3000)]
    rows += [(9, 17, "user", "the same words.")] * 500 + [(9, None, "user", "first.")] * 3 + [(8, 1, "user", "Hi.")]
    want = {c: brute(g)[0] for c, g in grouped(rows).items()}
    assert as_dict(R.repair(table(spark, rows, 8), block=50)) == want


def test_cuts_agree_with_exhaustive_choice():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(1, 7)
        codes = bytes(rng.randrange(16) for _ in range(n))
        runs = np.ones(n, np.int64)
        options = []
        for path in itertools.product(range(4), repeat=n):
            ways = [R._EDITS[c][s][t] for c, s, t in zip(codes, (0, *path[:-1]), path, strict=True)]
            if all(w[0] < R.NEVER for w in ways):
                options.append((sum(w[0] for w in ways) + R._CLOSE[path[-1]][0], "".join(w[1] for w in ways) + R._CLOSE[path[-1]][1]))
        assert R.solve(codes, runs) == min(options)


def test_empty_table_and_rows_all_lost(spark):
    empty = spark.createDataFrame([], ROWS)
    assert R.repair(empty).count() == 0 and R.digest(empty, R.repair(R.damage(empty))).count() == 0
    lost = [(c, 0, "user", "Hi.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    source = table(spark, lost)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert as_dict(R.digest(source, R.repair(R.damage(source)))) == {r[0]: nothing for r in lost}
