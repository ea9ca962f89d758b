"""Critical paths of traces and row patterns against brute force."""

import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from opsmill.operators import folds, metrics


def brute_path(spans):
    """Definition by recursion over one trace: (span, parent, start, end)."""
    ids = {s[0] for s in spans}
    kids = {}
    for s in spans:
        kids.setdefault(s[1] if s[1] in ids and s[1] != s[0] else None, []).append(s)
    out = {}

    def walk(span, lo, hi):
        cursor, inner, chain = hi, 0, []
        for c in sorted(kids.get(span[0], []), key=lambda c: (-min(c[3], hi), -c[3], max(c[2], lo), c[0])):
            a, b = max(c[2], lo), min(c[3], hi)
            if a <= b <= cursor:
                cursor, inner = a, inner + b - a
                chain.append((c, a, b))
        out[span[0]] = (lo, hi, hi - lo - inner)
        for c, a, b in chain:
            walk(c, a, b)

    root = min(kids[None], key=lambda s: (s[2] - s[3], s[0]))
    walk(root, root[2], root[3])
    return out, root[3] - root[2]


def random_trace(rng, n):
    spans = [(0, None, 0, 1000)]
    for i in range(1, n):
        p = rng.choice(spans)
        a = rng.randrange(p[2] - 30, p[3] + 10)
        spans.append((i, p[0], a, a + rng.choice([0, 5, 50, 200, 400])))
    return spans


def test_critical_path_is_the_definition(spark):
    rng = random.Random(4)
    traces = {t: random_trace(rng, rng.randrange(1, 40)) for t in range(25)}
    traces[100] = [(i, i - 1 if i else None, i, 1000 - i) for i in range(200)]  # 200 deep
    traces[101] = [(0, None, 0, 5000)] + [(i, 0, 2 * i, 2 * i + 2) for i in range(1, 800)]  # one after the other
    traces[102] = [(0, 77, 0, 10), (1, 0, 2, 30), (5, None, 0, 10)]  # an orphan and two roots of equal length
    data = [(t, *s) for t, spans in traces.items() for s in spans]
    data += [(7, *traces[7][-1])]  # a repeated row counts once
    data += [(200, 1, 2, 0, 5), (200, 2, 1, 0, 5), (200, 3, None, 0, 4), (201, 1, 1, 0, 8)]  # a cycle beside a root; a span that is its own parent
    df = spark.createDataFrame(data, "trace_id long, span_id long, parent_id long, start_ms long, end_ms long")
    got = {}
    for r in metrics.critical_path(df).collect():
        got.setdefault(r["trace_id"], {})[r["span_id"]] = (r["from_ms"], r["to_ms"], r["path_ms"], r["share"])
    for t, spans in traces.items():
        want, total = brute_path(spans)
        assert {k: v[:3] for k, v in got[t].items()} == want
        assert total == 0 or abs(sum(v[3] for v in got[t].values()) - 1) < 1e-9
    assert len(got[100]) == 200 and set(got[200]) == {3} and set(got[201]) == {1}


PATTERNS = ["a b* c", "a | a b | a b c", "(a | b)+ c?", "a{2,3} (b | c){0,2}", "(a b?){2,}", "b? a+ (b a){1,2}", "a{3}"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_automaton_finds_leftmost_longest_matches(pattern):
    rng = random.Random(pattern)
    rx = re.compile(re.sub(r"\s+", "", pattern))
    for _ in range(60):
        text = "".join(rng.choice("aabbc-") for _ in range(rng.randrange(0, 25)))
        want, at = [], 0
        while at < len(text):  # the longest match at the first place that has one
            ends = [e for e in range(len(text), at, -1) if rx.fullmatch(text, at, e)]
            if ends:
                want.append((at + 1, ends[0]))
                at = ends[0]
            else:
                at += 1
        fold = folds.RowPattern(pattern, "s", ["k"], [("n", "count", "v", "a"), ("v1", "first", "v", None), ("vs", "sum", "v", "b")])
        state, got = fold.init(()), []
        for i, c in enumerate(text):
            state, out = fold.step(state, {"k": 1, "s": None if c == "-" else c, "v": i})
            got += out
        got += fold.finish(state)
        assert [(m["first_row"], m["last_row"]) for m in got] == want
        for m, (a, b) in zip(got, want, strict=True):
            part = range(a - 1, b)
            assert m["n"] == sum(text[i] == "a" for i in part) and m["v1"] == a - 1
            assert (m["vs"] or 0) == sum(i for i in part if text[i] == "b")


def test_bad_patterns_are_refused():
    for bad in ("(a b", "a b)", "* a", "a & b"):
        with pytest.raises(ValueError):
            folds.pattern_positions(bad)


def test_pauses_split_a_hot_key_without_changing_matches(spark):
    rng = random.Random(8)
    t, data = 0, []
    for i in range(400):
        t += rng.choice([1, 1, 1, 50])
        data.append((1 if i % 20 else 2, t, i, rng.choice(["a", "b", "c", "z"])))
    df = spark.createDataFrame(data, "k long, t long, i long, e string").withColumn("ts", F.timestamp_seconds("t"))
    symbols = {s: F.col("e") == s for s in "abc"}
    got = folds.match_rows(df, "k", ["ts", "i"], symbols, "a+ (b | c)", [("from_i", "first", "i", None), ("to_i", "last", "i", None)], "ts", 50.0)
    want = []
    for k in (1, 2):
        mine, last, text, ids = [r for r in data if r[0] == k], None, "", []
        for _, t, i, e in mine:
            if last is not None and t - last >= 50:
                text, ids = text + "|", [*ids, None]
            text, ids, last = text + e, [*ids, i], t
        want += [(k, ids[m.start()], ids[m.end() - 1]) for m in re.finditer("a+[bc]", text)]
    assert rows(got, "k", "from_i", "to_i") == sorted(want)
    assert got.select("segment").distinct().count() > 10
