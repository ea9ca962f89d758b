import collections
import re

import pyarrow as pa

from llm_cases import none, odd  # noqa: F401
from opsmill.llm import arrays as A
from opsmill.llm import quality_rules as Q


def brute(text):
    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.split()]
    grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    base = (n, sum(len(w.decode()) for w in words), sum(raw.count(bytes([c])) for c in b"#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
    failed = n < 50 or 100 * len(hit) > 50 * n
    lettered = sum(bool(re.search(rb"[A-Za-z\x80-\xff]", w)) for w in words)
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False))
    upper, letters = len(re.findall(rb"[A-Z]", raw)), len(re.findall(rb"[A-Za-z]", raw))
    kept = (not failed and 2 * n <= base[1] <= 20 * n and 10 * base[2] <= base[1] and 20 * base[3] <= n and 2 * upper <= letters
            and 10 * lettered >= 7 * n and 10 * doubled <= 3 * n)
    return (*base, failed, kept)


def test_judge_matches_brute_force(spark, odd):
    got = Q.judge(odd, sample_rows=5).collect()
    assert len(got) == odd.count()
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], *brute(r["text"])) for r in odd.collect())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in got) == want


def test_junk_kinds_are_rejected_and_prose_kept(spark):
    prose = " ".join(f"word{i} goes on" for i in range(60))
    junk = {2: " ".join(f"word{i}###" for i in range(80)), 3: " | ".join(f"word{i}" for i in range(80)),
            4: " ".join(f"WORD{i} GOES" for i in range(60)), 5: " ".join(f"word{i} word{i}" for i in range(60))}
    rows = [(1, prose), *junk.items()]
    got = {r["doc_id"]: r["kept"] for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_order_ranks_by_rejections_per_cost_and_keeps_the_verdict(spark, odd):
    figures = {"symbols": {"cost": 1e-6, "selectivity": 0.1}, "doubled_words": {"cost": 1e-5, "selectivity": 0.9}, "shouting": {"cost": 1e-5, "selectivity": 0.0}}
    assert [r.name for r in Q.order(figures)][:2] == ["symbols", "doubled_words"]
    forward = sorted(map(str, Q.judge(odd).collect()))
    assert forward == sorted(map(str, Q.judge(odd, rules=Q.RULES[::-1]).collect()))


def test_measure_reports_every_rule(odd):
    got = Q.measure(odd)
    assert set(got) == {r.name for r in Q.RULES}
    assert all(f["cost"] >= 0 and 0 <= f["selectivity"] <= 1 for f in got.values())


def test_filter_keeps_all_columns_and_empty_tables(spark, odd, none):
    kept = Q.filter_documents(odd)
    assert kept.schema == odd.schema
    assert kept.count() == Q.judge(odd).filter("kept").count()
    assert Q.judge(none).count() == Q.filter_documents(none).count() == 0


def test_spans_never_cross_rows():
    texts = A.texts_of(pa.array(["ab", "cd", None, "", "e f"], pa.string()))
    words = texts.spans(A.NON_SPACE)
    assert [texts.data[a:b].tobytes() for a, b in zip(words.start, words.end, strict=True)] == [b"ab", b"cd", b"e", b"f"]
    assert words.n.tolist() == [1, 1, 0, 0, 2]
    h = words.hashes()
    assert len(set(h.tolist())) == 4
    again = A.texts_of(pa.array(["zz e"], pa.string())).spans(A.NON_SPACE).hashes()
    assert again[1] == h[2]  # a hash depends on the word alone


def test_slices_cover_all_rows_and_keep_long_texts_whole():
    column = pa.array(["x" * n for n in (3, 0, 50, 2, 2, 2)], pa.string())
    parts = list(A.slices(column, 5))
    assert [lo for lo, _ in parts][1:] == [hi for _, hi in parts][:-1] and parts[0][0] == 0 and parts[-1][1] == 6
    assert (2, 3) in parts
