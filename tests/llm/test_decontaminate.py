import hashlib
import random
import re

from opsmill.llm import decontaminate as D
from llm_cases import prose

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def brute(text, items, n=10):
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        size = min(n, len(w))
        grams = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(own) - size + 1) if size else ():
            if tuple(own[i:i + size]) in grams:
                hit.update(range(i, i + size))
                found.add("null" if item is None else str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def cases(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, 25)) for i in range(12)] + [(50, "tiny Item"), (51, None), (52, "..."), (None, prose(rng, 12)), (9, prose(rng, 11)), (60, prose(rng, 10))]
    items.append((61, items[0][1].upper()))
    docs = [(1, None), (2, ""), (3, prose(rng, 60)), (4, prose(rng, 30) + " " + items[0][1] + " " + prose(rng, 30)),
            (5, items[1][1].replace(" ", ",\n").upper()), (6, "a TINY-item, b"), (7, " ".join(items[2][1].split()[3:13])), (8, " ".join(items[2][1].split()[3:12])),
            (9, (items[3][1] + " ") * 40), (9, (items[3][1] + " ") * 40), (10, "é" + items[4][1]), (None, items[5][1]), (11, items[15][1] + "ü")]
    return (spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_words string"),
            spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, extra string"), docs, items)


def test_marks_match_brute_force_with_one_and_with_many_blocks(spark):
    docs, bench, rows, items = cases(spark)
    want = sorted((-1 if i is None else i, *brute(t, items)) for i, t in rows)
    for block in (D.BLOCK_WINDOWS, 30):
        got = D.digest(D.mark(docs, bench, block_windows=block)).collect()
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == want


def test_spans_go_and_clean_rows_stay(spark):
    docs, bench, rows, items = cases(spark)
    for block in (D.BLOCK_WINDOWS, 30):
        out = D.remove_spans(docs, bench, block_windows=block)
        assert out.schema == docs.schema
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        assert got[1] is None and got[2] == "" and got[3] == rows[2][1] and got[8] == rows[7][1]
        assert 5 not in got and 9 not in got  # mostly benchmark text
        before, after = rows[3][1].split(items[0][1])
        assert got[4] == before + after
        assert D.digest(D.mark(out, bench)).filter("contaminated").count() == 0


def test_spans_of_several_blocks_are_cut_once(spark):
    rng = random.Random(4)
    own, one, two = ([f"{c}{i}" for i in range(40)] for c in "abc")
    left, right = " ".join(own[:20]), " ".join(own[20:])
    items = [(1, " ".join(one[:12])), (2, " ".join(two[:12])), (3, " ".join(one[6:16])), (4, " ".join([*one[30:35], *two[30:35]]))]
    docs = [(1, " ".join(one[:12] + own[:16] + two[:12])),  # 30 % hit by each of two blocks
            (2, f"{left} {' '.join(one[:16])} {right}"),  # overlapping passages
            (3, f"{left} {' '.join(one[30:35])} {' '.join(two[:12])} {' '.join(two[30:35])} {right}"),  # a cut would join its neighbours
            (4, prose(rng, 30)), (5, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, __row int")
    got = {}
    for block in (D.BLOCK_WINDOWS, 12):
        out = D.remove_spans(table, bench, block_windows=block)
        assert out.schema == table.schema
        got[block] = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[12] == got[D.BLOCK_WINDOWS]
    assert 1 not in got[12] and got[12][2] == f"{left}  {right}"
    assert got[12][3] == f"{left} {' '.join(one[30:35])}  {' '.join(two[30:35])} {right}" and got[12][4] == docs[3][1] and got[12][5] is None


def test_empty_tables(spark):
    docs, bench, rows, _ = cases(spark)
    assert D.mark(docs.limit(0), bench).count() == 0
    got = D.digest(D.mark(docs, bench.limit(0))).collect()
    assert len(got) == len(rows) and not any(r["contaminated"] for r in got)
    assert D.remove_spans(docs, bench.limit(0)).count() == len(rows)
