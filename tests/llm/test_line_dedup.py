import collections
import random

from pyspark.sql import functions as F

from llm_cases import none, odd, prose  # noqa: F401
from opsmill.llm import line_dedup as D

SPACE = " \t\n\r\x0b\x0c"


def brute(rows, ratio=D.RATIO, least=D.LEAST_PAGES):
    lines_of = [[(w, w.strip(SPACE)) for w in (t or "").split("\n")] for _, _, t in rows]
    texts = {(h, t or "") for _, h, t in rows}
    pages = collections.Counter(h for h, _ in texts)
    seen = collections.Counter((h, x) for h, t in texts for x in {w.strip(SPACE) for w in t.split("\n")} if x)
    bad = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for (i, h, t), ls in zip(rows, lines_of, strict=True):
        drop = [bool(x) and (h, x) in bad for _, x in ls]
        out.append((i, h, t if t is None else "\n".join(w for (w, _), d in zip(ls, drop, strict=True) if not d), sum(drop)))
    return out


def cases():
    rng = random.Random(2)
    rows = []
    for i in range(120):
        host = rng.choice(["a", "a", "a", "b", "c", None])
        lines = [prose(rng, 12) for _ in range(rng.randrange(1, 6))]
        if host == "a" and i % 3:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(["  Subscribe now ", "Subscribe now", "\tSubscribe now\r"]))
        if i % 4 == 0:
            lines.append("Footer line é")
        if i % 5 == 0:
            lines += ["", "  "]
        rows.append((i, host, "\n".join(lines)))
    rows += [(200, "a", None), (201, "a", ""), (202, "a", "Subscribe now"), (203, "a", "Subscribe now\n" + "x " * 50), (203, "a", "Subscribe now\n" + "x " * 50),
             *[(210 + i, "b", "copied page line\nand its second line") for i in range(30)], *[(250 + i, None, "x\ny") for i in range(9)],
             *[(260 + i, "short", f"a line that all pages of this host share\nown {i:02} words") for i in range(10)],
             (204, "solo", "only\nhere"), (205, None, None), (206, "b", "a\n" * 30)]
    return rows


def key(r):
    return tuple((v is None, v) for v in r)


def test_both_ways_match_brute_force(spark):
    rows = cases()
    docs = spark.createDataFrame([(i, h, t, 1, "x") for i, h, t in rows], "doc_id long, source string, text string, pages int, __bad string")
    for limit in (D.BROADCAST_LINES, 0):
        out = D.drop_lines(docs, broadcast_lines=limit, count_as="n_dropped")
        got = sorted(((r["doc_id"], r["source"], r["text"], r["n_dropped"]) for r in out.collect()), key=key)
        assert got == sorted(brute(rows), key=key)
    plain = D.drop_lines(docs)
    assert plain.schema == docs.schema and plain.count() == len(rows)


def test_shares_are_relative_to_the_host(spark):
    rows = [(i, "big" if i < 60 else "small", f"text {i}\nshared line here" if i % 6 == 0 or i >= 60 else f"text {i}\nother {i}") for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    bad = {(r["host"], r["pages"], r["host_pages"]) for r in D.boilerplate(docs, ratio=0.3).collect()}
    assert bad == {("small", 4, 4)}


def test_copies_count_as_one_page_and_short_pages_lose_their_menu(spark):
    rows = [(i, "h", "copied line one\ncopied line two") for i in range(50)] + [(100 + i, "h", f"menu of the host, longer than the rest\nown {i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: r["text"] for r in D.drop_lines(docs).collect()}
    assert all(got[i] == rows[i][2] for i in range(50)) and all(got[100 + i] == f"own {i}" for i in range(30))
    for limit in (D.BROADCAST_COPIED, 0):
        counted = D.pages_of(docs, "source", "text", limit).groupBy("copies").count().collect()
        assert {tuple(r) for r in counted} == {(50, 50), (1, 30)}


def test_empty_table(spark, none):
    assert D.drop_lines(none).count() == 0


def test_odd_rows_pass(odd):
    out = D.drop_lines(odd)
    assert out.schema == odd.schema and out.count() == odd.count()
    assert out.filter(F.col("text").isNull()).count() == 1
