import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from llm_cases import none, prose  # noqa: F401
from opsmill.llm import arrays as A
from opsmill.llm import jaccard_join as J


def shingles(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n=4, percent=85):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1:]:
            if i is not None and j is not None and s and t:
                k = len(s & t)
                if 100 * k >= percent * (len(s) + len(t) - k):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    return sorted((-1 if i is None else i, len(s), -1 if i is None else find(i)) for i, s in sets)


def edited(rng, words, share):
    return " ".join(rng.choice(["new%d" % rng.randrange(10**6), w]) if rng.random() < share else w for w in words)


def cases():
    rng = random.Random(9)
    rows, passage = [], prose(rng, 60)
    bases = [prose(rng, 150).split() for _ in range(6)]
    for i in range(70):  # one large group of near copies around the threshold, and a few small ones
        rows.append((i, edited(rng, bases[0], rng.choice([0.01, 0.02, 0.05, 0.08]))))
    for i in range(70, 120):
        rows.append((i, edited(rng, rng.choice(bases[1:]), rng.choice([0.0, 0.01, 0.04]))))
    rows += [(i, prose(rng, 40) + " " + passage) for i in range(120, 160)]  # a passage that many share
    rows += [(i, passage) for i in range(160, 185)] + [(i, passage + " " + prose(rng, rng.randrange(1, 8))) for i in range(185, 215)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "One two"), (304, "one TWO"), (305, "one two three"), (306, "a b c d"), (306, "a b c d"), (307, "A b c d"),
             (None, passage), (None, None), (308, "x " * 400), (309, "x " * 300), (310, prose(rng, 6000))]
    rows.append((311, rows[-1][1] + " end"))
    # a chain whose ends do not link with each other
    chain = prose(rng, 100).split()
    for k in range(12):
        rows.append((400 + k, " ".join(chain[k * 3:] + [f"c{j}" for j in range(k * 3)])))
    return rows


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, component_id int")
    return sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in J.components(docs, **options).collect())


@pytest.mark.parametrize("few,limit,ids", [(16, 10**6, 10**6), (2, 10**6, 0), (4, 20, 10**6)])
def test_components_equal_brute_force(spark, few, limit, ids):
    """Also with almost every n-gram frequent, with a list that must raise its threshold, and with the join in place of the broadcast."""
    rows = cases()
    assert run(spark, rows, few=few, frequent_limit=limit, broadcast_ids=ids) == brute(rows)


def test_other_sizes_and_thresholds(spark):
    rows = cases()[:140]
    assert run(spark, rows, n=5, percent=80) == brute(rows, 5, 80)
    assert run(spark, rows[:60], n=2, percent=50, few=3) == brute(rows[:60], 2, 50)


def test_keep_first_keeps_one_of_each_group_and_all_columns(spark):
    rows = cases()
    docs = spark.createDataFrame([(i, t, "s", "x") for i, t in rows], "doc_id long, text string, source string, __gone string")
    kept = J.keep_first(docs)
    assert kept.schema == docs.schema
    got = collections.Counter(r["doc_id"] for r in kept.collect())
    want = {c for i, n, c in brute(rows, 5, 80) if i >= 0}
    assert set(got) - {None} == want and got[None] == 2 and all(n == 1 for i, n in got.items() if i is not None)


def test_empty_table(spark, none):
    assert J.components(none).count() == 0 and J.keep_first(none).count() == 0


def test_prefixes_of_linked_sets_share_enough():
    """The lemma the join rests on, on random sets in one random order."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(5, 60))
        base = rng.choice(200, n, replace=False)
        x = set(base.tolist())
        y = set(rng.permutation(base)[:n - int(rng.integers(0, 4))].tolist()) | set(rng.integers(200, 400, int(rng.integers(0, 4))).tolist())
        k = len(x & y)
        if 100 * k < 85 * len(x | y):
            continue
        a, b, o = sorted(x), sorted(y), J.overlap(len(x), len(y), 85)
        assert k >= o
        for m in (1, 2, 3):
            if o >= m:
                assert len(set(a[:len(a) - o + m]) & set(b[:len(b) - o + m])) >= m


def test_short_texts_are_one_gram():
    sets = J.ngram_sets(A.texts_of(pa.array(["", "a", "A", "a b", "a b c d", "a b c d e", None], pa.string())), 4)
    assert [len(s) for s in sets] == [0, 1, 1, 1, 1, 2, 0]
    assert sets[1].tolist() == sets[2].tolist() != sets[3].tolist()


def test_matches_are_chosen_by_cost():
    def cost(lengths, rare, least, k):
        prefix = lengths[:least + k - 1]
        often = sorted(prefix[rare:], reverse=True)
        return sum(prefix) + J.VERIFY * (sum(prefix[:rare]) / k + (often[k - 1] if len(often) >= k else 0))

    rng = random.Random(9)
    for _ in range(300):
        rare = rng.randrange(12)
        lengths = [J.RARE] * rare + sorted(rng.choice([20.0, 25.0, 100.0, 5000.0]) for _ in range(rng.randrange(1, 12)))
        least = rng.randrange(1, len(lengths) + 1)
        most = len(lengths) if rare < least else max(rare, least)
        allowed = range(1, max(1, min(J.MOST_MATCHES, most - least + 1)) + 1)
        got = J.matches_asked(np.array(lengths), rare, least, most)
        assert got in allowed and cost(lengths, rare, least, got) <= min(cost(lengths, rare, least, k) for k in allowed) + 1e-9
    # rare lists are worth more matches; lists of one passage are not, until a few are far longer than the next
    assert J.matches_asked(np.full(30, J.RARE), 30, 8, 30) == 3 and J.matches_asked(np.array([J.RARE] * 4 + [1000.0] * 6), 4, 5, 10) == 1
    assert J.matches_asked(np.array([J.RARE] * 9 + [20.0] * 3), 9, 10, 12) > 1


def test_passages_and_copies_with_costs_equal_brute_force(spark):
    """Copies of one text with changes, and texts that mostly consist of one passage."""
    rng = random.Random(10)
    body, passage = prose(rng, 120).split(), prose(rng, 40)
    rows = []
    for i in range(60):
        own = list(body)
        for _ in range(i % 6):
            own[rng.randrange(len(own))] = f"x{rng.randrange(3)}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, passage + " " + prose(rng, rng.randrange(0, 12))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranges = J.Ranges.of(docs)
    often, counts, _ = J.frequent_ngrams(docs, 4, ranges, J.FEW, J.FREQUENT_LIMIT)
    sig = J.signatures(docs, 4, 85, ranges, often, counts).collect()
    assert any(r["hot"] for r in sig) and any(not r["hot"] and r["k"] > 1 for r in sig)
    assert sorted(tuple(r) for r in J.components(docs, n=4, percent=85).collect()) == brute(rows, 4, 85)
