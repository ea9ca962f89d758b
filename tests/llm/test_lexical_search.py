import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from opsmill.llm import lexical_search as L
from llm_cases import prose

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text):
    return TERM.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def brute(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            score = 0
            for t in terms(text):
                if c[t]:
                    m = 25 + 75 * sum(c.values()) * n_docs // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def cases():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "don't", "x-y"]
    docs = [(i, prose(rng, rng.randrange(1, 50), words)) for i in range(120)]
    docs += [(200 + i, docs[3][1]) for i in range(25)]  # more equal scores than places
    docs += [(7, docs[7][1]), (None, docs[3][1]), (None, None), (300, None), (301, ""), (302, " .,! "), (303, prose(rng, 20000, words)), (-5, docs[3][1].upper())]
    items = [(i, prose(rng, rng.randrange(1, 30), words)) for i in range(20)]
    items += [(20, docs[3][1]), (20, docs[3][1]), (None, "W1 w1 w1"), (21, None), (22, "..."), (23, "nowhere tobefound"), (24, "ÜNÏ"), (25, "w2 " * 5000)]
    return docs, items


def tables(spark):
    docs, items = cases()
    return (spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, score string, rank int").repartition(5),
            spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc string, rank int"), docs, items)


@pytest.mark.parametrize("block", [(L.BLOCK_WORDS, L.BLOCK_ITEMS), (60, 4)])
def test_ranks_match_brute_force(spark, block):
    d, i, docs, items = tables(spark)
    got = L.search(d, i, block_words=block[0], block_items=block[1])
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_empty_sides(spark):
    d, i, _, _ = tables(spark)
    assert L.search(d.limit(0), i).count() == 0 and L.search(d, i.limit(0)).count() == 0
    assert L.search(d.filter("doc_id between 300 and 302"), i).count() == 0


def test_tiles_bound_partial_sums_and_lose_nothing():
    rng = np.random.default_rng(1)
    weights = rng.integers(0, 50, (37, 5))
    weights[11, 2], weights[0, 0] = 12345, 0
    parts = L.tiles(weights, 0, 37, width=8, bound=300)
    back = np.zeros_like(weights)
    for lo, hi, part in parts:
        assert hi - lo <= 8 and part.sum(axis=0).max() < 300
        back[lo:hi] += part.astype(np.int64)
    assert (back == weights).all()


def test_sums_over_two_to_the_53_stay_exact():
    big = L.EXACT // L.MOST_IMPACT
    weights = np.array([[big * 3 + 1], [big - 1], [7]])
    impact = np.array([[999_999.0, 999_997.0, 3.0]])
    total = sum(np.rint(impact[:, lo:hi] @ part).astype(np.int64) for lo, hi, part in L.tiles(weights, 0, 3))
    assert int(total[0, 0]) == (big * 3 + 1) * 999_999 + (big - 1) * 999_997 + 21


def test_best_does_not_depend_on_slices():
    rng = np.random.default_rng(4)
    scores, docs = rng.integers(0, 4, (200, 3)), rng.permutation(200)
    wanted = [(i, s, d) for i in range(3) for s, d in sorted(((int(s), int(d)) for s, d in zip(scores[:, i], docs, strict=True) if s), key=lambda x: (-x[0], x[1]))[:10]]
    for size in (1, 7, 200):
        best = L.Best(3, 10)
        for lo in range(0, 200, size):
            best.offer(scores[lo:lo + size], docs[lo:lo + size], np.zeros(len(docs[lo:lo + size]), bool))
        assert list(zip(best.item.tolist(), best.score.tolist(), best.doc.tolist(), strict=True)) == wanted


def test_an_equal_hash_of_another_word_is_no_hit():
    vocabulary = L.Vocabulary([L.terms_of("alpha beta")])
    vocabulary.data = vocabulary.data.copy()
    vocabulary.data[vocabulary.at[0]] ^= 1  # the bytes differ, the hash stays
    texts = L.A.texts_of(L.pa.array(["alpha beta alpha"]))
    assert len(vocabulary.find(texts, texts.spans(L.A.ALNUM))[0]) in (1, 2)
