import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_cases import none, odd, prose  # noqa: F401
from opsmill.llm import arrays as A
from opsmill.llm import language_id as L
from opsmill.llm import quality_gbt as G
from opsmill.llm import sampling as S
from opsmill.llm import toxicity as X

BAD = ["idiotx", "scumx", "vequta", "vequmo", "vequlo"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        junk, toxic = i % 5 == 0, i % 4 == 1
        words = prose(rng, rng.randrange(60, 160)).split()
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        if junk:
            words = [w + rng.choice(["###", "%%%"]) for w in words]
        rows.append((i, " ".join(words), "en", "s", 0.5, 9))
        labels.append((i, int(not junk), int(toxic)))
    labels += [(0, None, None), (None, 1, 1), (9999, 1, 0), (5, 0, 0)]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, __label int"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_folds_use_crc32_of_the_id_as_text(spark):
    import zlib

    got = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long").select("doc_id", S.remainder("doc_id", 5).alias("r")).collect()
    assert all(r["r"] == (-1 if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % 5) for r in got)


def test_samples_are_bounded_and_leave_the_fold_out(corpus):
    docs, labels = corpus
    some = S.labelled(docs, labels, "quality", "doc_id", "text", 5, 0, 40)
    assert 20 < some.count() < 130
    assert some.select("__id").join(docs.filter(S.remainder("doc_id", 5) == 0), F.col("__id") == F.col("doc_id")).count() == 0
    assert some.filter("__label is null").count() == 0


def test_quality_scores_held_out_rows(corpus, odd, none):
    docs, labels = corpus
    forest = G.train(S.labelled(docs, labels, "quality", "doc_id", "text", 5, 0, 1000), trees=5)
    got = {r["doc_id"]: r["score"] for r in G.classify(docs, forest).collect()}
    held = {r["doc_id"] for r in docs.filter(S.remainder("doc_id", 5) == 0).collect()}
    assert held and all((got[i] >= 0.3) == (i % 5 != 0) for i in held)
    out = G.classify(odd, forest).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert G.classify(none, forest).count() == 0


def test_flattened_trees_equal_the_spark_model(corpus):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    docs, labels = corpus
    rows = G.featurised(S.labelled(docs, labels, "quality", "doc_id", "text", 5, 0, 1000), ["__label"], "__text")
    rows = VectorAssembler(inputCols=list(G.FEATURES), outputCol="x").transform(rows).withColumn("y", F.col("__label").cast("double"))
    model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=4, maxDepth=3, seed=1).fit(rows)
    got = model.transform(rows).select(vector_to_array("probability")[1].alias("p"), *G.FEATURES).collect()
    x = np.array([[r[f] for f in G.FEATURES] for r in got])
    assert np.allclose(G.flatten(model).scores(x), [r["p"] for r in got], atol=1e-9)


def test_one_class_or_none(spark, corpus, odd):
    docs, labels = corpus
    only = S.labelled(docs, labels.filter("quality = 1"), "quality", "doc_id", "text", 5, 0, 1000)
    nothing = S.labelled(docs, labels.limit(0), "quality", "doc_id", "text", 5, 0, 1000)
    assert {r["score"] for r in G.classify(odd, G.train(only)).collect()} == {1.0}
    assert {r["score"] for r in G.classify(odd, G.train(nothing)).collect()} == {0.5}
    assert all(r["score"] < 0.01 for r in X.score(odd, X.train(nothing.select("*"))).collect())
    assert all(r["score"] > 0.99 for r in X.score(odd, X.train(only)).collect())
    no_language = L.train(docs.limit(0), "text", "lang")
    assert {(r["lang_pred"], r["score"]) for r in L.identify(odd, no_language).collect()} == {("und", 0.0)}
    single = L.identify(odd, L.train(docs, "text", "lang")).collect()
    assert {r["lang_pred"] for r in single} == {"en", "und"} and all(r["score"] == 1.0 for r in single if r["lang_pred"] == "en")


def brute_segments(at, score, gap):
    """All maximal segments by definition: recursively take the best segment (leftmost, shortest of equals)."""
    n = at[-1] + 1 if at else 0
    s = [-gap] * n
    for p, v in zip(at, score, strict=True):
        s[p] = v
    out = []

    def cut(lo, hi):
        best = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += s[j]
                if total > 1e-9 and (best is None or total > best[0] + 1e-9):
                    best = (total, i, j)
        if best:
            cut(lo, best[1])
            out.append((best[1], best[2], best[0]))
            cut(best[2] + 1, hi)

    cut(0, n)
    return out


def test_segments_equal_the_definition():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randrange(1, 25)
        at = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
        score = [rng.choice([0.3, 0.7, 1.1, 2.3]) + rng.random() / 97 for _ in at]
        gap = rng.choice([0.25, 0.61, 1.3])
        got = X.maximal_segments(at, score, gap)
        want = brute_segments(at, score, gap)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(math.isclose(x[2], y[2], abs_tol=1e-6) for x, y in zip(got, want, strict=True))


def test_toxicity_finds_passages_on_held_out_rows(corpus, odd, none):
    docs, labels = corpus
    lexicon = X.train(S.labelled(docs, labels, "toxic", "doc_id", "text", 3, 1, 1000))
    got = {r["doc_id"]: r for r in X.score(docs, lexicon).collect()}
    held = docs.filter(S.remainder("doc_id", 3) == 1).collect()
    right = sum((got[r["doc_id"]]["score"] >= 0.7) == (r["doc_id"] % 4 == 1) for r in held)
    assert right >= 0.97 * len(held)
    for r in held:
        for p in got[r["doc_id"]]["passages"]:
            words = r["text"].encode()[p["from"]:p["to"]].decode().split()
            assert any(w.strip("#%") in BAD for w in words)
    fresh = X.passages(A.texts_of(pa.array(["w1 w2 vequnew w3", "w1 w2 w3"], pa.string())), lexicon)[1]
    assert [f[0] for f in fresh] == [0]  # an unseen word with a known stem
    out = X.score(odd, lexicon).collect()
    assert len(out) == odd.count() and all(r["passages"] == [] and r["score"] < 0.7 for r in out if not r["passages"])
    assert X.score(none, lexicon).count() == 0


def test_copies_do_not_make_a_lexicon(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 60), 0) for i in range(80)] + [(100 + i, " ".join(f"u{k % 30}" for k in range(60)), 1) for i in range(40)]
    sample = spark.createDataFrame(rows, "__id long, __text string, __label int")
    words, stems = X.train(sample).words, X.train(sample).stems
    assert not len(words[0]) and not len(stems[0])


def test_scores_agree_with_and_without_the_cut(spark):
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(12000):
        odd_one = i % 5 == 0
        words = prose(rng, 30).split()
        if odd_one:
            words[rng.randrange(1, 30)] = "vequta"
            words = [*words, "###", "%%%"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(rng.random() < (0.7 if odd_one else 0.97)), int(rng.random() < (0.6 if odd_one else 0.02))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").persist()
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    stumps = lambda sample: G.train(sample, depth=2)  # noqa: E731, deeper trees fit the noise of so few rows
    for label, train, score in (("quality", stumps, G.classify), ("toxic", X.train, X.score)):
        got = []
        for rows_each in (400, 100_000):
            sample = S.labelled(docs, labels, label, "doc_id", "text", 5, 0, rows_each)
            sizes = {r["__label"]: (r["n"], r["w"]) for r in sample.groupBy("__label").agg(F.count("*").alias("n"), F.sum("__weight").alias("w")).collect()}
            got.append((sizes, [score(docs.filter(f"doc_id % 5 {op} 0"), train(sample)).agg(F.avg("score")).first()[0] for op in ("=", "<>")]))
        (cut, a), (whole, b) = got
        assert all(cut[y][0] < 0.8 * whole[y][0] and whole[y][0] == whole[y][1] for y in (0, 1))
        assert all(abs(cut[y][1] - whole[y][1]) < 0.15 * whole[y][1] for y in (0, 1))
        assert np.allclose(a, b, atol=0.12), (label, a, b)


LANGS = {"aa": ["the", "and", "with", "thing", "tion"], "bb": ["und", "der", "schen", "keit", "über"], "cc": ["que", "el", "ción", "año", "los"], "dd": ["le", "été", "aux", "ment", "où"]}


@pytest.mark.parametrize("names", [["aa", "bb"], ["aa", "bb", "cc", "dd"]])
def test_languages_on_held_out_rows(spark, names, odd, none):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(3, 40), LANGS[names[i % len(names)]]), names[i % len(names)]) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(docs.filter(S.remainder("doc_id", 4) != 2), "text", "lang")
    got = {r["doc_id"]: r for r in L.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang in rows)
    out = {r["doc_id"]: r for r in L.identify(odd, model).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (1, 2, 3)) and out[9]["lang_pred"] in names
    assert L.identify(none, model).count() == 0
    digits = spark.createDataFrame([(1, "12 34 !!"), (2, "é"), (3, "日本")], "doc_id long, text string")
    kinds = {r["doc_id"]: r["lang_pred"] for r in L.identify(digits, model).collect()}
    assert kinds[1] == "und" and kinds[2] in names and kinds[3] in names


def test_codewords_differ():
    for k in (2, 3, 4, 6, 7, 12, 40):
        book = L.codebook(k)
        assert len({tuple(r) for r in book.tolist()}) == k and (abs(book.sum(axis=0)) < k).all()
        if k > 6:
            assert min((a != b).sum() for i, a in enumerate(book) for b in book[:i]) >= 8


def test_mixed_text_is_ambiguous(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, prose(rng, 30, LANGS["aa" if i % 2 else "bb"]), "aa" if i % 2 else "bb") for i in range(80)], "doc_id long, text string, lang string")
    model = L.train(docs, "text", "lang")
    lead = {}
    for name, text in (("pure", "the and with thing"), ("mixed", "the and with thing und der schen keit")):
        lead[name] = model.decode(model.margins(A.texts_of(pa.array([text], pa.string()))))[2][0]
    assert lead["mixed"] < lead["pure"]


def test_margins_equal_brute_force(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, prose(rng, 10, LANGS["aa" if i % 2 else "bb"]), "aa" if i % 2 else "bb") for i in range(30)], "doc_id long, text string, lang string")
    model = L.train(docs, "text", "lang")
    texts = ["the und", "", "a", "ab", "x the und der", "über"]
    together = model.margins(A.texts_of(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):  # a text's margins do not depend on its neighbours
        assert np.allclose(together[i], model.margins(A.texts_of(pa.array([t], pa.string())))[0])
