import random

import numpy as np
import pytest

import corpus_pipeline
from llm_cases import prose
from opsmill.llm import byte_bpe
from opsmill.llm import decontaminate as D
from opsmill.llm import jaccard_join as J
from opsmill.llm import line_dedup as LD
from opsmill.llm import queries
from opsmill.llm import quality_rules as Q


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    items = [(i, prose(rng, 30)) for i in range(5)]
    body = [prose(rng, 90) for _ in range(60)]
    rows = [(i, f"{body[i]}\n{'All rights reserved here' if i % 3 == 0 else 'line ' + str(i)}", "en", f"s{i % 2}", 1) for i in range(60)]
    rows += [(100 + i, body[i] + " extra", "en", "s0", 1) for i in range(10)]  # near copies
    rows += [(200, body[50].replace(" ", "### ") + "###", "en", "s0", 1), (201, None, None, None, None), (202, "", "en", "s1", 0), (203, "short text", "de", "s1", 10)]
    rows += [(300, prose(rng, 80) + " " + items[0][1] + " " + prose(rng, 60), "en", "s1", 1), (301, items[1][1] + " " + items[2][1], "en", "s1", 1)]
    place = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place


def test_stages_in_order_and_their_effects(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "byte_level_bpe"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "byte_level_bpe":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        seen[name] = ids
        docs = out
    assert not seen["quality_rules"] & {200, 201, 202, 203} and set(range(60)) <= seen["quality_rules"]
    assert seen["line_dedup"] == seen["quality_rules"]
    assert set(range(60)) <= seen["ngram_jaccard_join"] and not seen["ngram_jaccard_join"] & set(range(100, 110))
    table = byte_bpe.TokenBytes(open(queries.rank_file(), "rb").read())
    texts = {r["doc_id"]: r["text"] for r in D.remove_spans(J.keep_first(LD.drop_lines(Q.filter_documents(spark.read.parquet(f"{folder}/documents.parquet"))), n=5, percent=80),
                                                            bench).collect()}
    for r in docs.collect():  # the tokens give the cleaned text back
        assert table.decode(np.array(r["ids"]))[0].tobytes().decode() == texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
    assert 300 in seen["byte_level_bpe"] and 301 not in seen["benchmark_decontamination"]
    kept = Q.filter_documents(spark.read.parquet(f"{folder}/documents.parquet"))
    lines = LD.drop_lines(kept)
    assert lines.filter("text like '%All rights reserved here%'").count() == 0
    spans = D.remove_spans(J.keep_first(lines, n=5, percent=80), bench)
    assert D.digest(D.mark(spans, bench)).filter("contaminated").count() == 0


def test_run_equals_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, docs.collect()))


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    rng = random.Random(3)
    body = [prose(rng, 90) for _ in range(8)]
    rows = [(i, body[i], "en", "s", 1, "x", True, "t", 5) for i in range(5)]
    rows += [(2, body[2], "en", "s", 1, "x", True, "t", 5), (2, body[7], "de", "s", 1, "y", False, "t", 6), (None, body[5], None, None, None, None, None, None, None),
             (9, None, "en", "s", 1, "x", True, "t", 5), (10, "", "en", "s", 1, "x", True, "t", 5), (11, " \n\t", "en", None, 1, "x", True, "t", 5)]
    place = str(tmp_path)
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept boolean, __text string, k int")
    table.write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    docs = spark.read.parquet(f"{place}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, place)
        assert docs.columns == table.columns
    got = corpus_pipeline.run(spark, place).collect()
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got) == [-1, 0, 1, 2, 3, 4]


def test_empty_table(spark, folder, tmp_path):
    place = str(tmp_path)
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{place}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{place}/benchmark.parquet")
    assert corpus_pipeline.run(spark, place).count() == 0


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == sorted(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)
