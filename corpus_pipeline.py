"""A training-data pipeline over ``documents``: each stage is one of the operators in ``opsmill.llm``.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``; all but the last return the columns of
``documents``. ``run`` chains the stages and writes between them to the shared folder of
``spark.checkpoint.dir``; ``opsmill.session.remove_scratch`` deletes those tables afterwards.

Defined results: a null, empty or blank text is no document of quality and goes in the first stage; a
null id stays (it takes no part in links) unless a rule rejects its text; repeated rows of an id are one
document after the third stage, whose kept row is any of them; further columns of ``documents``, whatever
their names, pass all stages but the last, which returns the columns that it names; an empty table gives
no rows; without benchmark items nothing is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsmill.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, quality_rules
from opsmill.llm.queries import rank_file
from opsmill.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source removed."""
    return line_dedup.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return jaccard_join.keep_first(docs, n=5, percent=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages removed; documents that mostly consist of them go."""
    return decontaminate.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with their number and hashes of the ids and of the
    decoded bytes."""
    return byte_bpe.digest(docs, rank_file(), keep=("doc_id", "lang", "source"), with_ids=True)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates),
          ("benchmark_decontamination", benchmark_passages), ("byte_level_bpe", tokens)]

#: SQL cannot express byte-pair merging or components over similar documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = scratch_path(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{place}/{k}-{name}")
        docs = spark.read.parquet(f"{place}/{k}-{name}")
    return docs
