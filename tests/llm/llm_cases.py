"""Small texts and fixtures for the tests of this folder."""

import random

import pytest
from pyspark.sql import types as T

WORDS = [f"w{i}" for i in range(300)]
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                    T.StructField("source", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("kept", T.StringType()),
                    T.StructField("__text", T.StringType())])


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows; extra columns clash with results."""
    rng = random.Random(5)
    long = "\n".join(prose(rng, 40) for _ in range(1500))
    body = prose(rng, 120)
    rows = [(None, body), (1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, long), (5, body), (6, body), (6, body), (7, "a"), (8, "a a a a a a a a"),
            (9, "naïve Ünïcode \u0085 日本語 \U0001f389 x" * 20), (10, "\n".join(["same line here"] * 60)), (11, "ONE TWO!! " * 40), (12, body + " tail")]
    return [(i, t, "en" if i != 3 else None, "s" if i != 4 else None, "x", "y", "z") for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOC)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)
