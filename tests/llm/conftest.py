import random

import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use themselves."""

    def make(rows, name="doc_id", text="text"):
        schema = T.StructType(
            [
                T.StructField(name, T.LongType()),
                T.StructField(text, T.StringType()),
                T.StructField("lang", T.StringType()),
                T.StructField("kept", T.StringType()),
                T.StructField("score", T.StringType()),
                T.StructField("digest", T.StringType()),
                T.StructField("node", T.StringType()),
                T.StructField("rank", T.StringType()),
            ]
        )
        return spark.createDataFrame([(i, t, None, "k", "s", "d", "n", "r") for i, t in rows], schema).repartition(3)

    return make


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture
def sentence(rng):
    def make(n, words=500):
        return " ".join(f"w{rng.randrange(words)}" for _ in range(n))

    return make
