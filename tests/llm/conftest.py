import random

import pytest
from pyspark.sql import types as T

#: Columns beyond those of documents whose names the operators use themselves.
CLASHING = ["id", "n", "uid", "label", "score", "bands", "_keep", "_id", "_copies", "_turn", "digest", "part", "tokens", "kept", "rate", "more"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in CLASHING)])
WORDS = "an the of river stone cloud paper green light house winter garden music letter window bridge silver ocean forest candle market summer orange pocket rocket velvet yellow basket dragon engine".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", str(rng.randrange(50))]) for _ in range(n))


def make(spark, texts, first=0):
    rows = [(first + i, t, "en", f"s{i % 3}", None if t is None else len(t), *(["x"] * len(CLASHING))) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def texts():
    """Null, empty, blank and tiny texts, copies but for white space, near copies, shared passages, a very long text."""
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 60)
    words = base.split()
    near = [" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in (5, 40, 80, 110)]
    out = [None, "", " \n\t", "one", "one two", "Ünï çödé 😀 text", base, base, base.replace(" ", "\n"), " " + base.upper(), *near]
    out += [prose(rng, 30) + " " + passage + " " + prose(rng, 20) for _ in range(5)]
    out += [prose(rng, rng.randrange(5, 150)) for _ in range(25)]
    return [*out, prose(rng, 20_000), "a" * 5000, base]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return make(spark, texts).repartition(5).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
