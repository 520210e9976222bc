"""Odd inputs that every operator of the subpackage must take."""

import random

import pytest
from pyspark.sql import functions as F

CLASHES = ("row", "row_no", "item", "digest", "bytes", "id", "slot", "length", "fp", "node", "component", "packer", "host", "score", "shown", "shard", "tokens")


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty and blank texts, ties, repeated rows, a very long text, other scripts."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 9))) for _ in range(300)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 60)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \t\n"), (53, rows[3][1].replace(" ", "\n ")), (54, rows[3][1]), (3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (None, None),
             (55, "日本語 テキスト. <|endoftext|> a  b\u00a0\n\nc <|startoftext|>"), (56, " ".join(r.choice(words) for _ in range(60_000))), (57, "x" * 30_000), (58, "A,B. it's  They'LL 123!?  ")]
    return rows


@pytest.fixture(scope="session")
def odd_documents(spark, odd_rows):
    """The rows with columns whose names the operators use themselves."""
    df = spark.createDataFrame(odd_rows, "doc_id long, text string").repartition(3, "doc_id")
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def same(got, want):
    """Equal as bags of rows."""
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
