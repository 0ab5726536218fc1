import random

import pytest
from pyspark.sql import functions as F

SYLLABLES = "an the re on ti er in ed ha st ou le ra mo ki su".split()


def invented(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="session")
def prose():
    return invented


@pytest.fixture(scope="session")
def table(spark):
    """Documents with the columns of the driver's table and others whose names operators use inside."""

    def make(rows):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        return df.select(
            "*",
            F.lit("en").alias("lang"),
            F.lit(None).cast("string").alias("source"),
            F.length("text").cast("bigint").alias("n_chars"),
            *[F.lit(1).alias(c) for c in ("block", "score", "node", "run", "length", "label", "spans", "pattern", "statistics", "_n")],
        )

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Null and empty texts, blanks only, short and long texts, ties, repeated rows, a null id."""
    text = invented(1, 60)
    return [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "one"),
        (5, text),
        (6, text),
        (6, text),
        (7, text + " tail"),
        (8, invented(2, 4000)),
        (9, "a " * 300),
        (None, text),
        (None, None),
        (10, "é ü 日本 \x0b x " + invented(3, 30)),
    ]
