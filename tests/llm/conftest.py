from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
HARD = [
    (1, "one two three four five", "en", "a", 23),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n\x0b ", "de", "", 5),
    (5, LONG, "en", "a", len(LONG)),
    (6, "one two three four five", "en", "b", 23),
    (6, "one two three four five", "en", "b", 23),
    (7, "Größe 　ok 𝔘nicode   x", "de", None, 20),
    (8, "<|im_start|> </s> [INST] \x00 end", "fr", "c", 10),
    (None, "one two three four five six", "en", "a", 27),
    (None, None, None, "z", None),
    (-5, "one  two three four five", "es", "a", 24),
]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def hard(spark):
    """Documents with nulls, empty and very long texts, ties and repeated rows."""
    return spark.createDataFrame(HARD, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def clashing(hard):
    """The same with more columns, under names that operators use themselves."""
    names = ["id", "size", "taken", "target", "until", "key", "bucket", "salt", "digest", "win", "n", "fp", "root", "least", "kept", "gone", "rest", "__id", "__label", "__s", "p_good", "turns", "source_size", "length", "start"]
    return hard.select("*", *[F.lit(f"x{i}").alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)
