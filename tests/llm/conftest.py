import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 701}" for i in range(60_000))
EDGE = [
    (None, "no id, but text of its own here", "en", "s", 3),
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t ", "en", None, 4),
    (4, "one two", None, "s", 7),
    (5, "the same words in the same order, twice over", "en", "s", 1),
    (5, "the same words in the same order, twice over", "en", "s", 1),
    (6, "the same words in the same order, twice over", "en", "hot", 1),
    (7, LONG, "en", "hot", len(LONG)),
    (8, "ünïcödé ♥ text — ΑΒΓ and 漢字 😀 too", "de", "hot", 9),
]
#: Names that operators use inside or add.
CLASHES = ("fp", "at", "h", "spans", "tier", "shard", "_shard", "version", "copy_no", "shuffle_key", "kind", "score", "w", "t", "hs", "n", "rate", "root", "low")


@pytest.fixture(scope="session")
def edge(spark):
    df = spark.createDataFrame(EDGE, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
