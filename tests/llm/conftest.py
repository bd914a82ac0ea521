import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use within
        *(T.StructField(c, T.StringType()) for c in ("size", "rep", "band", "component", "key", "n_lines", "_numbers", "keep", "taken")),
    ]
)


def rows_of(texts):
    return [(i, t, "en", f"s{(i or 0) % 3}", len(t) if t is not None else None, *["x"] * 9) for i, t in texts]


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts: spark.createDataFrame(rows_of(texts), SCHEMA)


def words(n, seed=0):
    return " ".join(f"w{(i * 7919 + seed * 104729) % 100003}" for i in range(n))


@pytest.fixture(scope="session")
def odd(make):
    """Null and empty texts, a very long one, repeated rows, null keys, odd characters."""
    long = words(60_000, 5)
    return make(
        [
            (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, words(80, 1)), (6, words(80, 1)), (7, words(80, 1) + " end"), (None, words(80, 1)), (None, None),
            (8, long), (9, long + " more"), (10, "\x01\x02 token = abcdefgh \u0000 é 漢字 😀 " + words(20, 3)), (11, "\n\n\n"), (12, "x\r\ny\x0bz"), (13, words(80, 1).upper()),
        ]
    )


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(1, 14)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
