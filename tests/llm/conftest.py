import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))]
    # names that the operators use inside
    + [T.StructField(n, T.StringType()) for n in ("digest", "row", "size", "key", "shard", "h", "u", "v", "taken", "frame")]
)
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
TEXTS = [
    (1, "alpha beta gamma", "en", "b", 3), (2, "alpha beta gamma", "en", "a", 3), (3, None, None, None, None), (4, "", "de", "a", 0), (5, " \n\t ", "de", "b", 4),
    (6, LONG, "en", "hot", 1), (7, LONG, "en", "hot", 1), (8, "ünïcödé 数字 \U0001f600 text", "fr", "hot", 2), (9, "alpha beta gamma", None, None, 3), (10, "one", "fr", "c", 1),
    (11, "1234 5678", "en", "c", 1), (11, "1234 5678", "en", "c", 1), (None, "no id here", "en", "c", 1), (12, "a <|endoftext|> b <|startoftext|>", "en", "c", 1),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    return spark.createDataFrame([(*r, *["x"] * (len(DOCS) - 5)) for r in TEXTS], DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def as_table(spark, tmp_path_factory):
    """Writes a frame as documents.parquet of a new folder, for a query."""

    def put(df, name="documents"):
        d = tmp_path_factory.mktemp("sf")
        df.write.parquet(f"{d}/{name}.parquet")
        return str(d)

    return put
