import pytest
from pyspark.sql import functions as F

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A frame of documents from (doc_id, text) or (doc_id, text, source)."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DDL).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def awkward(docs_of):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing column names."""
    long = "\n".join(f"Line {k} of a long text with words {k * 7} and {k % 5}." for k in range(3000))
    rows = [(1, "a b c d"), (2, None), (3, ""), (None, "no id here"), (None, None), (4, "a b c d"), (4, "a b c d"),
            (5, long), (6, " \n\t "), (7, "été \U0001f600 x́ あ"), (8, long + " end"), (9, "one", None)]
    df = docs_of(rows)
    for name in ("id", "th", "fp", "key", "label", "row", "size", "part", "shard", "src", "score"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DDL)
