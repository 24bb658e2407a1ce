import pytest
from pyspark.sql import types as T

KIND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# extra columns whose names the operators use themselves
CLASH = T.StructType([*KIND.fields, *[T.StructField(c, T.StringType()) for c in ("size", "key", "target", "score", "root", "uid", "cut")]])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text, source) with further columns; some names clash."""

    def make(rows, clash=True):
        full = [(i, t, "en", s, None if t is None else len(t), *(["x"] * 7 if clash else [])) for i, t, s in rows]
        return spark.createDataFrame(full, CLASH if clash else KIND)

    return make


@pytest.fixture(scope="session", autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
