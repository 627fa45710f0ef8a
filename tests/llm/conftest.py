import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Names the operators use inside; as extra columns of the input they must do no harm.
CLASHES = ["id", "t", "h", "b", "fp", "text_sha256", "keep_id", "kept", "score", "digest", "root", "name", "page_id"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with clashing extra columns on request."""

    def make(rows, clash=False):
        full = [(r[0], r[1], *(r[2:] or (None, None)), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if clash:
            from pyspark.sql import functions as F

            for c in CLASHES:
                df = df.withColumn(c, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def given(spark, sf_dir):
    from gridcast.llm.common import table

    return lambda name: table(spark, sf_dir, name)
