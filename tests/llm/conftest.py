import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

from vellum.llm.common import prepare

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text) or (doc_id, text, source) tuples, plus
    extra columns named like the operators' own."""
    prepare(spark)

    def make(rows, extra=True):
        full = [Row(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        df = spark.createDataFrame(full, DOC)
        if extra:
            for name in ("_uid", "_text", "_row", "id", "key", "size", "target", "length", "piece", "shard", "slot",
                         "component_id", "fingerprint", "score", "start", "block", "kept"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df
    return make
