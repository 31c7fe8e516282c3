import pytest


@pytest.fixture
def docs(spark):
    """Makes a table of documents from (doc_id, text[, source]) rows, with further columns of clashing names."""
    def make(rows, schema="doc_id long, text string, source string"):
        from pyspark.sql import functions as F
        full = [(*r, "s") if len(r) == 2 and schema.count(",") == 2 else tuple(r) for r in rows]
        df = spark.createDataFrame(full, schema)
        for name in ("key", "n", "kept", "size", "name", "rep", "line", "score", "rule", "copy"):
            df = df.withColumn(name, F.lit("x"))
        return df
    return make
