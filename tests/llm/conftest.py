import pytest


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="session")
def docs(spark):
    """A small documents table of id and text, with columns whose names the operators use inside."""

    def build(rows, parts=3):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, "doc_id long, text string")
        extra = {c: F.lit("x") for c in ("_id", "_text", "_k1", "node", "words", "size", "bucket", "n_words")}
        return df.withColumns(extra).repartition(parts)

    return build
