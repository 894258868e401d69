import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table, with a column whose name clashes with nothing that operators promise to keep, from (doc_id, text, lang, source) rows."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumn("size", F.lit("clash")).withColumn("score", F.lit("clash")).withColumn("fp", F.lit(1)).withColumn("target", F.lit(None).cast("string"))
        return df

    return make


@pytest.fixture(scope="session")
def sf(tmp_path_factory):
    """The smallest of the driver's folders, or skip where it is missing."""
    import os

    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test data here")
    return path
