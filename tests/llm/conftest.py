import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use inside."""

    def make(rows, extra=True):
        full = [(*r, *("en", "web", 1)[len(r) - 2 :]) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        if extra:
            for c in ("w", "hits", "fp", "kept", "keep_id", "size", "taken", "t", "u", "score", "a.b"):
                df = df.withColumn(c, F.lit("clash"))
        return df

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)
