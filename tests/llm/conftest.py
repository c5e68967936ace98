import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns whose names clash."""

    def make(rows):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(rows, DOCS)
        for name in ("k_id", "k_text", "at", "key", "n", "size", "fp", "rank", "id", "source_size", "m_id", "l_text", "term", "a b"):
            df = df.withColumn(name, F.lit("x"))
        return df

    return make
