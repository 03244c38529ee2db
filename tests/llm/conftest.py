import pytest

pytest.importorskip("quillveil.llm.queries")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def documents(spark):
    """A documents table of given (doc_id, text) rows, with columns whose names results use."""

    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        full = [(i, t, "en", "src0", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(full, schema)
        if extra:
            from pyspark.sql import functions as F

            for name in ("kept", "score", "n_words", "component_id", "sequence_id", "secret_spans"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make
