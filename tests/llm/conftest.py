import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A function that makes a documents table from (doc_id, text, source) rows."""

    def make(rows, extra=False):
        full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            # names that the operators use themselves
            for name in ("size", "key", "part", "range", "score", "utf8", "ids", "shard", "rank", "n", "component_id", "start", "label", "fold", "features", "prediction", "set", "position", "words", "value", "vector"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture
def odd(docs):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
    rows = [(1, "one two three", "a"), (1, "one two three", "a"), (2, None, "a"), (3, "", None), (None, "null id", "b"), (4, "x" * 200_000, "b"), (5, long, None), (6, "one two three", "a"), (7, " \t\n ", "c"), (None, None, None), (8, "tail space ", "c"), (9, "two  spaces\n\nand é ünï 漢字", "c")]
    return docs(rows, extra=True)


@pytest.fixture
def empty(docs):
    return docs([])
