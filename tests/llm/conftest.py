import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, __tick string, score double"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source]) rows, with extra columns whose names clash."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", 0, "x", "y", 0.5) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture(scope="session")
def spread(spark):
    """Rows of a table over several partitions."""
    return lambda df: df.repartition(5)
