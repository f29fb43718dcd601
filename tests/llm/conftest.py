import pytest

#: Column names that operators use for themselves.
CLASHING = ["id", "row", "hash", "spans", "doc", "k", "fp", "least", "votes", "gold", "pii", "_row", "_t", "n", "words", "component_id", "bin", "digest"]
LONG = " ".join(f"word{i % 5000} and{i % 7}." for i in range(40_000))
EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (None, None), (None, "a null id with some words in it"), (4, "one"), (5, LONG), (6, "Ünïcödé 日本語 😀 text   here"),
    (7, "same row twice with quite a few words"), (7, "same row twice with quite a few words"), (8, "same row twice with quite a few words"), (9, "x" * 5000), (10, "#### | $$$ || %%%"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def edges(docs_of):
    """Nulls, empty, very long and repeated texts."""
    return docs_of(EDGES)


@pytest.fixture(scope="session")
def clashing(edges):
    """The same with further columns of the names operators use."""
    from pyspark.sql import functions as F

    return edges.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in (1, 2, 4, 5, 6, 7)] + [(None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
