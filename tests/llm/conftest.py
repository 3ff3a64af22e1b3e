import pytest

EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "word"), (5, "Ünï cödé 漢字 😀 text"), (6, "x" * 70_000), (7, "a b " * 30_000), (8, "same text here once more"), (9, "same text here once more"), (None, "no id"), (9, "same text here once more")]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls, empty and long texts, repeated rows, and columns whose names could clash."""
    rows = [(i, t, "en", None if k % 3 == 0 else f"s{k % 2}", len(t or ""), 7, "u", 1) for k, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp int, size string, _kept int").repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
