import pytest

#: Columns whose names clash with those the operators use or return.
EXTRA = ("score", "lang_pred", "fp", "kept", "row_id", "start", "spans", "size", "part", "position", "hash", "id")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null ids and texts, empty, blank and very long texts, repeated rows, clashing extra columns."""
    long = "Mail a.b@c.example.org or word " * 12_000
    rows = [
        (1, "The and of to in. Words here are plain. " * 12, "en"), (1, "The and of to in. Words here are plain. " * 12, "en"),
        (2, None, "en"), (3, "", None), (4, " \t\n\x0b ", "en"), (None, "Der die das und nicht. " * 20, "de"),
        (None, None, None), (5, long, "en"), (6, "Der die das und nicht. " * 20, "de"), (7, "12 34 !!", "de"),
        (8, "   ß Ünï \U0001F600 é", None), (9, "x" * 50_000, "en"), (10, "1.2.3.4 " * 3000, "en"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    data = [(i, t, g, "src", len(t) if t else None, *["e"] * len(EXTRA)) for i, t, g in rows]
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
