import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string, Text2 string, _rule_kept int, _masked string, ids string, fp string"


@pytest.fixture(scope="session")
def odd(spark):
    """Texts at the edges: null, empty, blank, very long, repeated rows, ties, null ids; with columns that clash."""
    words = " ".join(f"w{i % 97}x{i}" for i in range(60))
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, words), (5, words), (5, words), (None, words), (6, words.upper()),
        (7, "a" * 200_000), (8, ("lorem ipsum dolor " * 30_000)), (9, "é漢🙂 " * 500), (10, "x\ny\nx\n\nx"), (None, None),
        (11, "mail me at jo.doe@mail.example.com or +1 (724) 555-7058, 44.161.181.40"), (12, "<|endoftext|> it's  we'll\r\n x"),
    ]
    rows = [(i, t, "en", "s", len(t) if t else None, -1, "clash", "c", 7, "m", None, "f") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sample():
    """The small documents table, as (doc_id, text)."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True))
