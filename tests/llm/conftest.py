import pytest

LONG = " ".join(f"word{i % 5000}" for i in range(120_000))
EDGE_TEXTS = [None, "", " \t\n ", "one", "a b", "Ünïcödé テスト 🎉 \x00 end", "x" * 300_000, LONG, "same text here again and again", "same text here again and again"]


@pytest.fixture
def edge_docs(spark):
    """Documents with odd texts, repeated rows, a null id and clashing columns."""
    rows = [(i, t, "en", "s", 1.5, ["x"], "mine") for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[8], (None, "no id here at all", "en", "s", 0.0, [], "x")]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, score double, spans array<string>, _text string")


@pytest.fixture
def no_docs(edge_docs):
    return edge_docs.where("doc_id < 0")
