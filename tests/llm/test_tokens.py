import public_tokenizers
from hypothesis import given, strategies as st

from nodeglass.llm import tokens


def greedy(pieces, word):
    """Longest match by trying every length."""
    n = at = 0
    while at < len(word):
        size = next((k for k in range(len(word) - at, 0, -1) if word[at:at + k] in pieces), 0)
        n += 1 if size else len(word[at].encode())
        at += size or 1
    return n


@given(st.lists(st.text("abcä", min_size=1, max_size=5), max_size=12), st.text("abcäx", max_size=30))
def test_equals_greedy_longest_match(pieces, word):
    assert tokens.LongestMatch(pieces).count(word) == greedy(set(pieces), word)


def test_whole_vocabulary(spark):
    path = public_tokenizers.path(tokens.VOCABULARY)
    pieces = tokens.read_vocabulary(path)
    automaton, known = tokens.LongestMatch(pieces), set(pieces)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).toPandas()
    for word in {w for t in docs["text"] for w in t.split()} | {"🎉x", "ﬁﬁ"}:
        assert automaton.count(tokens.MARK + word) == greedy(known, tokens.MARK + word)


def test_edge_rows(edge_docs, no_docs):
    path = public_tokenizers.path(tokens.VOCABULARY)
    out = {(r["doc_id"], r["text"]): r for r in tokens.count_tokens(edge_docs, path).collect()}
    assert all((out[i, t]["n_words"], out[i, t]["n_tokens"]) == (0, 0) for i, t in ((0, None), (1, ""), (2, " \t\n ")))
    assert [r["n_words"] for (i, _), r in out.items() if i == 7] == [120_000]
    counted = tokens.count_tokens(edge_docs, path)
    assert counted.count() == edge_docs.count() and set(edge_docs.columns) < set(counted.columns)
    assert tokens.count_tokens(no_docs, path).count() == 0


def test_replaces_columns_of_its_name(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, n_tokens string")
    row = tokens.count_tokens(docs, public_tokenizers.path(tokens.VOCABULARY)).first()
    assert (row["n_words"], row["n_tokens"]) == (2, 2)
