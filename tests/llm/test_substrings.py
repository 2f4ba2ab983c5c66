import random

import numpy as np
import pytest

import brute
from nodeglass.llm import substrings


def rows_of(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def grown(n, seed):
    """Texts over few words with shared passages of 8 to 40 words, and copies."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "A", "b", "ß", "日本"]) * rng.randint(1, 3)
    passages = [[word() for _ in range(rng.randint(8, 40))] for _ in range(5)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choice(passages) if rng.random() < 0.6 else [word() for _ in range(rng.randint(1, 30))]
        text = "".join(w + rng.choice([" ", "  ", "\n", "\t "]) for w in parts)
        rows.append((i * 7 % n, text))
        if rng.random() < 0.1:
            rows.append((n + i, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [3, 50_000])
@pytest.mark.parametrize("most", [2, 32])
def test_equals_brute_force(spark, monkeypatch, seed, hot, most):
    monkeypatch.setattr(substrings, "HOT_PIECES", hot)
    monkeypatch.setattr(substrings, "MOST_WINDOWS", most)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 2_000)
    rows = grown(80, seed)
    assert rows_of(substrings.without_repeats(frame(spark, rows))) == sorted(brute.without_repeats(rows), key=str)


def test_a_passage_with_many_surroundings(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_PIECES", 20)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    other = lambda: [f"w{rng.random()}" for _ in range(20)]
    rows = [(i, " ".join(other() + passage + other())) for i in range(200)]
    out = substrings.without_repeats(frame(spark, rows))
    assert rows_of(out) == sorted(brute.without_repeats(rows), key=str)
    assert out.where("n_removed = 30").count() == 199


def test_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", -1)
    rows = grown(60, 5)
    assert rows_of(substrings.without_repeats(frame(spark, rows))) == sorted(brute.without_repeats(rows), key=str)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(3, text), (3, text), (3, text + " more"), (None, text), (5, "new " + text), (5, None), (1, ""), (0, " \t\n"), (9, text.upper()),
            (2, " ".join(["la"] * 5_000)), (4, " ".join(["la"] * 40)), (8, "x" * 300_000)]
    got = rows_of(substrings.without_repeats(frame(spark, rows)))
    assert got == sorted(brute.without_repeats(rows), key=str)
    assert [r[2] for r in got if r[0] == 3] == [0, 0, 0] and (4, 40, 40, brute.sha("")) in got


def test_edge_table(spark, edge_docs, no_docs):
    out = substrings.without_repeats(edge_docs)
    want = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert rows_of(out) == sorted(brute.without_repeats(want), key=str)
    assert substrings.without_repeats(no_docs).count() == 0


def test_word_without_rhyme_or_reason(spark):
    """A Thue-Morse word and its complement stay two words."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest}")]
    assert [r[2] for r in rows_of(substrings.without_repeats(frame(spark, rows)))] == [0, 0, 13]


# The index by itself

def test_matching_statistics():
    rng = random.Random(4)
    lists = [[rng.randint(1, 3) for _ in range(rng.randint(1, 30))] for _ in range(12)]
    symbols = np.array([s for x in lists for s in [*x, 0]])
    for depth in (1, 4, 7, 13):
        index = substrings.FmIndex(symbols, depth)
        queries = [[rng.randint(1, 4) for _ in range(rng.randint(0, 25))] for _ in range(30)] + lists
        flat = np.array([s for q in queries for s in q], np.int64)
        first = np.concatenate(([0], np.cumsum([len(q) for q in queries])))
        lengths, lows = index.matching_statistics(flat, first)
        for q, a in zip(queries, first):
            for i in range(len(q)):
                want = max(n for n in range(min(depth, len(q) - i) + 1)
                           if n == 0 or any(x[j:j + n] == q[i:i + n] for x in lists for j in range(len(x) - n + 1)))
                assert lengths[a + i] == want
                if want == depth:
                    at = index.order[lows[a + i]]
                    assert symbols[at:at + depth].tolist() == q[i:i + depth]


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 37, 1000)
    matrix = substrings.WaveletMatrix(symbols, 6)
    for c in range(37):
        places = np.arange(1001)
        got = matrix.follow(np.full(1001, c), places) - matrix.follow(np.array([c]), np.array([0]))
        assert (got == np.concatenate(([0], np.cumsum(symbols == c)))).all()


def test_first_owners():
    texts = [b"a b c d", b"b c d", b"x a b c"]
    found, begin = substrings.first_owners(texts, [5, 3, 4], depth=3)
    assert found.tolist() == [4, 3, 3, 4, 4] and begin.tolist() == [0, 2, 3, 5]
