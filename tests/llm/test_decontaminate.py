import brute
import numpy as np
import pyarrow as pa
from hypothesis import given, strategies as st

from nodeglass.llm import decontaminate as d, words


def make(rng):
    word = lambda n: [f"w{x}" for x in rng.integers(0, 400, n)]
    items = [" ".join(word(rng.integers(8, 40))) for _ in range(30)] + ["too short", "", None, "w7", "one two three four", "a b c"]
    docs = []
    for i in range(200):
        text = word(rng.integers(0, 120))
        if i % 3:
            copy = items[rng.integers(30)].split()
            for _ in range(rng.integers(0, 3)):
                copy[rng.integers(len(copy))] = "edited"
            if i % 5 == 0:
                copy.insert(len(copy) // 2, "inserted")
            if i % 7 == 0:  # the halves swapped
                copy = copy[len(copy) // 2:] + copy[:len(copy) // 2]
            at = rng.integers(0, len(text) + 1)
            text[at:at] = copy[: len(copy) - int(rng.integers(0, 3))]
        docs.append("  ".join(text).upper() if i % 2 else "\n".join(text))
    return docs + ["Too  SHORT", "too short indeed", "", None, "and one two Three four!", "zero one two three four five", "a b", "a a b c b"], items


def test_equals_brute_force(spark):
    texts, items = make(np.random.default_rng(0))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = brute.contamination(texts, items)
    for n in (20_000, 7):  # in one round, and in several
        d.ITEMS_AT_ONCE, before = n, d.ITEMS_AT_ONCE
        try:
            got = {(r["doc_id"], r["item_id"]): r for r in d.find_contamination(docs, bench).collect()}
            kept = {r["doc_id"] for r in d.keep_uncontaminated(docs, bench).collect()}
        finally:
            d.ITEMS_AT_ONCE = before
        assert set(got) == want and all(0.8 <= r["similarity"] <= 1 for r in got.values())
        assert kept == set(range(len(texts))) - {t for t, _ in want}


@given(st.integers(0, 3000))
def test_multi_index_finds_all_within_the_radius(seed):
    rng = np.random.default_rng(seed)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, 20 + k % 2)) for k in range(20)]
    bench = d.Benchmark(list(range(20)), texts)
    bits = bench.prints[rng.integers(20)].copy()
    bits[rng.choice(d.BITS, int(rng.integers(0, 60)), replace=False)] ^= True
    for parity in (0, 1):
        want = [i for i in range(20) if i % 2 == parity and (bench.prints[i] != bits).sum() <= d.RADIUS]
        assert bench.near(bits, (5, 16 + parity)).tolist() == want


def test_index_passes_most_items_by():
    rng = np.random.default_rng(1)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10_000, 30))
    bench = d.Benchmark(list(range(1000)), [text() for _ in range(1000)])
    others = [d.simhash(words.shingle_hashes(*words.hashed_words(*block[1:]), 5)[0]) for block in (
        next(words.blocks(pa.array([text()]))) for _ in range(40))]
    share = np.mean([len(bench.candidates(bits, (5, 26))) for bits in others]) / 1000
    assert 0.05 < share < 1 / 3


def test_swapped_halves(spark):
    item = [f"i{k}" for k in range(60)]
    text = [f"t{k}" for k in range(500)]
    rows = [(1, " ".join(text + item[30:] + item[:30] + text)), (2, " ".join(text + item[40:] + item[20:40] + item[:20] + text)), (3, " ".join(text))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    want = brute.contamination([t for _, t in rows], [" ".join(item)])
    got = d.find_contamination(docs, bench).collect()
    assert {r["doc_id"] for r in got} == {rows[t][0] for t, _ in want} == {1}
    assert got[0]["first_word"] == 500 and got[0]["n_words"] == 60


def test_words_of_a_regular_pattern_stay_apart(spark):
    """A Thue-Morse word and its complement are two words."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, one)], "item_id long, text string")
    assert [r["doc_id"] for r in d.find_contamination(docs, bench).collect()] == [1]


def test_a_text_that_repeats_itself(spark):
    docs = spark.createDataFrame([(1, "la " * 60_000), (2, "lala")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "la"), (2, "la " * 12)], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["first_word"]) for r in d.find_contamination(docs, bench).collect()) == [(1, 1, 0), (1, 2, 0)]


def test_repeats_weigh_more():
    x, y = np.array([1, 2, 2, 3], np.uint64), np.array([2, 3, 3, 4], np.uint64)
    assert d.weighted_overlap(x, y) == (2, 6)


def test_edge_rows(edge_docs, no_docs, spark):
    bench = spark.createDataFrame([(1, "same text here again and again"), (2, None), (3, "")], "item_id long, text string")
    hits = d.find_contamination(edge_docs, bench)
    assert sorted(r["doc_id"] for r in hits.collect()) == [8, 8, 9]
    kept = d.keep_uncontaminated(edge_docs, bench)
    assert kept.schema == edge_docs.schema and kept.count() == edge_docs.count() - 3
    assert d.find_contamination(no_docs, bench).count() == d.keep_uncontaminated(no_docs, bench).count() == 0
    none = bench.where("false")
    assert d.find_contamination(edge_docs, none).count() == 0 and d.keep_uncontaminated(edge_docs, none).count() == edge_docs.count()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").toPandas() for t in ("documents", "benchmark"))
    want = brute.contamination(docs["text"], items["text"])
    got = d.op5_benchmark_decontamination(spark, sf).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == sorted((docs["doc_id"][t], items["item_id"][i]) for t, i in want)
    assert want
