import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from nodeglass.llm import packing, words
import pyarrow as pa

PATH = public_tokenizers.path(packing.VOCABULARY)


def coded(texts, encode):
    for _, data, offsets in words.blocks(pa.array(texts, pa.string())):
        starts, ends, first = words.word_spans(data, offsets)
        ids, places = encode.of_words(data, starts, ends)
        for a, b in zip(places[first[:-1]], places[first[1:]]):
            yield ids[a:b].tolist()


def test_ids_are_the_tokenizers():
    texts = ["", "Don't STOP, we'll: go!!", "Straße İstanbul ΑΣ é naïve ﬁ １２", "<|endoftext|> a<|startoftext|>b", "q\x85z \x1c x\x0by ²³",
             "日本語 🎉🎉 ok\u200bok", "'s 'S it's", "e\u0301 À̂", "a\x01b c\x02d", "x" * 5000, "µ ª º ÿ Ÿ"]
    tokenizer = Tokenizer.from_file(PATH)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encode = packing.WordIds(PATH)
    assert list(coded(texts, encode)) == want and list(coded(texts[::-1], encode)) == want[::-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_ids_of_any_text(texts):
    if not hasattr(test_ids_of_any_text, "both"):
        test_ids_of_any_text.both = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    tokenizer, encode = test_ids_of_any_text.both
    assert list(coded(texts, encode)) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.lists(st.integers(1, 50), max_size=200))
def test_bins(lengths):
    if not lengths:
        return
    number, offset = packing.best_two_fit(lengths, 50)
    for k in set(number.tolist()):
        own = sorted((o, n) for o, n, b in zip(offset.tolist(), lengths, number.tolist()) if b == k)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 50
    assert len(set(number.tolist())) <= 2 * sum(lengths) / 50 + 1


def test_two_fit_replaces_the_smallest():
    # Greedy fills 6 + 3 of 10; 2 + 2 fill the gap that 3 leaves exactly.
    number, _ = packing.best_two_fit([6, 3, 2, 2], 10)
    assert number[0] == number[2] == number[3] != number[1]


def check(docs, pieces, limit):
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for row in docs.collect():
        ids = np.array([*tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), limit)):
            part = ids[at:at + limit]
            want.append((row["doc_id"], k, at, len(part), zlib.crc32(part.tobytes())))
    got = [tuple(r[:5]) for r in pieces]
    assert sorted(got, key=str) == sorted(want, key=str)
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        own.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:])) and own[0][0] == 0 and sum(own[-1]) <= limit
    return len(by_sequence), -(-sum(r["length"] for r in pieces) // limit)


def test_edge_rows(edge_docs, no_docs):
    assert packing.pack_documents(no_docs, PATH).count() == 0
    check(edge_docs, packing.pack_documents(edge_docs, PATH).collect(), 4096)


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    used, least = check(docs, packing.op9_best_fit_packing(spark, "/root/testdata/sf0.001").collect(), 4096)
    assert used <= least + 2


def test_words_of_a_regular_pattern_have_their_own_ids():
    """A Thue-Morse word and its complement are two words."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    texts = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    tokenizer = Tokenizer.from_file(PATH)
    assert list(coded(texts, packing.WordIds(PATH))) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
