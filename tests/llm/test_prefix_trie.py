import random
import zlib

import pytest

import brute
from nodeglass.llm import prefix_trie as pt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def frame(spark, conversations):
    rows = [(c, i, role, text, "x") for c, turns in conversations.items() for i, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string")
    return df.repartition(3)


def grown(n, seed):
    """Random conversations with many shared openings, and a third of them copies."""
    rng, out = random.Random(seed), {}
    hot = [("user", "häufig"), ("assistant", "ja"), ("user", "")]
    for c in rng.sample(range(-20, 5 * n), n):
        out[c] = hot if rng.random() < 0.33 else [(rng.choice(["user", "assistant"]), rng.choice(["a", "b", "ü"])) for _ in range(rng.randint(1, 5))]
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("ids", [2, 50_000])
def test_equals_brute_force(spark, monkeypatch, seed, ids):
    monkeypatch.setattr(pt, "END_IDS", ids)
    monkeypatch.setattr(pt, "SHARD_TURNS", 40)
    conversations = grown(150, seed)
    out = pt.prefix_trie(pt.paths(pt.turn_lists(frame(spark, conversations))))
    assert rows_of(out) == sorted(brute.trie(conversations), key=str)


def test_small_skeleton(spark, monkeypatch):
    monkeypatch.setattr(pt, "SKELETON_BYTES", 60)
    conversations = grown(100, 3)
    out = pt.prefix_trie(pt.paths(pt.turn_lists(frame(spark, conversations))))
    assert rows_of(out) == sorted(brute.trie(conversations), key=str)


def test_shared_openings(spark):
    own = grown(60, 4)
    want = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        want[c] = own.get(first, [])[:h] + turns[h:]
    out = pt.prefix_trie(pt.paths(pt.with_shared_openings(pt.turn_lists(frame(spark, own)))))
    assert rows_of(out) == sorted(brute.trie(want), key=str)
    assert any(not turns for turns in want.values())  # turnless ones end in the root


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (1, 1, "user", "b"), (1, None, None, None), (1, 1, "user", "b"), (2, None, "", ""),
            (2, 7, "user", "b"), (3, 0, "user", "x" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {1: [("", ""), ("user", "b"), ("user", "b")], 2: [("", ""), ("user", "b")], 3: [("user", "x" * 300_000)]}
    assert rows_of(pt.prefix_trie(pt.paths(pt.turn_lists(df)))) == sorted(brute.trie(want), key=str)
    empty = pt.prefix_trie(pt.paths(pt.with_shared_openings(pt.turn_lists(df.where("false")))))
    assert empty.count() == 0 and empty.columns == pt._NODE


def test_long_conversation(spark):
    turns = [("user", str(i % 7)) for i in range(3000)]
    out = pt.prefix_trie(pt.paths(pt.turn_lists(frame(spark, {4: turns, 9: turns[:2999]}))))
    assert out.count() == 3001
    assert out.where("depth = 0").first()["saved_tokens"] == 2999
    assert out.where("depth = 2999").first()["n_convs"] == 2


def test_a_role_is_not_part_of_the_text(spark):
    out = pt.prefix_trie(pt.paths(pt.turn_lists(frame(spark, {1: [("a", "bc")], 2: [("ab", "c")]}))))
    assert out.count() == 3
