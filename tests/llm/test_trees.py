import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from nodeglass.llm import trees, words
from nodeglass.llm.tables import stage


def expected(rows, k, percent):
    sets = [set(brute.shingles(t, k)) for _, t in rows]
    return brute.components([i for i, _ in rows], brute.jaccard_links(sets, percent)), [len(s) for s in sets]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([60, 80, 90, 100]))
def test_part_keys_never_miss_a_link(seed, percent):
    rng = np.random.default_rng(seed)
    parts, n = trees.Parts(percent), int(rng.integers(1, 400))
    one = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    kept = one[rng.random(len(one)) < rng.uniform(percent / 100, 1)]
    two = np.unique(np.concatenate((kept, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64))))
    common = len(np.intersect1d(one, two))
    if len(two) and 100 * common >= percent * (len(one) + len(two) - common):
        frequent = one[::7]  # left out of the parts of both
        keys = [set(trees.part_keys(np.setdiff1d(s, frequent), len(s), parts).tolist()) for s in (one, two)]
        assert keys[0] & keys[1]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([60, 80, 90, 100]), st.sampled_from([0, 0.1, 0.6, 0.97]))
def test_linking_sets_keep_a_shared_key_in_any_order(seed, percent, left_out):
    """Each set leaves out the last keys of an order that it can spare."""
    rng = np.random.default_rng(seed)
    parts, n = trees.Parts(percent), int(rng.integers(1, 600))
    one = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    kept = one[rng.random(len(one)) < rng.uniform(percent / 100, 1)]
    two = np.unique(np.concatenate((kept, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64))))
    common = len(np.intersect1d(one, two))
    if len(two) and 100 * common >= percent * (len(one) + len(two) - common):
        frequent = np.union1d(one, two)
        frequent = frequent[rng.random(len(frequent)) < left_out]
        sets = [list(trees.banded_keys(np.setdiff1d(s, frequent), len(s), parts)) for s in (one, two)]
        assert min(room for of in sets for _, room, _ in of) >= 0
        shared = set(np.concatenate([k for _, _, k in sets[0]]).tolist()) & set(np.concatenate([k for _, _, k in sets[1]]).tolist())
        for order in ("random", "shared last"):  # the worst order is that of keys many sets have
            def place(key):
                return order == "shared last" and key in shared, int(words.mix(np.array([key]).view(np.uint64) ^ np.uint64(seed))[0])
            left = [{k for _, room, keys in of for k in sorted(keys.tolist(), key=place)[:len(keys) - room]} for of in sets]
            assert left[0] & left[1]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([50, 80, 90]), st.booleans())
def test_dual_traversal_connects_as_all_pairs(seed, percent, sides):
    rng = np.random.default_rng(seed)
    seeds = [rng.integers(0, 1 << 63, rng.integers(1, 60), dtype=np.uint64) for _ in range(6)]
    sets = [np.unique(s[rng.random(len(s)) < 0.95]) for s in seeds for _ in range(5)]
    sets = [s for s in sets if len(s)]
    side = rng.integers(0, 2, len(sets)) if sides else None
    links = [(i, j) for i, j in brute.jaccard_links([set(s.tolist()) for s in sets], percent)
             if side is None or side[i] != side[j]]
    ids = list(range(len(sets)))
    found = trees.tree_links(sets, side, percent) if len(sets) > 1 else []
    assert {tuple(sorted(p)) for p in found} <= {tuple(sorted(p)) for p in links}
    assert brute.components(ids, found) == brute.components(ids, links)


def copies(rng, n, length, edits):
    """Texts with groups of copies, near copies and a line that many share."""
    base = [[f"w{x}" for x in rng.integers(0, 3000, length)] for _ in range(n)]
    rows = []
    for i in range(n * 6):
        text = list(base[rng.integers(n)])
        for _ in range(rng.integers(0, edits + 1)):
            text[rng.integers(len(text))] = f"e{rng.integers(1000)}"
        rows.append((int(i * 3), " ".join((["all", "share", "this", "line", "here"] if i % 3 else []) + text)))
    return rows


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_equals_brute_force(spark, monkeypatch, k, percent):
    monkeypatch.setattr(trees, "CHUNK_SETS", 7)  # so that groups are cut
    rows = copies(np.random.default_rng(k), 8, 90, 6)
    got = {r["id"]: tuple(r[1:]) for r in trees.jaccard_components(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shingle=k, percent=percent).collect()}
    want, sizes = expected(rows, k, percent)
    assert [got[i] for i, _ in rows] == list(zip(sizes, want))


def test_part_edges_leave_out_what_can_be_spared(spark):
    """Key 7 is held by all; 1 and 2 share key 8, 3 has no other, 4 and 5 have none to spare."""
    rows = [(7, 1, 1), (8, 1, 1), (7, 2, 1), (8, 2, 1), (7, 3, 1), (9, 3, 1), (7, 4, 0), (7, 5, 0), (10, 6, 0)]
    parts = [trees._met(*(np.array(c, np.int64) for c in zip(*some))) for some in (rows[:4], rows[2:7], rows[6:])]
    table = spark.createDataFrame([tuple(r.values()) for p in parts for r in p.to_pylist()], trees.PARTS).repartition(4)
    shared = trees.shared_parts(table).distinct().collect()
    assert sorted((r["key"], r["id"]) for r in shared) == [(7, 1), (7, 2), (7, 3), (7, 4), (7, 5), (8, 1), (8, 2)]
    assert sorted(map(tuple, trees.part_edges(table).collect())) == [(2, 1), (5, 4)]
    assert trees.part_edges(table.where("key > 8")).count() == 0


def test_texts_that_meet_by_chance_form_no_group(spark, monkeypatch):
    """A chain of texts that share passages is no group; the near copies in it are one."""
    staged = {}

    def kept(df, label):
        staged[label] = stage(df, label)
        return staged[label]

    monkeypatch.setattr(trees, "stage", kept)
    passages = [[f"p{i}x{j}" for j in range(36)] for i in range(41)]
    texts = [passages[i] + [f"own{i}x{j}" for j in range(150)] + passages[i + 1] for i in range(40)]
    texts.append([w if j not in (50, 90) else "new" for j, w in enumerate(texts[20])])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    out = trees.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = {r["id"]: r["component_id"] for r in out.collect()}
    assert got == {i: 20 if i == 40 else i for i in range(41)}
    assert staged["sets-in-groups"].count() == 2


def test_edge_rows(edge_docs, no_docs):
    out = [tuple(r) for r in trees.jaccard_components(edge_docs, shingle=3, percent=90).collect()]
    assert len(out) == edge_docs.count()
    got = dict((r[0], r[1:]) for r in out)
    assert got[0] == (0, 0) and got[1] == (0, 1) and got[2] == (0, 2)
    assert got[3] == (1, 3) and got[4] == (1, 4)
    assert got[8] == got[9] == (4, 8) and sum(r[0] == 8 for r in out) == 2
    assert got[None] == (3, None)
    assert trees.jaccard_components(no_docs).count() == 0


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    rows = list(zip(docs["doc_id"].tolist(), docs["text"]))
    want, sizes = expected(rows, 3, 90)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in trees.op7_jaccard_join(spark, "/root/testdata/sf0.001").collect()}
    assert [got[i] for i, _ in rows] == list(zip(sizes, want))


@given(st.lists(st.one_of(st.none(), st.text("aB \t\né", max_size=20)), max_size=8), st.integers(1, 4))
def test_shingle_sets_agree_with_plain_ones(texts, k):
    sets = list(words.shingle_sets(pa.array(texts, pa.string()), k))
    plain = [set(brute.shingles(t, k)) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in plain]
    for i in range(len(texts)):
        for j in range(i):
            assert (sets[i].tolist() == sets[j].tolist()) == (plain[i] == plain[j])


def test_words_of_a_regular_pattern_and_shared_ids(spark):
    """A Thue-Morse word and its complement are two words; rows that share an id have their own sets."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    rows = [(1, one), (2, two), (3, one), (5, "a b c d"), (5, "x y z w"), (6, "x y z w"), (None, "x y z w")]
    out = trees.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=90)
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(
        [(1, 1, 1), (2, 1, 2), (3, 1, 1), (5, 2, 5), (5, 2, 5), (6, 2, 5), (None, 2, 5)], key=str)
