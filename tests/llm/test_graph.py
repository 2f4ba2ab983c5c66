import brute
import numpy as np

from nodeglass.llm.graph import MEETING, components, meeting, meeting_edges


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, 300, (180, 2)).tolist() + [[1000 + i, 1001 + i] for i in range(40)] + [[5, 2000 + i] for i in range(50)]
    ids = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(ids)}
    want = dict(zip(ids, brute.components(ids, [(at[a], at[b]) for a, b in pairs])))
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    loops = {x for x in ids if all(a == b for a, b in pairs if x in (a, b))}
    assert got == {x: c for x, c in want.items() if x not in loops}


def test_no_edges(spark):
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def test_meeting_rows_connect_what_meets(spark):
    rng = np.random.default_rng(1)
    keys, ids = rng.integers(0, 60, 400).astype(np.uint64), rng.integers(0, 150, 400)
    keys[:120] = 7  # a key of many
    rows = [r for part in np.array_split(np.arange(400), 5) for r in meeting(keys[part], ids[part]).to_pylist()]
    assert sum(r["key"] == 7 and r["other"] is None for r in rows) <= 5
    found = components(meeting_edges(spark.createDataFrame([tuple(r.values()) for r in rows], MEETING).repartition(4)))
    first = {}
    want = brute.components(sorted(set(ids.tolist())), [
        (i, j) for i, j in _pairs(sorted(set(ids.tolist())), zip(keys.tolist(), ids.tolist()), first)])
    got = {r["id"]: r["component"] for r in found.collect()}
    assert {i: got.get(i, i) for i in sorted(set(ids.tolist()))} == dict(zip(sorted(set(ids.tolist())), want))


def _pairs(names, rows, first):
    """Index pairs of ids that share a key, each with the first of the key."""
    place = {name: k for k, name in enumerate(names)}
    for key, name in rows:
        yield place[first.setdefault(key, name)], place[name]
