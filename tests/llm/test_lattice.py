import brute
import numpy as np
import pytest

from nodeglass.llm import lattice


def plain(rows, threshold=0.9):
    def usable(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ok = [i for i, (_, v) in enumerate(rows) if usable(v)]
    links = []
    for n, i in enumerate(ok):
        for j in ok[:n]:
            x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links.append((j, i))
    counts = np.bincount(np.array(links, int).ravel(), minlength=len(rows))
    return counts.tolist(), brute.components([r[0] for r in rows], links)


def test_decode_gives_nearest_points():
    rng = np.random.default_rng(0)
    y = rng.normal(size=(300, 8)) * 2
    near, other = lattice.decode(y)
    for points in (near, other):
        assert ((points % 2).sum(axis=1) % 8 == 0).all() and ((points % 2 == points[:, :1] % 2)).all()
        assert (points.sum(axis=1) % 4 == 0).all()  # twice a lattice point
    steps = np.array([[a, b, *[0] * 6] for a in (-1, 1) for b in (-1, 1)])
    d = ((y - near / 2) ** 2).sum(axis=1)
    for step in steps:
        assert (d <= ((y - near / 2 - step) ** 2).sum(axis=1) + 1e-9).all()
    assert (d <= 1 + 1e-9).all()  # the covering radius of the lattice


def make(rng, groups, size, noise):
    rows = []
    for g in range(groups):
        centre = rng.normal(size=64)
        rows += [centre + noise * rng.normal(size=64) for _ in range(size)]
    return rows


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lattice, "CHUNK", 9)
    rng = np.random.default_rng(3)
    vectors = make(rng, 20, 1, 0) + make(rng, 3, 12, 0.05) + make(rng, 4, 2, 0.08)
    vectors += [vectors[3], vectors[3], 2 * vectors[30]]
    rows = [(int(i * 2), np.float32(v).astype(float).tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {r["vec_id"]: r for r in lattice.near_duplicates(df).collect()}
    counts, component = plain(rows)
    assert [got[i]["n_links"] for i, _ in rows] == counts
    assert [got[i]["component_id"] for i, _ in rows] == component
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        x, z = rng.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        z -= (z @ x) * x
        z /= np.linalg.norm(z)
        c = rng.uniform(0.95, 1)
        rows += [(2 * i, x.tolist()), (2 * i + 1, (c * x + np.sqrt(1 - c * c) * z).tolist())]
    out = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert out["n_links"].sum() >= 0.9 * len(rows)  # each has one partner


def planted(rng, pairs, low, high):
    """Vectors of 64 dimensions, each followed by one at a cosine from low to high."""
    x, z = rng.normal(size=(2, pairs, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = rng.uniform(low, high, (pairs, 1))
    return np.stack((x, c * x + np.sqrt(1 - c * c) * z), axis=1).reshape(-1, 64)


@pytest.mark.parametrize("blocks", [3, 4, 5])
def test_lone_pairs_meet_whatever_the_blocks(blocks):
    """A pair at a cosine of 0.9 shares a cell of some table."""
    vectors = planted(np.random.default_rng(11), 400, 0.9, 0.9)
    met = np.zeros(400, bool)
    for found in lattice.cells(vectors, blocks):
        met |= (found[::2, :, None] == found[1::2, None, :]).any(axis=(1, 2))
    assert met.mean() >= 0.9


@pytest.mark.parametrize("vectors", [100_000, 1_000_000, 100_000_000])
def test_recall_at_the_threshold_at_every_size(spark, monkeypatch, vectors):
    blocks = lattice.blocks_for(vectors)
    monkeypatch.setattr(lattice, "blocks_for", lambda n: blocks)
    rows = [(i, v.tolist()) for i, v in enumerate(planted(np.random.default_rng(12), 200, 0.9001, 0.95))]
    out = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert out.agg({"n_links": "sum"}).first()[0] >= 0.9 * len(rows)  # each has one partner


def test_edge_rows(spark):
    v = [1.0, 2.0, 0.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [float("nan"), 1.0, 0.0]),
            (6, [float("inf"), 1.0, 0.0]), (7, v), (7, v), (8, [2.0, 4.0, 0.0]), (9, [1.0, 2.0]), (None, v), (10, [1e30, 2e30, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, component string")
    out = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_duplicates(df).collect()]
    assert len(out) == len(rows)
    alone = (1, 2, 3, 4, 5, 6, 9)
    assert {o for o in out if o[0] in alone} == {(i, 0, i, True) for i in alone}
    assert {o[2] for o in out if o[0] in (7, 8, 10)} == {7}
    assert lattice.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_query(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(e["vec_id"], e["embedding"])]
    counts, component = plain(rows)
    got = {r["vec_id"]: r for r in lattice.op8_embedding_near_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * sum(counts)
    assert [got[i]["component_id"] for i, _ in rows] == component
