"""Op 8: embedding near-duplicates by E8 lattice hashing.

Each of several tables projects the unit vectors at random onto a few blocks of
eight dimensions and takes the nearest point of the E8 lattice in each block as
the vector's cell. A vector is also entered in neighbouring cells, those with
the nearest point of the other coset in one block. Vectors that meet in a cell,
directly or through others, form a group; within a group all cosines are
computed, in blocks of ``CHUNK`` by ``CHUNK``, so nothing that met is missed and
nothing below the threshold links. Equal vectors are one vector with a
multiplicity throughout.

The number of blocks grows with the logarithm of the number of vectors, which
keeps chance meetings of unrelated vectors rare. The number of tables follows
from the blocks, so that a pair at a cosine of 0.9 that nothing else brings
together meets with a probability of ``FOUND`` at every size.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from nodeglass.llm.graph import MEETING, components, meeting, meeting_edges
from nodeglass.llm.tables import map_batches, stage, table
from nodeglass.llm.words import mix

FOUND = 0.93  # probability that a lone pair at a cosine of 0.9 meets in a cell
CELL = 1.75  # width of a lattice step, in units of a projected coordinate
# Of a block at a cosine of 0.9 and this CELL, by simulation of 400,000 pairs: same
# nearest point; points that differ but meet when probed; and for two blocks that
# differ, that either vector probes one of them.
SAME, PROBED, EITHER = 0.216, 0.206, 0.0153
CHUNK = 2000  # vectors on either side of one block of cosines, about
SEED = 8


def blocks_for(vectors):
    """Blocks of a table: 3 up to 200,000 vectors, one more per factor 100.

    With the tables that a further block needs, the cells an unrelated vector is
    met in become about 120 times fewer.
    """
    return 3 + max(0, math.ceil(math.log(max(vectors, 1) / 200_000, 100)))


def tables_for(blocks):
    """Tables in which a pair at a cosine of 0.9 meets with probability ``FOUND``."""
    meet = (SAME ** blocks + blocks * SAME ** (blocks - 1) * PROBED
            + math.comb(blocks, 2) * SAME ** (blocks - 2) * EITHER)
    return math.ceil(math.log(1 - FOUND) / math.log(1 - meet))


def _nearest_even(y):
    """Nearest integer points with an even coordinate sum."""
    out = np.rint(y)
    off = y - out
    odd = np.flatnonzero(out.sum(axis=1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(axis=1)
    out[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return out


def decode(y):
    """Twice the nearest E8 points, and twice the nearest of the other coset."""
    whole, half = _nearest_even(y), _nearest_even(y - 0.5) + 0.5
    nearer = (((y - whole) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1))[:, None]
    return np.where(nearer, 2 * whole, 2 * half).astype(np.int64), np.where(nearer, 2 * half, 2 * whole).astype(np.int64)


def cells(vectors, blocks):
    """For each table the cell numbers (vectors, 1 + blocks): the own and the probed ones."""
    n, size = vectors.shape
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rng = np.random.default_rng([SEED, size])
    weights = rng.integers(1, 1 << 62, 8, dtype=np.uint64) | np.uint64(1)
    for t in range(tables_for(blocks)):
        own, other = np.zeros((2, n, blocks), np.uint64)
        for b in range(blocks):
            near, next_ = decode(unit @ rng.normal(size=(size, 8)) / CELL)
            salt = np.array([(size << 32) + t * 64 + b], np.uint64)
            own[:, b] = mix((near.view(np.uint64) * weights).sum(axis=1, dtype=np.uint64) + mix(salt))
            other[:, b] = mix((next_.view(np.uint64) * weights).sum(axis=1, dtype=np.uint64) + mix(salt))
        whole = own.sum(axis=1, dtype=np.uint64)[:, None]
        yield np.concatenate((whole, whole - own + other), axis=1)


def _matrix(column):
    """Vectors of one length from an Arrow list column without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _cell_table(classes, blocks):
    """The cells of every class of vectors, as ``meeting`` rows."""

    def enter(batches):
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for size in np.unique(sizes):
                rows = pa.array(sizes == size)
                ids = np.repeat(batch.column(0).filter(rows).to_numpy(), 1 + blocks)
                for found in cells(_matrix(batch.column(1).filter(rows)), blocks):
                    yield meeting(found.ravel(), ids)

    return map_batches(classes.select("id", "vector", F.size("vector").alias("size")), enter, MEETING)


def _block_links(ids, vectors, many, side, threshold):
    """Rows (a, b, n): links b < a of a spanning forest, and link counts n per a."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    left, right = (np.arange(len(ids)),) * 2 if side is None else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    close = unit[left] @ unit[right].T >= threshold
    if side is None:
        np.fill_diagonal(close, False)
    out = [(ids[i], None, n) for i, n in zip(left, close @ many[right]) if n]
    if side is not None:
        out += [(ids[j], None, n) for j, n in zip(right, many[left] @ close) if n]
    # A breadth-first forest: each row of the matrix is looked at once.
    open_left, open_right = np.ones(len(left), bool), np.ones(len(right), bool)
    for root in range(len(left)):
        if not open_left[root]:
            continue
        open_left[root] = False
        if side is None:
            open_right[root] = False
        queue = [(True, root)]
        while queue:
            on_left, k = queue.pop()
            fresh = np.flatnonzero((close[k] & open_right) if on_left else (close[:, k] & open_left))
            here = ids[left[k] if on_left else right[k]]
            (open_right if on_left else open_left)[fresh] = False
            if side is None:
                open_left[fresh] = False
            out += [(here, ids[(right if on_left else left)[f]], 0) for f in fresh]
            queue += [(True if side is None else not on_left, f) for f in fresh]
    return out


def _group_links(classes, groups, threshold):
    """Links and link counts within groups (id, component), as (a, b, n) rows."""
    sizes = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias("chunks"))
    placed = stage(groups.join(sizes, "component").select(
        "id", "component", "chunks", F.pmod(F.xxhash64("id"), F.col("chunks")).alias("chunk")), "vector-groups")
    tasks = placed.select(
        "id", "component", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("with")
    ).select("id", "component", "chunk", F.least("chunk", "with").alias("one"), F.greatest("chunk", "with").alias("two"))
    # A vector is placed once for each chunk of its group.
    bins = max(1, (placed.agg(F.sum("chunks")).first()[0] or 0) // CHUNK)
    rows = tasks.join(classes, "id").withColumn("bin", F.pmod(F.xxhash64("component", "one", "two"), F.lit(bins)))

    def link(rows):
        out = []
        for (_, one, two), unit in rows.groupby(["component", "one", "two"]):
            for _, alike in unit.groupby(unit["vector"].map(len)):
                if len(alike) > 1:
                    side = None if one == two else (alike["chunk"].to_numpy() == two).astype(int)
                    out += _block_links(alike["id"].to_numpy(), np.stack(alike["vector"]).astype(np.float64),
                                        alike["many"].to_numpy(), side, threshold)
        return pd.DataFrame(out, columns=["a", "b", "n"]).astype({"a": "Int64", "b": "Int64", "n": "Int64"})

    columns = ["bin", "component", "one", "two", "chunk", "id", "many", "vector"]
    return rows.select(*columns).groupBy("bin").applyInPandas(link, "a long, b long, n long")


def near_duplicates(vectors, key="vec_id", vector="embedding", threshold=0.9):
    """(key, n_links, component_id, kept) for each row of ``vectors``.

    Two vectors link when they meet in a group and their cosine, in double
    precision, is ``threshold`` or more. n_links counts the other rows linked
    directly; component_id is the smallest key that links reach; kept marks the
    row of that key. Vectors that are null, empty, zero, or hold a null or a
    component that is not finite link with nothing; so do vectors of different
    lengths with each other. Rows that share a key count as one vertex and each
    comes out; a null key is its own component unless it links.
    """
    elements = F.col(vector).cast("array<double>")
    usable = F.coalesce(F.forall(elements, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                        & F.exists(elements, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(key).cast("long").alias("id"), elements.alias("vector"), usable.alias("usable")).withColumns({
        "k1": F.when(F.col("usable"), F.xxhash64("vector")), "k2": F.when(F.col("usable"), F.xxhash64(F.lit(1), "vector"))})
    classes = stage(rows.where("usable AND id IS NOT NULL").groupBy("k1", "k2").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("many"), F.any_value("vector").alias("vector")), "vector-classes")
    entered = _cell_table(classes, blocks_for(classes.count()))
    groups = stage(components(meeting_edges(entered), "vector-cells"), "vector-groups")
    found = stage(_group_links(classes.select("id", "many", "vector"), groups, threshold), "vector-links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    linked = components(found.where("b IS NOT NULL").select("a", "b"), "vector-links")
    named = classes.select("k1", "k2", "id", "many").join(counts, "id", "left").join(linked, "id", "left").select(
        "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    return rows.select("id", "k1", "k2").join(named, ["k1", "k2"], "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def op8_embedding_near_dedup(spark, sf_dir):
    """Links, component and keeping of every vector, at a cosine of 0.9."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


# All pairs; the lattice tables find the same links where these are as close as copies are.
OP8_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), usable AS (
  SELECT vec_id, v FROM vectors
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.9
), reached(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
), found AS (
  SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
)
SELECT f.vec_id, coalesce(c.n, 0) AS n_links, f.component_id, f.vec_id = f.component_id AS kept
FROM found f LEFT JOIN counts c ON c.a = f.vec_id
"""
