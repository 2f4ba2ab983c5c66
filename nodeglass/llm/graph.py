"""Vertices that meet under a key, and connected components of an edge table."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from nodeglass.llm.tables import stage
from nodeglass.llm.words import mix

MEETING = "key long, id long, other long"


def meeting(keys, ids):
    """Arrow rows (key, id, other) of vertices under keys, for ``meeting_edges``.

    What a task holds is joined before it moves: only the first vertex of each
    key keeps the key, the others have that vertex as ``other``. So a key that a
    third of all vertices have comes to the shuffle once per call, not per vertex.
    """
    keys, ids = keys.view(np.int64), np.asarray(ids, np.int64)
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = ids[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(ids) else ids
    twice = ~new & (ids == first)
    spread = np.where(new, keys, mix(ids.view(np.uint64)).view(np.int64))
    columns = [pa.array(spread[~twice]), pa.array(ids[~twice]), pa.array(first[~twice], mask=new[~twice])]
    return pa.RecordBatch.from_arrays(columns, names=["key", "id", "other"])


def meeting_edges(met):
    """Edges (a, b) that connect all vertices of each key with its least one."""
    least = F.first("id").over(Window.partitionBy("key").orderBy("id"))
    return met.select(F.col("id").alias("a"), F.coalesce("other", least).alias("b")).where("a <> b").distinct()


def components(edges, label="components"):
    """(id, component) for each vertex of ``edges`` (columns a, b of type long).

    The component is named by its smallest vertex. Each round links every
    vertex's larger neighbours, then its smaller ones, to the smallest vertex it
    knows (large-star and small-star); rounds grow with the logarithm of the
    longest path. Neighbour lists are never gathered: a vertex's smallest
    neighbour is a grouped minimum, which a join brings to its edges, so a
    vertex with very many neighbours is split like any skewed join key.
    Vertices without an edge to another one do not appear.
    """
    def tidy(pairs):
        return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(pairs):
        return pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = stage(tidy(edges.where("a IS NOT NULL AND b IS NOT NULL")), label)
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("low"))
        large = both.join(smallest, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        large = large.distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").select("b", "low").where("b > low").toDF("a", "b")
        edges = stage(small.unionByName(lowest.toDF("a", "b")).distinct(), label)
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
