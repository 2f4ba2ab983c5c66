"""Op 7: n-gram Jaccard join with signature trees.

Documents are sets of word shingles; two link when their sets' Jaccard
similarity reaches a threshold. The work goes in three steps.

1. Equal sets are one class; only classes are compared.
2. Classes that could link are brought together. Two linking sets differ in at
   most d shingles, d following from their sizes. When the hash range of shingles
   is cut into d + 1 parts (and some more, as parts may be empty), the sets
   agree on at least one part that is not empty; so classes with an equal part
   belong to one group. Very common shingles are left out of the parts (not of
   the sets): without them linking sets differ in d shingles at most as well.
   Sets that link agree on more parts than one if either has more parts than d + 1,
   so a set leaves as many of its parts out as it can spare, those that most sets
   have first. What agrees by chance is mostly left out so, and sets with too few
   parts in common with any others leave altogether.
3. Each group is joined by signature trees. A leaf holds a bitmap of one set's
   shingles, a node the OR of its children's bitmaps and their range of sizes.
   Pairs of nodes are taken down together and dropped as soon as their common
   bits or their sizes rule out the overlap a link needs. What arrives at the
   leaves is compared exactly. Large groups are cut by size and hash into
   chunks, and each pair of chunks whose sizes fit is a task of its own.

All links between different sets are found; components need no more than one
chain of links, so pairs already connected within a task are skipped.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window, functions as F

from nodeglass.llm import words
from nodeglass.llm.graph import components
from nodeglass.llm.tables import map_batches, release, stage, table
from nodeglass.operators.skew import checked_broadcast

SAMPLE_DOCUMENTS = 2048  # from which very common shingles are learned
COMMON_IN = 3  # different sample sets that hold a common shingle, at least
CELL_GROWTH = 1.5  # sizes that share a number of parts
CHUNK_SHINGLES = 2_000_000
CHUNK_SETS = 4000
BIN_SHINGLES = 500_000  # of the chunk pairs that one call joins, about
PAIRS_AT_ONCE = 50_000  # node pairs
PART_ROWS = 200_000  # rows of parts that a task hands on at once
BAND_GROWTH = 1.25  # sizes of a band of chunks
FANOUT = 4
PARTS = "key long, id long, own long, others array<struct<id: long, own: long>>"
ROOM = (1 << 32) - 1  # mask of the parts to spare in ``own``, beside the band
FEWER = 0.9  # share of rows left by a round that makes another one worth while


class Parts:
    """Into how many parts sets are cut, by size."""

    def __init__(self, percent):
        self.percent = percent
        self.bounds = [1, 2]

    def _bound(self, k):
        while len(self.bounds) <= k:
            s = self.bounds[-1]
            self.bounds.append(max(s + 1, -(-s * 100 // self.percent), int(s * CELL_GROWTH)))
        return self.bounds[k]

    def bands(self, n):
        """(band, parts, empty parts allowed) for a set of ``n`` shingles.

        Sizes fall into cells; band k is for pairs of which the smaller set lies
        in cell k and the other there or in the next cell.
        """
        k = 0
        while self._bound(k + 1) <= n:
            k += 1
        lower = k > 0 and -(-n * self.percent // 100) < self._bound(k)
        for band in [k - 1] * lower + [k]:
            end = self._bound(band + 1)
            both = max(2 * (end - 1), (end - 1) + (end - 1) * 100 // self.percent)
            need = both * (100 - self.percent) // (100 + self.percent) + 1
            spare = math.ceil(1.5 * need * math.exp(-self._bound(band) / need)) + 1 if need > 1 else 0
            yield band, need + spare, spare

    def differ(self, n, band):
        """In how many shingles a set of ``n`` differs from one it links with in ``band``, at most."""
        other, end = n * 100 // self.percent, self._bound(band + 1)
        if n >= end:  # the other one is the smaller
            other = min(other, end - 1)
        return (n + other) * (100 - self.percent) // (100 + self.percent)


def banded_keys(shingles, n, parts):
    """(band, room, keys of the parts) of a set (ascending ``shingles``, of ``n`` in all).

    With a set that links in the band it has more than ``room`` keys in common. So if
    every set leaves out ``room`` keys, by the same order of all keys, the first key
    in that order that two linking sets share stays in both.
    """
    for band, count, spare in parts.bands(n):
        place = ((shingles >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        begin = np.flatnonzero(np.diff(place, prepend=np.uint64(count)))
        name = np.uint64((band << 40) + (count << 20))
        out, filled = [], len(begin)
        if len(begin):
            sums = np.add.reduceat(words.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), begin)
            out.append(words.mix(sums + words.mix(place[begin] + name)))
        if count - len(begin) > spare:
            empty = np.setdiff1d(np.arange(count, dtype=np.uint64), place[begin])
            out.append(words.mix(words.mix(empty + name)))
            filled = count - spare  # a set without keys of empty parts has so many at least
        yield band, filled - parts.differ(n, band) - 1, np.concatenate(out).view(np.int64)


def part_keys(shingles, n, parts):
    """Keys of the parts of a set (ascending ``shingles``, of ``n`` in all)."""
    return np.concatenate([keys for _, _, keys in banded_keys(shingles, n, parts)])


def _keyed(docs, key, text):
    """Rows named by id and a hash of their text, as ids may be shared."""
    return docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))


def common_shingles(docs, shingle):
    """Hashes of shingles in at least ``COMMON_IN`` different sets of a sample.

    The sample has about ``SAMPLE_DOCUMENTS`` documents, drawn by the hash of
    their ids, whatever the number of documents is; that bounds the list.
    """
    total = docs.count()
    drawn = docs.where(F.pmod(F.xxhash64("id"), F.lit(max(1, total))) < SAMPLE_DOCUMENTS)

    def sets(batches):
        for batch in batches:
            found = [(words.set_key(s)[0], s) for s in words.shingle_sets(batch["text"], shingle) if len(s)]
            hashes = np.concatenate([s for _, s in found] or [np.zeros(0, np.uint64)]).view(np.int64)
            of = np.repeat([k for k, _ in found], [len(s) for _, s in found]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(of)], names=["hash", "of"])

    listed = map_batches(drawn, sets, "hash long, of long").distinct().groupBy("hash").count()
    rows = listed.where(F.col("count") >= COMMON_IN).select("hash").toPandas()
    return np.sort(rows["hash"].to_numpy(np.int64).view(np.uint64))


def sets_of(docs, shingle):
    """(id, h, n, k1, k2): size and 128-bit name of each document's set."""

    def name(batches):
        for batch in batches:
            sets = [(len(s), *words.set_key(s)) for s in words.shingle_sets(batch["text"], shingle)]
            columns = zip(*sets) if sets else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["h"], *(pa.array(c, pa.int64()) for c in columns)], names=["id", "h", "n", "k1", "k2"])

    return map_batches(docs, name, "id long, h long, n long, k1 long, k2 long")


def _met(keys, ids, owns):
    """Arrow rows of ``PARTS``: each key once, with the first id that has it and the others."""
    order = np.lexsort((ids, keys))
    keys, ids, owns = keys[order], ids[order], owns[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    more = np.diff(np.append(np.flatnonzero(new), len(keys))) - 1
    places = pa.array(np.concatenate(([0], np.cumsum(more))), pa.int32())
    rest = pa.StructArray.from_arrays([pa.array(ids[~new]), pa.array(owns[~new])], names=["id", "own"])
    others = pa.ListArray.from_arrays(places, rest, mask=pa.array(more == 0))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[new]), pa.array(ids[new]), pa.array(owns[new]), others], names=["key", "id", "own", "others"])


def part_table(docs, shingle, percent, common):
    """Classes under each of their parts, as ``PARTS`` rows; a task tells a class once.

    ``own`` has the band and the class's parts to spare there. What a task holds is
    joined before it moves, so a part that a third of all classes have comes to the
    shuffle once per call, not per class.
    """

    def rows(keys, of, owns):
        return _met(np.concatenate(keys), np.concatenate(of), np.concatenate(owns))

    def cut(batches):
        parts, seen = Parts(percent), set()
        frequent = common.value
        for batch in batches:
            keys, of, owns, many = [], [], [], 0
            for s in words.shingle_sets(batch["text"], shingle):
                if many >= PART_ROWS:
                    yield rows(keys, of, owns)
                    keys, of, owns, many = [], [], [], 0
                k1 = int(words.set_key(s)[0]) if len(s) else None
                if k1 is None or k1 in seen:
                    continue
                seen.add(k1)
                rare = s
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    rare = s[frequent[at] != s]
                for band, room, found in banded_keys(rare, len(s), parts):
                    keys.append(found)
                    of.append(np.full(len(found), k1))
                    owns.append(np.full(len(found), (band << 32) + room))
                    many += len(found)
            if keys:
                yield rows(keys, of, owns)

    return map_batches(docs, cut, PARTS)


def shared_parts(parts):
    """(key, id, own, many) of ``PARTS`` rows whose key two classes or more have.

    ``many`` orders the keys by the rows they have.
    """
    of_key = Window.partitionBy("key")
    counted = parts.select(
        "*", F.sum(F.lit(1) + F.coalesce(F.array_size("others"), F.lit(0))).over(of_key).alias("many"),
        (F.min("id").over(of_key) < F.max("id").over(of_key)).alias("met"))
    holders = F.concat(F.array(F.struct("id", "own")), F.coalesce("others", F.array().cast("array<struct<id: long, own: long>>")))
    return counted.where("met OR others IS NOT NULL").select("key", "many", F.inline(holders)).select("key", "id", "own", "many")


def part_edges(parts):
    """Edges (a, b) that connect all classes that may link, from ``PARTS`` rows.

    A class leaves out the parts it can spare, in each band those that most classes
    have. One that has no other part in common with any class links with none there
    and goes; then the parts of those that stay are counted anew, while that ends more.
    """
    rows = stage(shared_parts(parts), "shared-parts")
    release(rows.sparkSession)
    rows, before = rows.repartition("id").distinct(), None
    room = F.col("own").bitwiseAND(F.lit(ROOM))
    own = Window.partitionBy("id", "own")
    while True:
        ranked = rows.select(
            "key", "id", "own", F.row_number().over(own.orderBy(F.desc("many"), F.desc("key"))).alias("rank"),
            F.count(F.lit(1)).over(own).alias("all"))
        held = stage(ranked.where(F.col("all") > room), "parts-to-meet")
        left = held.count()
        if before is not None and left >= FEWER * before:
            break
        before = left
        counts = held.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
        rows = held.select("key", "id", "own").join(counts, "key")
    kept = held.where(F.col("rank") > room).select("key", "id")
    least = kept.groupBy("key").agg(F.min("id").alias("b"))
    return kept.join(least, "key").select(F.col("id").alias("a"), "b").where("a <> b").distinct()


class Tree:
    """Signature tree over sets in a given order; level 0 is the leaves."""

    def __init__(self, sets, bits):
        sizes = np.array([len(s) for s in sets], np.int64)
        row = np.repeat(np.arange(len(sets)), sizes)
        bit = np.concatenate(sets) >> np.uint64(64 - bits.bit_length() + 1)
        marks = np.zeros((len(sets), bits), bool)
        marks[row, bit.astype(np.int64)] = True
        maps = np.packbits(marks, axis=1).view(np.uint64)
        # Tokens of a set beyond its bits, as some share a bit.
        extra = sizes - np.bitwise_count(maps).sum(axis=1)
        self.levels = [(maps, sizes, sizes, extra)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, extra = self.levels[-1]
            begin = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, begin), np.minimum.reduceat(low, begin),
                                np.maximum.reduceat(high, begin), np.maximum.reduceat(extra, begin)))


def _survivors(one, two, a, b, percent, step=20_000):
    """Which node pairs (a of level ``one``, b of level ``two``) may hold a link."""
    keep = np.zeros(len(a), bool)
    for at in range(0, len(a), step):
        i, j = a[at:at + step], b[at:at + step]
        fits = (100 * one[2][i] >= percent * two[1][j]) & (100 * two[2][j] >= percent * one[1][i])
        k = np.flatnonzero(fits)
        i, j = i[k], j[k]
        common = np.bitwise_count(one[0][i] & two[0][j]).sum(axis=1, dtype=np.int64)
        most = np.minimum(common + np.minimum(one[3][i], two[3][j]), np.minimum(one[2][i], two[2][j]))
        keep[at + k] = (100 + percent) * most >= percent * (one[1][i] + two[1][j])
    return keep


def candidate_pairs(one, two, percent):
    """Leaf pairs left by taking the node pairs of two trees down together.

    They come in several arrays; pairs are taken down in runs of ``PAIRS_AT_ONCE``,
    so memory follows the depth of the trees. With ``two is one`` each unordered
    pair comes once.
    """
    level = lambda tree, k: tree.levels[min(k, len(tree.levels) - 1)]
    root = np.zeros(1, np.int64)
    stack = [(max(len(one.levels), len(two.levels)) - 1, root, root)]
    while stack:
        k, a, b = stack.pop()
        if len(a) > PAIRS_AT_ONCE:
            half = len(a) // 2
            stack += [(k, a[half:], b[half:]), (k, a[:half], b[:half])]
            continue
        keep = _survivors(level(one, k), level(two, k), a, b, percent)
        a, b = a[keep], b[keep]
        if k and len(a):
            child, whose = _children(a, one, k - 1)
            a, b = child, b[whose]
            child, whose = _children(b, two, k - 1)
            a, b = a[whose], child
            if two is one:
                a, b = a[a <= b], b[a <= b]
            stack.append((k - 1, a, b))
        elif len(a):
            yield (a[a < b], b[a < b]) if two is one else (a, b)


def _children(nodes, tree, k):
    """Children at level k of ``nodes`` one level up, and whose child each is."""
    if k >= len(tree.levels) - 1:  # the root of a lower tree stays
        return nodes, np.arange(len(nodes))
    child = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    whose = np.repeat(np.arange(len(nodes)), FANOUT)
    real = child < len(tree.levels[k][1])
    return child[real], whose[real]


class Links:
    """Sets connected so far; equal roots mean connected."""

    def __init__(self, n):
        self.up = list(range(n))

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def tree_links(sets, side, percent):
    """Links (i, j) that connect the sets as all links would.

    ``side``: None to join all sets with each other, else an array of 0 and 1 to
    join those of either side with the other's only.
    """
    sizes = np.array([len(s) for s in sets])
    bits = 1 << int(np.clip(np.ceil(np.log2(np.median(sizes) * 8)), 6, 15))
    order = np.array(sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i][0])))
    if side is None:
        tree = Tree([sets[i] for i in order], bits)
        left = right = order
        pairs = candidate_pairs(tree, tree, percent)
    else:
        left, right = order[side[order] == 0], order[side[order] == 1]
        if not len(left) or not len(right):
            return []
        pairs = candidate_pairs(Tree([sets[i] for i in left], bits), Tree([sets[i] for i in right], bits), percent)
    links, out = Links(len(sets)), []
    for i, j in ((i, j) for a, b in pairs for i, j in zip(left[a].tolist(), right[b].tolist())):
        if links.root(i) != links.root(j):
            x, y = sets[i], sets[j]
            common = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
            if 100 * common >= percent * (len(x) + len(y) - common) and links.join(i, j):
                out.append((i, j))
    return out


def _chunked(members):
    """``members`` with _chunk: 0 in groups that make one task, else by size band
    and, within a band, by hash into as many chunks as its weight needs."""
    bands = members.groupBy("_group", "_band").agg(F.sum("n").alias("_weight"), F.count(F.lit(1)).alias("_sets"))
    whole = bands.groupBy("_group").agg(
        ((F.sum("_weight") <= CHUNK_SHINGLES) & (F.sum("_sets") <= CHUNK_SETS)).alias("_whole"))
    slots = F.greatest(F.ceil(F.col("_weight") / CHUNK_SHINGLES), F.ceil(F.col("_sets") / CHUNK_SETS))
    bands = bands.join(whole, "_group").select("_group", "_band", "_whole", slots.alias("_slots"))
    slot = (F.col("_band") + 1) * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("_slots"))
    return members.join(bands, ["_group", "_band"]).select(
        "_group", "id", "n", "rep", F.when(F.col("_whole"), F.lit(0)).otherwise(slot).cast("long").alias("_chunk"))


def set_links(classes, docs, groups, shingle, percent):
    """Links (a, b) between classes in one group, by their k1.

    The text of a class is that of its representative, by id and hash.
    """
    members = stage(classes.join(groups, classes["k1"] == groups["id"]).select(
        F.col("component").alias("_group"), F.col("k1").alias("id"), "n", "rep",
        F.floor(F.log("n") / math.log(BAND_GROWTH)).alias("_band")), "sets-in-groups")
    members = stage(_chunked(members), "sets-in-chunks")
    chunks = members.groupBy("_group", "_chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    fits = F.col("y.low") * percent <= F.col("x.high") * 100
    units = chunks.alias("x").join(
        chunks.alias("y"), (F.col("x._group") == F.col("y._group")) & (F.col("x._chunk") <= F.col("y._chunk")) & fits
    ).select(F.col("x._group").alias("_group"), F.col("x._chunk").alias("_one"), F.col("y._chunk").alias("_two"))
    tasks = units.select("_group", "_one", "_two", F.explode(F.array_distinct(F.array("_one", "_two"))).alias("_chunk"))
    placed = members.drop("rep").join(tasks, ["_group", "_chunk"])
    bins = max(1, math.ceil((placed.agg(F.sum("n")).first()[0] or 0) / BIN_SHINGLES))
    wanted = checked_broadcast(stage(members.select(F.col("rep.id").alias("_doc"), F.col("rep.h").alias("_h"), F.col("id").alias("_class")).distinct(), "wanted"))
    texts = docs.join(wanted, F.col("id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h")))
    texts = stage(texts.select(F.col("_class").alias("id"), "text").dropDuplicates(["id"]), "texts-in-groups")
    release(docs.sparkSession)
    rows = placed.join(texts, "id").withColumn(
        "_bin", F.pmod(F.xxhash64("_group", "_one", "_two"), F.lit(bins)))

    def join(rows):
        found = []
        for (_, one, two), unit in rows.sort_values(["_group", "_one", "_two", "id"]).groupby(["_group", "_one", "_two"]):
            if len(unit) < 2:
                continue
            sets = list(words.shingle_sets(pa.array(unit["text"], pa.string()), shingle))
            ids = unit["id"].to_numpy()
            side = None if one == two else (unit["_chunk"].to_numpy() == two).astype(int)
            found += [(ids[i], ids[j]) for i, j in tree_links(sets, side, percent)]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    columns = ["_bin", "_group", "_one", "_two", "_chunk", "id", "text"]
    return rows.select(*columns).groupBy("_bin").applyInPandas(join, "a long, b long")


def jaccard_firsts(docs, key="doc_id", text="text", shingle=5, percent=80):
    """(id, h, n_shingles, first) for each row of ``docs``; h: xxhash64 of the text.

    ``first`` has the id and h of the first row of the component, by id, then h;
    ids that are null come last. It is null for rows without words. Rows that
    share an id are linked by their texts alone.
    """
    docs = _keyed(docs, key, text)
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(common_shingles(docs, shingle))
    sets = stage(sets_of(docs, shingle), "sets")
    own, least = F.struct("id", "h"), lambda x, has: F.coalesce(F.min(F.when(has, x)), F.min(x))
    classes = stage(sets.where("n > 0").groupBy("k1", "k2", "n").agg(least(own, F.col("id").isNotNull()).alias("rep")), "set-classes")
    together = part_edges(part_table(docs, shingle, percent, common))
    groups = stage(components(together, "set-groups"), "set-groups")
    links = components(set_links(classes, docs, groups, shingle, percent), "set-links")
    named = stage(classes.join(links, classes["k1"] == links["id"], "left").select(
        "k1", "k2", "n", "rep", F.coalesce("component", "k1").alias("component")), "set-components")
    release(spark)
    firsts = named.groupBy("component").agg(least(F.col("rep"), F.col("rep.id").isNotNull()).alias("first"))
    return sets.join(named.join(firsts, "component").drop("rep", "component"), ["k1", "k2", "n"], "left").select(
        "id", "h", F.col("n").alias("n_shingles"), "first")


def jaccard_components(docs, key="doc_id", text="text", shingle=5, percent=80):
    """(id, n_shingles, component_id) for each row of ``docs``.

    Two rows link when 100 * |intersection| >= percent * |union| of their sets
    of distinct ``shingle``-word runs; a text with fewer words has its whole
    sequence as its only shingle. Null texts and texts without words have an
    empty set and link with nothing. The component is named by the smallest key
    that links reach. Repeated rows come out as often as they came in. Keys are
    whole numbers; rows with a null key have a null component unless they link
    with others. Other columns of ``docs`` do not matter.
    """
    return jaccard_firsts(docs, key, text, shingle, percent).select("id", "n_shingles", F.coalesce("first.id", "id").alias("component_id"))


def op7_jaccard_join(spark, sf_dir):
    """Shingles and component of every document: 3 words, Jaccard 0.9 or more."""
    found = jaccard_components(table(spark, sf_dir, "documents"), shingle=3, percent=90)
    return found.withColumnRenamed("id", "doc_id")


OP7_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), places AS (
  SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, CASE WHEN len(words) > 0 THEN 2 ELSE 1 END))) AS i FROM texts
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS shingle FROM places
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= 90 * (p.n + q.n - shared)
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id
FROM documents d JOIN reached r ON r.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
