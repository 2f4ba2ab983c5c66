"""Op 12: prefix trie of conversations by a skeleton of splitters.

A conversation is the sequence of its turns, each named by a 16-byte digest of
role and text, so that its path sorts as bytes and a node of the trie is a
prefix of whole digests. Conversations are dealt to shards by ranges of (path,
id). A node can have members in two shards only if it lies on the path of a
splitter between them. The trie of the splitters' paths, the skeleton, is
therefore broadcast; every shard finishes all other nodes alone in one sorted
walk, and of skeleton nodes it tells its partial counts, which a grouping adds
up before the skeleton itself is summed from its ends to the root.

Copies of one conversation are dealt by id, so a conversation that a third of
all rows repeat fills many shards. Splitters come from a bounded sample; the
result is the same whatever they are. The skeleton has at most
``SKELETON_BYTES`` of paths; where splitters would need more, fewer are taken.

Odd rows: turns with a null conversation are left out (they belong to none);
null roles and texts are empty; turns of equal number (null first) follow each
other by digest, and a repeated row is another turn; an empty table has no
nodes, and columns besides the four named ones are passed by.
"""

import hashlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import functions as F

from nodeglass.llm.dataset_manifest import crc32_sql
from nodeglass.llm.tables import map_batches, stage, table
from nodeglass.operators.numbering import number_rows

DIGEST = 16
SHARD_TURNS = 100_000
SAMPLE_PER_SHARD = 30
SKELETON_BYTES = 1 << 20
END_IDS = 50_000  # ids of ends that a row of a skeleton node holds
FAMILY = 5  # conversations that open with the turns of the first of them
OPENING = 9  # modulus of the number of turns they share

# Rows of the shards' walk. kind 0: a finished node; 1: a shard's part of a
# skeleton node; 2: ids that end in a skeleton node.
_WALK = ("kind int, skeleton int, conv_id long, parent_conv_id long, depth long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, ends string")
_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_lists(turns):
    """(conv_id, turns): digest and text bytes of each conversation's turns in order.

    ``turns`` has conv_id, turn, role and text. The digest is the first half of
    a SHA-256 of the role's length, the role and the text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    light = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return light.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "bytes"))).alias("turns"))


def with_shared_openings(lists):
    """Conversations whose first turns are those of the first of their family.

    Conversation c takes the first h turns of c - c % ``FAMILY`` (as many as it
    has) and its own turns after its first h; h is the crc32 of c modulo
    ``OPENING``. Families are groups of at most ``FAMILY`` conversations.
    """
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    family = lists.groupBy(first.alias("first")).agg(F.collect_list(F.struct("conv_id", "turns")).alias("family"))
    opener = F.get(F.filter("family", lambda x: x["conv_id"] == F.col("first")), F.lit(0))["turns"]
    one = family.select(F.coalesce(opener, F.expr("slice(family[0].turns, 1, 0)")).alias("opener"), F.inline("family"))
    shared = F.crc32(F.col("conv_id").cast("string")) % OPENING
    return one.select("conv_id", F.concat(
        F.slice("opener", F.lit(1), shared.cast("int")), F.slice("turns", shared.cast("int") + 1, F.size("turns"))).alias("turns"))


def paths(lists):
    """(conv_id, path, bytes): the digests as one byte string, and each text's size."""
    return lists.select(
        "conv_id", F.unhex(F.concat_ws("", F.transform("turns", lambda t: t["digest"]))).alias("path"),
        F.transform("turns", lambda t: t["bytes"]).alias("bytes"))


def splitters(rows, shards):
    """Keys (path, conv_id) that cut the sorted ``rows`` into about ``shards`` ranges.

    From a sample of ``SAMPLE_PER_SHARD`` rows per shard, drawn by hash; as many
    as there are within ``SKELETON_BYTES`` of paths.
    """
    n, span = rows.count(), 1_000_003
    share = min(span, -(-SAMPLE_PER_SHARD * shards * span // max(1, n)))
    drawn = rows.where(F.pmod(F.xxhash64("conv_id"), F.lit(span)) < share).select("path", "conv_id")
    drawn = stage(number_rows(drawn, "place", order_by=["path", "conv_id"], stage=lambda df: stage(df, "sample")), "sample")
    step = max(1, drawn.count() // shards)
    while True:
        chosen = drawn.where((F.col("place") > 0) & (F.col("place") % step == 0))
        if (chosen.agg(F.sum(F.length("path"))).first()[0] or 0) <= SKELETON_BYTES:
            return sorted((bytes(r["path"]), r["conv_id"]) for r in chosen.select("path", "conv_id").collect())
        step *= 2


class Skeleton:
    """The trie of splitter paths. Node 0 is the root; children follow parents."""

    def __init__(self, cuts):
        self.cuts, self.parents, self.depths, self.child = cuts, [-1], [0], {}
        for path, _ in cuts:
            at = 0
            for d in range(0, len(path), DIGEST):
                key = at, path[d:d + DIGEST]
                if key not in self.child:
                    self.child[key] = len(self.parents)
                    self.parents.append(at)
                    self.depths.append(self.depths[at] + 1)
                at = self.child[key]


class _Open:
    """A node on the path from the root to the conversation in hand."""

    __slots__ = ("skeleton", "least", "convs", "children", "leaves", "saved", "size", "ends", "below")

    def __init__(self, skeleton, size):
        self.skeleton, self.size, self.least = skeleton, size, None
        self.convs = self.children = self.leaves = self.saved = 0
        self.ends, self.below = None, []


class _Walk:
    """One sorted pass over the conversations of a shard."""

    def __init__(self, skeleton):
        self.skeleton, self.out = skeleton, []
        self.restart(None)

    def restart(self, shard):
        self.shard, self.path, self.stack = shard, b"", [_Open(0, 0)]

    def add(self, shard, path, conv, sizes):
        if shard != self.shard:
            self.finish()
            self.restart(shard)
        depth, most = 0, min(len(path), len(self.path))
        if path == self.path:
            depth = len(path) // DIGEST
        else:
            while (depth + 1) * DIGEST <= most and path[depth * DIGEST:(depth + 1) * DIGEST] == self.path[depth * DIGEST:(depth + 1) * DIGEST]:
                depth += 1
        self.close(depth)
        for d in range(depth, len(path) // DIGEST):
            above = self.stack[-1].skeleton
            own = -1 if above < 0 else self.skeleton.child.get((above, path[d * DIGEST:(d + 1) * DIGEST]), -1)
            self.stack.append(_Open(own, sizes[d]))
        self.path, node = path, self.stack[-1]
        if node.skeleton >= 0:
            node.ends = node.ends or []
            node.ends.append(str(conv))
            if len(node.ends) == END_IDS:
                self.tell_ends(node)
        elif node.ends is None:
            node.ends = hashlib.sha256(str(conv).encode())
        else:
            node.ends.update(f",{conv}".encode())
        node.convs += 1
        node.least = conv if node.least is None else min(node.least, conv)

    def tell_ends(self, node):
        if node.ends:
            self.out.append((2, node.skeleton, int(node.ends[0]), None, None, None, None, None, None, ",".join(node.ends)))
            node.ends = None

    def close(self, depth):
        """Finish all open nodes below ``depth``."""
        while len(self.stack) > depth + 1:
            node, above = self.stack.pop(), self.stack[-1]
            self.end(node, len(self.stack))
            if node.skeleton < 0:
                above.children += 1
                above.leaves += node.leaves
                above.saved += node.saved
                ends = (node.ends or hashlib.sha256()).hexdigest()
                above.below.append((node.least, len(self.stack), node.convs, node.children, node.leaves, node.saved, ends))
            above.convs += node.convs
            above.least = node.least if above.least is None else min(above.least, node.least)

    def end(self, node, depth):
        if node.skeleton >= 0:
            self.tell_ends(node)
            self.out.append((1, node.skeleton, node.least, None, node.size, node.convs, node.children, node.leaves, node.saved, None))
        else:
            node.leaves += not node.children
            node.saved += (node.convs - 1) * node.size
        parent = node.least if node.skeleton < 0 else None
        self.out += [(0, node.skeleton, least, parent, *rest) for least, *rest in node.below]

    def finish(self):
        if self.stack[0].convs or len(self.stack) > 1:
            self.close(0)
            self.end(self.stack[0], 0)

    def taken(self):
        rows, self.out = self.out, []
        return rows


def _sum_up(skeleton):
    """Function of the skeleton's combined parts: finished rows of its nodes."""
    def run(parts):
        nodes = {r["skeleton"]: r for r in parts.to_pylist()}
        children, leaves, saved = ([0] * len(skeleton.parents) for _ in range(3))
        rows = []
        for at in range(len(skeleton.parents) - 1, -1, -1):  # a child comes before its parent
            if at not in nodes:
                continue
            r, above = nodes[at], skeleton.parents[at]
            n = children[at] + r["n_children"]
            own_leaves = leaves[at] + r["n_leaves"] + (n == 0)
            own_saved = saved[at] + r["saved_tokens"] + (r["n_convs"] - 1) * r["size"]
            if above >= 0:
                children[above] += 1
                leaves[above] += own_leaves
                saved[above] += own_saved
            parent = nodes[above]["conv_id"] if above >= 0 else None
            rows.append((at, r["conv_id"], skeleton.depths[at], parent, r["n_convs"], n, own_leaves, own_saved))
        return pa.table({c: pa.array([r[i] for r in rows], pa.int32() if i == 0 else pa.int64())
                         for i, c in enumerate(["skeleton", *_NODE[:-1]])})

    return run


def _hash_ends(batches):
    """Streams (skeleton, ends) in order; one digest per skeleton node."""
    at, state = None, None
    for batch in batches:
        done = []
        for node, text in zip(batch["skeleton"].to_pylist(), batch["ends"].to_pylist()):
            if node != at:
                if state:
                    done.append((at, state.hexdigest()))
                at, state = node, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done])], ["skeleton", "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([state.hexdigest()])], ["skeleton", "ends_sha256"])


def prefix_trie(rows):
    """All nodes of the trie of ``rows`` (conv_id, path, bytes), one row each.

    ``ends_sha256`` hashes the ids that end in a node, ascending and joined by
    commas. That hash is sequential by nature: the ids of one node pass a single
    task, as a stream of joined texts of ``END_IDS`` ids.
    """
    rows = stage(rows, "paths")
    spark = rows.sparkSession
    turns = rows.agg(F.sum(F.size("bytes") + 1)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))
    skeleton = Skeleton(splitters(rows, shards))
    shared = spark.sparkContext.broadcast(skeleton)  # at most SKELETON_BYTES / DIGEST nodes

    def deal(batches):
        cuts = shared.value.cuts
        for batch in batches:
            keys = zip(batch["path"].to_pylist(), batch["conv_id"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([bisect_right(cuts, key) for key in keys], pa.int32())], [*batch.schema.names, "shard"])

    def walk(batches):
        state, kinds = _Walk(shared.value), pa.schema([
            ("kind", pa.int32()), ("skeleton", pa.int32()), *((c, pa.int64()) for c in (
                "conv_id", "parent_conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends", pa.string())])

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds.types)], schema=kinds)

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("shard", "path", "conv_id", "bytes"))):
                state.add(*row)
            if len(state.out) > 10_000:
                yield batch_of(state.taken())
        state.finish()
        if state.out:
            yield batch_of(state.taken())

    dealt = map_batches(rows, deal, "conv_id long, path binary, bytes array<long>, shard int")
    dealt = dealt.repartition(len(skeleton.cuts) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")
    found = stage(map_batches(dealt, walk, _WALK), "walk")

    parts = found.where("kind = 1").groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("size"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    # One row per skeleton node, so the one group is as bounded as the skeleton.
    top = parts.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_sum_up(skeleton), ", ".join(["skeleton int", *(f"{c} long" for c in _NODE[:-1])]))
    top = stage(top, "skeleton")
    ends = found.where("kind = 2").select("skeleton", "conv_id", "ends").repartition("skeleton").sortWithinPartitions("skeleton", "conv_id")
    ends = map_batches(ends.select("skeleton", "ends"), _hash_ends, "skeleton int, ends_sha256 string")
    nothing = F.lit(hashlib.sha256().hexdigest())
    finished = top.join(ends, "skeleton", "left").select(*_NODE[:-1], F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    over = F.broadcast(top.select("skeleton", F.col("conv_id").alias("above")))
    alone = found.where("kind = 0").join(over, "skeleton", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"),
        *_NODE[3:-1], F.col("ends").alias("ends_sha256"))
    return finished.unionByName(alone)


def op12_prefix_trie(spark, sf_dir):
    """Trie of all conversations, families sharing their openings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(paths(with_shared_openings(turn_lists(turns))))


OP12_SQL = f"""
WITH own AS (
  SELECT conv_id, list({{'d': digest, 'b': bytes}} ORDER BY turn NULLS FIRST, digest) AS turns
  FROM (SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes,
      substr(sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')), 1, {2 * DIGEST}) AS digest
    FROM conversations WHERE conv_id IS NOT NULL)
  GROUP BY conv_id
), shared AS (
  SELECT *, {crc32_sql('CAST(conv_id AS VARCHAR)')} % {OPENING} AS h FROM own
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(f.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM shared c LEFT JOIN own f ON f.conv_id = c.conv_id - c.conv_id % {FAMILY}
), seqs AS (
  SELECT conv_id, list_transform(turns, lambda t: t.d) AS ds, list_transform(turns, lambda t: t.b) AS bs, len(turns) AS n FROM rebuilt
), members AS (
  SELECT conv_id, n, k AS depth, array_to_string(ds[1:k], '') AS node, CASE WHEN k > 0 THEN array_to_string(ds[1:k - 1], '') END AS above,
    CASE WHEN k > 0 THEN bs[k] ELSE 0 END AS size
  FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM seqs)
), nodes AS (
  SELECT node, any_value(above) AS above, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM members GROUP BY node, depth
), children AS (
  SELECT above AS node, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above
), counted AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (node)
), under AS (
  SELECT substr(node, 1, k * {2 * DIGEST}) AS node, n_children = 0 AS leaf, (n_convs - 1) * size AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM counted)
), sums AS (
  SELECT node, CAST(sum(CAST(leaf AS INT)) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM under GROUP BY node
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
FROM counted c JOIN sums s USING (node) LEFT JOIN nodes p ON p.node = c.above
"""
