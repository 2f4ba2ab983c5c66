"""Op 11: Merkle manifest of a dataset, with levels kept as concatenated strings.

Every row is a leaf. The leaves of a group (a language) in key order are cut
into aligned blocks of ``FANOUT ** BLOCK_LEVELS``. A block keeps each of its
levels as one string of 64-digit digests, so a parent is the hash of a
fixed-width substring, and a node's siblings are the substrings on either side
of it. The roots of the blocks are the leaves of the next round, until a group
has one node left, its subroot; the subroots are the leaves of a last tree.
Proofs are made on the way down, block by block. A task holds one block.

Odd rows: a null field counts as ``-``; rows with null keys come first, equal
keys follow each other by leaf; a null group is a group of its own and the
first; repeated rows are leaves like all others; an empty table has no rows,
and columns besides the named ones are passed by.
"""

from pyspark.sql import functions as F

from nodeglass.llm.tables import stage, table
from nodeglass.operators.numbering import number_rows
from nodeglass.operators.skew import checked_broadcast

FANOUT = 8
BLOCK_LEVELS = 4
DIGEST = 64  # hex digits
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(fields):
    """Digest of a row: each field as byte count, colon and value, or ``-``."""
    def said(column):
        text = column.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(said, fields)), 256)


def _hash(content):
    return F.sha2(content, 256).cast("binary")


def _cut(content, first, length):
    """``length`` bytes from place ``first`` on (from 0), or as many as there are."""
    return F.substring(content, first.cast("int") + 1, length.cast("int"))


def _parents(level):
    """The level above: one digest for every ``FANOUT`` of the string."""
    run = FANOUT * DIGEST
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / run).cast("int"))
    return F.concat_ws("", F.transform(runs, lambda r: F.sha2(_cut(level, r * run, F.lit(run)), 256))).cast("binary")


def _flanks(levels, at, depth):
    """Siblings of the node at place ``at`` of a block on each of its levels."""
    def beside(level):
        node = F.floor(at / F.pow(F.lit(FANOUT), level)).cast("int")
        inside = F.pmod(node, F.lit(FANOUT))
        content = F.get(levels, level)
        return F.struct(
            _cut(content, (node - inside) * DIGEST, inside * DIGEST).alias("left"),
            _cut(content, (node + 1) * DIGEST, (FANOUT - 1 - inside) * DIGEST).alias("right"))

    numbers = F.when(depth > 0, F.sequence(F.lit(0), depth - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, beside)


def fold(node, path):
    """The root that ``node`` and its siblings, level by level, lead to."""
    return F.aggregate(path, node, lambda low, side: _hash(F.concat(side["left"], low, side["right"])))


def proof(path):
    """All siblings of a path as one string."""
    return F.aggregate(path, F.lit(b""), lambda all_, side: F.concat(all_, side["left"], side["right"]))


def blocks(nodes, levels=BLOCK_LEVELS, keep=()):
    """One row per aligned block of nodes (grp, pos, n: nodes in the group, node).

    Its columns: grp, block, n, depth (levels above its nodes), levels (one
    string each, the nodes first) and, with ``keep``, kept (those columns of
    each node in order). A group takes no more levels than it needs to come
    down to one node.
    """
    size = FANOUT ** levels
    whole = nodes.groupBy("grp", F.expr(f"pos div {size}").alias("block")).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "node", *keep))).alias("nodes"))
    depth = sum(((F.col("n") > FANOUT ** i).cast("int") for i in range(levels)), F.lit(0))
    lowest = F.concat_ws("", F.transform("nodes", lambda x: x["node"].cast("string"))).cast("binary")
    whole = whole.withColumns({"depth": depth, "lowest": lowest})
    above = F.when(F.col("depth") > 0, F.sequence(F.lit(1), "depth")).otherwise(F.array().cast("array<int>"))
    levels = F.aggregate(above, F.array("lowest"), lambda all_, _: F.array_append(all_, _parents(F.element_at(all_, -1))))
    kept = [F.transform("nodes", lambda x: F.struct(*(x[c].alias(c) for c in keep))).alias("kept")] if keep else []
    return whole.select("grp", "block", "n", "depth", levels.alias("levels"), *kept)


def climb(nodes, levels=BLOCK_LEVELS, keep=()):
    """All rounds of blocks from ``nodes`` up, and the last nodes (grp, pos, n, node)."""
    rounds, size = [], FANOUT ** levels
    while True:
        rounds.append(stage(blocks(nodes, levels, keep), "blocks"))
        keep = ()
        nodes = rounds[-1].select(
            "grp", F.col("block").alias("pos"), F.expr(f"(n + {size - 1}) div {size}").alias("n"),
            F.element_at("levels", -1).alias("node"))
        if nodes.where("n > 1").isEmpty():
            return rounds, nodes


def _down(rounds, paths, levels, also=()):
    """Paths of the lowest blocks, from those of the topmost nodes (grp, pos, path)."""
    for whole in reversed(rounds[1:]):
        members = F.sequence(F.lit(0), (F.length(F.get("levels", F.lit(0))) / DIGEST).cast("int") - 1)
        here = whole.withColumnRenamed("block", "pos").join(paths, ["grp", "pos"])
        paths = here.select("grp", "pos", "levels", "depth", "path", *also, F.explode(members).alias("at")).select(
            "grp", _place("pos", "at", levels).alias("pos"),
            F.concat(_flanks(F.col("levels"), F.col("at"), F.col("depth")), "path").alias("path"), *also)
    return paths


def _place(block, at, levels):
    return F.col(block) * FANOUT ** levels + F.col(at)


def manifest(leaves, key, group, levels=BLOCK_LEVELS):
    """Leaves with their path to the root of the whole dataset.

    ``leaves`` has ``key``, ``group``, ``leaf`` and ``altered`` (a digest to fold
    in place of the leaf, or null). Returns key, leaf, subroot, root,
    proof_sha256, folded_root and verified, one row per leaf.
    """
    light = stage(leaves.select(F.col(key).alias("key"), F.col(group).alias("grp_name"), "leaf", "altered"), "leaves")
    placed = stage(number_rows(light, "place", order_by=["grp_name", "key", "leaf"], stage=lambda df: stage(df, "placed")), "numbered")
    groups = placed.groupBy("grp_name").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = stage(number_rows(groups, "grp", order_by=["first"], stage=lambda df: stage(df, "groups")), "groups")
    nodes = placed.join(checked_broadcast(groups).withColumnRenamed("grp_name", "name"), F.col("grp_name").eqNullSafe(F.col("name"))).select(
        "grp", (F.col("place") - F.col("first")).alias("pos"), "n", F.col("leaf").cast("binary").alias("node"), "key", "altered")
    rounds, subroots = climb(nodes, levels, keep=("key", "altered"))
    tops = subroots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), F.lit(groups.count()).cast("long").alias("n"), "node")
    upper, roots = climb(stage(tops, "subroots"), levels)
    root = roots.select("node").first()
    start = roots.select("grp", "pos", F.array().cast("array<struct<left:binary,right:binary>>").alias("path"))
    in_lowest = upper[0].withColumnRenamed("block", "pos").join(_down(upper, start, levels), ["grp", "pos"])
    each = F.sequence(F.lit(0), (F.length(F.get("levels", F.lit(0))) / DIGEST).cast("int") - 1)
    of_groups = in_lowest.select("pos", "levels", "depth", "path", F.explode(each).alias("at")).select(
        _place("pos", "at", levels).alias("grp"), F.lit(0).cast("long").alias("pos"),
        _cut(F.get("levels", F.lit(0)), F.col("at") * DIGEST, F.lit(DIGEST)).alias("subroot"),
        F.concat(_flanks(F.col("levels"), F.col("at"), F.col("depth")), "path").alias("path"))
    whole = rounds[0].withColumnRenamed("block", "pos").join(_down(rounds, stage(of_groups, "paths"), levels, ("subroot",)), ["grp", "pos"])

    def row(kept, at):
        leaf = _cut(F.get("levels", F.lit(0)), at * DIGEST, F.lit(DIGEST))
        return F.struct(
            kept["key"].alias("key"), leaf.cast("string").alias("leaf"), kept["altered"].cast("binary").alias("altered"),
            F.concat(_flanks(F.col("levels"), at, F.col("depth")), "path").alias("path"))

    each = whole.select("subroot", F.inline(F.transform("kept", row)))
    return each.select(
        F.col("key").alias(key), "leaf", F.col("subroot").cast("string").alias("subroot"),
        F.lit(root["node"].decode() if root else None).cast("string").alias("root"),
        F.sha2(proof("path"), 256).alias("proof_sha256"),
        fold(F.coalesce("altered", F.col("leaf").cast("binary")), "path").cast("string").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_dataset_manifest(spark, sf_dir):
    """Manifest of all documents by language, and the audit of a copy in which
    the texts of a third of them were lower-cased."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    altered = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return manifest(docs.select(
        "doc_id", "lang", leaf_digest([F.col(c) for c in FIELDS]).alias("leaf"),
        F.when(hit, leaf_digest(altered)).alias("altered")), "doc_id", "lang")


def crc32_sql(text):
    """DuckDB: unsigned crc32 of a short ASCII text, bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return (f"xor(list_reduce(list_concat([4294967295], {steps}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) "
            "ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)")


def _tree_sql(name, start, levels):
    """CTEs of all levels above ``start`` (g, p, h, c: nodes in the group) and each node's siblings."""
    parts = [f"{name}0 AS ({start})"]
    for i in range(levels):
        parts.append(f"""{name}{i + 1} AS (
  SELECT g, p // {FANOUT} AS p, CASE WHEN any_value(c) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h,
    (any_value(c) + {FANOUT - 1}) // {FANOUT} AS c
  FROM {name}{i} GROUP BY g, p // {FANOUT})""")
        side = f"string_agg(h, '') OVER (PARTITION BY g, p // {FANOUT} ORDER BY p ROWS BETWEEN"
        parts.append(f"""{name}{i}_sides AS (
  SELECT g, p, c > 1 AS open, coalesce({side} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce({side} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{i})""")
    return ",\n".join(parts)


def _sql(levels=7, top_levels=3):
    def leaf(text):
        values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return "sha256(" + " || ".join(f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values) + ")"

    joins, sides = [], []
    for name, own, n in (("a", "p0", levels), ("b", "g", top_levels)):
        for i in range(n):
            group = "s.g = 0" if name == "b" else "s.g = f.g"
            joins.append(f"""f{len(joins) + 1} AS (
  SELECT f.* EXCLUDE (folded, proof), f.proof || CASE WHEN s.open THEN s.l || s.r ELSE '' END AS proof,
    CASE WHEN s.open THEN sha256(s.l || f.folded || s.r) ELSE f.folded END AS folded
  FROM f{len(joins)} f JOIN {name}{i}_sides s ON {group} AND s.p = f.{own} // {FANOUT ** i})""")
    return f"""
WITH leaves AS (
  SELECT doc_id, lang, {leaf('text')} AS leaf,
    CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS altered
  FROM documents
), placed AS (
  SELECT doc_id, leaf, altered, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p0,
    count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g
  FROM leaves
), {_tree_sql('a', 'SELECT g, p0 AS p, leaf AS h, n AS c FROM placed', levels)},
{_tree_sql('b', f'SELECT 0 AS g, g AS p, h, count(*) OVER () AS c FROM a{levels}', top_levels)},
f0 AS (SELECT *, coalesce(altered, leaf) AS folded, '' AS proof FROM placed),
{','.join(joins)}
SELECT f.doc_id, f.leaf, a.h AS subroot, b.h AS root, sha256(f.proof) AS proof_sha256, f.folded AS folded_root,
  f.folded = b.h AS verified
FROM f{len(joins)} f JOIN a{levels} a ON a.g = f.g CROSS JOIN b{top_levels} b
"""


OP11_SQL = _sql()
