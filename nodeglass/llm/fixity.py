"""Op 4: WARC fixity audit with Merkle trees.

Pages become WARC response records, which lie one after the other, by key, in
archives of ``ARCHIVE_KEYS`` keys, each at a byte offset. The records of a key
are a leaf. A node of the tree stands for an aligned range of keys, ``FANOUT``
times that of its children, and its digest covers theirs in order: a record that
is lost or added elsewhere moves neither a leaf nor a node. The root stands for
the whole replica. Two replicas are audited from their roots down; only nodes
whose digests differ are opened, and the records of the leaves reached are
compared. Offsets are no part of a digest: where they alone differ, the records
have moved, which is told by ranges.

A subtree of ``ARCHIVE_KEYS`` keys is one row, with its inner nodes nested, so
that building it takes one shuffle and opening it none; the roots of subtrees are
the leaves of the trees above.

Odd rows: null urls and payloads are empty; records without a key are one leaf
before all others; equal records follow each other and are one row with their
number of copies, and the records of one key are combined whatever their number;
an empty replica has no nodes. Columns besides the named ones are passed by.
"""

from pyspark.sql import Window, functions as F

from nodeglass.llm.tables import stage, table
from nodeglass.operators.running import running_totals

FANOUT_BITS = 4
FANOUT = 1 << FANOUT_BITS
SUBTREE_BITS = 3 * FANOUT_BITS
ARCHIVE_KEYS = 1 << SUBTREE_BITS  # so an archive is a whole subtree
MOST_ROUNDS = -(-64 // SUBTREE_BITS)
NO_KEY = -(1 << 63)
FAULT_EVERY = 97  # keys from one fault of a kind in the query's second copy to the next


def warc_record(url, payload):
    """A WARC/1.1 response record as bytes; null url or payload count as empty."""
    body = F.encode(F.coalesce(payload, F.lit("")), "utf-8")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "utf-8"), body, F.encode(F.lit("\r\n\r\n"), "utf-8"))


def manifest(pages, key="page_id", url="url", payload="html", record=None):
    """One row per record: key, archive, offset, length, copies, digest.

    ``record``: a column of record bytes in place of the one made from url and
    payload. Records are ordered by key, then digest. Only keys, lengths and
    digests are shuffled, never the payloads, and offsets are running totals, so
    no task holds an archive.
    """
    content = warc_record(F.col(url), F.col(payload)) if record is None else record
    light = pages.select(F.col(key).cast("long").alias("key"), content.alias("_bytes")).select(
        "key", F.length("_bytes").cast("long").alias("length"), F.sha2("_bytes", 256).alias("digest"))
    records = light.groupBy("key", "length", "digest").agg(F.count(F.lit(1)).alias("copies")).withColumns({
        "archive": F.shiftright(_slot(), SUBTREE_BITS), "_size": F.col("length") * F.col("copies")})
    laid = running_totals(records, ["key", "digest", "length"], {"_end": "_size"}, stage=lambda df: stage(df, "records"))
    begin = laid.groupBy("archive").agg(F.min(F.col("_end") - F.col("_size")).alias("_begin"))
    return laid.join(begin, "archive").select(
        "key", "archive", (F.col("_end") - F.col("_size") - F.col("_begin")).alias("offset"), "length", "copies", "digest")


def _slot():
    return F.coalesce("key", F.lit(NO_KEY))


def leaves(records):
    """(node, digest): the records of each key, in any number.

    Their digests are combined bit by bit, which needs neither an order nor
    memory; no two rows of a key are equal, so none cancel.
    """
    own = F.sha2(F.concat_ws(":", "digest", "length", "copies"), 256)
    limbs = [F.conv(F.substring(own, 16 * i + 1, 16), 16, -10).cast("long") for i in range(4)]
    mixed = records.select(_slot().alias("node"), *[x.alias(f"x{i}") for i, x in enumerate(limbs)]).groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), *[F.bit_xor(f"x{i}").alias(f"x{i}") for i in range(4)])
    return mixed.select("node", F.sha2(F.concat_ws(":", "node", "n", "x0", "x1", "x2", "x3"), 256).alias("digest"))


def subtrees(nodes):
    """(node, digest, children) of the subtrees of ``ARCHIVE_KEYS`` nodes each.

    Children are nested down to the nodes given. All levels are grouped within
    the partitions of one shuffle.
    """
    level = nodes.select(F.shiftright("node", SUBTREE_BITS).alias("top"), "*").repartition("top")
    for _ in range(SUBTREE_BITS // FANOUT_BITS):
        kept = [c for c in ("node", "digest", "children") if c in level.columns]
        level = level.withColumn("parent", F.shiftright("node", FANOUT_BITS)).groupBy("top", "parent").agg(
            F.sort_array(F.collect_list(F.struct(*kept))).alias("children"))
        level = level.select("top", F.col("parent").alias("node"), F.sha2(
            F.concat_ws("", F.transform("children", lambda c: F.concat_ws(":", c["node"], c["digest"]))), 256).alias("digest"), "children")
    return level.drop("top")


def trees(*replicas):
    """For each replica its rounds of subtrees, from the leaves' up to one row.

    All replicas take as many rounds, so their roots stand for the same keys.
    """
    rounds = [[] for _ in replicas]
    nodes = [leaves(records) for records in replicas]
    for _ in range(MOST_ROUNDS):
        for i, level in enumerate(nodes):
            rounds[i].append(stage(subtrees(level), "subtrees"))
        nodes = [r[-1].select("node", "digest") for r in rounds]
        if all(r[-1].limit(2).count() < 2 for r in rounds):
            break
    return rounds


def _opened(pairs):
    """One level down: (node, x, y) of children whose digests differ."""
    xs, ys = F.col("x.children"), F.col("y.children")
    none = F.filter(F.coalesce(xs, ys), lambda _: F.lit(False))
    xs, ys = F.coalesce(xs, none), F.coalesce(ys, none)
    names = F.array_distinct(F.concat(F.transform(xs, lambda c: c["node"]), F.transform(ys, lambda c: c["node"])))
    of = lambda cs, n: F.get(F.filter(cs, lambda c: c["node"] == n), F.lit(0))
    both = F.transform(names, lambda n: F.struct(n.alias("node"), of(xs, n).alias("x"), of(ys, n).alias("y")))
    return pairs.select(F.inline(F.filter(both, lambda p: ~p["x"]["digest"].eqNullSafe(p["y"]["digest"]))))


def audit(expected, actual):
    """(node): leaves whose records differ between two manifests.

    Starts at the roots; a round's differing leaves are the subtrees that the
    round below opens.
    """
    open_ = None
    for a, b in reversed(list(zip(*trees(expected, actual)))):
        if open_ is not None:
            a, b = (side.join(open_, "node", "left_semi") for side in (a, b))
        one = a.select("node", F.struct("digest", "children").alias("x"))
        two = b.select("node", F.struct("digest", "children").alias("y"))
        pairs = one.join(two, "node", "full").where("NOT (x.digest <=> y.digest)")
        open_ = stage(_opened(_opened(_opened(pairs))).select("node"), "open")
    return open_


_RECORD = ["archive", "offset", "length", "copies", "digest"]


def locate(expected, actual):
    """Corrupt records: status, key, archive, offset, end, copies, expected_digest, actual_digest.

    A record that was expected and is not there is ``missing``, one that is
    there and was not expected ``unexpected``; one of each under the same key are
    one ``damaged`` record, paired in the order of their digests. Place and bytes
    are those of ``expected``, or of ``actual`` where nothing was expected;
    ``copies`` tells how many equal records that concerns.
    """
    found = audit(expected, actual)

    def reached(records, other):
        """Copies of records that the other side has not, numbered by key."""
        here = lambda df: df.withColumn("node", _slot()).join(found, "node", "left_semi")
        theirs = here(other).select(F.col("node"), F.col("length"), F.col("digest"), F.col("copies").alias("theirs"))
        more = here(records).join(theirs, ["node", "length", "digest"], "left").withColumn(
            "copies", F.col("copies") - F.coalesce("theirs", F.lit(0))).where("copies > 0")
        return more.withColumn("number", F.row_number().over(Window.partitionBy("node").orderBy("digest", "length")))

    one = reached(expected, actual).select("node", "number", "key", *_RECORD)
    two = reached(actual, expected).select("node", "number", *[F.col(c).alias(f"{c}2") for c in ("key", *_RECORD)])
    status = F.when(F.col("digest2").isNull(), "missing").when(F.col("digest").isNull(), "unexpected").otherwise("damaged")
    own = lambda c: F.when(F.col("digest").isNotNull(), F.col(c)).otherwise(F.col(f"{c}2"))
    return one.join(two, ["node", "number"], "full").select(
        status.alias("status"), own("key").alias("key"), own("archive").alias("archive"), own("offset").alias("offset"),
        (own("offset") + own("length")).alias("end"), own("copies").alias("copies"),
        F.col("digest").alias("expected_digest"), F.col("digest2").alias("actual_digest"))


def moved(expected, actual):
    """Intact records at other offsets, as ranges: archive, shift, first_key, last_key, records."""
    other = actual.select("key", "length", "digest", F.col("offset").alias("offset2"))
    same = expected.withColumn("node", _slot()).join(other.withColumn("node", _slot()).drop("key"), ["node", "length", "digest"])
    shift = F.col("offset2") - F.col("offset")
    return same.where(shift != 0).groupBy("archive", shift.alias("shift")).agg(
        F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count(F.lit(1)).alias("records"))


def aged_copy(pages):
    """A second copy with faults of four kinds, each at every ``FAULT_EVERY``-th key.

    (page_id, record). Stands for a replica on worn media, so that the audit has
    something to find: a letter of the record differs, its payload is cut to
    half, it is lost, or another capture of the page follows it.
    """
    whole = warc_record(F.col("url"), F.col("html"))
    worn = F.concat(F.encode(F.lit("WARC/1.1\r\nWARC-Type: sesponse"), "utf-8"), F.substring(whole, 30, 1 << 30))
    half = warc_record(F.col("url"), F.expr("substring(html, 1, length(html) div 2)"))
    again = warc_record(F.concat(F.coalesce("url", F.lit("")), F.lit("#again")), F.col("html"))
    kind = F.pmod(F.col("page_id"), F.lit(FAULT_EVERY))
    record = F.when(kind == 5, F.array(worn)).when(kind == 17, F.array(half)).when(kind == 29, F.slice(F.array(whole), 1, 0)).when(
        kind == 41, F.array(whole, again)).otherwise(F.array(whole))
    return pages.select("page_id", F.explode(record).alias("record"))


def op4_warc_fixity(spark, sf_dir):
    """Corrupt records of a worn copy of all pages, with archive and byte range."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    expected = stage(manifest(pages), "manifest")
    actual = stage(manifest(aged_copy(pages), record=F.col("record")), "manifest")
    return locate(expected, actual).withColumnRenamed("key", "page_id")


_LINE = "chr(13) || chr(10)"


def _record_sql(url, html, kind="response"):
    return (f"'WARC/1.1' || {_LINE} || 'WARC-Type: {kind}' || {_LINE} || 'WARC-Target-URI: ' || {url} || {_LINE} || "
            f"'Content-Type: text/html' || {_LINE} || 'Content-Length: ' || CAST(strlen({html}) AS VARCHAR) || {_LINE} || {_LINE} || "
            f"{html} || {_LINE} || {_LINE}")


def _laid_sql(records):
    """Manifest of a table (page_id, r)."""
    return f"""
  SELECT *, page_id // {ARCHIVE_KEYS} AS archive,
    CAST(coalesce(sum(length * copies) OVER (PARTITION BY page_id // {ARCHIVE_KEYS} ORDER BY page_id, digest, length
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_
  FROM (SELECT page_id, CAST(strlen(r) AS BIGINT) AS length, sha256(r) AS digest, count(*) AS copies FROM {records} GROUP BY ALL)"""


def _rest_sql(one, two):
    """Records of ``one`` that ``two`` has not, numbered by key."""
    return f"""
  SELECT a.* REPLACE (a.copies - coalesce(b.copies, 0) AS copies),
    row_number() OVER (PARTITION BY a.page_id ORDER BY a.digest, a.length) AS number
  FROM {one} a LEFT JOIN {two} b ON a.page_id = b.page_id AND a.digest = b.digest AND a.length = b.length
  WHERE a.copies > coalesce(b.copies, 0)"""


_WHOLE = _record_sql("coalesce(url, '')", "coalesce(html, '')")
OP4_SQL = f"""
WITH whole AS (SELECT page_id, {_WHOLE} AS r FROM pages),
copy AS (
  SELECT page_id, CASE page_id % {FAULT_EVERY} WHEN 5 THEN {_record_sql("coalesce(url, '')", "coalesce(html, '')", "sesponse")}
    WHEN 17 THEN {_record_sql("coalesce(url, '')", "coalesce(substr(html, 1, length(html) // 2), '')")} ELSE {_WHOLE} END AS r
  FROM pages WHERE page_id % {FAULT_EVERY} <> 29
  UNION ALL SELECT page_id, {_record_sql("coalesce(url, '') || '#again'", "coalesce(html, '')")} FROM pages WHERE page_id % {FAULT_EVERY} = 41
), expected AS ({_laid_sql('whole')}), actual AS ({_laid_sql('copy')}),
a AS ({_rest_sql('expected', 'actual')}), b AS ({_rest_sql('actual', 'expected')})
SELECT CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'unexpected' ELSE 'damaged' END AS status,
  coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.archive, b.archive) AS archive, coalesce(a.offset_, b.offset_) AS "offset",
  coalesce(a.offset_ + a.length, b.offset_ + b.length) AS "end", coalesce(a.copies, b.copies) AS copies,
  a.digest AS expected_digest, b.digest AS actual_digest
FROM a FULL JOIN b ON a.page_id = b.page_id AND a.number = b.number
"""
