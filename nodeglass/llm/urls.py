"""Op 10: URL filters with a cascade of Bloom filters.

The keys of a list and of the whole corpus are known when the filter is built.
Level 0 holds the listed keys. Other corpus keys that level 0 takes for listed
go into level 1, listed keys that level 1 takes for those go into level 2, and
so on until a level takes no key wrongly. A corpus key is listed if the first
level that rejects it has an odd number. For each key of the corpus that answer
is exact, so urls are judged by hashing alone, without a join.

Keys are dealt into shards by hash, one small cascade each. Judging takes the
shards in groups whose filters together stay below ``MAX_BYTES``; each group is
broadcast and answers for its own shards' keys. Almost always there is one.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from nodeglass.llm.tables import free_name, stage, table

BITS_PER_KEY = 12
HASHES = 4
SHARD_KEYS = 1 << 16  # listed keys a shard holds on average, at most
MAX_BYTES = 32 << 20  # of filters that are broadcast together
MAX_LEVELS = 64

# Rules as (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
# Labels of host names that put a host on the list of the query.
LISTED_LABELS = ["spam-farm", "cheap-pills"]


def split_url(url):
    """Column pair host, path of a url column; both empty without ``://``."""
    place = F.instr(url, "://")
    rest = F.when(place > 0, F.substring(url, place + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host, path, rules):
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))) \
            .otherwise(found)
    return found


def _spots(hashes, level, bits):
    """For each 64-bit hash its bit numbers in a filter: array (hashes, HASHES)."""
    salt = np.uint64((level * 2 + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = hashes.astype(np.uint64) ^ salt
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    low, high = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return (low[:, None] + np.arange(HASHES, dtype=np.uint64) * high[:, None]) % np.uint64(bits)


def make_filter(hashes, level):
    """Bits of a Bloom filter of ``hashes``, packed into bytes."""
    bits = np.zeros(max(64, len(hashes) * BITS_PER_KEY + 7 & ~7), bool)
    bits[_spots(hashes, level, len(bits)).ravel()] = True
    return np.packbits(bits)


def in_filter(packed, hashes, level):
    """Which of ``hashes`` the filter takes for its own."""
    spots = _spots(hashes, level, len(packed) * 8)
    return ((packed[spots >> np.uint64(3)] >> (np.uint64(7) - (spots & np.uint64(7))).astype(np.uint8)) & 1) \
        .all(axis=1)


def build_cascade(listed, others):
    """Filters, level by level, that tell ``listed`` from ``others`` exactly."""
    levels, inside, outside = [], np.asarray(listed), np.asarray(others)
    while len(inside):
        if len(levels) == MAX_LEVELS:
            raise ValueError("a key is both listed and not listed")
        levels.append(make_filter(inside, len(levels)))
        wrong = outside[in_filter(levels[-1], outside, len(levels) - 1)]
        inside, outside = wrong, inside
    return levels


def ask_cascade(levels, hashes):
    """Whether each key hash is listed; exact for keys of the build."""
    answer, open_ = np.zeros(len(hashes), bool), np.arange(len(hashes))
    for level, packed in enumerate(levels):
        passed = in_filter(packed, hashes[open_], level)
        answer[open_[~passed]] = level % 2 == 1
        open_ = open_[passed]
    answer[open_] = len(levels) % 2 == 1
    return answer


def build_cascades(universe, listed):
    """Filters as rows (shard, level, bits), and the number of shards.

    ``universe`` and ``listed``: DataFrames with a column ``key``. Listed keys
    outside the universe are never asked for and left out; null keys belong to
    no list. Each shard is built by one task from the hashes of its keys.
    """
    marked = universe.select("key", F.lit(0).alias("listed"), F.lit(1).alias("used")).unionByName(
        listed.select("key", F.lit(1).alias("listed"), F.lit(0).alias("used"))
    )
    keys = stage(
        marked.where("key IS NOT NULL").groupBy(F.xxhash64("key").alias("hash"))
        .agg(F.max("listed").alias("listed"), F.max("used").alias("used")).where("used = 1").drop("used"),
        "url-keys",
    )
    counts = keys.agg(F.sum("listed").alias("listed"), F.count(F.lit(1)).alias("all")).first()
    shards = max(1, -(-(counts["listed"] or 0) // SHARD_KEYS), -(-counts["all"] // (16 * SHARD_KEYS)))

    def build(rows):
        hashes, is_listed = rows["hash"].to_numpy(), rows["listed"].to_numpy() == 1
        levels = build_cascade(hashes[is_listed], hashes[~is_listed])
        return pd.DataFrame({"shard": rows["shard"].iloc[0], "level": np.arange(len(levels), dtype=np.int32),
                             "bits": [x.tobytes() for x in levels]})

    dealt = keys.withColumn("shard", _shard("hash", shards)).groupBy("shard")
    return stage(dealt.applyInPandas(build, "shard int, level int, bits binary"), "url-cascades"), shards


def _shard(hashes, shards):
    return F.pmod(F.shiftright(hashes, 32), F.lit(shards)).cast("int")


def _judge(cascades, shards):
    """A column function telling which hashes are listed, null for other shards."""

    @F.pandas_udf("boolean")
    def judge(hashes: pd.Series) -> pd.Series:
        values = hashes.to_numpy()
        at = (values >> 32) % shards
        out = pd.Series([None] * len(values), dtype=object)
        for shard in np.unique(at):
            if shard in cascades.value:
                rows = np.flatnonzero(at == shard)
                out.iloc[rows] = ask_cascade(cascades.value[shard], values[rows])
        return out

    return judge


def with_membership(df, key, universe, listed, column="listed"):
    """``df`` with a boolean ``column``: is ``key`` on the list? Null keys: false.

    Exact for all keys of ``universe``. A column of that name is replaced.
    """
    spark = df.sparkSession
    filters, shards = build_cascades(universe, listed)
    sizes = filters.groupBy("shard").agg(F.sum(F.length("bits")).alias("bytes")).orderBy("shard").collect()
    groups, held = [[]], 0  # shards without a listed key have no filters: false
    for row in sizes:
        if groups[-1] and held + row["bytes"] > MAX_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(row["shard"])
        held += row["bytes"]
    answer = F.lit(None).cast("boolean")
    number = free_name("hash", [*df.columns, column])
    asked = df.withColumn(number, F.xxhash64(key)).withColumn(column, answer)
    for n, group in enumerate(groups):
        if n:
            asked = stage(asked, "url-judged")
        cascades = {}
        for row in filters.where(F.col("shard").isin(group)).orderBy("shard", "level").toLocalIterator():
            cascades.setdefault(row["shard"], []).append(np.frombuffer(row["bits"], np.uint8))
        judged = _judge(spark.sparkContext.broadcast(cascades), shards)(number)
        asked = asked.withColumn(column, F.coalesce(column, judged))
    return asked.withColumn(column, F.coalesce(F.when(F.col(key).isNotNull(), F.col(column)), F.lit(False))).drop(number)


def judge_urls(pages, listed_hosts, rules=RULES, url="url"):
    """``pages`` with host, path, rule and verdict of each url.

    The longest rule that fits decides; a url without one is blocked if its host
    is in ``listed_hosts`` (a DataFrame with a column ``key``). A null url or one
    without ``://`` has an empty host and path and is allowed unless the list
    holds the empty host. Repeated rows are judged each; columns named host,
    path, rule or verdict are replaced.
    """
    host, path = split_url(F.col(url))
    split = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    listed, both = (free_name(name, split.columns) for name in ("listed", "rule_and_verdict"))
    marked = with_membership(split, "host", split.select(F.col("host").alias("key")), listed_hosts, listed)
    found = rule_of(F.col("host"), F.col("path"), rules)
    by_list = F.when(F.col(listed), "block").otherwise("allow")
    return marked.withColumn(both, found).withColumns(
        {"rule": F.col(f"{both}.rule"), "verdict": F.coalesce(f"{both}.verdict", by_list)}
    ).drop(both, listed)


def hosts_with_labels(pages, labels=LISTED_LABELS, url="url"):
    """All hosts of ``pages`` that have one of ``labels`` between their dots."""
    hosts = pages.select(split_url(F.col(url))[0].alias("key")).distinct()
    return hosts.where(F.arrays_overlap(F.split("key", r"\."), F.array(*map(F.lit, labels))))


def op10_url_filters(spark, sf_dir):
    """Host, path, rule and verdict of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge_urls(pages, hosts_with_labels(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


_LABELS = ", ".join(f"'{x}'" for x in LISTED_LABELS)
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
OP10_SQL = f"""
WITH rests AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rests
), rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULES}), hosts AS (SELECT DISTINCT host FROM split),
paths AS (SELECT DISTINCT host, path FROM split), fits AS (
  SELECT host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    max_by(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM paths JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT page_id, split.host, split.path, rule, coalesce(verdict,
  CASE WHEN list_has_any(string_split(split.host, '.'), [{_LABELS}]) THEN 'block' ELSE 'allow' END) AS verdict
FROM split LEFT JOIN fits ON split.host = fits.host AND split.path = fits.path
"""
