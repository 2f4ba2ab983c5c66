"""Joins that stay balanced when one key holds a large share of the rows."""

from pyspark.sql import functions as F

# A side is broadcast only after it was counted and found at most this long.
BROADCAST_ROWS = 200_000


def salted_join(big, small, on, row_key, salts=64):
    """Inner join of ``big`` with a side that has one row per join key.

    Rows of one key are spread over ``salts`` buckets by the hash of
    ``row_key``; the small side is repeated once per bucket. A null key meets a
    null key: a plain comparison would add a null filter to both sides, which
    works out a costly key once more where the rows are read.
    """
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(row_key), F.lit(salts)).cast("int"))
    repeated = small.withColumnRenamed(on, "_on").withColumn(
        "_bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    same = F.col(on).eqNullSafe(F.col("_on")) & (F.col("_salt") == F.col("_bucket"))
    added = [c for c in small.columns if c != on]
    return spread.join(repeated, same).select(on, *[c for c in big.columns if c != on], *added)


def checked_broadcast(materialised, limit=BROADCAST_ROWS):
    """Mark an already written table for broadcast if it is short enough.

    Longer ones are left to a shuffle join, which adaptive execution splits
    where keys are skewed.
    """
    return F.broadcast(materialised) if materialised.count() <= limit else materialised
