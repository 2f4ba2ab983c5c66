"""Exact quantiles of numbers with very many distinct values.

``percentile`` keeps every distinct value of a group in the memory of one task.
Here a sketch of bounded size first brackets the wanted rank, and one more pass
counts the rows below the bracket and lists the few values inside it.
"""

import math

from pyspark.sql import Window, functions as F, types as T

from nodeglass.operators.skew import checked_broadcast
from nodeglass.session import materialise

# percentile_approx is off by at most 1/ACCURACY of the rows; MARGIN is wider.
ACCURACY = 10_000
MARGIN = 3 / ACCURACY


def exact_quantile(df, value, q, at_most=500_000):
    """Quantile ``q`` of a column, linearly interpolated; None without values.

    Only counts and bracket ends come back to the driver. The bracket shrinks
    to about 1/1600 of its rows per round until at most ``at_most`` are inside.
    """
    v = F.col(value)
    df = df.select(v).filter(v.isNotNull())
    total = df.count()
    if total == 0:
        return None
    position = q * (total - 1)
    low_rank, high_rank = math.floor(position), math.ceil(position)
    inside, below, size = df, 0, total
    while size > at_most:
        ranks = [(low_rank - below) / size - MARGIN, (high_rank - below) / size + MARGIN]
        ranks = [min(max(r, 0.0), 1.0) for r in ranks]
        low, high = inside.agg(F.percentile_approx(v, ranks, ACCURACY)).first()[0]
        # Bounds from an earlier round still hold, so counting is over `inside`.
        under, within = inside.agg(
            F.count(F.when(v < low, 1)), F.count(F.when(v.between(low, high), 1))
        ).first()
        if not (under <= low_rank - below and high_rank - below < under + within):
            break  # the exact step below works on any bracket, only slower
        if low == high:
            return float(low)
        if within == size:
            break
        inside, below, size = df.filter(v.between(low, high)), below + under, within
    # Equal values collapse first; the sort of what is left can spill.
    values = inside.groupBy(v).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(v).rowsBetween(Window.unboundedPreceding, 0))
    at_rank = lambda rank: F.min(F.when(F.col("upto") > rank - below, v))
    low, high = values.withColumn("upto", upto).agg(at_rank(low_rank), at_rank(high_rank)).first()
    return float(low) + (float(high) - float(low)) * (position - low_rank)


def exact_median(df, value):
    return exact_quantile(df, value, 0.5)


def grouped_median(df, key, value, at_most=5_000_000, also=None):
    """``key``, ``median`` for every key that has a value.

    ``also`` maps names to further aggregates taken in the bracketing pass;
    with it the result has every key, the median being null without values.

    Each row is only compared with its key's bracket, and everything outside
    collapses into two counts before the shuffle. So a key with a third of all
    rows sends its middle values, not its rows, to one task. Keys so long that
    even their middle holds more than ``at_most`` rows (billions of rows each,
    so there are few) are narrowed down one at a time.
    """
    v, also = F.col(value), also or {}
    per_key = materialise(df.groupBy(key).agg(
        F.count(v).alias("total"),
        F.percentile_approx(v, [0.5 - MARGIN, 0.5 + MARGIN], ACCURACY).alias("ends"),
        *[c.alias(name) for name, c in also.items()],
    ))
    df = df.select(key, v).filter(v.isNotNull())
    brackets = per_key.filter(F.col("total") > 0).select(
        key, "total", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high")
    )
    is_long = F.col("total") > at_most / (2 * MARGIN)
    medians = _bracketed_median(df, key, v, brackets.filter(~is_long))
    long_keys = [r[0] for r in brackets.filter(is_long).select(key).collect()]
    if long_keys:
        found = [(k, exact_quantile(df.filter(F.col(key) == k), value, 0.5, at_most)) for k in long_keys]
        names = T.StructType([df.schema[key], T.StructField("median", T.DoubleType())])
        medians = medians.union(df.sparkSession.createDataFrame(found, names))
    return per_key.select(key, *also).join(medians, key, "left") if also else medians


def _bracketed_median(df, key, v, brackets):
    placed = df.join(checked_broadcast(brackets), key).select(
        key, "total",
        F.when(v < F.col("low"), -1).when(v > F.col("high"), 1).otherwise(0).alias("side"),
        F.when(v.between(F.col("low"), F.col("high")), v).alias("v"),
    )
    counts = placed.groupBy(key, "total", "side", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(
        Window.partitionBy(key).orderBy("side", "v").rowsBetween(Window.unboundedPreceding, 0)
    )
    at_rank = lambda rank: F.min(F.when(F.col("upto") > rank, F.struct("side", "v")))
    low_rank = F.call_function("div", F.col("total") - 1, F.lit(2).cast("long"))
    high_rank = F.call_function("div", F.col("total"), F.lit(2).cast("long"))
    found = counts.withColumn("upto", upto).groupBy(key).agg(
        at_rank(low_rank).alias("a"), at_rank(high_rank).alias("b")
    )
    # The sketch's error bound puts both ranks inside; refuse to guess otherwise.
    inside = (F.col("a.side") == 0) & (F.col("b.side") == 0)
    median = F.when(inside, (F.col("a.v") + F.col("b.v")) / 2).otherwise(
        F.raise_error(F.lit("median outside its bracket")).cast("double")
    )
    return found.select(key, median.alias("median"))
