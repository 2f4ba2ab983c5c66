"""Which schema version applies to a log id, by start id."""

from pyspark.sql import Window, functions as F

from nodeglass.session import materialise


def resolve_active_column(logs, config, inline=200, stage=materialise):
    """Add ``active_column``: that of the greatest ``time_start`` <= log_id.

    Null before the first start; of equal starts the greatest column holds. A
    config of up to ``inline`` rows becomes one conditional expression, so there
    is no join at all; a longer one is merged with the logs in id order.
    """
    head = config.select("time_start", "active_column").limit(inline + 1).collect()
    if len(head) <= inline:
        pick = F.lit(None).cast("string")
        for start, column in sorted(head, key=lambda r: (r[0], r[1] is not None, r[1] or "")):
            pick = F.when(F.col("log_id") >= start, column).otherwise(pick)
        return logs.withColumn("active_column", pick)
    return _resolve_by_merge(logs, config, stage)


def _resolve_by_merge(logs, config, stage):
    """Logs and starts in one id order, cut into ranges.

    Within a range a log takes the last start before it; one that has none takes
    the last start of the ranges before, of which there is one row per range. The
    ranges follow the rows, however they are spread over the ids.
    """
    starts = config.select(
        F.col("time_start").cast("long").alias("_at"), F.lit(0).alias("_side"), F.col("active_column").alias("_column"))
    rows = logs.withColumns({"_at": F.col("log_id").cast("long"), "_side": F.lit(1)})
    merged = rows.unionByName(starts.where("_at IS NOT NULL"), allowMissingColumns=True)
    ranged = stage(merged.repartitionByRange("_at").withColumn("_range", F.spark_partition_id()))
    start = F.when(F.col("_side") == 0, F.struct("_at", F.col("_column").isNotNull().alias("_known"), "_column"))
    ends = ranged.groupBy("_range").agg(F.max(start).alias("_end"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_range", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy("_range").orderBy("_at", "_side", "_column").rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.withColumn("_own", F.last(start, ignorenulls=True).over(inside)).join(F.broadcast(carried), "_range")
    return found.where("_side = 1").select(*logs.columns, F.coalesce("_own", "_carried")["_column"].alias("active_column"))


def active_version(config, version):
    """The row of ``version``, or the earliest one if there is no such version."""
    rank = F.struct((F.col("version") != version).alias("other"), F.col("time_start"))
    return config.agg(
        F.min_by(F.struct("version", "active_column"), rank).alias("c")
    ).select(F.col("c.version").alias("current_version"), F.col("c.active_column").alias("current_column"))
