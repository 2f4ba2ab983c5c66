"""Consecutive numbers for the rows of a distributed table."""

from pyspark.sql import Window, functions as F

from nodeglass.session import materialise

# monotonically_increasing_id keeps the row's place in its partition here.
_PLACE_BITS = (1 << 33) - 1


def number_rows(df, column, start=0, order_by=None, stage=materialise):
    """Add ``column`` = start, start + 1, ... without gaps.

    With ``order_by`` (a unique key) the numbers follow it and do not depend on
    the partitioning; without it they follow the partition order. Rows are
    written out with their partition and place, the partition sizes give each
    partition its offset, and only those sizes (one row per partition) meet in
    one task. ``stage`` writes the placed rows and returns them from storage.
    """
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = stage(df.withColumns({
        "_part": F.spark_partition_id(),
        "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE_BITS)),
    }))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    return (
        placed.join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(column, F.lit(start).cast("long") + F.col("_offset") + F.col("_place"))
        .drop("_part", "_place", "_offset")
    )
