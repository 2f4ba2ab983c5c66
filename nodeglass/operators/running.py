"""Running totals over a whole table without a task that holds it.

Rows are range-partitioned by their order. Every partition sums alone, and the
totals of the partitions before it, one row per partition, are added: a prefix
sum of two levels.
"""

from pyspark.sql import Window, functions as F

from nodeglass.session import materialise


def running_totals(df, order, totals, stage=materialise):
    """Add running sums: ``totals`` maps a new column to the column it sums.

    Each row's sum includes the row and all rows before it by ``order``, a list
    of columns that names rows uniquely. ``stage`` writes the ranged rows and
    returns them from storage, so that all steps see the same partitions.
    """
    ranged = stage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    ends = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{name}") for name, c in totals.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_range", *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in totals])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(F.broadcast(carried), "_range")  # one row per partition
        .withColumns({name: F.col(f"_{name}") + F.sum(c).over(inside) for name, c in totals.items()})
        .drop("_range", *[f"_{name}" for name in totals])
    )
