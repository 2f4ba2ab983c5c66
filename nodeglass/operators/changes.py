"""Comparing a row with the one before it, and updating node state."""

from pyspark.sql import Window, functions as F

from nodeglass import settings as S
from nodeglass.functions import load_version, window_id


def with_previous(df, order, value, previous, block=100_000):
    """Add ``previous``: ``value`` of the row before, by a whole-number key.

    The key range is cut into blocks, each handled by its own task; the first
    row of a block looks at the last value of the nearest block before it.
    """
    blocked = df.withColumn("_block", F.call_function("div", F.col(order), F.lit(block).cast("long")))
    ends = blocked.groupBy("_block").agg(F.max_by(value, order).alias("_end"))
    carried = ends.select("_block", F.lag("_end").over(Window.orderBy("_block")).alias("_carried"))
    in_block = Window.partitionBy("_block").orderBy(order)
    return (
        blocked.join(carried, "_block")
        .withColumn(
            previous,
            F.when(F.row_number().over(in_block) == 1, F.col("_carried"))
            .otherwise(F.lag(value).over(in_block)),
        )
        .drop("_block", "_carried")
    )


def rotation_events(logs, window=S.WINDOW, mode="cyclic"):
    """Windows whose layout version differs from that of the window before."""
    return rotations_of(logs.select(window_id("log_id", window).alias("window_id")).distinct(), window, mode)


def rotations_of(windows, window=S.WINDOW, mode="cyclic"):
    """As ``rotation_events``, from a table with one row per ``window_id``."""
    versions = windows.withColumn("version", load_version(F.col("window_id") * window, mode, window))
    return with_previous(versions, "window_id", "version", "previous_version").filter(
        F.col("version") != F.col("previous_version")
    ).select("window_id", "previous_version", "version")


def increases(totals, order, value):
    """Rows whose total is higher than the one before (0 before the first)."""
    stepped = with_previous(totals, order, value, "previous_total")
    return stepped.withColumn("previous_total", F.coalesce("previous_total", F.lit(0).cast("long"))).withColumn(
        "increase", F.col(value) - F.col("previous_total")
    ).filter(F.col("increase") > 0)


def merge_node_state(state, update, key="node_uuid", columns=("is_infected", "last_http_code", "reported_json")):
    """Refresh ``columns`` of known nodes; ids not in ``state`` are ignored."""
    changed = update.select(key, F.lit(True).alias("_changed"), *[F.col(c).alias(f"_{c}") for c in columns])
    return state.join(changed, key, "left").withColumns({
        c: F.when(F.col("_changed"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns
    }).drop("_changed", *[f"_{c}" for c in columns])
