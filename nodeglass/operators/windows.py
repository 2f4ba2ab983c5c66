"""Count windows over the log id axis."""

from pyspark.sql import DataFrame, functions as F

from nodeglass import settings as S
from nodeglass.functions import window_id


def newest_folder(logs):
    """The part of a stored log table that holds the highest ids.

    Found from the folder names; other tables are returned as they are.
    """
    if "id_folder" not in logs.columns:
        return logs
    return logs.filter(F.col("id_folder") == logs.agg(F.max("id_folder")).scalar())


def max_log_id(logs):
    """One row: the highest log id, 0 for an empty table."""
    return newest_folder(logs).agg(F.coalesce(F.max("log_id"), F.lit(0).cast("long")).alias("max_log_id"))


def snapshot(logs):
    """The highest id as a number, to pin several reports to one state."""
    return max_log_id(logs).first()["max_log_id"]


def _start(max_id, rule):
    """First id of a window, from a pinned highest id or a table of logs.

    For a table the whole bound is one row of its own, so that it enters other
    plans as a plain subquery value, which the Parquet filter accepts.
    """
    if isinstance(max_id, DataFrame):
        return max_log_id(max_id).select(rule(F.col("max_log_id")).alias("start"))
    return rule(F.lit(max_id).cast("long"))


def tumbling_start(max_id, window=S.WINDOW):
    """First id of the window that holds ``max_id``."""
    return _start(max_id, lambda top: window_id(top, window) * window)


def trailing_start(max_id, window=S.WINDOW):
    """``window`` ids back from ``max_id``; with it, up to ``window + 1`` ids."""
    return _start(max_id, lambda top: F.greatest(F.lit(0).cast("long"), top - window))


def since(df, start, ids_per_folder=S.IDS_PER_FOLDER):
    """Rows from id ``start`` on; folders below it are not listed for reading."""
    first = start.scalar() if isinstance(start, DataFrame) else start
    kept = df.filter(F.col("log_id") >= first)
    if "id_folder" in df.columns:
        first_folder = F.call_function("div", first, F.lit(ids_per_folder).cast("long"))
        kept = kept.filter(F.col("id_folder") >= first_folder)
    return kept


def tumbling(df, max_id, window=S.WINDOW):
    return since(df, tumbling_start(max_id, window))


def trailing(df, max_id, window=S.WINDOW):
    return since(df, trailing_start(max_id, window))


def id_range(df, start, end=None):
    """Half-open id range; without ``end``, everything from ``start`` on."""
    kept = df.filter(F.col("log_id") >= start)
    return kept if end is None else kept.filter(F.col("log_id") < end)


def above(df, last_seen):
    """Rows above the last id seen, oldest first."""
    return df.filter(F.col("log_id") > last_seen).orderBy("log_id")


def window_totals(logs, window=S.WINDOW):
    """Logs per tumbling window."""
    return logs.groupBy(window_id("log_id", window).alias("window_id")).agg(
        F.count(F.lit(1)).alias("log_count"),
        F.min("log_id").alias("first_log_id"),
        F.max("log_id").alias("last_log_id"),
    )
