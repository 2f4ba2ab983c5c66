"""Latest log per node."""

from pyspark.sql import functions as F, types as T

# Types an aggregation buffer can update in place, so hashing needs no sort.
_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def latest_per_node(logs, columns):
    """``columns`` of the log with the highest id of each node.

    One pass with partial aggregation; no join of the logs with themselves.
    Text columns would force a sort of all rows, so they first serve as
    grouping keys, which leaves few rows per node for the second step.
    """
    columns = [c for c in columns if c not in ("node_id", "log_id")]
    fixed = [c for c in columns if isinstance(logs.schema[c].dataType, _FIXED_WIDTH)]
    text = [c for c in columns if c not in fixed]
    latest = lambda names: [F.max_by(c, "log_id").alias(c) for c in names] + [F.max("log_id").alias("log_id")]
    found = logs.groupBy("node_id", *text).agg(*latest(fixed))
    if text:
        found = found.groupBy("node_id").agg(*latest(columns))
    return found.select("node_id", "log_id", *columns)
