"""Feature tables for the two detection models."""

from pyspark.sql import DataFrame, functions as F

from nodeglass import settings as S
from nodeglass.functions import code_flag, resolved_load
from nodeglass.operators.latency import node_latency
from nodeglass.operators.order_stats import exact_median, grouped_median

LOG_FEATURES = ["response_time_ms", "http_response_code", "effective_load", "is_throttled", "is_partial"]
NODE_FEATURES = [
    "avg_response_time_ms", "max_response_time_ms", "p95_response_time_ms",
    "throttled_ratio", "partial_ratio", "avg_load",
]


def with_load(logs, policy="effective", mode="cyclic", window=S.WINDOW):
    """Add ``effective_load``, missing where the policy finds none."""
    return logs.withColumn("effective_load", resolved_load(policy, mode, window))


def median_load(logs, approximate=False):
    """Median of ``effective_load`` over all logs: the training-time fill."""
    if approximate:
        return logs.agg(F.percentile_approx("effective_load", 0.5, 10_000)).first()[0]
    return exact_median(logs, "effective_load")


def log_features(logs, fill, keep=("log_id", "node_id")):
    """One row per log with the five features as doubles.

    ``fill`` replaces a missing load: the median found at training time, which
    is stored with the model, or a constant.
    """
    return logs.select(
        *keep,
        F.col("response_time_ms").cast("double").alias("response_time_ms"),
        F.col("http_response_code").cast("double").alias("http_response_code"),
        F.coalesce("effective_load", F.lit(float(fill))).alias("effective_load"),
        code_flag(S.THROTTLED_CODE).cast("double").alias("is_throttled"),
        code_flag(S.PARTIAL_CODE).cast("double").alias("is_partial"),
    )


def scaler_stats(features, columns=LOG_FEATURES):
    """Row count, mean and population deviation per feature, in one row.

    A constant feature gets deviation 1, so scaling leaves it at zero.
    """
    deviation = lambda c: F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c))
    return features.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[deviation(c).alias(f"{c}_std") for c in columns],
    )


def standardise(features, stats, columns=LOG_FEATURES):
    """Scale by the numbers of a ``scaler_stats`` row."""
    row = stats.first() if isinstance(stats, DataFrame) else stats
    return features.withColumns({
        c: (F.col(c) - F.lit(row[f"{c}_mean"])) / F.lit(row[f"{c}_std"]) for c in columns
    })


def node_features(logs, nodes):
    """Per-node aggregates joined to the registry label.

    The mean load counts each missing load as the node's median. Both parts are
    one row per node, so joining them moves no logs.
    """
    share = lambda code: F.avg((F.col("http_response_code") == code).cast("double"))
    loads = grouped_median(logs, "node_id", "effective_load", also={
        "throttled_ratio": share(S.THROTTLED_CODE),
        "partial_ratio": share(S.PARTIAL_CODE),
        "load_sum": F.sum("effective_load"),
        "missing": F.count_if(F.col("effective_load").isNull()),
    })
    avg_load = (F.col("load_sum") + F.col("missing") * F.col("median")) / F.col("log_count")
    labels = nodes.select(F.col("node_uuid").alias("node_id"), "is_infected")
    return node_latency(logs).join(loads, "node_id").join(labels, "node_id").select(
        "node_id",
        F.col("avg_rt").alias("avg_response_time_ms"),
        F.col("max_rt").alias("max_response_time_ms"),
        F.col("p95_rt").alias("p95_response_time_ms"),
        "throttled_ratio", "partial_ratio", avg_load.alias("avg_load"), "log_count", "is_infected",
    )
