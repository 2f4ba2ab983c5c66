"""Latency statistics per node."""

from pyspark.sql import functions as F


def latency_histogram(logs, by=("node_id",)):
    """Logs per node and latency value.

    A busy node is spread over all tasks here, and what reaches the per-node
    step is one row per distinct millisecond value, however many logs it has.
    """
    return logs.groupBy(*by, "response_time_ms").agg(F.count(F.lit(1)).alias("n"))


def statistics_of_counts(counts, by=("node_id",), quantile=0.95):
    """``avg_rt``, ``max_rt``, ``p95_rt`` and ``log_count`` of a histogram, all exact."""
    ms, n = F.col("response_time_ms"), F.col("n")
    return counts.groupBy(*by).agg(
        (F.sum(ms * n) / F.sum(F.when(ms.isNotNull(), n))).alias("avg_rt"),
        F.max(ms).alias("max_rt"),
        F.percentile(ms, quantile, n).alias("p95_rt"),
        F.sum(n).alias("log_count"),
    )


def node_latency(logs, by=("node_id",), quantile=0.95):
    """Statistics per node, through the histogram."""
    return statistics_of_counts(latency_histogram(logs, by), by, quantile)


def node_latency_approx(logs, by=("node_id",), quantile=0.95, accuracy=10_000):
    """As ``node_latency`` with a sketched quantile, in a single shuffle."""
    ms = F.col("response_time_ms")
    return logs.groupBy(*by).agg(
        F.avg(ms).alias("avg_rt"),
        F.max(ms).alias("max_rt"),
        F.percentile_approx(ms, quantile, accuracy).cast("double").alias("p95_rt"),
        F.count(F.lit(1)).alias("log_count"),
    )
