"""Anomaly records: predicate, hits, totals, pages."""

from pyspark.sql import functions as F

from nodeglass import settings as S
from nodeglass.operators.windows import tumbling


def below_threshold(scored, threshold=S.ANOMALY_THRESHOLD):
    """Strictly below: a score equal to the threshold is normal."""
    return scored.filter(F.col("anomaly_score") < threshold)


def hits_per_node(anomalies):
    return anomalies.groupBy("node_id").agg(F.count(F.lit(1)).alias("hit_count"))


def flagged_nodes(anomalies):
    return anomalies.select("node_id").distinct()


def anomaly_totals(anomalies, approximate=False):
    """Records and distinct nodes, in one row."""
    nodes = F.approx_count_distinct("node_id") if approximate else F.count_distinct("node_id")
    return anomalies.agg(
        F.count(F.lit(1)).alias("total_anomalies"), nodes.alias("unique_nodes_flagged")
    )


def window_threats(anomalies, max_id, window=S.WINDOW):
    """Totals of the current tumbling window."""
    return anomaly_totals(tumbling(anomalies, max_id, window)).select(
        F.col("unique_nodes_flagged").alias("active_threats"), "total_anomalies"
    )


def flag_rate(scored, threshold=S.ANOMALY_THRESHOLD):
    """Share of logs the detector flags."""
    flag = F.col("anomaly_score") < threshold
    return scored.agg(
        F.count(F.lit(1)).alias("log_count"),
        F.coalesce(F.sum(flag.cast("long")), F.lit(0)).alias("anomaly_count"),
        F.avg(flag.cast("double")).alias("flag_rate"),
    )


def flag_counts_by_window(scored, window_column="window_id", threshold=S.ANOMALY_THRESHOLD):
    return scored.groupBy(window_column).agg(
        F.count(F.lit(1)).alias("log_count"),
        F.sum((F.col("anomaly_score") < threshold).cast("long")).alias("anomaly_count"),
    )
