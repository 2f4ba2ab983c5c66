"""Detected nodes against the registry's truth."""

from pyspark.sql import functions as F

from nodeglass import settings as S
from nodeglass.functions import load_version


def detected_nodes(scored, threshold=S.ANOMALY_THRESHOLD):
    """Distinct nodes with at least one flagged log."""
    return scored.filter(F.col("anomaly_score") < threshold).select("node_id").distinct()


def truth_nodes(nodes):
    return nodes.filter("is_infected").select(F.col("node_uuid").alias("node_id"))


def correct_hits(detected, truth):
    return detected.intersect(truth)


def missed_nodes(detected, truth):
    return truth.subtract(detected)


def all_detected(first, second):
    return first.union(second).distinct()


def coverage_report(flagged, nodes, window=S.WINDOW):
    """Detection per layout version and overall, against the infected nodes.

    ``flagged`` holds the flagged logs. One pass marks, per node, under which
    versions it was caught; the sets of the report are sums over that one row
    per node.
    """
    version = load_version("log_id", "cyclic", window)
    caught = flagged.groupBy("node_id").agg(
        F.max((version == 1).cast("int")).alias("v1"),
        F.max((version == 2).cast("int")).alias("v2"),
    ).withColumn("total", F.greatest("v1", "v2"))
    marked = truth_nodes(nodes).withColumn("is_true", F.lit(1)).join(caught, "node_id", "full").na.fill(
        0, ["is_true", "v1", "v2", "total"]
    )
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    scopes = [F.struct(
        F.lit(name).alias("scope"),
        count(F.col(name)).alias("detected"),
        count(F.col(name) * F.col("is_true")).alias("correct"),
        count((1 - F.col(name)) * F.col("is_true")).alias("missed"),
        count(F.col("is_true")).alias("truth"),
    ) for name in ("v1", "v2", "total")]
    rows = marked.agg(F.array(*scopes).alias("scopes")).select(F.explode("scopes").alias("s")).select("s.*")
    return rows.withColumn(
        "coverage_pct", F.when(F.col("truth") > 0, 100.0 * F.col("correct") / F.col("truth"))
    )


def scores_by_label(scored, nodes):
    """Mean score of infected and clean nodes' logs.

    Scores are summed per node before the join, so no node's logs travel.
    """
    per_node = scored.groupBy("node_id").agg(
        F.sum("anomaly_score").alias("score_sum"), F.count("anomaly_score").alias("score_n")
    )
    labels = nodes.select(F.col("node_uuid").alias("node_id"), "is_infected")
    return per_node.join(labels, "node_id").groupBy("is_infected").agg(
        (F.sum("score_sum") / F.sum("score_n")).alias("mean_score"), F.sum("score_n").alias("log_count")
    )


def scores_with_label(scored, nodes):
    labels = nodes.select(F.col("node_uuid").alias("node_id"), "is_infected")
    return scored.join(labels, "node_id")
