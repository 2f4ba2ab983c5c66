"""Rule detectors. Thresholds not fixed elsewhere are this library's own."""

from pyspark.sql import functions as F

from nodeglass import settings as S
from nodeglass.functions import status_mismatch
from nodeglass.operators.windows import tumbling

# Documented rule limits.
DDOS_FACTOR = 5
SLOW_MS = 200

_ALERT = ["rule", "node_id", "log_id", "severity", "evidence"]


def throttling_per_node(logs):
    return logs.groupBy("node_id").agg(
        F.sum((F.col("http_response_code") == S.THROTTLED_CODE).cast("long")).alias("throttled"),
        F.count(F.lit(1)).alias("log_count"),
    )


def ddos_nodes(logs, max_id=None, factor=DDOS_FACTOR, window=S.WINDOW):
    """Nodes with more than ``factor`` times the mean throttled logs per node,
    within the current tumbling window."""
    counts = throttling_per_node(tumbling(logs, logs if max_id is None else max_id, window))
    mean = counts.agg(F.avg("throttled")).scalar()
    return counts.select("node_id", "throttled", mean.alias("mean_throttled")).filter(
        F.col("throttled") > factor * F.col("mean_throttled")
    )


def slow_logs(logs, limit_ms=SLOW_MS):
    return logs.filter(F.col("response_time_ms") > limit_ms)


def mismatched_logs(logs):
    return logs.filter(status_mismatch())


def infected_nodes_seen(logs, nodes):
    """Registry-infected nodes that send logs, with how many."""
    seen = logs.groupBy("node_id").agg(F.count(F.lit(1)).alias("log_count"))
    infected = nodes.filter("is_infected").select(F.col("node_uuid").alias("node_id"))
    return seen.join(infected, "node_id", "left_semi")


def _log_alerts(logs, slow_ms):
    """Both per-log rules in one scan."""
    alert = lambda name, severity, evidence: F.struct(
        F.lit(name).alias("rule"), F.lit(severity).alias("severity"), evidence.alias("evidence")
    )
    ms = F.col("response_time_ms")
    slow = F.when(ms > slow_ms, alert(
        "LATENCY", "MEDIUM", F.concat(F.lit("response_time_ms="), ms.cast("string"))))
    mismatch = F.when(status_mismatch(), alert(
        "STATUS_MISMATCH", "HIGH",
        F.concat(F.lit("http_response_code="), F.col("http_response_code").cast("string"))))
    found = logs.select("node_id", "log_id", F.explode(F.array_compact(F.array(slow, mismatch))).alias("a"))
    return found.select("node_id", "log_id", "a.*").select(_ALERT)


def threat_alerts(logs, nodes, max_id=None, factor=DDOS_FACTOR, slow_ms=SLOW_MS, window=S.WINDOW):
    """All alerts: (rule, node_id, log_id, severity, evidence).

    The two node rules have no ``log_id``.
    """
    none = F.lit(None).cast("long").alias("log_id")
    ddos = ddos_nodes(logs, max_id, factor, window).select(
        F.lit("DDOS").alias("rule"), "node_id", none, F.lit("CRITICAL").alias("severity"),
        F.concat(F.lit("throttled="), F.col("throttled").cast("string")).alias("evidence"),
    )
    infected = infected_nodes_seen(logs, nodes).select(
        F.lit("INFECTED_NODE").alias("rule"), "node_id", none, F.lit("CRITICAL").alias("severity"),
        F.concat(F.lit("log_count="), F.col("log_count").cast("string")).alias("evidence"),
    )
    return _log_alerts(logs, slow_ms).unionByName(ddos).unionByName(infected)


def threat_counts(alerts):
    return alerts.groupBy("rule").agg(F.count(F.lit(1)).alias("alert_count"))


def top_offenders(alerts, count=5):
    return alerts.groupBy("node_id").agg(F.count(F.lit(1)).alias("alert_count")).orderBy(
        F.desc("alert_count"), "node_id"
    ).limit(count)


def threat_summary(logs, nodes, **options):
    """Counts per rule and the nodes with most alerts, as one long table."""
    per_pair = threat_alerts(logs, nodes, **options).groupBy("rule", "node_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    by_rule = per_pair.groupBy("rule").agg(F.sum("n").alias("alert_count")).select(
        F.lit("rule").alias("section"), F.col("rule").alias("item"), "alert_count"
    )
    by_node = per_pair.groupBy("node_id").agg(F.sum("n").alias("alert_count")).orderBy(
        F.desc("alert_count"), "node_id"
    ).limit(5).select(F.lit("top_node").alias("section"), F.col("node_id").cast("string").alias("item"), "alert_count")
    return by_rule.unionByName(by_node)
