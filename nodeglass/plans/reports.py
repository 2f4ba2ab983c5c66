"""Named reports.

``max_id`` pins a report to one state of the log table. It may be a number from
``windows.snapshot`` (several reports of the same state) or None, in which case
the highest id is found by a subquery of the same plan.
"""

from pyspark.sql import functions as F

from nodeglass import settings as S
from nodeglass.functions import (
    effective_load, http_label, iso_timestamp, load_version, log_message, map_label, risk_level,
    rotation_timer, round2, sync_status,
)
from nodeglass.operators.anomalies import (
    anomaly_totals, flagged_nodes, hits_per_node, window_threats,
)
from nodeglass.operators.asof import active_version
from nodeglass.operators.clones import clone_totals, cloned_identities
from nodeglass.operators.latency import node_latency
from nodeglass.operators.latest import latest_per_node
from nodeglass.operators.topk import anomaly_page, latest_logs, registry_page, stratified_top
from nodeglass.operators.windows import snapshot, trailing_start, since, tumbling


def _serials(nodes):
    return nodes.select(F.col("node_uuid").alias("node_id"), "serial_number")


def with_window_flag(nodes, anomalies, max_id, window=S.WINDOW):
    """Add ``window_flagged``: the node has an anomaly in the current window."""
    flagged = flagged_nodes(tumbling(anomalies, max_id, window)).select(
        F.col("node_id").alias("node_uuid"), F.lit(True).alias("_hit")
    )
    return nodes.join(flagged, "node_uuid", "left").withColumn(
        "window_flagged", F.col("_hit").isNotNull()
    ).drop("_hit")


def city_map(logs, nodes, anomalies, max_id=None, window=S.WINDOW):
    """True status of every node that has sent a log."""
    latest = latest_per_node(logs, ["http_response_code"]).withColumnRenamed("node_id", "node_uuid")
    mapped = nodes.select("node_uuid", "serial_number").join(latest, "node_uuid")
    return with_window_flag(mapped, anomalies, logs if max_id is None else max_id, window).select(
        "node_uuid", "serial_number",
        map_label().alias("http_status_label"),
        "http_response_code",
        F.col("window_flagged").alias("is_infected"),
    )


def node_risk(logs, anomalies, nodes, max_id=None, window=S.WINDOW):
    """Latency, hits and risk of every node seen in the trailing window."""
    start = trailing_start(logs if max_id is None else max_id, window)
    stats = node_latency(since(logs, start))
    hits = hits_per_node(since(anomalies, start))
    hit_count = F.coalesce("hit_count", F.lit(0).cast("long"))
    average = F.coalesce("avg_rt", F.lit(0.0))
    return (
        stats.join(hits, "node_id", "left").join(_serials(nodes), "node_id", "left").select(
            F.col("node_id").alias("node_uuid"),
            F.coalesce("serial_number", F.lit(S.UNKNOWN_SERIAL)).alias("serial_number"),
            round2("avg_rt").alias("avg_response_time_ms"),
            F.coalesce("max_rt", F.lit(0)).cast("int").alias("max_response_time_ms"),
            round2("p95_rt").alias("p95_response_time_ms"),
            "log_count",
            hit_count.alias("anomaly_hit_count"),
            risk_level(average, hit_count).alias("risk_level"),
        )
    )


HEATMAP_COLUMNS = [
    "node_uuid", "serial_number", "avg_response_time_ms", "max_response_time_ms",
    "p95_response_time_ms", "log_count", "anomaly_hit_count", "risk_level",
]


def heatmap(logs, anomalies, nodes, max_id=None, window=S.WINDOW, quotas=None):
    """Slowest nodes of each risk level, up to the level's quota."""
    return stratified_top(node_risk(logs, anomalies, nodes, max_id, window), quotas).select(HEATMAP_COLUMNS)


def schema_console(logs, config, log_id=None, window=S.WINDOW):
    """``(current, versions)`` at ``log_id``, by default the latest."""
    log_id = snapshot(logs) if log_id is None else log_id
    version = load_version(F.lit(log_id).cast("long"), "cyclic", window)
    current = active_version(config, version).select(
        "current_version", "current_column", F.lit(log_id).cast("long").alias("latest_log_id")
    )
    is_current = F.col("version") == current.select("current_version").scalar()
    versions = config.withColumn("is_current", is_current).select(
        "version", "active_column", "time_start", "is_current"
    ).orderBy("time_start")
    return current, versions


def asset_registry(nodes, skip=0, limit=100):
    return registry_page(nodes, skip, limit)


def node_status(logs, nodes, node_uuid, window=S.WINDOW):
    """Latest state of one node; empty for an unknown or silent node."""
    latest = latest_logs(logs.filter(F.col("node_id") == node_uuid), 1)
    version = load_version("log_id", "cyclic", window)
    return nodes.filter(F.col("node_uuid") == node_uuid).join(
        latest, F.col("node_uuid") == F.col("node_id")
    ).select(
        "node_uuid", "serial_number", "is_infected",
        F.col("http_response_code").alias("last_http_code"),
        F.col("response_time_ms").alias("last_response_time_ms"),
        http_label().alias("true_status"),
        "json_status",
        version.alias("active_schema_version"),
        effective_load(version).alias("effective_load"),
    )


def anomaly_report(anomalies, skip=0, limit=200):
    """``(summary, page)``."""
    return anomaly_totals(anomalies), anomaly_page(anomalies, skip, limit)


def clone_report(nodes):
    """``(summary, clones)``, the most copied serial first."""
    return clone_totals(nodes), cloned_identities(nodes).orderBy(
        F.desc("clone_count"), "serial_number", "part"
    )


def inventory(nodes, logs):
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    return count(nodes).select(F.col("n").alias("total_nodes"), count(logs).scalar().alias("total_logs"))


def dashboard_metadata(logs, anomalies, max_id, window=S.WINDOW):
    """Header figures at a pinned state, in one row."""
    latest = logs.filter(F.col("log_id") == max_id).agg(F.max("ingested_at").alias("ts"))
    return window_threats(anomalies, max_id, window).select(
        iso_timestamp(latest.scalar()).alias("latest_log_timestamp"),
        F.lit(max_id).cast("long").alias("total_logs_processed"),
        "active_threats", "total_anomalies",
        F.lit(S.DASHBOARD_STATUS).alias("status"),
    )


def dashboard_schema_engine(logs, config, max_id, window=S.WINDOW):
    current, _ = schema_console(logs, config, max_id, window)
    return current.select(
        "current_version", F.col("current_column").alias("active_column"),
        rotation_timer("latest_log_id", window).alias("rotation_timer"),
        sync_status("current_column").alias("sync_status"),
    )


def dashboard_nodes(logs, nodes, anomalies, max_id=None, full=False, window=S.WINDOW):
    """Every node with its latest code; ``full`` adds serial and user agent."""
    latest = latest_per_node(logs, ["http_response_code", "json_status"]).withColumnRenamed("node_id", "node_uuid")
    flagged = with_window_flag(nodes, anomalies, logs if max_id is None else max_id, window)
    heavy = [F.col("serial_number").alias("decoded_serial"), F.col("user_agent").alias("encoded_ua")]
    return flagged.join(latest, "node_uuid", "left").select(
        F.col("node_uuid").alias("id"),
        F.col("window_flagged").alias("is_infected"),
        F.lit(False).alias("conflict_detected"),
        F.coalesce("http_response_code", F.lit(200)).alias("last_http_code"),
        F.coalesce("json_status", F.lit(S.CLAIMED_STATUS)).alias("reported_json"),
        *(heavy if full else []),
    )


def dashboard_logs(logs, full=False):
    """The latest log lines, newest first."""
    return latest_logs(logs, 50 if full else 10).select(
        F.col("log_id").alias("id"),
        iso_timestamp("ingested_at").alias("timestamp"),
        "node_id",
        log_message().alias("message"),
        http_label().alias("status"),
        F.col("http_response_code").alias("http_code"),
    )


def dashboard(logs, nodes, anomalies, config, full=False, window=S.WINDOW):
    """All five sections, pinned to one state of the logs."""
    max_id = snapshot(logs)
    seen, found = (df.filter(F.col("log_id") <= max_id) for df in (logs, anomalies))
    return {
        "metadata": dashboard_metadata(seen, found, max_id, window),
        "schema_engine": dashboard_schema_engine(seen, config, max_id, window),
        "nodes": dashboard_nodes(seen, nodes, found, max_id, full, window),
        "heatmap": heatmap(seen, found, nodes, max_id, window).limit(30),
        "terminal_logs": dashboard_logs(seen, full),
    }
