"""Every operator and report as a query over the test tables, with check SQL.

A query takes a ``Tables`` and returns a DataFrame. Queries without SQL are the
model outputs, which no SQL engine can reproduce.
"""

from functools import cached_property

from pyspark.sql import Window, functions as F

from nodeglass import functions as X, schemas, settings as S, sources
from nodeglass.operators import (
    anomalies as anom, asof, audit, boosting, changes, classify, clones, features, forest, latency, latest,
    numbering, quality, rules, topk, windows,
)
from nodeglass.plans import jobs, reports
from nodeglass.plans.oracles import with_views
from nodeglass.session import materialise, scratch_path
from nodeglass.sources import views
from nodeglass.streaming import ingest, state

QUERIES, ORACLES = {}, {}
_MODELS = {}


class Tables:
    """The telemetry views of one data folder."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir
        self.logs = views.logs(spark, sf_dir)
        self.nodes = views.nodes(spark, sf_dir)
        self.raw_nodes = views.raw_nodes(spark, sf_dir)
        self.anomalies = views.anomalies(spark, sf_dir)
        self.config = views.schema_config(spark, sf_dir)

    def scratch(self, label):
        return scratch_path(self.spark, label)

    @cached_property
    def loaded(self):
        return features.with_load(self.logs)

    @cached_property
    def log_features(self):
        return features.log_features(self.loaded, features.median_load(self.loaded))

    @cached_property
    def forest(self):
        """One fitted forest per session and folder, shared by the model queries."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _MODELS:
            fill = features.median_load(self.loaded)
            _MODELS[key] = forest.fit_forest(features.log_features(self.loaded, fill), fill)
        return _MODELS[key]

    @cached_property
    def scored(self):
        return forest.score_logs(self.loaded, self.forest)

    @cached_property
    def rule_scored(self):
        """Logs with a score any engine can compute, for the checks around scores."""
        return self.logs.withColumn("anomaly_score", (200 - F.col("response_time_ms")) / F.lit(1000.0))

    @cached_property
    def node_features(self):
        return features.node_features(self.loaded, self.nodes)

    @cached_property
    def stored_node_features(self):
        """Written once, for models that read them more than once."""
        return materialise(self.node_features)

    @cached_property
    def classifier(self):
        """One fitted classifier per session and folder, shared by the model queries."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, "classifier")
        if key not in _MODELS:
            _MODELS[key] = classify.fit_classifier(self.stored_node_features)
        return _MODELS[key]

    @cached_property
    def trained(self):
        """One run of the training job per session and folder: its models' path and its report."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, "training")
        if key not in _MODELS:
            path = self.scratch("models")
            _MODELS[key] = path, jobs.train(self.logs, self.nodes, path)[1]
        return _MODELS[key]

    @cached_property
    def clean_nodes(self):
        """A registry that lacks some of the nodes sending logs."""
        return self.nodes.filter(~F.col("is_infected"))

    def event_stream(self):
        schema = self.spark.read.parquet(f"{self.sf_dir}/events.parquet").schema
        events = ingest.read_log_stream(self.spark, self.sf_dir, schema, name_filter="events.parquet")
        return views.logs_from_events(events)

    def run_ingest(self, source, sink=None, **options):
        """Ingest a stream to its end and return the sink."""
        sink = sink or ingest.Sink(self.scratch("sink"))
        ingest.stream_ingest(source, sink, self.scratch("stream"), **options).awaitTermination()
        return sink


def query(name, sql=None):
    def register(build):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build
    return register


def _rounded(df, *columns, digits=9):
    """Engines sum in different orders, so checks compare nine decimals."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _ids(df):
    return df.select("log_id", "node_id")


# Sources and sinks ----------------------------------------------------------

@query("io1_load_node_registry", "SELECT node_uuid, user_agent, is_infected, serial_number FROM nodes")
def _(t):
    path = t.scratch("registry")
    t.raw_nodes.write.option("header", True).csv(path)
    return sources.load_node_registry(t.spark, path)


@query("io2_load_system_logs", """
SELECT log_id, node_id, json_status, http_response_code, response_time_ms, load_val, l_v1,
  CAST(CASE WHEN log_id >= 5000 THEN 2 ELSE 1 END AS INT) AS active_schema_version,
  CASE WHEN log_id >= 5000 THEN l_v1 ELSE load_val END AS effective_load,
  CASE WHEN http_response_code = 200 THEN 'HEALTHY' WHEN http_response_code = 206 THEN 'PARTIAL'
       WHEN http_response_code = 429 THEN 'THROTTLED' WHEN http_response_code >= 500 THEN 'CRITICAL'
       ELSE 'UNKNOWN' END AS http_status_label FROM logs""")
def _(t):
    path = t.scratch("logs")
    t.logs.drop("ingested_at").withColumnRenamed("l_v1", "L_V1").write.option("header", True).csv(path)
    return sources.load_system_logs(t.spark, path)


@query("io3_load_schema_config", "SELECT version, time_start, active_column FROM config")
def _(t):
    path = t.scratch("config")
    t.config.write.option("header", True).csv(path)
    return sources.load_schema_config(t.spark, path)


@query("io4_seed_nodes", "SELECT node_uuid, user_agent, serial_number, is_infected FROM nodes")
def _(t):
    path = t.scratch("nodes")
    sources.seed_nodes(t.nodes.filter("is_infected"), path)
    sources.seed_nodes(t.nodes.union(t.nodes), path)
    return sources.read_table(t.spark, path, schemas.NODES).drop("created_at")


_LOG_COLUMNS = "log_id, node_id, json_status, http_response_code, response_time_ms, load_val, l_v1"


@query("io5_seed_logs", f"SELECT {_LOG_COLUMNS} FROM logs")
def _(t):
    path = t.scratch("logs")
    sources.seed_logs(t.logs.filter("http_response_code = 200"), path)
    sources.seed_logs(t.logs, path)
    return sources.read_table(t.spark, path, schemas.LOGS).drop("ingested_at", "id_folder")


@query("io6_seed_schema_config", "SELECT version, time_start, active_column FROM config")
def _(t):
    path = t.scratch("config")
    for _ in range(2):
        sources.seed_schema_config(t.config, path)
    return sources.read_table(t.spark, path, schemas.SCHEMA_CONFIG)


@query("io7_seed_anomaly_records", "SELECT node_id, log_id, anomaly_score, detector FROM anomalies")
def _(t):
    path = t.scratch("anomalies")
    sources.seed_anomalies(t.anomalies.filter("anomaly_score < -0.05"), path)
    sources.seed_anomalies(t.anomalies, path)
    return sources.read_table(t.spark, path, schemas.ANOMALIES).drop("detected_at")


@query("io8_append_with_generated_ids", """
SELECT row_number() OVER (ORDER BY ingested_at, node_id) - 1 AS log_id, node_id, http_response_code,
       response_time_ms FROM logs""")
def _(t):
    path = t.scratch("logs")
    numbered = numbering.number_rows(t.logs.drop("log_id"), "log_id", 0, ["ingested_at", "node_id"])
    sources.append_logs(numbered, path)
    return sources.read_table(t.spark, path, schemas.LOGS).select(
        "log_id", "node_id", "http_response_code", "response_time_ms"
    )


@query("io9_refresh_reference_tables", "SELECT node_uuid, user_agent, serial_number, is_infected FROM nodes")
def _(t):
    nodes_path, config_path = t.scratch("nodes"), t.scratch("config")
    spelled = t.raw_nodes.withColumn("is_infected", F.initcap(F.col("is_infected").cast("string")))
    for _ in range(2):
        sources.refresh_reference_tables(spelled, t.config, nodes_path, config_path)
    return sources.read_table(t.spark, nodes_path, schemas.NODES).drop("created_at")


@query("io10_registry_export", """
SELECT CAST(node_uuid AS VARCHAR) AS node_id, user_agent AS encoded_user_agent,
       serial_number AS decoded_serial,
       CASE WHEN node_uuid IN (SELECT node_id FROM flagged) THEN 'INFECTED' ELSE 'OPERATIONAL' END AS status
FROM nodes""")
def _(t):
    path = t.scratch("export")
    flagged = reports.with_window_flag(t.nodes, t.anomalies, t.logs)
    sources.write_export(sources.registry_export(flagged, "window_flagged"), path)
    return t.spark.read.csv(path, header=True)


@query("io11_heatmap_export", """
SELECT CAST(node_uuid AS VARCHAR) AS node_id, serial_number AS serial,
       concat(regexp_replace(CAST(avg_response_time_ms AS VARCHAR), '\\.0$', ''), 'ms') AS avg_rt,
       concat(CAST(max_response_time_ms AS VARCHAR), 'ms') AS max_rt,
       concat(regexp_replace(CAST(p95_response_time_ms AS VARCHAR), '\\.0$', ''), 'ms') AS p95_rt,
       CAST(log_count AS VARCHAR) AS logs, risk_level AS risk FROM heat""")
def _(t):
    path = t.scratch("export")
    sources.write_export(sources.heatmap_export(reports.heatmap(t.logs, t.anomalies, t.nodes)), path)
    return t.spark.read.csv(path, header=True)


@query("io12_save_load_models")
def _(t):
    path = t.scratch("model")
    forest.save_forest(t.forest, path)
    return forest.score_logs(t.loaded, forest.load_forest(t.spark, path))


@query("io12_models_come_back", """
SELECT (SELECT count(*) FROM logs) AS logs_alike, (SELECT count(*) FROM features) AS nodes_alike""")
def _(t):
    """Both models score everything as before once saved and loaded."""
    path = t.scratch("models")
    jobs.save_models(jobs.Models(t.forest, t.classifier), path)
    again = jobs.load_models(t.spark, path)
    alike = lambda one, two, key, score: one.select(key, score).join(
        two.select(key, F.col(score).alias("again")), key).where(F.col(score) == F.col("again")).agg(F.count(F.lit(1))).scalar()
    table = t.stored_node_features
    return t.spark.range(1).select(
        alike(t.scored, forest.score_logs(t.loaded, again.forest), "log_id", "anomaly_score").alias("logs_alike"),
        alike(classify.score_nodes(t.classifier, table), classify.score_nodes(again.classifier, table), "node_id", "infected_prob").alias("nodes_alike"))


# Column expressions ---------------------------------------------------------

@query("pr1_decode_serial", "SELECT node_uuid, user_agent, serial_number FROM nodes")
def _(t):
    return t.raw_nodes.select("node_uuid", "user_agent", X.decode_serial_number("user_agent").alias("serial_number"))


@query("pr2_http_label", """
SELECT log_id, CASE WHEN http_response_code = 200 THEN 'HEALTHY' WHEN http_response_code = 206 THEN 'PARTIAL'
  WHEN http_response_code = 429 THEN 'THROTTLED' WHEN http_response_code >= 500 THEN 'CRITICAL'
  ELSE 'UNKNOWN' END AS label FROM logs""")
def _(t):
    return t.logs.select("log_id", X.http_label().alias("label"))


@query("pr3_map_label", """
SELECT log_id, CASE WHEN http_response_code = 200 THEN 'HEALTHY' WHEN http_response_code = 206 THEN 'PARTIAL'
  WHEN http_response_code = 429 THEN 'THROTTLED' ELSE 'CRITICAL' END AS label FROM logs""")
def _(t):
    return t.logs.select("log_id", X.map_label().alias("label"))


@query("pr4_version_step", "SELECT log_id, CAST(CASE WHEN log_id >= 5000 THEN 2 ELSE 1 END AS INT) AS version FROM logs")
def _(t):
    return t.logs.select("log_id", X.load_version(mode="step").alias("version"))


@query("pr5_version_cyclic", "SELECT log_id, CAST((log_id // 5000) % 2 + 1 AS INT) AS version FROM logs")
def _(t):
    return t.logs.select("log_id", X.load_version().alias("version"))


@query("pr6_effective_load", "SELECT log_id, effective_load FROM loaded")
def _(t):
    return t.logs.select("log_id", X.effective_load(X.load_version()).alias("effective_load"))


@query("pr7_fallback_load", """
SELECT log_id, coalesce(CASE WHEN log_id >= 5000 THEN l_v1 END, load_val) AS load FROM
(SELECT log_id, coalesce(load_val, response_time_ms / 1000.0::DOUBLE) AS load_val, l_v1 FROM logs) x""")
def _(t):
    both = t.logs.withColumn("load_val", F.coalesce("load_val", F.col("response_time_ms") / 1000.0))
    return both.select("log_id", X.fallback_load(X.load_version(mode="step")).alias("load"))


@query("pr8_coalesced_load", "SELECT log_id, coalesce(load_val, l_v1, 0.3::DOUBLE) AS load FROM logs")
def _(t):
    return t.logs.select("log_id", X.coalesced_load().alias("load"))


@query("pr9_risk_level", "SELECT node_uuid, risk_level FROM risk")
def _(t):
    return reports.node_risk(t.logs, t.anomalies, t.nodes).select("node_uuid", "risk_level")


@query("pr10_code_flags", """
SELECT log_id, CAST(http_response_code = 429 AS INT) AS is_throttled,
       CAST(http_response_code = 206 AS INT) AS is_partial FROM logs""")
def _(t):
    return t.logs.select(
        "log_id", X.code_flag(429).alias("is_throttled"), X.code_flag(206).alias("is_partial")
    )


@query("pr11_rounding", """
SELECT node_id, round(coalesce(avg(response_time_ms), 0), 2) AS avg_ms, coalesce(max(response_time_ms), 0) AS max_ms,
       round(coalesce(avg(load_val), 0), 2) AS avg_load_val FROM logs GROUP BY node_id""")
def _(t):
    return t.logs.groupBy("node_id").agg(
        X.round2(F.avg("response_time_ms")).alias("avg_ms"),
        F.coalesce(F.max("response_time_ms"), F.lit(0)).alias("max_ms"),
        X.round2(F.avg("load_val")).alias("avg_load_val"),
    )


@query("pr12_rotation_timer", "SELECT printf('-%04d_PKTS', 5000 - max_id % 5000) AS rotation_timer FROM top")
def _(t):
    return windows.max_log_id(t.logs).select(X.rotation_timer("max_log_id").alias("rotation_timer"))


@query("pr13_sync_status", "SELECT version, concat(active_column, '_LOCKED') AS sync_status FROM config")
def _(t):
    return t.config.select("version", X.sync_status("active_column").alias("sync_status"))


@query("pr14_log_message", """
SELECT log_id, concat('Forensic Packet Recv: ', http_response_code::VARCHAR, ' | RT=', response_time_ms::VARCHAR, 'ms')
  AS message FROM logs""")
def _(t):
    return t.logs.select("log_id", X.log_message().alias("message"))


@query("pr15_iso_timestamp", "SELECT log_id, strftime(ingested_at, '%Y-%m-%dT%H:%M:%S.%f') AS ts FROM logs")
def _(t):
    return t.logs.select("log_id", X.iso_timestamp("ingested_at").alias("ts"))


@query("pr16_display_status", """
SELECT node_uuid, CASE WHEN is_infected THEN 'INFECTED' ELSE 'OPERATIONAL' END AS status FROM nodes""")
def _(t):
    return t.nodes.select("node_uuid", X.display_status().alias("status"))


@query("pr17_latency_bar", """
SELECT node_id, round(least(100.0::DOUBLE, coalesce(avg(response_time_ms), 0) / 250 * 100), 9) AS pct
FROM logs GROUP BY node_id""")
def _(t):
    means = t.logs.groupBy("node_id").agg(F.avg("response_time_ms").alias("ms"))
    return means.select("node_id", F.round(X.latency_bar_pct("ms"), 9).alias("pct"))


@query("pr18_window_progress", """
SELECT log_id, 5000 - log_id % 5000 AS remaining, (5000 - (5000 - log_id % 5000)) % 5000 AS progress,
       round(((log_id % 5000) / 5000.0::DOUBLE) * 100, 9) AS progress_pct, 5000 - log_id % 5000 < 500 AS near_rotation
FROM logs""")
def _(t):
    return _rounded(t.logs.select("log_id", *X.window_progress("log_id")), "progress_pct")


_DASHBOARD_NODES = """
SELECT node_uuid AS id, node_uuid IN (SELECT node_id FROM flagged) AS is_infected, false AS conflict_detected,
       coalesce(http_response_code, 200) AS last_http_code, coalesce(json_status, 'OPERATIONAL') AS reported_json
       {} FROM nodes LEFT JOIN latest ON node_uuid = node_id"""


@query("pr19_full_node_record", _DASHBOARD_NODES.format(", serial_number AS decoded_serial, user_agent AS encoded_ua"))
def _(t):
    return reports.dashboard_nodes(t.logs, t.nodes, t.anomalies, full=True)


@query("pr20_silent_node_defaults", """
SELECT node_uuid, coalesce(http_response_code, 200) AS last_http_code,
       coalesce(json_status, 'OPERATIONAL') AS reported_json
FROM nodes LEFT JOIN latest ON node_uuid = node_id WHERE node_id IS NULL""")
def _(t):
    shown = reports.dashboard_nodes(t.logs, t.nodes, t.anomalies).withColumnRenamed("id", "node_uuid")
    seen = t.logs.select(F.col("node_id").alias("node_uuid"))
    return shown.join(seen, "node_uuid", "left_anti").select("node_uuid", "last_http_code", "reported_json")


@query("pr21_null_if_nan", "SELECT log_id, load_val, l_v1 FROM logs")
def _(t):
    nan = F.lit(float("nan"))
    gappy = t.logs.withColumns({c: F.coalesce(c, nan) for c in ("load_val", "l_v1")})
    return gappy.select("log_id", *[X.null_if_nan(c).alias(c) for c in ("load_val", "l_v1")])


# Filters --------------------------------------------------------------------

@query("fi1_window_filter", "SELECT log_id, node_id FROM logs, top WHERE log_id >= (max_id // 5000) * 5000")
def _(t):
    return _ids(windows.tumbling(t.logs, t.logs))


# Codes up to 599 and latencies from 0 pass; the shifted values break both.
@query("fi2_row_contract", """
WITH shifted AS (SELECT log_id, response_time_ms * 4 AS code, response_time_ms - 60 AS ms FROM logs)
SELECT log_id, code BETWEEN 100 AND 599 AND ms >= 0 AS accepted,
       concat_ws('; ', CASE WHEN code NOT BETWEEN 100 AND 599 THEN 'http_response_code out of range' END,
                       CASE WHEN ms < 0 THEN 'response_time_ms negative' END) AS reasons,
       'OPERATIONAL' AS json_status FROM shifted""")
def _(t):
    shifted = t.logs.withColumns({
        "http_response_code": F.col("response_time_ms") * 4,
        "response_time_ms": F.col("response_time_ms") - 60,
        "json_status": F.nullif("json_status", F.lit("OPERATIONAL")),
    })
    valid, rejected = quality.split_rows(shifted)
    return valid.select("log_id", F.lit(True).alias("accepted"), F.lit("").alias("reasons"), "json_status").union(
        rejected.select("log_id", F.lit(False), F.array_join("reasons", "; "), "json_status")
    )


@query("fi3_anomaly_predicate", "SELECT log_id, node_id FROM logs WHERE (200 - response_time_ms) / 1000.0::DOUBLE < 0")
def _(t):
    return _ids(anom.below_threshold(t.rule_scored))


@query("fi4_critical_nodes", "SELECT node_uuid, serial_number, log_count FROM heat WHERE risk_level = 'CRITICAL'")
def _(t):
    shown = reports.heatmap(t.logs, t.anomalies, t.nodes)
    return shown.filter("risk_level = 'CRITICAL'").select("node_uuid", "serial_number", "log_count")


@query("fi5_id_ranges", """
SELECT log_id, CASE WHEN log_id < 5000 THEN 'v1' ELSE 'v2' END AS slice FROM logs""")
def _(t):
    part = lambda name, *ends: windows.id_range(t.logs, *ends).select("log_id", F.lit(name).alias("slice"))
    return part("v1", 0, S.WINDOW).union(part("v2", S.WINDOW))


_STATUS = """
SELECT node_uuid, serial_number, is_infected, http_response_code AS last_http_code,
       response_time_ms AS last_response_time_ms,
       CASE WHEN http_response_code = 200 THEN 'HEALTHY' WHEN http_response_code = 206 THEN 'PARTIAL'
            WHEN http_response_code = 429 THEN 'THROTTLED' WHEN http_response_code >= 500 THEN 'CRITICAL'
            ELSE 'UNKNOWN' END AS true_status, json_status,
       CAST((log_id // 5000) % 2 + 1 AS INT) AS active_schema_version,
       CASE WHEN (log_id // 5000) % 2 = 1 THEN l_v1 ELSE load_val END AS effective_load
FROM nodes JOIN latest ON node_uuid = node_id WHERE node_uuid = {}"""


@query("fi6_node_lookup", _STATUS.format("(SELECT min(node_id) FROM logs)"))
def _(t):
    return reports.node_status(t.logs, t.nodes, t.logs.agg(F.min("node_id")).first()[0])


@query("fi7_alert_lines", "SELECT log_id, http_response_code <> 200 AS highlighted FROM logs")
def _(t):
    return t.logs.select("log_id", X.is_alert_line().alias("highlighted"))


# Joins ----------------------------------------------------------------------

_CITY_MAP = """
SELECT node_uuid, serial_number,
       CASE WHEN http_response_code = 200 THEN 'HEALTHY' WHEN http_response_code = 206 THEN 'PARTIAL'
            WHEN http_response_code = 429 THEN 'THROTTLED' ELSE 'CRITICAL' END AS http_status_label,
       http_response_code, node_uuid IN (SELECT node_id FROM flagged) AS is_infected
FROM nodes JOIN latest ON node_uuid = node_id"""


@query("jo1_map_join", "SELECT node_uuid, serial_number, http_response_code FROM nodes JOIN latest ON node_uuid = node_id")
def _(t):
    return reports.city_map(t.logs, t.nodes, t.anomalies).select("node_uuid", "serial_number", "http_response_code")


@query("jo2_all_nodes_join", _DASHBOARD_NODES.format(""))
def _(t):
    return reports.dashboard_nodes(t.logs, t.nodes, t.anomalies)


@query("jo3_risk_join", """
SELECT s.node_id AS node_uuid, coalesce(n.serial_number, 'UNKNOWN') AS serial_number, anomaly_hit_count
FROM (SELECT node_uuid AS node_id, anomaly_hit_count FROM risk) s
LEFT JOIN (SELECT * FROM nodes WHERE NOT is_infected) n ON n.node_uuid = s.node_id""")
def _(t):
    return reports.node_risk(t.logs, t.anomalies, t.clean_nodes).select(
        "node_uuid", "serial_number", "anomaly_hit_count"
    )


@query("jo4_feature_label_join", "SELECT node_id, log_count, is_infected FROM features")
def _(t):
    return t.node_features.select("node_id", "log_count", "is_infected")


@query("jo5_known_nodes", """
SELECT log_id, node_id, node_id IN (SELECT node_uuid FROM nodes WHERE NOT is_infected) AS known FROM logs""")
def _(t):
    known = quality.known_nodes_only(t.logs, t.clean_nodes)
    unknown = quality.unknown_nodes_only(t.logs, t.clean_nodes)
    return _ids(known).withColumn("known", F.lit(True)).union(_ids(unknown).withColumn("known", F.lit(False)))


@query("jo6_orphans", """
SELECT DISTINCT node_id FROM logs WHERE node_id NOT IN (SELECT node_uuid FROM nodes WHERE NOT is_infected)""")
def _(t):
    return quality.orphan_node_ids(t.logs, t.clean_nodes)


@query("jo7_window_flag", "SELECT node_uuid, node_uuid IN (SELECT node_id FROM flagged) AS window_flagged FROM nodes")
def _(t):
    return reports.with_window_flag(t.nodes, t.anomalies, t.logs).select("node_uuid", "window_flagged")


@query("jo8_asof_schema", "SELECT log_id, active_column FROM logs ASOF LEFT JOIN config ON log_id >= time_start")
def _(t):
    return asof.resolve_active_column(t.logs, t.config).select("log_id", "active_column")


@query("jo8_asof_long_config", """
SELECT log_id, active_column FROM logs ASOF LEFT JOIN (
  SELECT log_id AS time_start, concat('column_', (response_time_ms % 7)::VARCHAR) AS active_column FROM logs WHERE log_id % 3 = 1
) c ON log_id >= time_start""")
def _(t):
    """A config that changes with every third log, merged by range."""
    column = F.concat(F.lit("column_"), (F.col("response_time_ms") % 7).cast("string"))
    config = t.logs.where("log_id % 3 = 1").select(F.col("log_id").alias("time_start"), column.alias("active_column"))
    return asof.resolve_active_column(t.logs, config).select("log_id", "active_column")


@query("jo9_active_version", """
SELECT version AS current_version, active_column AS current_column FROM config, top
ORDER BY CASE WHEN version = (max_id // 5000) % 2 + 1 THEN 0 ELSE 1 END, time_start LIMIT 1""")
def _(t):
    version = X.load_version(F.lit(windows.snapshot(t.logs)))
    return asof.active_version(t.config, version)


@query("jo10_scores_with_label", """
SELECT log_id, node_id, (200 - response_time_ms) / 1000.0::DOUBLE AS anomaly_score, is_infected
FROM logs JOIN nodes ON node_uuid = node_id""")
def _(t):
    return audit.scores_with_label(t.rule_scored.select("log_id", "node_id", "anomaly_score"), t.nodes)


@query("jo11_state_merge", """
SELECT node_uuid, coalesce(l.node_id IN (SELECT node_id FROM flagged), is_infected) AS is_infected,
       coalesce(http_response_code, 0) AS last_http_code, coalesce(json_status, 'UNSEEN') AS reported_json
FROM nodes LEFT JOIN latest l ON node_uuid = l.node_id WHERE is_infected""")
def _(t):
    before = t.nodes.filter("is_infected").select(
        "node_uuid", "is_infected", F.lit(0).alias("last_http_code"), F.lit("UNSEEN").alias("reported_json")
    )
    seen = t.logs.select(F.col("node_id").alias("node_uuid"))
    update = reports.dashboard_nodes(t.logs, t.nodes, t.anomalies).withColumnRenamed("id", "node_uuid")
    return changes.merge_node_state(before, update.join(seen, "node_uuid", "left_semi"))


# Aggregations ---------------------------------------------------------------

@query("ag1_max_log_id", "SELECT coalesce(max(log_id), 0) AS max_log_id FROM logs")
def _(t):
    return windows.max_log_id(t.logs)


_INVENTORY = "SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM logs) AS total_logs"


@query("ag2_inventory_counts", _INVENTORY)
def _(t):
    return reports.inventory(t.nodes, t.logs)


@query("ag3_node_latency", """
SELECT node_id, round(avg(response_time_ms), 9) AS avg_rt, max(response_time_ms) AS max_rt,
       round(quantile_cont(response_time_ms, 0.95), 9) AS p95_rt, count(*) AS log_count FROM logs GROUP BY node_id""")
def _(t):
    return _rounded(latency.node_latency(t.logs), "avg_rt", "p95_rt")


@query("ag4_anomaly_hits", """
SELECT node_id, count(*) AS hit_count FROM anomalies, top WHERE log_id >= greatest(0, max_id - 5000) GROUP BY node_id""")
def _(t):
    return anom.hits_per_node(windows.trailing(t.anomalies, t.logs))


_TOTALS = "SELECT count(*) AS total_anomalies, count(DISTINCT node_id) AS unique_nodes_flagged FROM anomalies"


@query("ag5_anomaly_totals", _TOTALS)
def _(t):
    return anom.anomaly_totals(t.anomalies)


@query("ag6_window_threats", """
SELECT count(DISTINCT node_id) AS active_threats, count(*) AS total_anomalies
FROM anomalies, top WHERE log_id >= (max_id // 5000) * 5000""")
def _(t):
    return anom.window_threats(t.anomalies, t.logs)


@query("ag7_cloned_identities", """
SELECT serial_number, clone_count, CAST(infected_count AS BIGINT) AS infected_count, node_uuids FROM clones""")
def _(t):
    found = clones.cloned_identities(t.nodes)
    return found.select("serial_number", "clone_count", "infected_count", F.array_join("node_uuids", ",").alias("node_uuids"))


_CLONE_TOTALS = """
SELECT count(*) AS total_cloned_serials, CAST(coalesce(sum(clone_count), 0) AS BIGINT) AS total_affected_nodes FROM clones"""


@query("ag8_clone_totals", _CLONE_TOTALS)
def _(t):
    return clones.clone_totals(t.nodes)


_FEATURES = """
SELECT node_id, round(avg_response_time_ms, 9) AS avg_response_time_ms, max_response_time_ms,
       round(p95_response_time_ms, 9) AS p95_response_time_ms, round(throttled_ratio, 9) AS throttled_ratio,
       round(partial_ratio, 9) AS partial_ratio, round(avg_load, 12) AS avg_load, log_count, is_infected FROM features"""


@query("ag9_node_features", _FEATURES)
def _(t):
    found = t.node_features.withColumn("avg_load", F.round("avg_load", 12))
    return _rounded(found, "avg_response_time_ms", "p95_response_time_ms", "throttled_ratio", "partial_ratio")


@query("ag10_distributions", """
SELECT 'code' AS kind, CAST(http_response_code AS VARCHAR) AS item, count(*) AS log_count FROM logs GROUP BY 2
UNION ALL SELECT 'label', CASE WHEN http_response_code = 200 THEN 'HEALTHY' WHEN http_response_code = 206 THEN 'PARTIAL'
  WHEN http_response_code = 429 THEN 'THROTTLED' WHEN http_response_code >= 500 THEN 'CRITICAL' ELSE 'UNKNOWN' END,
  count(*) FROM logs GROUP BY 2""")
def _(t):
    codes = jobs.code_distribution(t.logs).select(
        F.lit("code").alias("kind"), F.col("http_response_code").cast("string").alias("item"), "log_count"
    )
    return codes.union(jobs.label_distribution(t.logs).select(F.lit("label"), "http_status_label", "log_count"))


@query("ag11_registry_summary", """
SELECT count(*) AS total_nodes, CAST(sum(CAST(is_infected AS INT)) AS BIGINT) AS infected_nodes,
       round(avg(CAST(is_infected AS INT)), 9) AS infected_rate FROM nodes""")
def _(t):
    return _rounded(jobs.registry_summary(t.nodes), "infected_rate")


@query("ag12_median_load", "SELECT round(median(effective_load), 9) AS median_load FROM loaded")
def _(t):
    fill = features.median_load(t.loaded)
    return windows.max_log_id(t.logs).select(F.round(F.lit(fill), 9).alias("median_load"))


_FEATURE_SQL = ["response_time_ms", "http_response_code", "effective_load", "is_throttled", "is_partial"]
_DEVIATION = "CASE WHEN stddev_pop({0}) = 0 THEN 1.0 ELSE stddev_pop({0}) END"


@query("ag13_scaler_stats", "SELECT count(*) AS row_count, " + ", ".join(
    f"round(avg({c}), 9) AS {c}_mean, round({_DEVIATION.format(c)}, 9) AS {c}_std" for c in _FEATURE_SQL
) + " FROM log_features")
def _(t):
    stats = features.scaler_stats(t.log_features)
    return _rounded(stats, *[c for c in stats.columns if c != "row_count"])


@query("ag14_flag_rate", """
SELECT count(*) AS log_count, CAST(sum(CAST(response_time_ms > 200 AS INT)) AS BIGINT) AS anomaly_count,
       round(avg(CAST(response_time_ms > 200 AS INT)), 9) AS flag_rate FROM logs""")
def _(t):
    return _rounded(anom.flag_rate(t.rule_scored), "flag_rate")


@query("ag15_class_balance", """
SELECT CAST(sum(CAST(is_infected AS INT)) AS BIGINT) AS positives,
       CAST(sum(1 - CAST(is_infected AS INT)) AS BIGINT) AS negatives,
       round(CASE WHEN sum(CAST(is_infected AS INT)) > 0
             THEN sum(1 - CAST(is_infected AS INT)) / sum(CAST(is_infected AS INT))::DOUBLE ELSE 1.0 END, 9) AS positive_weight
FROM features""")
def _(t):
    return _rounded(classify.class_balance(t.node_features), "positive_weight")


@query("ag16_ingest_summary", """
SELECT is_infected, count(*) AS ingested_count, CAST(sum(CAST(response_time_ms > 200 AS INT)) AS BIGINT) AS anomalies_detected,
       concat('Successfully ingested ', count(*)::VARCHAR, ' logs.') AS message
FROM logs JOIN nodes ON node_uuid = node_id GROUP BY is_infected""")
def _(t):
    labelled = audit.scores_with_label(t.rule_scored, t.nodes)
    counted = labelled.groupBy("is_infected").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("anomaly_score") < 0).cast("long")).alias("bad")
    )
    return counted.select("is_infected", *jobs.ingest_summary(F.col("n"), F.col("bad")))


@query("ag17_clone_infection_rate", """
SELECT 'cloned' AS scope, count(*) AS node_count, round(avg(CAST(is_infected AS INT)), 9) AS infected_rate
FROM nodes WHERE serial_number IN (SELECT serial_number FROM clones)
UNION ALL SELECT 'all', count(*), round(avg(CAST(is_infected AS INT)), 9) FROM nodes""")
def _(t):
    return _rounded(clones.clone_infection_rates(t.nodes), "infected_rate")


@query("ag18_score_by_label", """
SELECT is_infected, round(avg((200 - response_time_ms) / 1000.0::DOUBLE), 9) AS mean_score, count(*) AS log_count
FROM logs JOIN nodes ON node_uuid = node_id GROUP BY is_infected""")
def _(t):
    return _rounded(audit.scores_by_label(t.rule_scored, t.nodes), "mean_score")


@query("ag19_anomalies_per_window", """
SELECT log_id // 5000 AS window_id, count(*) AS log_count,
       CAST(sum(CAST(response_time_ms > 200 AS INT)) AS BIGINT) AS anomaly_count FROM logs GROUP BY 1""")
def _(t):
    return anom.flag_counts_by_window(t.rule_scored.withColumn("window_id", X.window_id()))


@query("ag20_quality_checks", """
SELECT 'latency_out_of_range' AS check_name, count(*) AS violations FROM logs WHERE response_time_ms NOT BETWEEN 0 AND 10000
UNION ALL SELECT 'json_status_not_operational', count(*) FROM logs WHERE json_status <> 'OPERATIONAL'
UNION ALL SELECT 'unexpected_http_code', count(*) FROM logs WHERE http_response_code NOT IN (200, 206, 429)
UNION ALL SELECT 'load_in_inactive_column', count(*) FROM logs
  WHERE (log_id < 5000 AND l_v1 IS NOT NULL) OR (log_id >= 5000 AND load_val IS NOT NULL)
UNION ALL SELECT 'duplicate_log_id', count(*) - count(DISTINCT log_id) FROM logs
UNION ALL SELECT 'serial_without_prefix', count(*) FROM nodes WHERE serial_number NOT LIKE 'SN-%'
UNION ALL SELECT 'log_node_not_in_registry', count(DISTINCT node_id) FROM logs WHERE node_id NOT IN (SELECT node_uuid FROM nodes)""")
def _(t):
    return quality.quality_report(t.logs, t.nodes)


@query("ag20_duplicate_ids", """
SELECT CAST(count(*) FILTER (WHERE log_id % 97 = 5) + 2 * count(*) FILTER (WHERE log_id % 1000 = 64) AS BIGINT) AS duplicate_log_id FROM logs""")
def _(t):
    """Ids that were delivered again, some of them twice."""
    again = t.logs.where("log_id % 97 = 5"), t.logs.where("log_id % 1000 = 64")
    return quality.duplicate_ids(t.logs.union(again[0]).union(again[1]).union(again[1]))


# Greatest per group ---------------------------------------------------------

@query("wn1_latest_log", "SELECT node_id, log_id, http_response_code, json_status, response_time_ms FROM latest")
def _(t):
    return latest.latest_per_node(t.logs, ["http_response_code", "json_status", "response_time_ms"])


@query("wn2_clone_members", """
SELECT node_uuid, serial_number, is_infected FROM nodes WHERE serial_number IN (SELECT serial_number FROM clones)""")
def _(t):
    return clones.clone_members(t.nodes).select("node_uuid", "serial_number", "is_infected")


_HEAT_COLUMNS = ", ".join(reports.HEATMAP_COLUMNS)


@query("wn3_stratified_top", "SELECT node_uuid, risk_level, CAST(rn AS INT) AS stratum_rank FROM heat")
def _(t):
    picked = topk.stratified_top(reports.node_risk(t.logs, t.anomalies, t.nodes))
    return picked.select("node_uuid", "risk_level", "stratum_rank")


# Order and pages ------------------------------------------------------------

@query("sl1_latency_order", f"SELECT {_HEAT_COLUMNS} FROM risk ORDER BY avg_response_time_ms DESC, node_uuid")
def _(t):
    return reports.node_risk(t.logs, t.anomalies, t.nodes).orderBy(F.desc("avg_response_time_ms"), "node_uuid")


@query("sl2_dashboard_cap", f"SELECT {_HEAT_COLUMNS} FROM heat LIMIT 30")
def _(t):
    return reports.heatmap(t.logs, t.anomalies, t.nodes).limit(30)


@query("sl3_registry_page", """
SELECT node_uuid, user_agent, serial_number, is_infected FROM nodes ORDER BY node_uuid LIMIT 100 OFFSET 50""")
def _(t):
    return topk.registry_page(t.nodes, 50, 100)


@query("sl3_registry_page_keyset", """
SELECT node_uuid, user_agent, serial_number, is_infected FROM nodes WHERE node_uuid > 49 ORDER BY node_uuid LIMIT 100""")
def _(t):
    page = topk.page_after(t.nodes, "node_uuid", 49, 100)
    return page.select("node_uuid", "user_agent", "serial_number", "is_infected")


@query("sl4_anomaly_page", """
SELECT node_id, log_id, anomaly_score, detector FROM anomalies ORDER BY anomaly_score, log_id LIMIT 200""")
def _(t):
    return topk.anomaly_page(t.anomalies).drop("detected_at")


@query("sl5_latest_logs", "SELECT log_id, node_id, http_response_code FROM logs ORDER BY log_id DESC LIMIT 50")
def _(t):
    return topk.latest_logs(t.logs, 50).select("log_id", "node_id", "http_response_code")


@query("sl6_latest_log_of_node", """
SELECT log_id, node_id, http_response_code FROM logs WHERE node_id = (SELECT max(node_id) FROM logs)
ORDER BY log_id DESC LIMIT 1""")
def _(t):
    node = t.logs.agg(F.max("node_id")).scalar()
    found = topk.latest_logs(t.logs.filter(F.col("node_id") == node), 1)
    return found.select("log_id", "node_id", "http_response_code")


@query("sl7_clones_by_count", "SELECT serial_number, clone_count FROM clones ORDER BY clone_count DESC, serial_number")
def _(t):
    return reports.clone_report(t.nodes)[1].select("serial_number", "clone_count")


_VERSIONS = """
SELECT version, active_column, time_start, version = (max_id // 5000) % 2 + 1 AS is_current
FROM config, top ORDER BY time_start"""


@query("sl8_schema_versions", _VERSIONS)
def _(t):
    return reports.schema_console(t.logs, t.config)[1]


@query("sl9_table_view", "SELECT node_uuid, serial_number FROM nodes ORDER BY node_uuid LIMIT 150")
def _(t):
    return topk.table_view(t.nodes.select("node_uuid", "serial_number"), "node_uuid", steps=3)


# Set operations -------------------------------------------------------------

def _detected(t, version):
    """Nodes caught while one layout version was live."""
    return audit.detected_nodes(t.rule_scored.filter(X.load_version() == version), -0.1)


_CAUGHT = "(SELECT DISTINCT node_id FROM logs WHERE (log_id // 5000) % 2 = {} AND response_time_ms > 300)"
_V1, _V2 = _CAUGHT.format(0), _CAUGHT.format(1)
_TRUTH = "(SELECT node_uuid AS node_id FROM nodes WHERE is_infected)"


@query("so1_detected_nodes", f"SELECT node_id FROM {_V1} x")
def _(t):
    return _detected(t, 1)


@query("so2_correct_hits", f"SELECT node_id FROM {_V1} x INTERSECT SELECT node_id FROM {_TRUTH} y")
def _(t):
    return audit.correct_hits(_detected(t, 1), audit.truth_nodes(t.nodes))


@query("so3_missed_nodes", f"SELECT node_id FROM {_TRUTH} x EXCEPT SELECT node_id FROM {_V2} y")
def _(t):
    return audit.missed_nodes(_detected(t, 2), audit.truth_nodes(t.nodes))


@query("so4_all_detected", f"SELECT node_id FROM {_V1} x UNION SELECT node_id FROM {_V2} y")
def _(t):
    return audit.all_detected(_detected(t, 1), _detected(t, 2))


@query("so5_coverage", f"""
WITH d AS (SELECT 'v1' AS scope, node_id FROM {_V1} a UNION ALL SELECT 'v2', node_id FROM {_V2} b
           UNION ALL SELECT 'total', node_id FROM (SELECT node_id FROM {_V1} c UNION SELECT node_id FROM {_V2} e) u),
truth AS (SELECT node_id FROM {_TRUTH} f)
SELECT scope, count(d.node_id) AS detected, count(t.node_id) AS correct,
       (SELECT count(*) FROM truth) - count(t.node_id) AS missed, (SELECT count(*) FROM truth) AS truth,
       round(100.0 * count(t.node_id) / (SELECT count(*) FROM truth)::DOUBLE, 9) AS coverage_pct
FROM (VALUES ('v1'), ('v2'), ('total')) s(scope) LEFT JOIN d USING (scope)
LEFT JOIN truth t ON t.node_id = d.node_id GROUP BY scope""")
def _(t):
    caught = t.rule_scored.filter("anomaly_score < -0.1")
    return _rounded(audit.coverage_report(caught, t.nodes), "coverage_pct")


@query("so6_strata_order", """
SELECT row_number() OVER (ORDER BY CASE risk_level WHEN 'CRITICAL' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, rn)
       AS position, node_uuid, risk_level FROM heat""")
def _(t):
    picked = topk.stratified_top(reports.node_risk(t.logs, t.anomalies, t.nodes))
    numbered = numbering.number_rows(picked, "position", 1, ["stratum_order", "stratum_rank"])
    return numbered.select("position", "node_uuid", "risk_level")


# Streaming ------------------------------------------------------------------

@query("st1_stream_ingest", f"SELECT {_LOG_COLUMNS} FROM logs")
def _(t):
    sink = t.run_ingest(t.event_stream())
    return sink.read(t.spark, "logs").drop("ingested_at", "batch_id")


@query("st2_validated_micro_batch", """
SELECT log_id, node_id, CASE WHEN node_id IN (SELECT node_uuid FROM nodes WHERE NOT is_infected)
       THEN 'stored' ELSE 'unknown node' END AS outcome FROM logs""")
def _(t):
    sink = t.run_ingest(t.event_stream(), nodes=t.clean_nodes, forest=t.forest)
    stored = _ids(sink.read(t.spark, "logs")).withColumn("outcome", F.lit("stored"))
    rejected = sink.read(t.spark, "rejected")
    return stored.union(rejected.select("log_id", "node_id", F.array_join("reasons", "; ")))


def _in_batches(logs, batches):
    """Logs dealt by id to so many batches of consecutive ids."""
    size = logs.agg(F.max("log_id")).first()[0] // batches + 1
    place = F.call_function("div", F.col("log_id"), F.lit(size).cast("long"))
    return [logs.filter(place == i) for i in range(batches)]


@query("st2_compacted_batches", f"""
SELECT {_LOG_COLUMNS}, batch_id, true AS few_parts FROM (
  SELECT *, log_id // (max_id // 9 + 1) AS batch_id FROM logs, top) l""")
def _(t):
    """Nine batches with compaction of every two parts: all rows, few folders."""
    sink = ingest.Sink(t.scratch("sink"), fan_in=2)
    for number, batch in enumerate(_in_batches(t.logs, 9)):
        ingest.ingest_batch(batch, number, sink)
    parts = [p for p in sink.snapshot(t.spark)["parts"] if p["table"] == "logs"]
    return sink.read(t.spark, "logs").drop("ingested_at").withColumn("few_parts", F.lit(len(parts) <= 4))


@query("st3_assigned_ids", """
SELECT row_number() OVER (ORDER BY ingested_at, node_id) + 99 AS log_id, node_id, response_time_ms FROM logs""")
def _(t):
    source = t.event_stream().drop("log_id")
    sink = t.run_ingest(source, order_by=["ingested_at", "node_id"], first_id=100)
    return sink.read(t.spark, "logs").select("log_id", "node_id", "response_time_ms")


@query("st4_tumbling_windows", """
SELECT log_id // 5000 AS window_id, count(*) AS log_count, min(log_id) AS first_log_id, max(log_id) AS last_log_id
FROM logs GROUP BY 1""")
def _(t):
    return ingest.committed_window_totals(t.spark, t.run_ingest(t.event_stream()))


@query("st5_trailing_window", "SELECT log_id, node_id FROM logs, top WHERE log_id >= greatest(0, max_id - 5000)")
def _(t):
    return _ids(t.run_ingest(t.event_stream()).trailing(t.spark))


@query("st5_trailing_latency", """
SELECT node_id, round(avg(response_time_ms), 9) AS avg_rt, CAST(max(response_time_ms) AS BIGINT) AS max_rt,
       round(quantile_cont(response_time_ms, 0.95), 9) AS p95_rt, count(*) AS log_count
FROM logs, top WHERE log_id >= greatest(0, max_id - 5000) GROUP BY node_id""")
def _(t):
    """From histograms that the ingest keeps for every 2,000 ids."""
    found = t.run_ingest(t.event_stream(), sink=ingest.Sink(t.scratch("sink"), block=2000)).trailing_latency(t.spark)
    return _rounded(found, "avg_rt", "p95_rt")


@query("st6_rotating_load", """
SELECT log_id, CAST((log_id // 5000) % 2 + 1 AS INT) AS schema_version,
       coalesce(CASE WHEN (log_id // 5000) % 2 = 1 THEN l_v1 END, load_val) AS load FROM logs""")
def _(t):
    path = t.scratch("loads")
    ingest.with_rotating_load(t.event_stream()).select("log_id", "schema_version", "load").writeStream.format(
        "parquet"
    ).option("checkpointLocation", t.scratch("stream")).trigger(availableNow=True).start(path).awaitTermination()
    return t.spark.read.parquet(path)


@query("st7_incremental_read", """
SELECT log_id, node_id, http_response_code <> 200 AS highlighted FROM logs, top WHERE log_id > max_id // 2 ORDER BY log_id""")
def _(t):
    seen = windows.snapshot(t.logs) // 2
    return windows.above(t.logs, seen).select("log_id", "node_id", X.is_alert_line().alias("highlighted"))


@query("st8_rotation_events", """
SELECT window_id, previous_version, version FROM (
  SELECT window_id, version, lag(version) OVER (ORDER BY window_id) AS previous_version
  FROM (SELECT DISTINCT log_id // 5000 AS window_id, CAST((log_id // 5000) % 2 + 1 AS INT) AS version FROM logs) w) v
WHERE version <> previous_version""")
def _(t):
    return changes.rotation_events(t.logs)


@query("st8_rotation_events_stream", """
SELECT window_id, CAST(3 - version AS INT) AS previous_version, version FROM (
  SELECT DISTINCT log_id // 5000 AS window_id, CAST((log_id // 5000) % 2 + 1 AS INT) AS version FROM logs) w
WHERE window_id > 0""")
def _(t):
    return ingest.committed_rotations(t.spark, t.run_ingest(t.event_stream()))


@query("st9_anomaly_increase", """
SELECT refresh, CAST(total AS BIGINT) AS total, CAST(coalesce(before, 0) AS BIGINT) AS previous_total,
       CAST(total - coalesce(before, 0) AS BIGINT) AS increase FROM (
  SELECT refresh, total, lag(total) OVER (ORDER BY refresh) AS before FROM (
    SELECT refresh, sum(n) OVER (PARTITION BY refresh // 5 ORDER BY refresh) AS total FROM (
      SELECT log_id // 1000 AS refresh, count(*) AS n FROM anomalies GROUP BY 1) a) b) c
WHERE total > coalesce(before, 0)""")
def _(t):
    refresh = F.call_function("div", F.col("log_id"), F.lit(1000).cast("long"))
    counts = t.anomalies.groupBy(refresh.alias("refresh")).agg(F.count(F.lit(1)).alias("n"))
    in_window = Window.partitionBy(F.call_function("div", F.col("refresh"), F.lit(5).cast("long"))).orderBy("refresh")
    totals = counts.select("refresh", F.sum("n").over(in_window).alias("total"))
    return changes.increases(totals, "refresh", "total")


@query("st10_latest_state_stream", "SELECT node_id, log_id, http_response_code, json_status FROM latest")
def _(t):
    root = t.scratch("state")
    state.stream_latest_state(t.event_stream(), root, t.scratch("stream")).awaitTermination()
    return state.read_latest_state(t.spark, root)


@query("st11_repeat_free_stream", "SELECT log_id, node_id FROM logs")
def _(t):
    path = t.scratch("once")
    once = ingest.drop_repeats(t.event_stream().union(t.event_stream()))
    _ids(once).writeStream.format("parquet").option("checkpointLocation", t.scratch("stream")).trigger(
        availableNow=True
    ).start(path).awaitTermination()
    return t.spark.read.parquet(path)


# Detection models -----------------------------------------------------------

@query("ml1_log_features", "SELECT * REPLACE (round(effective_load, 9) AS effective_load) FROM log_features")
def _(t):
    return t.log_features.withColumn("effective_load", F.round("effective_load", 9))


@query("ml2_standardised_features", "SELECT log_id, node_id, " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM log_features)) / (SELECT {_DEVIATION.format(c)} FROM log_features), 9) AS {c}"
    for c in _FEATURE_SQL
) + " FROM log_features")
def _(t):
    scaled = features.standardise(t.log_features, features.scaler_stats(t.log_features))
    return _rounded(scaled, *_FEATURE_SQL)


@query("ml3_fit_forest")
def _(t):
    return t.forest.trees


@query("ml3_forest_shape", """
SELECT CAST(range AS INT) AS tree_id, least(256, (SELECT count(*) FROM logs)) AS root_size,
       least(256, (SELECT count(*) FROM logs)) AS leaf_total, true AS splits_have_two_children FROM range(200)""")
def _(t):
    """Each tree holds a full sample and every row of it ends in one leaf."""
    leaf = F.col("feature") < 0
    return t.forest.trees.groupBy("tree_id").agg(
        F.max(F.when(F.col("slot") == 0, F.col("leaf_size"))).alias("root_size"),
        F.sum(F.when(leaf, F.col("leaf_size"))).alias("leaf_total"),
        (F.count_if(leaf) == F.count_if(~leaf) + 1).alias("splits_have_two_children"),
    )


@query("ml4_score_batch")
def _(t):
    return _rounded(t.scored, "anomaly_score")


# Scores are a model's own, but the share they flag is set by the contamination.
@query("ml4_flag_share", "SELECT count(*) AS log_count, true AS near_contamination, true AS scores_in_range FROM logs")
def _(t):
    score = F.col("anomaly_score") + F.lit(t.forest.offset)
    return t.scored.agg(
        F.count(F.lit(1)).alias("log_count"),
        (F.abs(F.avg(F.col("is_anomaly").cast("int")) - S.CONTAMINATION) < 0.002).alias("near_contamination"),
        F.every(score.between(-1, 0)).alias("scores_in_range"),
    )


@query("ml5_score_single")
def _(t):
    newest = topk.latest_logs(t.loaded, 1)
    return forest.score_logs(newest, t.forest, fill=S.LOAD_FILL)


@query("ml5_single_is_batch", "SELECT max_id AS log_id, true AS same_score FROM top")
def _(t):
    """The newest log scores alone as it does among all others."""
    alone = forest.score_logs(topk.latest_logs(t.loaded, 1), t.forest, fill=S.LOAD_FILL)
    batch = forest.score_logs(t.loaded, t.forest, fill=S.LOAD_FILL).select("log_id", F.col("anomaly_score").alias("in_batch"))
    return alone.join(batch, "log_id").select("log_id", (F.col("anomaly_score") == F.col("in_batch")).alias("same_score"))


@query("ml5_suspicious_scores_lower", """
SELECT count(*) AS log_count, true AS suspicious_scores_lower FROM logs WHERE http_response_code = 200 AND response_time_ms <= 120""")
def _(t):
    """Quiet logs against the same logs made slow, throttled and loaded."""
    quiet = t.loaded.where("http_response_code = 200 AND response_time_ms <= 120")
    loud = quiet.withColumns({"response_time_ms": F.lit(250), "http_response_code": F.lit(429), "effective_load": F.lit(0.99)})
    before = forest.score_logs(quiet, t.forest).select("log_id", F.col("anomaly_score").alias("before"))
    return forest.score_logs(loud, t.forest).join(before, "log_id").agg(
        F.count(F.lit(1)).alias("log_count"), (F.avg("anomaly_score") < F.avg("before")).alias("suspicious_scores_lower"))


@query("ml6_train_classifier")
def _(t):
    weights = list(t.classifier.importances().items())
    return t.spark.createDataFrame(weights, "feature string, importance double")


# The first split of a fit, which any engine can find: the greatest gain over all
# quantile cuts, from gradients at even odds.
@query("ml6_first_split", f"""
WITH rows AS (
  SELECT node_id, is_infected, unnest({features.NODE_FEATURES}) AS feature,
    unnest(range({len(features.NODE_FEATURES)})) AS place, unnest([{', '.join(f'coalesce(CAST({c} AS DOUBLE), 0)' for c in features.NODE_FEATURES)}]) AS x
  FROM features
), balance AS (
  SELECT CASE WHEN count(*) FILTER (WHERE is_infected) > 0
    THEN count(*) FILTER (WHERE NOT is_infected) / count(*) FILTER (WHERE is_infected) ELSE 1.0 END AS w FROM features
), ranked AS (
  SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) AS r, count(*) OVER (PARTITION BY feature) AS n FROM rows
), cuts AS (
  SELECT DISTINCT feature, x AS cut FROM ranked, range(1, 256) t(k) WHERE r = (k * n + 255) // 256
), sums AS (
  SELECT feature, place, cut, sum(CASE WHEN x <= cut THEN g ELSE 0 END) AS gl, sum(CASE WHEN x <= cut THEN h ELSE 0 END) AS hl,
    sum(CASE WHEN x <= cut THEN 0 ELSE g END) AS gr, sum(CASE WHEN x <= cut THEN 0 ELSE h END) AS hr
  FROM (SELECT *, CASE WHEN is_infected THEN -0.5 * w ELSE 0.5 END AS g, CASE WHEN is_infected THEN 0.25 * w ELSE 0.25 END AS h
        FROM rows, balance) JOIN cuts USING (feature)
  GROUP BY feature, place, cut
), gains AS (
  SELECT *, (gl * gl / (hl + 1) + gr * gr / (hr + 1) - (gl + gr) * (gl + gr) / (hl + hr + 1)) / 2 AS gain
  FROM sums WHERE hl >= 1 AND hr >= 1
)
SELECT feature, round(cut, 6) AS threshold, round(gain, 6) AS gain, round(-{S.BOOST_RATE} * gl / (hl + 1), 6) AS left_value,
  round(-{S.BOOST_RATE} * gr / (hr + 1), 6) AS right_value
FROM gains WHERE gain > 1e-6 ORDER BY gain DESC, place, cut LIMIT 1""")
def _(t):
    model = classify.fit_classifier(t.stored_node_features, rounds=1, depth=1)
    tree = boosting.as_table(t.spark, model)
    of = lambda slot, column: F.max(F.when(F.col("slot") == slot, F.col(column)))
    split = tree.agg(of(0, "feature").alias("feature"), of(0, "threshold").alias("threshold"), of(0, "gain").alias("gain"),
                     of(1, "value").alias("left_value"), of(2, "value").alias("right_value")).where("feature IS NOT NULL")
    return _rounded(split, "threshold", "gain", "left_value", "right_value", digits=6)


@query("ml7_score_nodes")
def _(t):
    return classify.score_nodes(t.classifier, t.stored_node_features).select("node_id", "infected_prob", "predicted_infected")


@query("ml8_evaluate_classifier")
def _(t):
    scored = classify.score_nodes(t.classifier, t.stored_node_features)
    return classify.class_report(scored).withColumn("auc", F.lit(classify.auc(scored)))


@query("ml6_tree_shapes", f"""
SELECT CAST(range AS INT) AS round, true AS splits_have_two_children, true AS within_depth FROM range({S.BOOST_ROUNDS})""")
def _(t):
    """Every round of the fit has a binary tree of at most the depth asked for."""
    leaf = F.col("feature").isNull()
    return boosting.as_table(t.spark, t.classifier).groupBy("round").agg(
        (F.count_if(leaf) == F.count_if(~leaf) + 1).alias("splits_have_two_children"),
        (F.max("slot") < 2 ** (S.BOOST_DEPTH + 1) - 1).alias("within_depth"))


@query("ml7_chances", "SELECT node_id, true AS in_range, true AS cut_at_half FROM features")
def _(t):
    chance = F.col("infected_prob")
    return classify.score_nodes(t.classifier, t.stored_node_features).select(
        "node_id", chance.between(0, 1).alias("in_range"), (F.col("predicted_infected") == (chance >= 0.5)).alias("cut_at_half"))


@query("ml8_learned", """
SELECT CASE WHEN is_infected THEN 'Infected' ELSE 'Clean' END AS class, count(*) AS support, true AS better_than_chance
FROM features GROUP BY is_infected""")
def _(t):
    scored = classify.score_nodes(t.classifier, t.stored_node_features)
    return classify.class_report(scored).select("class", "support", F.lit(classify.auc(scored) > 0.5).alias("better_than_chance"))


@query("ml8_rank_auc", """
SELECT round(sum(CASE WHEN n.s < p.s THEN n.n * p.n WHEN n.s = p.s THEN n.n * p.n / 2 ELSE 0 END) / sum(n.n * p.n), 9) AS auc
FROM (SELECT round(avg_response_time_ms) AS s, count(*)::DOUBLE AS n FROM features WHERE is_infected GROUP BY 1) p,
     (SELECT round(avg_response_time_ms) AS s, count(*)::DOUBLE AS n FROM features WHERE NOT is_infected GROUP BY 1) n""")
def _(t):
    """Area under the curve of a score that any engine can make, with ties."""
    scored = t.node_features.withColumn("score", F.round("avg_response_time_ms"))
    return _rounded(classify.rank_auc(scored, score="score"), "auc")


# The same evaluation on a prediction any engine can make.
@query("ml8_class_report", """
WITH p AS (SELECT is_infected AS a, avg_response_time_ms > 140 AS p FROM features),
c AS (SELECT 'Clean' AS class, NOT a AS a, NOT p AS p FROM p UNION ALL SELECT 'Infected', a, p FROM p),
s AS (SELECT class, sum(CAST(a AND p AS INT)) AS hit, sum(CAST(p AS INT)) AS said, sum(CAST(a AS INT)) AS support FROM c GROUP BY class)
SELECT class, round(CASE WHEN said > 0 THEN hit / said::DOUBLE ELSE 0 END, 9) AS precision,
       round(CASE WHEN support > 0 THEN hit / support::DOUBLE ELSE 0 END, 9) AS recall,
       round(CASE WHEN said + support > 0 THEN 2 * hit / (said + support)::DOUBLE ELSE 0 END, 9) AS f1,
       CAST(support AS BIGINT) AS support FROM s""")
def _(t):
    guessed = t.node_features.withColumn("predicted_infected", F.col("avg_response_time_ms") > 140)
    return _rounded(classify.class_report(guessed), "precision", "recall", "f1")


@query("ml9_ground_truth_audit")
def _(t):
    return audit.coverage_report(t.scored.filter("is_anomaly"), t.nodes)


@query("ml9_audit_adds_up", """
SELECT unnest(['v1', 'v2', 'total']) AS scope, (SELECT count(*) FROM nodes WHERE is_infected) AS truth, true AS adds_up""")
def _(t):
    report = audit.coverage_report(t.scored.filter("is_anomaly"), t.nodes)
    fits = (F.col("correct") + F.col("missed") == F.col("truth")) & (F.col("correct") <= F.col("detected"))
    return report.select("scope", "truth", fits.alias("adds_up"))


# Rules ----------------------------------------------------------------------

@query("ru1_ddos_nodes", """
SELECT node_id, throttled, round((SELECT avg(throttled) FROM throttling), 9) AS mean_throttled
FROM throttling WHERE throttled > 5 * (SELECT avg(throttled) FROM throttling)""")
def _(t):
    return _rounded(rules.ddos_nodes(t.logs), "mean_throttled")


# A lower factor, so that evenly spread data has hits to compare.
@query("ru1_ddos_nodes_double", """
SELECT node_id, throttled, round((SELECT avg(throttled) FROM throttling), 9) AS mean_throttled
FROM throttling WHERE throttled > 2 * (SELECT avg(throttled) FROM throttling)""")
def _(t):
    return _rounded(rules.ddos_nodes(t.logs, factor=2), "mean_throttled")


@query("ru2_slow_logs", "SELECT log_id, node_id, response_time_ms FROM logs WHERE response_time_ms > 200")
def _(t):
    return rules.slow_logs(t.logs).select("log_id", "node_id", "response_time_ms")


@query("ru3_status_mismatch", "SELECT log_id, node_id, http_response_code FROM logs WHERE http_response_code <> 200")
def _(t):
    return rules.mismatched_logs(t.logs).select("log_id", "node_id", "http_response_code")


@query("ru4_infected_nodes", """
SELECT node_id, count(*) AS log_count FROM logs JOIN nodes ON node_uuid = node_id WHERE is_infected GROUP BY node_id""")
def _(t):
    return rules.infected_nodes_seen(t.logs, t.nodes)


@query("ru5_threat_alerts", "SELECT rule, node_id, coalesce(log_id, -1) AS log_id, severity, evidence FROM alerts")
def _(t):
    alerts = rules.threat_alerts(t.logs, t.nodes)
    return alerts.withColumn("log_id", F.coalesce("log_id", F.lit(-1)))


@query("ru6_threat_summary", """
SELECT 'rule' AS section, rule AS item, count(*) AS alert_count FROM alerts GROUP BY rule
UNION ALL SELECT * FROM (SELECT 'top_node', CAST(node_id AS VARCHAR), count(*) FROM alerts GROUP BY node_id
                         ORDER BY count(*) DESC, node_id LIMIT 5) x""")
def _(t):
    return rules.threat_summary(t.logs, t.nodes)


# Reports --------------------------------------------------------------------

@query("rp1_city_map", _CITY_MAP)
def _(t):
    return reports.city_map(t.logs, t.nodes, t.anomalies)


@query("rp2_heatmap", f"SELECT {_HEAT_COLUMNS} FROM heat")
def _(t):
    return reports.heatmap(t.logs, t.anomalies, t.nodes)


@query("rp3_schema_console", """
SELECT version AS current_version, active_column AS current_column, max_id AS latest_log_id FROM config, top
ORDER BY CASE WHEN version = (max_id // 5000) % 2 + 1 THEN 0 ELSE 1 END, time_start LIMIT 1""")
def _(t):
    return reports.schema_console(t.logs, t.config)[0]


@query("rp3_schema_versions", _VERSIONS)
def _(t):
    return reports.schema_console(t.logs, t.config)[1]


@query("rp4_asset_registry", """
SELECT node_uuid, user_agent, serial_number, is_infected FROM nodes ORDER BY node_uuid LIMIT 100""")
def _(t):
    return reports.asset_registry(t.nodes)


@query("rp5_node_status", _STATUS.format("(SELECT max(node_id) FROM logs)"))
def _(t):
    return reports.node_status(t.logs, t.nodes, t.logs.agg(F.max("node_id")).first()[0])


@query("rp6_anomaly_summary", _TOTALS)
def _(t):
    return reports.anomaly_report(t.anomalies)[0]


@query("rp6_anomaly_page", """
SELECT node_id, log_id, anomaly_score, detector FROM anomalies ORDER BY anomaly_score, log_id LIMIT 200 OFFSET 20""")
def _(t):
    return reports.anomaly_report(t.anomalies, 20)[1].drop("detected_at")


@query("rp7_dashboard_metadata", """
SELECT (SELECT strftime(ingested_at, '%Y-%m-%dT%H:%M:%S.%f') FROM logs, top WHERE log_id = max_id) AS latest_log_timestamp,
       (SELECT max_id FROM top) AS total_logs_processed, count(DISTINCT node_id) AS active_threats,
       count(*) AS total_anomalies, 'OPERATIONAL_SYNCED_STRATIFIED' AS status
FROM anomalies, top WHERE log_id >= (max_id // 5000) * 5000""")
def _(t):
    return reports.dashboard(t.logs, t.nodes, t.anomalies, t.config)["metadata"]


@query("rp7_dashboard_schema_engine", """
SELECT version AS current_version, active_column, printf('-%04d_PKTS', 5000 - max_id % 5000) AS rotation_timer,
       concat(active_column, '_LOCKED') AS sync_status FROM config, top
ORDER BY CASE WHEN version = (max_id // 5000) % 2 + 1 THEN 0 ELSE 1 END, time_start LIMIT 1""")
def _(t):
    return reports.dashboard(t.logs, t.nodes, t.anomalies, t.config)["schema_engine"]


@query("rp7_dashboard_nodes", _DASHBOARD_NODES.format(""))
def _(t):
    return reports.dashboard(t.logs, t.nodes, t.anomalies, t.config)["nodes"]


@query("rp7_dashboard_heatmap", f"SELECT {_HEAT_COLUMNS} FROM heat")
def _(t):
    return reports.dashboard(t.logs, t.nodes, t.anomalies, t.config)["heatmap"]


@query("rp7_dashboard_logs", """
SELECT log_id AS id, strftime(ingested_at, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, node_id,
       concat('Forensic Packet Recv: ', http_response_code::VARCHAR, ' | RT=', response_time_ms::VARCHAR, 'ms') AS message,
       CASE WHEN http_response_code = 200 THEN 'HEALTHY' WHEN http_response_code = 206 THEN 'PARTIAL'
            WHEN http_response_code = 429 THEN 'THROTTLED' WHEN http_response_code >= 500 THEN 'CRITICAL'
            ELSE 'UNKNOWN' END AS status, http_response_code AS http_code
FROM logs ORDER BY log_id DESC LIMIT 50""")
def _(t):
    return reports.dashboard(t.logs, t.nodes, t.anomalies, t.config, full=True)["terminal_logs"]


@query("rp8_clone_summary", _CLONE_TOTALS)
def _(t):
    return reports.clone_report(t.nodes)[0]


@query("rp8_cloned_identities", """
SELECT serial_number, clone_count, CAST(infected_count AS BIGINT) AS infected_count, node_uuids FROM clones
ORDER BY clone_count DESC, serial_number""")
def _(t):
    found = reports.clone_report(t.nodes)[1]
    return found.withColumn("node_uuids", F.array_join("node_uuids", ",")).drop("part")


@query("rp9_inventory", _INVENTORY)
def _(t):
    return reports.inventory(t.nodes, t.logs)


@query("rp10_bulk_ingest", """
SELECT count(*) AS ingested_count, concat('Successfully ingested ', count(*)::VARCHAR, ' logs.') AS message,
       count(*) AS next_id, true AS anomalies_recorded
FROM logs WHERE node_id IN (SELECT node_uuid FROM nodes WHERE NOT is_infected)""")
def _(t):
    sink = ingest.Sink(t.scratch("sink"))
    ingest.ingest_batch(t.logs.drop("log_id"), 0, sink, nodes=t.clean_nodes, forest=t.forest)
    recorded = sink.read(t.spark, "anomalies").agg(F.count(F.lit(1))).scalar()
    return sink.read(t.spark, "ledger").select(
        *jobs.ingest_summary(F.col("ingested_count"), F.col("anomaly_count")), "next_id",
        (F.col("anomaly_count") == recorded).alias("anomalies_recorded"),
    ).drop("anomalies_detected")


@query("rp11_training_job")
def _(t):
    path, found = t.trained
    models = jobs.load_models(t.spark, path)
    rate = anom.flag_rate(forest.score_logs(t.loaded, models.forest)).select("flag_rate").scalar()
    return found["classes"].withColumns({"auc": F.lit(found["auc"]), "flag_rate": rate})


@query("rp11_training_report", """
SELECT http_response_code, count(*) AS log_count, (SELECT count(*) FROM nodes) AS total_nodes,
       (SELECT count(*) FROM nodes WHERE is_infected) AS infected_nodes FROM logs GROUP BY http_response_code""")
def _(t):
    """What the training job reports of its input."""
    _, found = t.trained
    of = lambda column: found["registry"].select(column).scalar().alias(column)
    return found["codes"].select("http_response_code", "log_count", of("total_nodes"), of("infected_nodes"))


@query("rp12_seed_job", """
SELECT 'schema_config' AS table_name, count(*) AS added, 0::BIGINT AS added_again FROM config
UNION ALL SELECT 'nodes', count(*), 0 FROM nodes UNION ALL SELECT 'logs', count(*), 0 FROM logs""")
def _(t):
    root = t.scratch("tables")
    runs = [jobs.seed(t.nodes, t.logs, t.config, root) for _ in range(2)]
    rows = [(name, runs[0][name], runs[1][name]) for name in runs[0]]
    return t.spark.createDataFrame(rows, "table_name string, added long, added_again long")
