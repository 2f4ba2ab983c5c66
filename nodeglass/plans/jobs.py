"""Batch jobs: seeding, training, bulk ingest."""

from dataclasses import dataclass

from pyspark.sql import functions as F

from nodeglass import schemas, settings as S
from nodeglass.functions import http_label
from nodeglass.operators.classify import (
    auc, class_report, fit_classifier, load_classifier, save_classifier, score_nodes,
)
from nodeglass.operators.features import log_features, median_load, node_features, with_load
from nodeglass.operators.forest import anomaly_records, fit_forest, load_forest, save_forest, score_logs
from nodeglass.session import materialise
from nodeglass.sources.readers import read_table
from nodeglass.sources.writers import seed_anomalies, seed_logs, seed_nodes, seed_schema_config


def code_distribution(logs):
    return logs.groupBy("http_response_code").agg(F.count(F.lit(1)).alias("log_count"))


def label_distribution(logs):
    return logs.groupBy(http_label().alias("http_status_label")).agg(F.count(F.lit(1)).alias("log_count"))


def registry_summary(nodes):
    return nodes.agg(
        F.count(F.lit(1)).alias("total_nodes"),
        F.coalesce(F.sum(F.col("is_infected").cast("long")), F.lit(0)).alias("infected_nodes"),
        F.avg(F.col("is_infected").cast("double")).alias("infected_rate"),
    )


@dataclass
class Models:
    forest: object
    classifier: object


def save_models(models, path):
    save_forest(models.forest, f"{path}/forest")
    save_classifier(models.forest.trees.sparkSession, models.classifier, f"{path}/classifier")


def load_models(spark, path):
    forest = load_forest(spark, f"{path}/forest")
    return Models(forest, load_classifier(spark, f"{path}/classifier"))


def train(logs, nodes, path=None, policy="effective", mode="cyclic", window=S.WINDOW,
          trees=S.FOREST_TREES, contamination=S.CONTAMINATION, rounds=S.BOOST_ROUNDS, seed=S.SEED):
    """Fit both models; returns them with the report tables of the run."""
    loaded = with_load(logs, policy, mode, window)
    fill = median_load(loaded)
    fill = S.LOAD_FILL if fill is None else fill
    forest = fit_forest(log_features(loaded, fill), fill, trees=trees, contamination=contamination, seed=seed)
    table = materialise(node_features(loaded, nodes))
    classifier = fit_classifier(table, rounds=rounds)
    scored = materialise(score_nodes(classifier, table))
    models = Models(forest, classifier)
    if path:
        save_models(models, path)
    return models, {
        "registry": registry_summary(nodes),
        "codes": code_distribution(logs),
        "labels": label_distribution(logs),
        "classes": class_report(scored),
        "auc": auc(scored),
    }


def seed_anomaly_history(logs, forest, path, policy="effective", mode="step", window=S.WINDOW):
    """Score all stored logs and add the records not there yet; the count added."""
    scored = score_logs(with_load(logs, policy, mode, window), forest)
    return seed_anomalies(anomaly_records(scored), path)


def seed(nodes, logs, config, root, forest=None):
    """Fill all tables under ``root``; a second run adds nothing.

    Without a forest the logs stay unscored.
    """
    added = {
        "schema_config": seed_schema_config(config, f"{root}/schema_config"),
        "nodes": seed_nodes(nodes, f"{root}/nodes"),
        "logs": seed_logs(logs, f"{root}/logs"),
    }
    if forest is not None:
        stored = read_table(logs.sparkSession, f"{root}/logs", schemas.LOGS)
        added["anomalies"] = seed_anomaly_history(stored, forest, f"{root}/anomalies")
    return added


def ingest_summary(ingested, anomalies):
    """One row in the wording of the ingest reply."""
    message = F.when(ingested == 0, S.NOTHING_INGESTED_MESSAGE).otherwise(
        F.format_string(S.INGESTED_MESSAGE, ingested)
    )
    return [
        ingested.alias("ingested_count"), anomalies.alias("anomalies_detected"), message.alias("message"),
    ]
