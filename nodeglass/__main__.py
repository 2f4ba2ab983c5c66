"""Jobs for spark-submit.

    python -m nodeglass train  --registry R.csv --logs L.csv --models DIR
    python -m nodeglass seed   --registry R.csv --logs L.csv --config C.csv --root DIR [--models DIR]
    python -m nodeglass reset  --registry R.csv --config C.csv --root DIR
    python -m nodeglass ingest --input DIR --root DIR --sink DIR --checkpoint DIR [--models DIR] [--every "500 milliseconds"]
    python -m nodeglass report NAME --root DIR --out DIR [--format csv]
"""

import argparse

from pyspark.sql import SparkSession

from nodeglass import schemas, settings as S, sources
from nodeglass.plans import jobs, reports
from nodeglass.session import checkpoint_dir
from nodeglass.streaming import ingest

_TABLES = {
    "nodes": schemas.NODES, "logs": schemas.LOGS, "schema_config": schemas.SCHEMA_CONFIG,
    "anomalies": schemas.ANOMALIES,
}


class Store:
    """The seeded tables under one root."""

    def __init__(self, spark, root):
        self.nodes, self.logs, self.config, self.anomalies = (
            sources.read_table(spark, f"{root}/{name}", schema) for name, schema in _TABLES.items()
        )


REPORTS = {
    "city-map": lambda t: reports.city_map(t.logs, t.nodes, t.anomalies),
    "heatmap": lambda t: sources.heatmap_export(reports.heatmap(t.logs, t.anomalies, t.nodes)),
    "risk": lambda t: reports.node_risk(t.logs, t.anomalies, t.nodes),
    "schema-console": lambda t: reports.schema_console(t.logs, t.config)[1],
    "nodes": lambda t: sources.registry_export(reports.with_window_flag(t.nodes, t.anomalies, t.logs), "window_flagged"),
    "anomalies": lambda t: reports.anomaly_report(t.anomalies, limit=1000)[1],
    "cloned-identities": lambda t: reports.clone_report(t.nodes)[1],
    "dashboard-nodes": lambda t: reports.dashboard(t.logs, t.nodes, t.anomalies, t.config, full=True)["nodes"],
    "terminal-logs": lambda t: reports.dashboard_logs(t.logs, full=True),
    "inventory": lambda t: reports.inventory(t.nodes, t.logs),
}


def _models(spark, path):
    return jobs.load_models(spark, path) if path else None


def train(spark, args):
    nodes = sources.load_node_registry(spark, args.registry)
    logs = sources.load_system_logs(spark, args.logs)
    _, found = jobs.train(logs, nodes, args.models, mode="step", trees=args.trees, rounds=args.rounds)
    for name in ("registry", "codes", "labels", "classes"):
        found[name].show()
    print(f"AUC {found['auc']:.4f}")


def seed(spark, args):
    models = _models(spark, args.models)
    added = jobs.seed(
        sources.load_node_registry(spark, args.registry), sources.load_system_logs(spark, args.logs),
        sources.load_schema_config(spark, args.config), args.root, models and models.forest,
    )
    print(added)


def reset(spark, args):
    read = lambda path: spark.read.csv(path, header=True)
    print(sources.refresh_reference_tables(
        read(args.registry), read(args.config), f"{args.root}/nodes", f"{args.root}/schema_config"
    ))


def run_ingest(spark, args):
    models = _models(spark, args.models)
    incoming = schemas.T.StructType([f for f in schemas.LOGS if f.name != "log_id"])
    stream = ingest.read_log_stream(spark, args.input, incoming, args.format)
    ingest.stream_ingest(
        stream, ingest.Sink(args.sink), args.checkpoint,
        {"processingTime": args.every} if args.every else None,
        nodes=Store(spark, args.root).nodes, forest=models and models.forest, first_id=args.first_id,
    ).awaitTermination()


def report(spark, args):
    sources.write_export(REPORTS[args.name](Store(spark, args.root)), args.out, args.format)


def parser():
    top = argparse.ArgumentParser(prog="nodeglass", description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    jobs_ = top.add_subparsers(required=True)

    def job(run, name, *required, **optional):
        p = jobs_.add_parser(name)
        p.set_defaults(run=run)
        for option in required:
            p.add_argument(f"--{option}", required=True)
        for option, default in optional.items():
            kind = int if isinstance(default, int) else str
            p.add_argument(f"--{option.replace('_', '-')}", default=default, type=kind)
        return p

    job(train, "train", "registry", "logs", "models", trees=S.FOREST_TREES, rounds=S.BOOST_ROUNDS)
    job(seed, "seed", "registry", "logs", "config", "root", models=None)
    job(reset, "reset", "registry", "config", "root")
    job(run_ingest, "ingest", "input", "root", "sink", "checkpoint", models=None, every=None, format="parquet", first_id=0)
    job(report, "report", "root", "out", format="csv").add_argument("name", choices=sorted(REPORTS))
    return top


def main(arguments=None):
    args = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("nodeglass").getOrCreate()
    checkpoint_dir(spark)
    args.run(spark, args)


if __name__ == "__main__":
    main()
