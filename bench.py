"""Headline timings; prints one JSON line.

BENCH_SF_DIR picks the data folder, BENCH_CPUS the local cores.
"""

import json
import os
import sys
import time

from nodeglass.plans import catalog
from nodeglass.session import build_session

HEADLINE = [
    "rp2_heatmap", "rp1_city_map", "rp7_dashboard_nodes", "rp8_cloned_identities", "ag3_node_latency",
    "ag9_node_features", "ag12_median_load", "ag20_quality_checks", "wn1_latest_log", "jo5_known_nodes",
    "jo8_asof_schema", "pr1_decode_serial", "fi2_row_contract", "ru6_threat_summary", "io8_append_with_generated_ids",
    "ml3_fit_forest", "ml4_score_batch", "ml7_score_nodes", "st1_stream_ingest", "st2_validated_micro_batch",
    "st10_latest_state_stream",
]


def timed(run):
    started = time.perf_counter()
    run()
    return round(time.perf_counter() - started, 3)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("nodeglass-bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    drain = lambda df: df.write.format("noop").mode("overwrite").save()
    drain(spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").count())  # start the engine
    names = [n for n in HEADLINE if len(sys.argv) < 2 or n.startswith(tuple(sys.argv[1:]))]
    times = {name: timed(lambda: drain(catalog.QUERIES[name](spark, sf_dir))) for name in names}
    logs = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rate = lambda name: round(logs / times[name]) if name in times else None
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "logs": logs,
        "ingest_logs_per_sec": rate("st1_stream_ingest"),
        "validated_scored_ingest_logs_per_sec": rate("st2_validated_micro_batch"),
        "score_logs_per_sec": rate("ml4_score_batch"),
    }))


if __name__ == "__main__":
    main()
