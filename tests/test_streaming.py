import pytest
from pyspark.sql import functions as F

from nodeglass import schemas
from nodeglass.operators import changes, features, forest
from nodeglass.plans.jobs import ingest_summary
from nodeglass.streaming import ingest, state

DELIVERED = [f for f in schemas.LOGS if f.name != "log_id"]


@pytest.fixture
def arrivals(spark, tmp_path, make_logs):
    """A folder of files, and a function that adds one with the given rows."""
    path = str(tmp_path / "in")

    def add(first, count, node=1):
        logs = make_logs([(i, node + i % 3, 429 if i % 10 == 0 else 200, 100 + i % 50, 0.1, None) for i in range(first, first + count)])
        logs.drop("log_id").coalesce(1).write.mode("append").parquet(path)

    return path, add


def run(spark, path, sink, checkpoint, **options):
    source = ingest.read_log_stream(spark, path, schemas.T.StructType(DELIVERED), files_per_batch=1)
    query = ingest.stream_ingest(source, sink, checkpoint, order_by=["ingested_at", "node_id"], **options)
    query.awaitTermination()


def test_ids_continue_over_batches_and_restarts(spark, tmp_path, arrivals, make_nodes):
    path, add = arrivals
    sink, checkpoint = ingest.Sink(str(tmp_path / "out")), str(tmp_path / "ck")
    nodes = make_nodes([(1, "SN-1", False), (2, "SN-2", False)])
    add(0, 40), add(40, 30)
    run(spark, path, sink, checkpoint, nodes=nodes, window=20)
    add(70, 50)
    run(spark, path, sink, checkpoint, nodes=nodes, window=20)
    run(spark, path, sink, checkpoint, nodes=nodes, window=20)  # nothing new
    stored = sink.read(spark, "logs")
    assert sorted(r["log_id"] for r in stored.collect()) == list(range(80))
    assert stored.filter("node_id = 3").count() == 0
    rejected = sink.read(spark, "rejected")
    assert rejected.count() == 40 and {tuple(r["reasons"]) for r in rejected.collect()} == {("unknown node",)}
    totals = ingest.committed_window_totals(spark, sink).orderBy("window_id").collect()
    assert [(r["window_id"], r["log_count"]) for r in totals] == [(0, 20), (1, 20), (2, 20), (3, 20)]
    assert ingest.current_window(spark, sink).first()["window_id"] == 3


def test_repeated_batch_leaves_the_same_rows_once(spark, tmp_path, make_logs):
    sink = ingest.Sink(str(tmp_path / "out"))
    batches = [make_logs([(i, 1, 200, 10 + i, None, None) for i in range(a, b)]).drop("log_id") for a, b in ((0, 10), (10, 25))]
    ingest.ingest_batch(batches[0], 0, sink, order_by=["response_time_ms"])
    crashed = ingest.Sink(sink.root)
    crashed.commit = lambda *args, **changes: (_ for _ in ()).throw(OSError)
    with pytest.raises(OSError):
        ingest.ingest_batch(batches[1], 1, crashed, order_by=["response_time_ms"])
    assert sink.read(spark, "logs").count() == 10  # the unfinished batch is not shown
    for _ in range(2):
        assert ingest.ingest_batch(batches[1], 1, sink, order_by=["response_time_ms"]) == (25, 15, 0)
    assert sink.vacuum(spark) == 4  # what the crashed one has left: logs, rejected, window_totals, ledger
    rows = sink.read(spark, "logs").orderBy("log_id").select("log_id", "response_time_ms").collect()
    assert [tuple(r) for r in rows] == [(i, 10 + i) for i in range(25)]


def test_batch_without_known_nodes(spark, tmp_path, make_logs, make_nodes):
    sink = ingest.Sink(str(tmp_path / "out"))
    batch = make_logs([(0, 5, 200, 10, None, None)]).drop("log_id")
    assert ingest.ingest_batch(batch, 0, sink, nodes=make_nodes([(1, "SN-1", False)]), first_id=7) == (7, 0, 0)
    ledger = sink.read(spark, "ledger").select(*ingest_summary(F.col("ingested_count"), F.col("anomaly_count")))
    assert ledger.first()[:] == (0, 0, "No valid nodes in batch.")


def test_rows_with_ids_keep_them(spark, tmp_path, make_logs):
    sink = ingest.Sink(str(tmp_path / "out"))
    assert ingest.ingest_batch(make_logs([(100, 1, 200, 10, None, None), (105, 1, 200, 10, None, None)]), 0, sink) == (106, 2, 0)
    assert ingest.ingest_batch(make_logs([(3, 1, 200, 10, None, None)]), 1, sink) == (106, 1, 0)
    assert sorted(r["log_id"] for r in sink.read(spark, "logs").collect()) == [3, 100, 105]


def test_scores_belong_to_the_stored_ids(spark, tmp_path, make_logs):
    logs = make_logs([(i, i % 7, 429 if i % 15 == 0 else 200, 280 if i % 15 == 0 else 100 + i % 20, 0.2, None) for i in range(300)])
    loaded = features.with_load(logs)
    model = forest.fit_forest(features.log_features(loaded, 0.3), 0.3, trees=30)
    sink = ingest.Sink(str(tmp_path / "out"))
    row = ingest.ingest_batch(logs.drop("log_id"), 0, sink, forest=model, order_by=["ingested_at"], first_id=1000)
    found = sink.read(spark, "anomalies")
    assert row[2] == found.count() > 0
    codes = found.join(sink.read(spark, "logs"), "log_id").select("http_response_code").distinct().collect()
    assert [c[0] for c in codes] == [429]
    steps = changes.increases(ingest.batch_anomaly_totals(spark, sink), "batch_id", "total_anomalies").collect()
    assert [(r["batch_id"], r["increase"]) for r in steps] == [(0, row[2])]


def test_latest_state_follows_the_stream(spark, tmp_path, make_logs):
    path, root, checkpoint = (str(tmp_path / n) for n in ("in", "state", "ck"))

    def feed(rows):
        make_logs(rows).coalesce(1).write.mode("append").parquet(path)
        stream = ingest.read_log_stream(spark, path, schemas.LOGS, files_per_batch=1)
        state.stream_latest_state(stream, root, checkpoint).awaitTermination()
        found = state.read_latest_state(spark, root).select("node_id", "log_id", "http_response_code").collect()
        return sorted(tuple(r) for r in found)

    assert feed([(0, 1, 200, 1, None, None), (1, 2, 206, 1, None, None)]) == [(1, 0, 200), (2, 1, 206)]
    assert feed([(2, 1, 429, 1, None, None)]) == [(1, 2, 429), (2, 1, 206)]


def test_repeats_within_the_delay_are_dropped(spark, tmp_path, make_logs):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    logs = make_logs([(i, 1, 200, 1, None, None) for i in range(100, 105)])
    logs.union(logs).write.parquet(path)
    stream = ingest.drop_repeats(ingest.read_log_stream(spark, path, schemas.LOGS))
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(
        availableNow=True
    ).start(out).awaitTermination()
    assert sorted(r["log_id"] for r in spark.read.parquet(out).collect()) == list(range(100, 105))


def test_csv_source_with_a_time_trigger(spark, tmp_path, make_logs):
    path, sink = str(tmp_path / "in"), ingest.Sink(str(tmp_path / "out"))
    make_logs([(i, 1, 200, 1, 0.5, None) for i in range(12)]).write.option("header", True).csv(path)
    stream = ingest.read_log_stream(spark, path, schemas.LOGS, fmt="csv")
    query = ingest.stream_ingest(stream, sink, str(tmp_path / "ck"), {"processingTime": "500 milliseconds"})
    query.processAllAvailable()
    query.stop()
    assert sink.read(spark, "logs").count() == 12


def test_rotation_events_compare_with_the_window_before(make_logs):
    # windows 0, 1, 3, 5 and 6: versions 1, 2, 2, 2 and 1
    logs = make_logs([(i, 1, 200, 1, None, None) for i in (0, 5, 12, 31, 52, 60)])
    found = changes.rotation_events(logs, window=10).orderBy("window_id").collect()
    assert [tuple(r) for r in found] == [(1, 1, 2), (6, 2, 1)]
