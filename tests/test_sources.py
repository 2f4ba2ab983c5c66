import pytest
from pyspark.sql import functions as F

from nodeglass import schemas, sources
from nodeglass.operators import features, forest, topk, windows
from nodeglass.plans import jobs
from nodeglass.sources import writers


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / name)


def mode(spark, name):
    return spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(name)


def write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_registry_headers_are_tidied(spark, folder):
    path = write(folder("r.csv"), " Node_UUID ,USER_AGENT,Is_Infected\n1,Node/2.0 U04tMQ==,True\nx,Node/2.0 ??,false\n")
    rows = sources.load_node_registry(spark, path).collect()
    assert [tuple(r) for r in rows] == [(1, "Node/2.0 U04tMQ==", True, "SN-1"), (None, "Node/2.0 ??", False, "")]


def test_log_reader(spark, folder):
    path = write(folder("l.csv"), (
        "log_id,node_id,json_status,http_response_code,response_time_ms,load_val,L_V1\n"
        "0,1,OPERATIONAL,200,120,0.5,\n5000,1,OPERATIONAL,404,90,,NaN\n10000,2,OPERATIONAL,500,bad,0.1,0.2\n"
    ))
    rows = sources.load_system_logs(spark, path).orderBy("log_id").collect()
    assert [(r["active_schema_version"], r["effective_load"], r["http_status_label"]) for r in rows] == [
        (1, 0.5, "HEALTHY"), (2, None, "UNKNOWN"), (2, 0.2, "CRITICAL"),
    ]
    assert rows[2]["response_time_ms"] is None


def test_seeding_twice_adds_nothing(spark, folder, make_logs, make_nodes):
    nodes = make_nodes([(i, f"SN-{i}", False) for i in range(20)])
    logs = make_logs([(i, i % 20, 200, 10, None, None) for i in range(300)])
    config = spark.createDataFrame([(1, 0, "load_val"), (2, 5000, "L_V1")], "version int, time_start long, active_column string")
    first, second = (jobs.seed(nodes.union(nodes), logs, config, folder("t")) for _ in range(2))
    assert first == {"schema_config": 2, "nodes": 20, "logs": 300}
    assert second == {"schema_config": 0, "nodes": 0, "logs": 0}
    assert sources.read_table(spark, folder("t/nodes"), schemas.NODES).count() == 20


def test_anomalies_are_keyed_on_log_and_detector(spark, folder):
    shape = "node_id long, log_id long, anomaly_score double, detector string"
    rows = [(1, 1, -0.1, "IsolationForest"), (1, 1, -0.1, "Other"), (1, 2, -0.1, "IsolationForest")]
    assert sources.seed_anomalies(spark.createDataFrame(rows[:1], shape), folder("a")) == 1
    assert sources.seed_anomalies(spark.createDataFrame(rows, shape), folder("a")) == 2


def test_log_folders_prune_window_reads(spark, folder, make_logs):
    logs = make_logs([(i, 1, 200, 10, None, None) for i in range(100)])
    writers.append_logs(logs, folder("logs"), ids_per_folder=20)
    stored = sources.read_table(spark, folder("logs"), schemas.LOGS)
    cut = windows.since(stored, windows.trailing_start(99, 30), ids_per_folder=20)
    assert sorted(r["log_id"] for r in cut.collect()) == list(range(69, 100))
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "id_folder" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "GreaterThanOrEqual(log_id" in plan
    cut = windows.since(stored, windows.trailing_start(stored, 30), ids_per_folder=20)
    assert sorted(r["log_id"] for r in cut.collect()) == list(range(69, 100))
    plan = cut._jdf.queryExecution().explainString(mode(spark, "formatted"))
    assert "GreaterThanOrEqual(log_id,ScalarSubquery" in plan
    assert "id_folder" in plan.split("PartitionFilters")[1].split("\n")[0]


def test_refresh_replaces_and_decodes(spark, folder):
    config = spark.createDataFrame([("1", "0", "load_val")], "version string, time_start string, active_column string")
    shape = "node_uuid string, user_agent string, is_infected string"
    for flags in (("TRUE", "False"), ("true", "no")):
        raw = spark.createDataFrame([("1", "A U04tMQ==", flags[0]), ("2", "A raw", flags[1])], shape)
        assert sources.refresh_reference_tables(raw, config, folder("n"), folder("c")) == (2, 1)
    rows = sources.read_table(spark, folder("n"), schemas.NODES).orderBy("node_uuid").collect()
    assert [(r["serial_number"], r["is_infected"]) for r in rows] == [("SN-1", True), ("raw", False)]


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_exports(spark, folder, make_nodes, fmt):
    table = sources.registry_export(make_nodes([(1, "SN-1", True), (2, "SN-2", False)]))
    sources.write_export(table, folder("e"), fmt)
    read = spark.read.format(fmt).option("header", True).load(folder("e"))
    assert sorted((str(r["node_id"]), r["status"]) for r in read.collect()) == [("1", "INFECTED"), ("2", "OPERATIONAL")]


def test_seed_job_scores_history_once(spark, folder, make_logs, make_nodes):
    logs = make_logs([(i, i % 5, 429 if i % 20 == 0 else 200, 300 if i % 20 == 0 else 100 + i % 9, 0.1, None) for i in range(400)])
    nodes = make_nodes([(i, f"SN-{i}", False) for i in range(5)])
    config = spark.createDataFrame([(1, 0, "load_val")], "version int, time_start long, active_column string")
    loaded = features.with_load(logs)
    model = forest.fit_forest(features.log_features(loaded, 0.3), 0.3, trees=20)
    first, second = (jobs.seed(nodes, logs, config, folder("t"), model) for _ in range(2))
    assert first["anomalies"] > 0 and second["anomalies"] == 0
    stored = sources.read_table(spark, folder("t/anomalies"), schemas.ANOMALIES)
    assert stored.count() == first["anomalies"] and stored.filter("anomaly_score >= 0").count() == 0



def test_latest_logs_need_only_the_newest_folder(spark, folder, make_logs):
    logs = make_logs([(i, 1, 200, 10, None, None) for i in range(45)])
    writers.append_logs(logs, folder("logs"), ids_per_folder=20)
    stored = sources.read_table(spark, folder("logs"), schemas.LOGS)
    assert windows.snapshot(stored) == 44
    for count in (3, 5, 6, 30):  # the newest folder holds 5 logs
        assert [r["log_id"] for r in topk.latest_logs(stored, count).collect()] == list(range(44, 44 - count, -1))


def test_late_seeding_fills_the_gap(spark, folder, make_logs):
    logs = make_logs([(i, 1, 200, 10, None, None) for i in range(100)])
    assert sources.seed_logs(logs.filter("log_id < 30 or log_id > 60"), folder("logs"), ids_per_folder=20) == 69
    assert sources.seed_logs(logs, folder("logs"), ids_per_folder=20) == 31
    assert sources.seed_logs(logs.limit(0), folder("logs"), ids_per_folder=20) == 0
    assert sources.read_table(spark, folder("logs"), schemas.LOGS).count() == 100


def test_insert_compares_only_near_files(spark, make_nodes, tmp_path):
    path, at = str(tmp_path / "nodes"), lambda ids: make_nodes([(i, f"SN-{i}", False) for i in ids])
    for block in range(6):
        assert writers.seed_nodes(at(range(block * 100, block * 100 + 100)), path) == 100
    stored = writers.read_table(spark, path, schemas.NODES)
    files = lambda ids: writers.within(stored, at(ids), "node_uuid").select(F.input_file_name()).distinct().count()
    every = len(stored.inputFiles())
    assert files([5, 7]) == 1 and files([5, 595]) == 2 and files(range(0, 600, 50)) <= every
    assert writers.seed_nodes(at([5, 595, 700, 701, 700]), path) == 2
    assert writers.seed_nodes(at([5, 595, 700, 701]), path) == 0 and writers.seed_nodes(at([]), path) == 0
    assert sorted(r[0] for r in writers.read_table(spark, path, schemas.NODES).select("node_uuid").collect()) == [*range(600), 700, 701]
