"""Growing tables: snapshots, compaction, zone maps, merged histograms and states."""

import random

import pytest
from pyspark.sql import functions as F

from nodeglass import schemas
from nodeglass.operators import latency, windows
from nodeglass.streaming import ingest, snapshots, state


@pytest.fixture
def store(tmp_path):
    return snapshots.Store(str(tmp_path / "store"), {"logs": schemas.LOGS, "config": schemas.SCHEMA_CONFIG}, fan_in=4)


def add(spark, store, make_logs, batch, first, count):
    part = store.write(make_logs([(i, i % 3, 200, i % 50, None, None) for i in range(first, first + count)]).coalesce(1), "logs", batch)
    store.commit(spark, store.snapshot(spark), [part], last_batch=batch)


def ids(df):
    return sorted(r["log_id"] for r in df.select("log_id").collect())


def test_parts_stay_few_over_thousands_of_batches():
    parts, most, rewritten = [], 0, 0
    for batch in range(2000):
        parts.append({"table": "logs", "path": str(batch), "level": 0, "rows": 50})
        while members := snapshots.due(parts, "logs"):
            gone = {p["path"] for p in members}
            merged = {"table": "logs", "path": "+".join(sorted(gone))[:50] + str(len(parts)) + str(batch), "level": members[0]["level"] + 1,
                      "rows": sum(p["rows"] for p in members)}
            rewritten += merged["rows"]
            parts = [p for p in parts if p["path"] not in gone] + [merged]
        most = max(most, len(parts))
    assert sum(p["rows"] for p in parts) == 100_000
    assert most <= 3 * (snapshots.FAN_IN - 1) and rewritten <= 3 * 100_000


def test_full_parts_are_left_alone():
    part = lambda rows, level=0: {"table": "logs", "path": str(random.random()), "level": level, "rows": rows}
    parts = [part(100) for _ in range(5)] + [part(1) for _ in range(3)]
    assert snapshots.due(parts, "logs", 4, full_rows=100) == []
    assert len(snapshots.due(parts, "logs", 4, full_rows=100, keyed=True)) == 8
    assert len(snapshots.due(parts + [part(0)], "logs", 4, full_rows=100)) == 4


def test_compaction_keeps_all_rows(spark, store, make_logs):
    for batch in range(22):
        add(spark, store, make_logs, batch, batch * 5, 5)
        store.compact(spark)
    now = store.snapshot(spark)
    assert ids(store.read(spark, "logs")) == list(range(110))
    assert sorted((p["level"], p["first_batch"], p["last_batch"]) for p in now["parts"]) == [
        (0, 20, 20), (0, 21, 21), (1, 16, 19), (2, 0, 15)]
    assert len(store.read(spark, "logs").inputFiles()) == 4
    assert now["last_batch"] == 21 and len(store._versions(spark)) == snapshots.KEEP


def test_old_snapshots_stay_readable_for_a_while(spark, store, make_logs):
    for batch in range(3):
        add(spark, store, make_logs, batch, batch, 1)
    then = store.snapshot(spark)
    add(spark, store, make_logs, 3, 3, 1)
    assert store.compact(spark) == 1
    assert ids(store.read(spark, "logs", snapshot=then)) == [0, 1, 2]
    for batch in range(4, 4 + snapshots.KEEP):
        add(spark, store, make_logs, batch, batch, 1)
    with pytest.raises(Exception):
        store.read(spark, "logs", snapshot=then).collect()
    assert ids(store.read(spark, "logs")) == list(range(4 + snapshots.KEEP))


def test_crash_in_mid_compaction(spark, store, make_logs, monkeypatch):
    for batch in range(4):
        add(spark, store, make_logs, batch, batch * 3, 3)
    with monkeypatch.context() as broken:
        broken.setattr(store, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError))
        with pytest.raises(OSError):
            store.compact(spark)
    assert ids(store.read(spark, "logs")) == list(range(12)) and len(store.snapshot(spark)["parts"]) == 4
    assert store.compact(spark) == 1
    assert ids(store.read(spark, "logs")) == list(range(12)) and len(store.snapshot(spark)["parts"]) == 1
    assert store.vacuum(spark) == 1 and store.vacuum(spark) == 0  # the folder of the crashed merge
    assert ids(store.read(spark, "logs")) == list(range(12))


def test_a_second_writer_fails(spark, store, make_logs):
    before = store.snapshot(spark)
    add(spark, store, make_logs, 0, 0, 2)
    part = store.write(make_logs([(9, 1, 200, 1, None, None)]), "logs", 0)
    with pytest.raises(RuntimeError):
        store.commit(spark, before, [part], last_batch=0)
    assert ids(store.read(spark, "logs")) == [0, 1]


def test_zone_maps_pick_the_parts(spark, store, make_logs):
    for batch in range(12):
        add(spark, store, make_logs, batch, batch * 100, 100)
    assert store.max_id(spark, "logs") == 1199
    found = store.read(spark, "logs", from_id=950, to_id=1050)
    assert ids(found) == list(range(950, 1051)) and len(found.inputFiles()) == 2
    assert store.read(spark, "logs", from_id=5000).count() == 0
    assert store.max_id(spark, "config") == 0 and store.read(spark, "config").count() == 0


def batches_of(make_logs, sizes, seed=1):
    rng, at = random.Random(seed), 0
    for size in sizes:
        rows = [(i, 7 if rng.random() < 0.4 else rng.randint(1, 5), 200, None if rng.random() < 0.05 else rng.randint(1, 30), None, None)
                for i in range(at, at + size)]
        at += size
        yield make_logs(rows).coalesce(1)


@pytest.mark.parametrize("block", [None, 16])
def test_trailing_window_over_the_sink(spark, tmp_path, make_logs, block):
    sink = ingest.Sink(str(tmp_path / "sink"), fan_in=3, block=block)
    for number, batch in enumerate(batches_of(make_logs, [40, 1, 90, 33, 60])):
        ingest.ingest_batch(batch, number, sink)
        stored = sink.read(spark, "logs")
        for window in (10, 64):
            want = windows.trailing(stored, stored, window)
            assert ids(sink.trailing(spark, window)) == ids(want)
            rounded = lambda df: sorted((r["node_id"], round(r["avg_rt"], 9), r["max_rt"], round(r["p95_rt"], 9), r["log_count"]) for r in df.collect())
            assert rounded(sink.trailing_latency(spark, window)) == rounded(latency.node_latency(want))


def test_window_opens_few_files_whatever_the_history(spark, tmp_path, make_logs):
    sink = ingest.Sink(str(tmp_path / "sink"), fan_in=4)
    for number, batch in enumerate(batches_of(make_logs, [20] * 21)):
        ingest.ingest_batch(batch, number, sink)
    assert len(sink.trailing(spark, 19).inputFiles()) == 1
    assert len(sink.trailing(spark, 39).inputFiles()) <= 2
    assert max(sum(p["table"] == t for p in sink.snapshot(spark)["parts"]) for t in sink.tables) <= 6
    totals = [r["total_anomalies"] for r in ingest.batch_anomaly_totals(spark, sink).orderBy("batch_id").collect()]
    assert totals == [0] * 21


def test_latest_state_is_read_from_a_base_and_few_changes(spark, tmp_path, make_logs):
    root, rng, want = str(tmp_path / "state"), random.Random(2), {}
    for batch in range(18):
        rows = [(batch * 10 + i, rng.randint(1, 6), rng.choice([200, 429]), 1, None, None) for i in range(10)]
        for log_id, node, code, *_ in rows:
            want[node] = (log_id, code)
        store = state.StateStore(root, fan_in=4)  # a new one each time, as after a restart
        changes = state.latest_per_node(make_logs(rows), state._STATE)
        for _ in range(2):
            store.apply(changes, batch)
    found = state.read_latest_state(spark, root)
    assert {r["node_id"]: (r["log_id"], r["http_response_code"]) for r in found.collect()} == want
    parts = store.snapshot(spark)["parts"]
    assert len(parts) <= 6 and max(p["rows"] for p in parts) <= 6
