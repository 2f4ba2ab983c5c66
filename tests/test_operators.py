import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeglass.operators import (
    anomalies, asof, audit, changes, clones, features, latency, latest, numbering, order_stats, quality, rules, topk,
    windows,
)
from nodeglass.plans import reports
from nodeglass.sources import views


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# Order statistics -----------------------------------------------------------

def numbers(kind, n=5000):
    rng = np.random.default_rng(3)
    return {
        "even": rng.random(n), "tied": rng.integers(0, 7, n).astype(float), "constant": np.full(n, 0.3),
        "wild": np.exp(rng.normal(0, 30, n)) * rng.choice([-1, 1], n), "mostly_one": np.where(rng.random(n) < 0.9, 1.0, rng.random(n)),
    }[kind]


@pytest.mark.parametrize("kind", ["even", "tied", "constant", "wild", "mostly_one"])
@pytest.mark.parametrize("q", [0.0, 0.08, 0.5, 1.0])
def test_exact_quantile_at_every_bracket_size(spark, kind, q):
    values = numbers(kind)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
    for at_most in (10, 10_000):
        assert order_stats.exact_quantile(df, "v", q, at_most) == pytest.approx(np.percentile(values, 100 * q), rel=1e-12)


def test_exact_quantile_without_values(spark):
    assert order_stats.exact_quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.5) is None


def test_grouped_median_with_a_dominant_key(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(0, rng.random()) for _ in range(60_000)] + [(k, rng.choice([0.1, 0.2, rng.random()])) for k in range(1, 40) for _ in range(k)]
    rows += [(7, None), (99, None)]
    groups = defaultdict(list)
    for k, v in rows:
        if v is not None:
            groups[k].append(v)
    df = spark.createDataFrame(rows, "k long, v double")
    for limit in (200_000, 0):  # broadcast brackets, then the shuffle join
        monkeypatch.setattr(order_stats, "checked_broadcast", lambda t, n=limit: t if n == 0 else F.broadcast(t))
        for at_most in (5_000_000, 30):  # 30: key 0 is narrowed down on its own
            got = dict(rows_of(order_stats.grouped_median(df, "k", "v", at_most), "k", "median"))
            assert got == pytest.approx({k: float(np.median(v)) for k, v in groups.items()})


# Numbering, pages, previous row ----------------------------------------------

@pytest.mark.parametrize("partitions", [1, 7])
def test_numbers_follow_the_order_without_gaps(spark, partitions):
    keys = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(partitions)
    got = rows_of(numbering.number_rows(df, "id", 100, ["k"]), "id", "k")
    assert got == [(100 + i, k) for i, k in enumerate(sorted(keys))]
    unordered = numbering.number_rows(df, "id", 5)
    assert sorted(r["id"] for r in unordered.collect()) == list(range(5, 505))


def test_numbering_an_empty_table(spark):
    assert numbering.number_rows(spark.createDataFrame([], "k long"), "id", 0, ["k"]).count() == 0


def test_deep_pages_equal_shallow_ones(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") % 50).alias("score"), F.col("id").alias("log_id"))
    shallow = topk.page(df, "score", 900, 30, "log_id").collect()
    monkeypatch.setattr(topk, "SHALLOW", 10)
    assert topk.page(df, "score", 900, 30, "log_id").collect() == shallow
    with pytest.raises(ValueError):
        topk.page(df, "score", -1, 5)


def test_page_limits(make_nodes):
    nodes = make_nodes([(i, f"SN-{i}", False) for i in range(10)])
    assert [r["node_uuid"] for r in topk.registry_page(nodes, 3, 4).collect()] == [3, 4, 5, 6]
    assert [r["node_uuid"] for r in topk.page_after(nodes, "node_uuid", 6, 2).collect()] == [7, 8]
    for limit in (0, 501):
        with pytest.raises(ValueError):
            topk.registry_page(nodes, 0, limit)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_previous_value_across_blocks(spark, block):
    keys = [0, 1, 2, 5, 9, 10, 30, 31]
    df = spark.createDataFrame([(k, k * 10) for k in keys], "k long, v long")
    got = rows_of(changes.with_previous(df, "k", "v", "p", block), "k", "p")
    assert got == [(k, None if i == 0 else keys[i - 1] * 10) for i, k in enumerate(keys)]


def test_stratified_top_breaks_ties_and_drops_unlisted_strata(spark):
    rows = [(i, "CRITICAL", 300.0) for i in range(20)] + [(100 + i, "HIGH", 180.0) for i in range(3)]
    rows += [(200 + i, "LOW", float(i)) for i in range(8)] + [(300, "MEDIUM", 130.0)]
    df = spark.createDataFrame(rows, "node_uuid long, risk_level string, avg_response_time_ms double")
    got = [r["node_uuid"] for r in topk.stratified_top(df).collect()]
    assert got == list(range(15)) + [300] + [207, 206, 205, 204, 203]
    plan = topk.stratified_top(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


# Per-node operators -----------------------------------------------------------

def random_logs(n=3000, seed=2):
    """A third of all logs belong to node 0."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        live, value = (i // 500) % 2, rng.random() if rng.random() < 0.8 else None
        rows.append((
            i, 0 if i % 3 == 0 else rng.randint(1, 40), rng.choice([200, 200, 200, 206, 429, 404, 503]),
            rng.randint(0, 400), None if live else value, value if live else None,
        ))
    return rows


def test_latency_against_brute_force(make_logs):
    rows, by_node = random_logs(), defaultdict(list)
    for r in rows:
        by_node[r[1]].append(r[3])
    got = {r["node_id"]: r for r in latency.node_latency(make_logs(rows)).collect()}
    assert set(got) == set(by_node)
    for node, ms in by_node.items():
        assert got[node]["avg_rt"] == pytest.approx(np.mean(ms))
        assert got[node]["p95_rt"] == pytest.approx(np.percentile(ms, 95))
        assert (got[node]["max_rt"], got[node]["log_count"]) == (max(ms), len(ms))
    rough = {r["node_id"]: r for r in latency.node_latency_approx(make_logs(rows)).collect()}
    assert all(rough[n]["max_rt"] == max(ms) for n, ms in by_node.items())


def test_node_features_against_brute_force(make_logs, make_nodes):
    rows = random_logs() + [(9000, 77, 429, 10, None, None)]
    by_node = defaultdict(list)
    for r in rows:
        by_node[r[1]].append(r)
    nodes = make_nodes([(n, f"SN-{n}", n % 5 == 0) for n in by_node if n != 3] + [(500, "SN-500", True)])
    loaded = features.with_load(make_logs(rows), window=500)
    got = {r["node_id"]: r for r in features.node_features(loaded, nodes).collect()}
    assert set(got) == set(by_node) - {3}
    for node, f in got.items():
        logs = by_node[node]
        loads = [r[5] if (r[0] // 500) % 2 else r[4] for r in logs]
        known = [v for v in loads if v is not None]
        if known:
            assert f["avg_load"] == pytest.approx(np.mean([np.median(known) if v is None else v for v in loads]))
        else:
            assert f["avg_load"] is None
        assert f["throttled_ratio"] == pytest.approx(np.mean([r[2] == 429 for r in logs]))
        assert f["partial_ratio"] == pytest.approx(np.mean([r[2] == 206 for r in logs]))
        assert f["p95_response_time_ms"] == pytest.approx(np.percentile([r[3] for r in logs], 95))


def test_latest_log_is_by_id(make_logs):
    rows = random_logs()
    want = {}
    for r in rows:
        want[r[1]] = (r[0], r[2], r[4])
    got = latest.latest_per_node(make_logs(rows).repartition(4), ["http_response_code", "load_val", "json_status"])
    assert {r["node_id"]: (r["log_id"], r["http_response_code"], r["load_val"]) for r in got.collect()} == want
    plan = latest.latest_per_node(make_logs(rows), ["http_response_code", "json_status"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by(http_response_code" in plan


def test_clones_in_parts_hold_every_node(make_nodes):
    rows = [(i, "SN-HOT", i % 4 == 0) for i in range(300)] + [(1000, "SN-A", True), (1001, "SN-A", False), (1002, "SN-B", False)]
    found = clones.cloned_identities(make_nodes(rows), list_size=50).collect()
    hot = [r for r in found if r["serial_number"] == "SN-HOT"]
    assert len(hot) > 1 and all(r["clone_count"] == 300 and r["infected_count"] == 75 for r in hot)
    assert sorted(n for r in hot for n in r["node_uuids"]) == list(range(300))
    whole = {r["serial_number"]: r["node_uuids"] for r in clones.cloned_identities(make_nodes(rows)).collect()}
    assert whole == {"SN-HOT": list(range(300)), "SN-A": [1000, 1001]}
    assert clones.clone_totals(make_nodes(rows)).first()[:] == (2, 302)
    assert clones.clone_totals(make_nodes([(1, "SN-1", False)])).first()[:] == (0, 0)


def test_clone_members_with_null_and_repeated_keys(make_nodes):
    rows = [(1, "SN-A", True), (1, "SN-A", None), (2, None, True), (3, None, False), (4, "SN-B", True), (None, "SN-B", True),
            (5, "", True), (6, "", None), (7, "SN-C", False), (8, "SN-C", None)]
    found = clones.clone_members(make_nodes(rows))
    assert found.columns == ["serial_number", "node_uuid", "user_agent", "is_infected", "clone_count", "infected_count"]
    got = sorted((r[0], r[1], r[4], r[5]) for r in found.collect())
    assert got == [("", 5, 2, 1), ("", 6, 2, 1), ("SN-A", 1, 2, 1), ("SN-A", 1, 2, 1), ("SN-C", 7, 2, 0), ("SN-C", 8, 2, 0)]


def test_clone_members_decode_once_a_side_after_the_rows_are_dealt(spark, tmp_path):
    """One input file is one split; no serial may be decoded where it is read."""
    customers = spark.range(100).selectExpr("id AS c_custkey", "CAST(id AS double) AS c_acctbal").coalesce(1)
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    found = clones.clone_members(views.nodes(spark, tmp_path))
    assert sorted(r["node_uuid"] for r in found.collect()) == [48, 49, 98, 99]
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("unbase64(") == 2 and plan.count("Exchange hashpartitioning(node_uuid") == 2
    for read in plan.split("Exchange hashpartitioning(node_uuid")[1:]:
        assert "unbase64(" not in read.split("FileScan")[0] and "unbase64(" not in read.split("FileScan")[1].split("\n")[0]


# Windows, joins, checks --------------------------------------------------------

def test_windows_at_the_edges(make_logs):
    def ids(top, cut):
        logs = make_logs([(i, 1, 200, 1, None, None) for i in (0, 4999, 5000, 5001, 9999, 10000) if i <= top])
        return [r["log_id"] for r in cut(logs, logs).orderBy("log_id").collect()]

    assert ids(4999, windows.tumbling) == [0, 4999]
    assert ids(5000, windows.tumbling) == [5000]
    assert ids(5000, windows.trailing) == [0, 4999, 5000]
    assert ids(10000, windows.trailing) == [5000, 5001, 9999, 10000]
    empty = make_logs([(0, 1, 200, 1, None, None)]).limit(0)
    assert windows.snapshot(empty) == 0
    assert windows.tumbling(empty, empty).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_asof_by_merge_equals_inline(spark, parts):
    logs = spark.range(0, 400).select(F.col("id").alias("log_id"), (F.col("id") % 3).alias("x")).repartition(parts)
    starts = [(5, "a"), (17, "b"), (18, "c"), (18, "a"), (120, "d"), (130, None), (150, "f"), (900, "e")]
    config = spark.createDataFrame(starts, "time_start long, active_column string")
    inline = rows_of(asof.resolve_active_column(logs, config), "log_id", "x", "active_column")
    assert inline[4] == (4, 1, None) and inline[18] == (18, 0, "c") and inline[140] == (140, 2, None) and inline[399] == (399, 0, "f")
    assert rows_of(asof.resolve_active_column(logs, config, inline=0), "log_id", "x", "active_column") == inline
    none = config.where("false")
    assert rows_of(asof.resolve_active_column(logs, none, inline=-1), "active_column") == [(None,)] * 400


def test_asof_of_a_long_config(spark):
    """A start at every other id, dense at one end; each log takes the last one."""
    logs = spark.range(0, 60_000, 1, 6).select((F.col("id") * 50).alias("log_id"))
    config = spark.range(0, 200_000, 1, 6).select(
        F.when(F.col("id") < 150_000, F.col("id")).otherwise(F.col("id") * 10).alias("time_start")).withColumn(
        "active_column", F.col("time_start").cast("string"))
    found = asof.resolve_active_column(logs, config)
    at = F.col("log_id")
    want = F.when(at < 150_000, at).when(at < 1_500_000, F.lit(149_999)).otherwise(F.least(at - at % 10, F.lit(1_999_990)))
    assert found.count() == 60_000 and found.where(~F.col("active_column").eqNullSafe(want.cast("string"))).isEmpty()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_duplicate_ids(spark):
    ids = [-65, -64, -1, 0, 63, 64, 64, 64, 127, 128, 1 << 62, 1 << 62, None, None]
    logs = spark.createDataFrame([(i,) for i in ids], "log_id long").repartition(4)
    assert quality.duplicate_ids(logs).first()[0] == 3
    assert quality.duplicate_ids(logs.where("false")).first()[0] == 0


def test_active_version_falls_back_to_the_first(spark):
    config = spark.createDataFrame([(3, 50, "x"), (1, 0, "y")], "version int, time_start long, active_column string")
    assert asof.active_version(config, F.lit(3)).first()[:] == (3, "x")
    assert asof.active_version(config, F.lit(2)).first()[:] == (1, "y")


def test_row_contract(spark):
    rows = spark.createDataFrame(
        [(1, 1, 100, 0, None), (2, 1, 599, 5, "X"), (3, 1, 600, -1, None), (4, None, 99, 5, None), (5, 1, None, None, None)],
        "log_id long, node_id long, http_response_code int, response_time_ms int, json_status string",
    )
    valid, rejected = quality.split_rows(rows)
    assert rows_of(valid, "log_id", "json_status") == [(1, "OPERATIONAL"), (2, "X")]
    reasons = {r["log_id"]: r["reasons"] for r in rejected.collect()}
    assert reasons == {
        3: ["http_response_code out of range", "response_time_ms negative"],
        4: ["node_id missing", "http_response_code out of range"],
        5: ["http_response_code out of range", "response_time_ms negative"],
    }


def test_quality_report_counts(make_logs, make_nodes):
    logs = make_logs([
        (0, 1, 200, 5, 0.1, None), (0, 1, 404, 10_001, 0.1, None), (5000, 2, 206, 5, 0.2, None), (5001, 9, 429, -1, None, 0.2),
    ])
    nodes = make_nodes([(1, "SN-1", False), (2, "XX", True)])
    assert dict(rows_of(quality.quality_report(logs, nodes), "check_name", "violations")) == {
        "latency_out_of_range": 2, "json_status_not_operational": 0, "unexpected_http_code": 1,
        "load_in_inactive_column": 1, "duplicate_log_id": 1, "serial_without_prefix": 1, "log_node_not_in_registry": 1,
    }
    empty = dict(rows_of(quality.quality_report(logs.limit(0), nodes.limit(0)), "check_name", "violations"))
    assert set(empty.values()) == {0}


def test_state_merge_updates_known_nodes_only(spark):
    shape = "node_uuid long, is_infected boolean, last_http_code int, reported_json string"
    state = spark.createDataFrame([(1, False, 200, "A"), (2, False, 200, "A")], shape)
    update = spark.createDataFrame([(2, True, 429, "B"), (3, True, 500, "B")], shape)
    assert rows_of(changes.merge_node_state(state, update), *state.columns) == [(1, False, 200, "A"), (2, True, 429, "B")]


def test_coverage_without_truth_is_null(make_logs, make_nodes):
    logs = make_logs([(0, 1, 200, 5, None, None), (5000, 2, 200, 5, None, None), (10001, 1, 200, 5, None, None)])
    report = audit.coverage_report(logs, make_nodes([(1, "SN-1", False), (2, "SN-2", False)]))
    assert rows_of(report, "scope", "detected", "correct", "missed", "truth", "coverage_pct") == [
        ("total", 2, 0, 0, 0, None), ("v1", 1, 0, 0, 0, None), ("v2", 1, 0, 0, 0, None),
    ]


def test_rules(make_logs, make_nodes):
    logs = make_logs([(i, 1, 429, 100, None, None) for i in range(60)] + [(100 + n, n, 200, 100 + n * 20, None, None) for n in range(2, 12)])
    nodes = make_nodes([(n, f"SN-{n}", n == 2) for n in range(1, 12)])
    assert rows_of(rules.ddos_nodes(logs), "node_id", "throttled") == [(1, 60)]
    counts = dict(rows_of(rules.threat_counts(rules.threat_alerts(logs, nodes)), "rule", "alert_count"))
    assert counts == {"DDOS": 1, "STATUS_MISMATCH": 60, "LATENCY": 6, "INFECTED_NODE": 1}
    assert rules.top_offenders(rules.threat_alerts(logs, nodes), 2).collect()[0][:] == (1, 61)
    summary = {(r["section"], r["item"]): r["alert_count"] for r in rules.threat_summary(logs, nodes).collect()}
    assert summary[("rule", "DDOS")] == 1 and summary[("top_node", "1")] == 61


# Reports ------------------------------------------------------------------------

def test_reports_on_small_fleet(spark, make_logs, make_nodes):
    logs = make_logs([(0, 1, 200, 100, 0.5, None), (5001, 1, 429, 300, None, 0.7), (5002, 2, 404, 130, None, None), (5003, 9, 200, 1, None, None)])
    nodes = make_nodes([(1, "SN-1", True), (2, "SN-2", False), (3, "SN-3", True)])
    found = spark.createDataFrame(
        [(1, 5001, -0.1), (2, 3, -0.2)], "node_id long, log_id long, anomaly_score double"
    ).withColumn("detector", F.lit("IsolationForest"))
    assert rows_of(reports.city_map(logs, nodes, found), "node_uuid", "http_status_label", "is_infected") == [
        (1, "THROTTLED", True), (2, "CRITICAL", False),
    ]
    risk = {r["node_uuid"]: r for r in reports.node_risk(logs, found, nodes).collect()}
    assert set(risk) == {1, 2, 9} and risk[9]["serial_number"] == "UNKNOWN"
    assert (risk[1]["avg_response_time_ms"], risk[1]["anomaly_hit_count"], risk[1]["risk_level"]) == (300.0, 1, "CRITICAL")
    shown = {r["id"]: r for r in reports.dashboard_nodes(logs, nodes, found).collect()}
    assert (shown[3]["last_http_code"], shown[3]["reported_json"], shown[3]["is_infected"]) == (200, "OPERATIONAL", False)
    status = reports.node_status(logs, nodes, 1).collect()
    assert len(status) == 1 and status[0]["effective_load"] == 0.7 and status[0]["active_schema_version"] == 2
    assert reports.node_status(logs, nodes, 3).count() == reports.node_status(logs, nodes, 42).count() == 0
    assert reports.inventory(nodes, logs).first()[:] == (3, 4)


def test_reports_on_an_empty_log_table(spark, make_logs, make_nodes):
    logs = make_logs([(0, 1, 200, 1, None, None)]).limit(0)
    nodes = make_nodes([(1, "SN-1", True)])
    found = spark.createDataFrame([], "node_id long, log_id long, anomaly_score double, detector string")
    config = spark.createDataFrame([(1, 0, "load_val"), (2, 5000, "L_V1")], "version int, time_start long, active_column string")
    parts = reports.dashboard(logs, nodes, found, config, full=True)
    assert parts["schema_engine"].first()[:] == (1, "load_val", "-5000_PKTS", "load_val_LOCKED")
    assert parts["metadata"].first()["active_threats"] == 0
    assert parts["nodes"].count() == 1 and parts["heatmap"].count() == 0 and parts["terminal_logs"].count() == 0


def test_schema_console_at_an_id(spark, make_logs):
    config = spark.createDataFrame([(2, 5000, "L_V1"), (1, 0, "load_val")], "version int, time_start long, active_column string")
    logs = make_logs([(12, 1, 200, 1, None, None)])
    current, versions = reports.schema_console(logs, config, 7000)
    assert current.first()[:] == (2, "L_V1", 7000)
    assert [r["is_current"] for r in versions.collect()] == [False, True]
    assert reports.schema_console(logs, config)[0].first()[:] == (1, "load_val", 12)


def test_pinned_reports_ignore_the_rest_of_the_table(make_logs):
    logs = make_logs([(i, 1, 200, 1, None, None) for i in range(20)])
    cut = windows.tumbling(logs, 9, window=5)
    assert sorted(r["log_id"] for r in cut.collect()) == list(range(5, 20))
    assert anomalies.flag_rate(logs.withColumn("anomaly_score", F.lit(0.0))).first()[:] == (20, 0, 0.0)
