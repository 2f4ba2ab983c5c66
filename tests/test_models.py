import random
import subprocess
import sys

import numpy as np
from pyspark import cloudpickle
import pytest
from pyspark.sql import functions as F

from nodeglass.operators import audit, classify, features, forest
from nodeglass.plans import jobs


def telemetry(make_logs, n=2000, seed=4):
    """Mostly calm logs; every 25th is slow, throttled and loaded."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        odd = i % 25 == 0
        rows.append((
            i, rng.randint(200, 220) if odd else rng.randint(0, 199), 429 if odd else rng.choice([200] * 9 + [206]),
            rng.randint(230, 260) if odd else rng.randint(90, 150),
            None if rng.random() < 0.05 else (rng.uniform(0.9, 1.0) if odd else rng.uniform(0.2, 0.4)), None,
        ))
    return make_logs(rows)


@pytest.fixture
def loaded(make_logs):
    return features.with_load(telemetry(make_logs))


def fit(loaded, **options):
    fill = features.median_load(loaded)
    return forest.fit_forest(features.log_features(loaded, fill), fill, **options)


def one_log(make_logs, ms, code, load):
    return features.with_load(make_logs([(0, 1, code, ms, load, None)]))


def test_flags_the_contamination_share_and_ranks_odd_logs_low(loaded, make_logs):
    model = fit(loaded)
    scored = forest.score_logs(loaded, model)
    flagged = scored.filter("is_anomaly").count()
    assert flagged == pytest.approx(0.08 * 2000, abs=10)
    by_kind = dict(scored.groupBy((F.col("log_id") % 25 == 0)).agg(F.avg("anomaly_score")).collect())
    assert by_kind[True] < 0 < by_kind[False]
    odd = forest.score_logs(one_log(make_logs, 250, 429, 0.99), model).first()
    calm = forest.score_logs(one_log(make_logs, 120, 200, 0.3), model).first()
    assert odd["anomaly_score"] < calm["anomaly_score"] and calm["anomaly_score"] > 0 and odd["is_anomaly"]


def test_infected_nodes_score_lower(loaded, make_nodes):
    nodes = make_nodes([(n, f"SN-{n}", n >= 200) for n in range(221)])
    scored = forest.score_logs(loaded, fit(loaded, trees=40))
    means = {r["is_infected"]: r["mean_score"] for r in audit.scores_by_label(scored, nodes).collect()}
    assert means[True] < means[False]


@pytest.mark.parametrize("trees, subsample", [(20, 64), (4, 16)])  # drawn per tree; dealt out
def test_same_forest_under_any_partitioning(loaded, trees, subsample):
    def grown(parts):
        model = fit(loaded.repartition(parts), trees=trees, subsample=subsample)
        return model.offset, sorted(map(tuple, model.trees.drop("threshold").na.fill(-1).collect()))

    first, second = grown(2), grown(7)
    assert first[1] == second[1]
    assert first[0] == pytest.approx(second[0])
    roots = [r for r in first[1] if r[1] == 0]
    assert len(roots) == trees and all(r[3] == subsample for r in roots)


def test_scores_equal_a_walk_down_the_trees(loaded):
    model = fit(loaded, trees=10, subsample=32)
    nodes = {(r["tree_id"], r["slot"]): r for r in model.trees.collect()}
    scaled = features.standardise(features.log_features(loaded, model.load_fill), model.scaler).limit(50).collect()
    scores = {r["log_id"]: r["anomaly_score"] for r in forest.score_logs(loaded, model).collect()}
    harmonic = lambda n: np.log(n - 1) + np.euler_gamma
    path = lambda n: 0.0 if n <= 1 else 1.0 if n == 2 else 2 * harmonic(n) - 2 * (n - 1) / n
    for row in scaled:
        depths = []
        for tree in range(10):
            slot, depth = 0, 0
            while nodes[tree, slot]["feature"] >= 0:
                node = nodes[tree, slot]
                right = row[features.LOG_FEATURES[node["feature"]]] > node["threshold"]
                slot, depth = 2 * slot + (2 if right else 1), depth + 1
            depths.append(depth + path(nodes[tree, slot]["leaf_size"]))
        assert scores[row["log_id"]] == pytest.approx(-(2 ** (-np.mean(depths) / path(32))) - model.offset)


def test_saved_forest_scores_the_same(spark, loaded, tmp_path):
    model = fit(loaded, trees=10)
    forest.save_forest(model, str(tmp_path / "m"))
    again = forest.load_forest(spark, str(tmp_path / "m"))
    score = lambda m: sorted(map(tuple, forest.score_logs(loaded, m).select("log_id", "anomaly_score").collect()))
    assert score(model) == score(again)
    with pytest.raises(FileNotFoundError):
        forest.load_forest(spark, str(tmp_path / "nothing"))


def test_tiny_and_empty_training_sets(make_logs):
    few = features.with_load(make_logs([(i, 1, 200, 100 + i, 0.1, None) for i in range(3)]))
    assert forest.score_logs(few, fit(few, trees=5)).count() == 3
    with pytest.raises(ValueError):
        forest.fit_forest(features.log_features(few.limit(0), 0.3), 0.3)


def test_constant_feature_scales_to_zero(make_logs):
    table = features.log_features(features.with_load(make_logs([(i, 1, 200, 100, 0.5, None) for i in range(4)])), 0.3)
    scaled = features.standardise(table, features.scaler_stats(table))
    assert all(r[c] == 0.0 for r in scaled.collect() for c in features.LOG_FEATURES)


def test_fill_is_the_training_median(make_logs):
    logs = features.with_load(make_logs([(0, 1, 200, 1, 0.1, None), (1, 1, 200, 1, 0.5, None), (2, 1, 200, 1, 0.9, None), (3, 1, 200, 1, None, None)]))
    assert features.median_load(logs) == 0.5
    assert features.median_load(logs, approximate=True) == 0.5
    filled = features.log_features(logs, 0.5).orderBy("log_id").collect()
    assert filled[3]["effective_load"] == 0.5


def test_training_job(spark, make_logs, make_nodes, tmp_path):
    logs = telemetry(make_logs)
    nodes = make_nodes([(n, f"SN-{n}", n >= 200) for n in range(221)])
    seen = logs.select("node_id").distinct().count()
    models, found = jobs.train(logs, nodes, str(tmp_path / "models"), trees=20, rounds=3)
    assert found["auc"] > 0.9
    classes = {r["class"]: r for r in found["classes"].collect()}
    assert classes["Infected"]["recall"] > 0.8 and classes["Clean"]["support"] + classes["Infected"]["support"] == seen
    again = jobs.load_models(spark, str(tmp_path / "models"))
    table = features.node_features(features.with_load(logs), nodes)
    score = lambda m: dict(map(tuple, classify.score_nodes(m, table).select("node_id", "infected_prob").collect()))
    assert score(models.classifier) == pytest.approx(score(again.classifier))
    assert found["registry"].first()["infected_nodes"] == 21


def test_class_balance_without_positives(make_nodes):
    assert classify.class_balance(make_nodes([(1, "SN-1", False)])).first()[:] == (0, 1, 1.0)


def test_task_functions_load_without_the_package(tmp_path):
    code = cloudpickle.dumps((forest._path_lengths, forest._build_tree))
    (tmp_path / "code").write_bytes(code)
    load = "import pickle; print(len(pickle.load(open('code', 'rb'))))"
    done = subprocess.run([sys.executable, "-c", load], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.strip() == "2", done.stderr
