"""Boosted trees and the area under the curve against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeglass.operators import boosting, classify, skew
from nodeglass.operators.features import NODE_FEATURES
from nodeglass.operators.running import running_totals

COLUMNS = ["a", "b", "c"]


def rows_of(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rng.randint(0, 40), rng.random()
        c = None if rng.random() < 0.1 else float(rng.randint(0, 3))
        out.append((i, float(a), b, c, rng.random() < (0.8 if a > 25 and b > 0.4 else 0.1)))
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y boolean").repartition(parts)


def plain_boosting(rows, rounds, depth, rate, weight, penalty=1.0, least=1.0):
    """Every cut of every node tried on lists; trees as nested (feature, threshold, left, right) or values."""
    x = [[v or 0.0 for v in r[1:4]] for r in rows]
    y = [r[4] for r in rows]
    n, margin, trees = len(rows), [0.0] * len(rows), []
    cuts = []
    for f in range(3):
        ordered = sorted(v[f] for v in x)
        cuts.append(sorted({ordered[math.ceil(k * n / 256) - 1] for k in range(1, 256)}))

    def grow(members, level, g, h):
        G, H = sum(g[i] for i in members), sum(h[i] for i in members)
        best = (1e-6, None)
        for f in range(3) if level < depth else ():
            for cut in cuts[f]:
                left = [i for i in members if x[i][f] <= cut]
                gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                gr, hr = G - gl, H - hl
                if hl >= least and hr >= least:
                    gain = (gl * gl / (hl + penalty) + gr * gr / (hr + penalty) - G * G / (H + penalty)) / 2
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut, left))
        if best[1] is None:
            value = -rate * G / (H + penalty)
            for i in members:
                margin[i] += value
            return value
        f, cut, left = best[1]
        right = [i for i in members if x[i][f] > cut]
        return f, cut, grow(left, level + 1, g, h), grow(right, level + 1, g, h)

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        w = [weight if t else 1.0 for t in y]
        trees.append(grow(list(range(n)), 0, [wi * (pi - t) for wi, pi, t in zip(w, p, y)], [wi * pi * (1 - pi) for wi, pi in zip(w, p)]))
    return trees, margin


def nested(model, number, slot=0):
    f = int(model.feature[number, slot])
    if f < 0:
        return pytest.approx(model.value[number, slot], abs=1e-6)
    return f, model.threshold[number, slot], nested(model, number, 2 * slot + 1), nested(model, number, 2 * slot + 2)


def test_equals_plain_boosting(spark):
    rows = rows_of(120)
    model = boosting.fit(frame(spark, rows), COLUMNS, "y", rounds=4, depth=3, rate=0.3, positive_weight=2.5)
    trees, margin = plain_boosting(rows, 4, 3, 0.3, 2.5)
    assert [nested(model, i) for i in range(4)] == trees
    scored = frame(spark, rows).withColumn("p", boosting.probability(model, spark)).orderBy("id").collect()
    assert [r["p"] for r in scored] == pytest.approx([1 / (1 + math.exp(-m)) for m in margin], abs=1e-6)


def same(one, two):
    return all((getattr(one, k) == getattr(two, k)).all() for k in ("feature", "threshold", "value", "gain"))


def test_a_job_for_each_level_grows_the_same_trees(spark, monkeypatch):
    table = frame(spark, rows_of(400, 2), 5)
    one = boosting.fit(table, COLUMNS, "y", rounds=3, depth=4, positive_weight=4.0)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    for parts in (1, 7):
        assert same(one, boosting.fit(table.repartition(parts), COLUMNS, "y", rounds=3, depth=4, positive_weight=4.0))


def test_tables_without_a_split(spark):
    table = frame(spark, rows_of(50))
    chance = lambda model: [r[0] for r in table.select(boosting.probability(model, spark)).distinct().collect()]
    empty = boosting.fit(table.where("false"), COLUMNS, "y", rounds=3)
    assert chance(empty) == [0.5] and sum(empty.importances().values()) == 0
    flat = boosting.fit(table.withColumns({c: F.lit(1.0) for c in COLUMNS}), COLUMNS, "y", rounds=3)
    assert len(chance(flat)) == 1
    negative = boosting.fit(table.withColumn("y", F.lit(False)), COLUMNS, "y", rounds=30, rate=0.3)
    assert max(chance(negative)) < 0.1
    unknown = boosting.fit(table.withColumns({c: F.lit(None).cast("double") for c in COLUMNS}).withColumn("y", F.lit(None).cast("boolean")), COLUMNS, "y", rounds=2)
    assert (unknown.feature < 0).all()


def test_many_rounds_learn_the_labels(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        sick = rng.random() < 0.15
        latency = rng.gauss(190 if sick else 120, 25)
        rows.append((i, latency, latency * 2, latency * 1.5, rng.random() * (0.5 if sick else 0.2), 0.0, None if i % 9 == 0 else 0.3, sick))
    table = spark.createDataFrame(rows, "node_id long, " + ", ".join(f"{c} double" for c in NODE_FEATURES) + ", is_infected boolean")
    model = classify.fit_classifier(table)
    assert model.feature.shape == (300, 63) and sum(model.importances().values()) == pytest.approx(1)
    scored = classify.score_nodes(model, table)
    assert scored.columns == [*table.columns, "infected_prob", "predicted_infected"]
    assert classify.auc(scored) > 0.99
    report = {r["class"]: r for r in classify.class_report(scored).collect()}
    assert report["Infected"]["recall"] > 0.95
    classify.save_classifier(spark, model, str(tmp_path / "m"))
    again = classify.load_classifier(spark, str(tmp_path / "m"))
    order = lambda m: [r["infected_prob"] for r in classify.score_nodes(m, table).orderBy("node_id").collect()]
    assert order(model) == order(again)
    with pytest.raises(FileNotFoundError):
        classify.load_classifier(spark, str(tmp_path / "nothing"))


def test_rank_auc(spark):
    rng = random.Random(5)
    rows = [(rng.random() < 0.3, float(rng.randint(0, 12))) for _ in range(200)] + [(None, 1.0), (True, None)]
    df = spark.createDataFrame(rows, "is_infected boolean, infected_prob double").repartition(4)
    high, low = ([s for y, s in rows if y is want and s is not None] for want in (True, False))
    want = np.mean([(p > n) + (p == n) / 2 for p in high for n in low])
    assert classify.auc(df) == pytest.approx(want)
    assert classify.auc(df.where("is_infected")) is None and classify.auc(df.where("false")) is None


def test_running_totals(spark):
    rng = random.Random(6)
    rows = [(k, rng.randint(-5, 5), rng.randint(0, 3)) for k in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k long, x long, z long").repartition(6)
    got = running_totals(df, ["k"], {"sx": "x", "sz": "z"}).orderBy("k").collect()
    sx = sz = 0
    for r, (k, x, z) in zip(got, sorted(rows), strict=True):
        sx, sz = sx + x, sz + z
        assert (r["k"], r["x"], r["sx"], r["sz"]) == (k, x, sx, sz)
    assert running_totals(df.where("false"), ["k"], {"sx": "x"}).count() == 0
