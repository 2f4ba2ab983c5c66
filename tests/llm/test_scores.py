"""Toxicity and quality: held-out accuracy, odd rows, and steps done by hand."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nodeglass.llm import labelled, quality, toxicity, words

SF = "/root/testdata/sf0.01"


def held_out(spark, out, label):
    known = spark.read.parquet(f"{SF}/labels.parquet")
    return known.join(out.where("held_out"), "doc_id").select(F.col(label).alias("label"), "score", "predicted").toPandas()


def area(rows):
    """Area under the ROC curve."""
    rank, ones = rows["score"].rank(), rows["label"] == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


@pytest.fixture(scope="module")
def known(spark):
    rows = []
    rng = np.random.default_rng(0)
    for i in range(400):
        text = [f"w{x}" for x in rng.integers(0, 60, 40)]
        if i % 4 == 0:
            text[5::9] = ["vilething"] * len(text[5::9])
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, _label int")


def test_toxicity_held_out(spark):
    out = toxicity.op1_toxicity(spark, SF)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    out = out.cache()
    assert out.count() == 1000 and out.where("score NOT BETWEEN 0 AND 1 OR predicted <> int(score >= 0.5)").isEmpty()
    assert area(held_out(spark, out, "toxic")) > 0.85


def test_quality_held_out(spark):
    out = quality.op6_quality_classifier(spark, SF).cache()
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = held_out(spark, out, "quality")
    assert out.count() == 1000 and (rows["label"] == rows["predicted"]).mean() > 0.95


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    known = spark.read.parquet(f"{SF}/labels.parquet")
    changed = known.withColumn("toxic", F.when(labelled.fold("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted((r["doc_id"], r["_label"]) for r in labelled.with_labels(docs, k, "toxic").where(
        labelled.fold("doc_id", 5) != 0).collect()) for k in (known, changed))
    assert one == two


def test_labels_by_shuffle_equal_labels_by_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    known = spark.createDataFrame([(1, 0, None), (1, 1, 1), (2, 1, 0), (3, None, 1), (None, 1, 1), (4, 7, 7)], "doc_id long, quality int, toxic int")
    found = [sorted((r["doc_id"], r["_label"]) for r in labelled.with_labels(docs, known, "quality").collect())]
    monkeypatch.setattr(labelled.skew, "BROADCAST_ROWS", 0)
    found.append(sorted((r["doc_id"], r["_label"]) for r in labelled.with_labels(docs, known, "quality").collect()))
    assert found == [[(1, 1), (2, 1)]] * 2


def test_toxicity_edge_rows(spark, edge_docs, no_docs, known):
    out = toxicity.score_toxicity(edge_docs, known)
    assert sorted(out.columns) == sorted(edge_docs.columns)
    rows = out.collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (0, 1)}) == 1
    assert toxicity.score_toxicity(no_docs, known).count() == 0
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(edge_docs, known.where("false")).collect())


def test_toxicity_sees_words_not_partitions(spark, known):
    docs = spark.createDataFrame([(1, "w1 w2 w3 w4 vilething w5 w6 vilething"), (2, "w1 w2 w3 w4 w5 w6 w7")], "doc_id long, text string")
    scores = [{r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, known.repartition(n)).collect()} for n in (1, 7)]
    assert scores[0] == pytest.approx(scores[1]) and scores[0][1] > 0.5 > scores[0][2]


def test_counts_cover_all_and_the_scale_a_sample(spark, known, monkeypatch):
    counted, taught, fit, scale = [], [], toxicity.fit, toxicity.fit_logistic
    monkeypatch.setattr(toxicity, "SCALE_ROWS", 100)
    monkeypatch.setattr(toxicity, "fit", lambda rows: counted.append(rows.count()) or fit(rows))
    monkeypatch.setattr(toxicity, "fit_logistic", lambda x, y: taught.append(len(y)) or scale(x, y))
    toxicity.score_toxicity(spark.createDataFrame([(1, "w1")], "doc_id long, text string"), known)
    assert counted == [400] and 60 < taught[0] < 140


def test_a_text_is_scored_without_its_own_counts(spark, monkeypatch):
    """Leaving a text's counts out gives the ratios of a model that never saw it."""
    texts = [("abab cab bad", 1), ("bb ab", 0), ("cabbage bad", 0), ("bad cab ab", 1), ("dab bad dab", 1)]
    discounts = toxicity._discounts
    monkeypatch.setattr(toxicity, "_discounts", lambda tables: dict.fromkeys(discounts(tables), 0.5))
    whole = toxicity.fit(spark.createDataFrame(texts, "text string, _label int"))
    for i, (text, label) in enumerate(texts):
        rest = toxicity.fit(spark.createDataFrame(texts[:i] + texts[i + 1:], "text string, _label int"))
        rest = whole[0], rest[1], (rest[2][0], *whole[2][1:])  # what both classes share stays
        (_, data, offsets), = words.blocks(pa.array([text]))
        for ratios in (toxicity.word_ratios, toxicity.byte_ratios):
            got, want = ratios(whole, data, offsets, np.array([label == 1]))[0], ratios(rest, data, offsets)[0]
            assert got == pytest.approx(want, abs=1e-4)


def test_byte_model_by_hand(spark):
    """Probabilities of a tiny corpus against counts in dictionaries."""
    texts = [("abab cab", 1), ("bb ab", 0), ("cabbage", 0)]
    model = toxicity.fit(spark.createDataFrame(texts, "text string, _label int"))
    counts = [Counter(), Counter()]
    for text, toxic in texts:
        padded = " " * 5 + text
        for i in range(5, len(padded)):
            counts[1 - toxic][padded[i - 4:i + 1]] += 1
    orders = {5: counts}
    for k in (4, 3):
        orders[k] = [Counter(g[1:] for g in c) for c in orders[k + 1]]
    orders[2] = Counter(g[1:] for g in {*orders[3][0], *orders[3][1]})
    orders[1] = Counter(g[1:] for g in orders[2])

    def cut(c):
        once, twice = (sum(n == k for n in c.values()) for k in (1, 2))
        return once / (once + 2 * twice) if once else 0.5

    def probability(gram, c):
        k = len(gram)
        if k == 1:
            return (orders[1][gram] + 1) / (sum(orders[1].values()) + 256)
        table = orders[k] if k == 2 else orders[k][c]
        total = sum(n for g, n in table.items() if g[:-1] == gram[:-1])
        lower = probability(gram[1:], c)
        if not total:
            return lower
        kinds = sum(g[:-1] == gram[:-1] for g in table)
        return max(table[gram] - cut(table), 0) / total + cut(table) * kinds / total * lower

    text = "cab xa"
    (_, data, offsets), = words.blocks(pa.array([text]))
    ratios, _ = toxicity.byte_ratios(model, data, offsets)
    padded = " " * 5 + text
    want = [math.log(probability(padded[i - 4:i + 1], 0) / probability(padded[i - 4:i + 1], 1)) for i in range(5, len(padded))]
    assert ratios.tolist() == pytest.approx(want, abs=1e-4)


def test_quality_edge_rows(spark, edge_docs, no_docs, known):
    out = quality.score_quality(edge_docs, known)
    assert sorted(out.columns) == sorted(edge_docs.columns)
    rows = out.collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score_quality(no_docs, known).count() == 0
    assert {r["score"] for r in quality.score_quality(edge_docs, known.where("false")).collect()} == {0.5}


def test_quality_scores_are_those_of_the_network():
    texts = ["a bc bc def", "xyz", "", "hello hello hello"]
    model = quality.train(texts, np.array([1, 0, 1, 0]))
    by_bag = [model[0][b] @ w + model[1] if len(b) else model[1] for b, w in quality._bags(pa.array(texts))]
    assert quality.log_odds(model, pa.array(texts)).tolist() == pytest.approx(by_bag, abs=1e-5)


def test_sample_is_bounded(spark, known, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_DOCUMENTS", 50)
    monkeypatch.setattr(quality, "train", lambda texts, labels: (np.full(1 << quality.BUCKET_BITS, len(texts), np.float32), 0.0))
    odds, _ = quality.fit(known.withColumnRenamed("doc_id", "key"))
    assert 20 < odds[0] < 90


def test_logistic_scale():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(int)
    assert labelled.fit_logistic(x, y, penalty=0).tolist() == pytest.approx([2, -1, 0.5], abs=0.25)


def test_quality_training_equals_dense_matrices(monkeypatch):
    """The same steps on whole vectors of features, most of them 0."""
    monkeypatch.setattr(quality, "EPOCHS", 2)
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["good", "fine", "bad", "poor", "x y"], rng.integers(0, 12))) for _ in range(25)]
    labels = np.array([int("good" in t) for t in texts])
    size = 1 << quality.BUCKET_BITS
    bags = list(quality._bags(pa.array(texts)))
    used = np.unique(np.concatenate([b for b, _ in bags]))
    x = np.zeros((len(texts), len(used)))
    for i, (buckets, shares) in enumerate(bags):
        x[i, np.searchsorted(used, buckets)] = shares
        assert not len(buckets) or shares.sum() == pytest.approx(1 if len(texts[i]) >= 3 else 0.5)
    rng = np.random.default_rng(7)
    v = rng.uniform(-1 / quality.DIMENSIONS, 1 / quality.DIMENSIONS, (size, quality.DIMENSIONS))[used]
    layer, constant, done = np.zeros((2, quality.DIMENSIONS)), np.zeros(2), 0
    for _ in range(2):
        for i in rng.permutation(len(texts)):
            mean = x[i] @ v
            z = np.exp(layer @ mean + constant)
            error = z / z.sum() - np.eye(2)[labels[i]]
            rate = quality.RATE * (1 - done / (2 * len(texts)))
            slope = np.outer(x[i] * np.sqrt((x[i] > 0).sum()), error @ layer)
            layer = layer - rate * np.outer(error, mean)
            constant = constant - rate * 0.1 * error
            v = v - rate * slope
            done += 1
    odds, offset = quality.train(texts, labels)
    assert odds[used] == pytest.approx(v @ (layer[1] - layer[0]), abs=1e-5) and offset == pytest.approx(constant[1] - constant[0])
