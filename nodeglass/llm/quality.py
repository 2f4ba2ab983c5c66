"""Op 6: quality classifier with supervised subword embeddings.

Every word and every run of 3 to 5 bytes of a text is a feature with a learned
vector, found by hash; a word equal to the one before it counts as the feature
"ditto". A text is the mean of its features' vectors, half from words and half
from byte runs, and a softmax layer turns the mean into class probabilities.
Vectors and layer are trained together by stochastic gradient descent, one
document a step. As the layer is linear, scoring needs only each bucket's part
in the log-odds.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from nodeglass.llm import words
from nodeglass.llm.labelled import fold, with_labels
from nodeglass.llm.tables import map_batches, table

BUCKET_BITS = 17
LENGTHS = (3, 4, 5)  # bytes of character n-grams
DIMENSIONS = 8
TRAIN_DOCUMENTS = 3000  # labelled documents the classifier is fitted on, at most about
EPOCHS = 5
RATE = 0.5
_SHIFT = np.uint64(64 - BUCKET_BITS)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _features(data, offsets):
    """(buckets, each text's first) of the words, then of each length of n-gram.

    N-grams that would start in the text before get the bucket -1.
    """
    data = np.where(words.WHITE[data], np.uint8(32), data)
    starts, ends, first = words.word_spans(data, offsets)
    hashes = words.word_hashes(data, starts, ends)
    ditto = np.zeros(len(hashes), bool)
    ditto[1:] = hashes[1:] == hashes[:-1]
    ditto[first[:-1][np.diff(first) > 0]] = False
    yield np.where(ditto, 0, hashes >> _SHIFT).astype(np.int32), first
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    sequence = data.astype(np.uint64)
    for j in range(1, max(LENGTHS)):
        sequence[j:] |= data[:-j].astype(np.uint64) << np.uint64(8 * j)
        if j + 1 in LENGTHS:
            own = sequence & np.uint64((1 << 8 * (j + 1)) - 1)
            bucket = ((own + np.uint64(j)) * _STEP >> _SHIFT).astype(np.int32)
            yield np.where(place >= j, bucket, -1), offsets


def _bags(column):
    """For each text its distinct buckets and their shares, which sum to 1."""
    for _, data, offsets in words.blocks(column):
        kinds = list(_features(data, offsets))
        for k in range(len(offsets) - 1):
            single, *runs = [buckets[begin[k]:begin[k + 1]] for buckets, begin in kinds]
            runs = np.concatenate(runs)
            runs = runs[runs >= 0]
            weights = np.repeat([0.5 / max(1, len(single)), 0.5 / max(1, len(runs))], [len(single), len(runs)])
            buckets, which = np.unique(np.concatenate((single, runs)), return_inverse=True)
            yield buckets, np.bincount(which, weights, len(buckets))


def train(texts, labels, seed=7):
    """Log-odds of class 1 for each bucket, and the constant part.

    Plain numpy stochastic gradient descent with a rate that falls to 0.
    """
    bags = list(_bags(pa.array(texts, pa.string())))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS))
    layer, constant = np.zeros((2, DIMENSIONS)), np.zeros(2)
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            buckets, shares = bags[i]
            mean = shares @ vectors[buckets]
            z = layer @ mean + constant
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            rate = RATE * (1 - done / steps)
            back = p @ layer
            layer -= rate * np.outer(p, mean)
            constant -= rate * 0.1 * p
            # Shares fall with a text's length; the root of their number keeps steps alike.
            vectors[buckets] -= rate * (shares[:, None] * len(shares) ** 0.5) * back
            done += 1
    odds = layer[1] - layer[0]
    return (vectors @ odds).astype(np.float32), float(constant[1] - constant[0])


def fit(labelled):
    """Train in one task on a bounded sample of documents (key, text, _label)."""
    total = labelled.count()
    if total > TRAIN_DOCUMENTS:
        labelled = labelled.where(F.pmod(F.xxhash64("key"), F.lit(total)) < TRAIN_DOCUMENTS)

    def one(rows):
        rows = rows.sort_values(["key", "text"], ignore_index=True)
        odds, constant = train(rows["text"], rows["_label"].to_numpy())
        return pd.DataFrame({"odds": [odds.tobytes()], "constant": [constant]})

    sample = labelled.select("key", F.coalesce("text", F.lit("")).alias("text"), "_label", F.lit(0).alias("all"))
    rows = sample.groupBy("all").applyInPandas(one, "odds binary, constant double").collect()
    if not rows:
        return np.zeros(1 << BUCKET_BITS, np.float32), 0.0
    return np.frombuffer(rows[0]["odds"], np.float32), rows[0]["constant"]


def log_odds(model, column):
    """Log-odds of class 1 for each text of an Arrow column."""
    odds, constant = model
    padded = np.append(odds, np.float32(0))  # bucket -1
    out = np.zeros(len(column))
    for at, data, offsets in words.blocks(column):
        sums, counts = np.zeros((2, len(offsets) - 1)), np.zeros((2, len(offsets) - 1))
        for n, (buckets, begin) in enumerate(_features(data, offsets)):
            upto = np.concatenate(([0.0], np.cumsum(padded[buckets], dtype=np.float64)))
            real = np.concatenate(([0], np.cumsum(buckets >= 0)))
            sums[min(n, 1)] += upto[begin[1:]] - upto[begin[:-1]]
            counts[min(n, 1)] += real[begin[1:]] - real[begin[:-1]]
        out[at:at + len(offsets) - 1] = (0.5 * sums / np.maximum(counts, 1)).sum(axis=0)
    return out + constant


def score_quality(docs, labelled, key="doc_id", text="text"):
    """``docs`` with ``score``, 0 to 1, higher for likelier good texts.

    ``labelled``: documents (key, text, _label), of which at most about
    ``TRAIN_DOCUMENTS``, drawn by hash of the key, are trained on. Null and
    empty texts have no features and get the constant part of the model; with
    no labelled documents every score is one half. A column called score is
    replaced; rows come out as often as they came in.
    """
    model = docs.sparkSession.sparkContext.broadcast(
        fit(labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), "_label")))
    kept = [c for c in docs.columns if c != "score"]
    place = kept.index(text)

    def score(batches):
        for batch in batches:
            found = 1 / (1 + np.exp(-np.clip(log_odds(model.value, batch.column(place)), -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*kept, "score"])

    schema = T.StructType([*docs.select(*kept).schema, T.StructField("score", T.DoubleType())])
    return map_batches(docs.select(*kept), score, schema)


def op6_quality_classifier(spark, sf_dir):
    """Quality of every document; labels of fold 1 of 3 are never used."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = with_labels(docs, table(spark, sf_dir, "labels"), "quality").where(fold("doc_id", 3) != 1)
    return score_quality(docs, labelled).select(
        "doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
