"""Labelled documents and the folds that keep some of them out of training."""

import numpy as np
from pyspark.sql import functions as F

from nodeglass.llm.tables import stage
from nodeglass.operators import skew


def fold(key, folds):
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds))


def with_labels(docs, labels, label, key="doc_id"):
    """``docs`` labelled 0 or 1, with the label as ``_label``.

    A key with several labels has the largest. The label table is broadcast
    after it was counted. Beyond the checked number the join is a shuffle and its
    result a table, so that the texts move once however often they are read.
    """
    one = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(
        F.max(label).cast("int").alias("_label"))
    if one.count() <= skew.BROADCAST_ROWS:
        return docs.join(F.broadcast(one), key)
    return stage(docs.join(one, key), "labelled")


def fit_logistic(features, labels, penalty=1e-3, steps=50):
    """Weights (last: intercept) of a ridge logistic regression, by Newton steps.

    ``features`` is a numpy matrix; both labels must occur.
    """
    middle, width = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.column_stack(((features - middle) / width, np.ones(len(features))))
    w, ridge = np.zeros(x.shape[1]), penalty * len(x) * np.diag([1.0] * features.shape[1] + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (labels - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / width, w[-1] - (w[:-1] * middle / width).sum())
