"""Second-order boosted trees on histograms (Chen and Guestrin, 2016).

Features are cut into at most ``BINS`` quantile bins. Each level of a tree is one
aggregation: tasks sum gradients and Hessians of the logistic loss by (tree node,
feature, bin), the sums meet in a grouping, and the driver, which sees at most
``2**depth * features * BINS`` of them, picks every node's split by regularised
gain. Gradients are rounded to a fixed binary scale at which all sums are exact,
so the trees do not depend on partitioning or retries.

A table of up to ``skew.BROADCAST_ROWS`` rows, as may be broadcast, is boosted by
one task: the same steps without a job for each of the levels.
"""

import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from nodeglass import settings as S
from nodeglass.operators import skew
from nodeglass.session import file_system, scratch_path

# The functions below travel to the executors as code, so that the package need
# not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 256
QUANTILE_ACCURACY = 100_000
LEAST_GAIN = 1e-6

_STATE = "bins binary, label boolean, margin double"
_TREES = "round int, slot int, feature int, cut int, threshold double, value double, gain double"


@dataclass
class BoostedTrees:
    """Trees by heap slot: node s has the children 2s + 1 and 2s + 2.

    ``feature`` is -1 at leaves; a row goes left where its feature is at most
    ``threshold``. ``value`` of a leaf is added to the log odds.
    """

    features: list
    feature: np.ndarray  # rounds x slots
    threshold: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def importances(self):
        """Mean gain of the splits on each feature, as shares of 1."""
        mean = [self.gain[self.feature == i].mean() if (self.feature == i).any() else 0.0 for i in range(len(self.features))]
        total = sum(mean)
        return {name: float(m / total) if total else 0.0 for name, m in zip(self.features, mean)}

    def margins(self, columns):
        """Log odds of rows given as one array per feature."""
        x = np.column_stack([np.asarray(c, float) for c in columns])
        total, every = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            slot = np.zeros(len(x), np.int64)
            for _ in range(int(len(feature) + 1).bit_length() - 2):
                split = feature[slot]
                right = x[every, np.maximum(split, 0)] > threshold[slot]
                slot = np.where(split < 0, slot, 2 * slot + 1 + right)
            total += value[slot]
        return total


@dataclass
class _Rules:
    """What a fit is told: sizes, regularisation and the scale of its sums."""

    cuts: list  # of each feature, ascending
    depth: int
    rate: float
    penalty: float
    least_weight: float
    positive_weight: float
    scale: float

    def empty_tree(self):
        slots = 2 ** (self.depth + 1) - 1
        return {"feature": np.full(slots, -1), "cut": np.zeros(slots, int), "threshold": np.zeros(slots),
                "value": np.zeros(slots), "gain": np.zeros(slots)}


def cut_points(table, columns, bins=BINS):
    """Distinct quantiles k/bins of each column, from bounded sketches."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    row = table.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, QUANTILE_ACCURACY).alias(c) for c in columns]).first()
    return [np.unique(np.asarray(row[c] if row[c] is not None else [], float)) for c in columns]


def _matrix(column, width):
    """Rows of bins from a column of ``width`` bytes each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _gradients(margin, label, rules):
    """First and second derivatives as whole numbers of ``1 / scale``."""
    chance = 1 / (1 + np.exp(-margin))
    weight = np.where(label, rules.positive_weight, 1.0) * rules.scale
    return np.rint(weight * (chance - label)), np.rint(weight * chance * (1 - chance))


def _slots(bins, tree, depth):
    """The tree node that each row has come to."""
    slot, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        split = tree["feature"][slot]
        right = bins[every, np.maximum(split, 0)] > tree["cut"][slot]
        slot = np.where(split < 0, slot, 2 * slot + 1 + right)
    return slot


def _histograms(bins, margin, label, tree, level, rules):
    """Sums by (node of the level, feature, bin, derivative)."""
    node = _slots(bins, tree, level) - (2 ** level - 1)
    g, h = _gradients(margin, label, rules)
    here = node >= 0
    if not here.all():
        bins, node, g, h = bins[here], node[here], g[here], h[here]
    out = np.zeros((2 ** level, bins.shape[1], BINS, 2))
    for f in range(bins.shape[1]):
        at = node * BINS + bins[:, f]
        for k, part in enumerate((g, h)):
            out[:, f, :, k] = np.bincount(at, part, 2 ** level * BINS).reshape(-1, BINS)
    return out


def _grow(tree, level, sums, rules):
    """Split the nodes of a level where that gains; true if any was."""
    left = np.cumsum(sums, axis=2) / rules.scale
    whole = left[:, :1, -1:, :]
    right = whole - left
    weigh = lambda x: x[..., 0] ** 2 / (x[..., 1] + rules.penalty)
    gain = (weigh(left) + weigh(right) - weigh(whole)) / 2
    fits = (left[..., 1] >= rules.least_weight) & (right[..., 1] >= rules.least_weight)
    for f, cuts in enumerate(rules.cuts):
        fits[:, f, len(cuts):] = False
    gain = np.where(fits, gain, -np.inf)
    value = lambda x: -rules.rate * x[0] / (x[1] + rules.penalty)
    any_split = False
    for i in range(len(sums)):
        slot = 2 ** level - 1 + i
        if level == 0:
            tree["value"][slot] = value(whole[i, 0, 0])
        f, b = np.unravel_index(np.argmax(gain[i]), gain[i].shape)
        if gain[i, f, b] > LEAST_GAIN:
            any_split = True
            tree["feature"][slot], tree["cut"][slot] = f, b
            tree["threshold"][slot], tree["gain"][slot] = rules.cuts[f][b], gain[i, f, b]
            tree["value"][2 * slot + 1], tree["value"][2 * slot + 2] = value(left[i, f, b]), value(right[i, f, b])
    return any_split


def _tree_rows(number, tree):
    """Rows of the nodes that a tree has."""
    slots, todo = [], [0]
    while todo:
        s = todo.pop()
        slots.append(s)
        if tree["feature"][s] >= 0:
            todo += [2 * s + 1, 2 * s + 2]
    return [(number, s, *(tree[k][s].item() for k in ("feature", "cut", "threshold", "value", "gain"))) for s in sorted(slots)]


def _binned(table, columns, label, cuts):
    """The fit's own table: each row's bins in one byte string, label and log odds."""
    def run(batches):
        for batch in batches:
            x = [np.searchsorted(c, batch[name].to_numpy(), "left").astype(np.uint8) for name, c in zip(columns, cuts)]
            packed = np.column_stack(x).tobytes()
            rows = [packed[i:i + len(columns)] for i in range(0, len(packed), len(columns))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.binary()), batch["_label"], pa.array(np.zeros(len(rows)))], ["bins", "label", "margin"])

    taken = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
    return table.select(*taken, F.coalesce(F.col(label).cast("boolean"), F.lit(False)).alias("_label")).mapInArrow(run, _STATE)


def _boost_here(state, rounds, rules):
    """All rounds by one task; the trees as a table."""
    width = len(rules.cuts)

    def run(rows):
        bins, label = _matrix(rows["bins"], width), rows["label"].to_numpy()
        margin, out = rows["margin"].to_numpy().copy(), []
        for number in range(rounds):
            tree = rules.empty_tree()
            for level in range(rules.depth):
                if not _grow(tree, level, _histograms(bins, margin, label, tree, level, rules), rules):
                    break
            margin += tree["value"][_slots(bins, tree, rules.depth)]
            out += _tree_rows(number, tree)
        names = [part.split()[0] for part in _TREES.split(", ")]
        kinds = [pa.int32()] * 4 + [pa.float64()] * 3
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    whole = state.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, _TREES)
    return [tuple(r) for r in whole.collect()]


def _boost_wide(state, rounds, rules, path):
    """A job for each level, and a written table of log odds for each round."""
    width, spark, out = len(rules.cuts), state.sparkSession, []

    def sums(tree, level):
        def run(batches):
            for batch in batches:
                found = _histograms(_matrix(batch["bins"], width), batch["margin"].to_numpy(), batch["label"].to_numpy(zero_copy_only=False),
                                    tree, level, rules).reshape(-1, 2)
                at = np.flatnonzero(found.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at, 0]), pa.array(found[at, 1])], ["at", "g", "h"])

        parts = state.mapInArrow(run, "at long, g double, h double").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        whole = np.zeros((2 ** level * width * BINS, 2))
        for r in parts.collect():  # at most nodes x features x bins
            whole[r["at"]] = r["g"], r["h"]
        return whole.reshape(2 ** level, width, BINS, 2)

    def moved(tree):
        def run(batches):
            for batch in batches:
                margin = batch["margin"].to_numpy() + tree["value"][_slots(_matrix(batch["bins"], width), tree, rules.depth)]
                yield pa.RecordBatch.from_arrays([batch["bins"], batch["label"], pa.array(margin)], ["bins", "label", "margin"])

        return state.mapInArrow(run, _STATE)

    for number in range(rounds):
        tree = rules.empty_tree()
        for level in range(rules.depth):
            if not _grow(tree, level, sums(tree, level), rules):
                break
        out += _tree_rows(number, tree)
        if number + 1 < rounds:
            moved(tree).write.parquet(f"{path}/{number + 1}")
            state = spark.read.schema(_STATE).parquet(f"{path}/{number + 1}")
            old, system = file_system(spark, f"{path}/{number}")
            system.delete(old, True)
    return out


def fit(table, columns, label, rounds=S.BOOST_ROUNDS, depth=S.BOOST_DEPTH, rate=S.BOOST_RATE, positive_weight=1.0,
        penalty=1.0, least_weight=1.0):
    """Trees for the chance that ``label`` is true; missing features are 0.

    ``positive_weight`` counts each positive row so many times; a leaf needs a
    Hessian sum of ``least_weight``, and ``penalty`` is added to it. An empty
    table gives trees of one leaf without a vote.
    """
    columns = list(columns)
    filled = table.na.fill(0, columns)
    cuts = cut_points(filled, columns)
    spark, path = table.sparkSession, scratch_path(table.sparkSession, "boosting")
    _binned(table, columns, label, cuts).write.parquet(f"{path}/0")
    state = spark.read.schema(_STATE).parquet(f"{path}/0")
    rows = state.count()
    most = max(1, rows) * max(1.0, positive_weight)
    rules = _Rules(cuts, depth, rate, penalty, least_weight, positive_weight, 2.0 ** min(40, 51 - math.ceil(math.log2(most))))
    try:
        if not rows:
            found = [(number, 0, -1, 0, 0.0, 0.0, 0.0) for number in range(rounds)]
        elif rows <= skew.BROADCAST_ROWS:
            found = _boost_here(state, rounds, rules)
        else:
            found = _boost_wide(state, rounds, rules, path)
    finally:
        old, system = file_system(spark, path)
        system.delete(old, True)
    return from_rows(columns, [(number, slot, f, threshold, value, gain) for number, slot, f, _, threshold, value, gain in found])


def from_rows(columns, rows):
    """A model from (round, slot, feature, threshold, value, gain) rows."""
    rounds, slots = max(r[0] for r in rows) + 1, max(r[1] for r in rows) + 1
    slots = 2 ** slots.bit_length() - 1  # whole levels
    model = BoostedTrees(list(columns), np.full((rounds, slots), -1), *(np.zeros((rounds, slots)) for _ in range(3)))
    for number, slot, feature, threshold, value, gain in rows:
        model.feature[number, slot], model.threshold[number, slot] = feature, threshold
        model.value[number, slot], model.gain[number, slot] = value, gain
    return model


def as_table(spark, model):
    """The nodes of all trees, with the names of their features."""
    rows = []
    for number in range(len(model.feature)):
        todo = [0]
        while todo:
            s = todo.pop()
            f = int(model.feature[number, s])
            name = model.features[f] if f >= 0 else None
            rows.append((number, s, name, *(float(x[number, s]) for x in (model.threshold, model.value, model.gain))))
            if f >= 0:
                todo += [2 * s + 1, 2 * s + 2]
    return spark.createDataFrame(rows, "round int, slot int, feature string, threshold double, value double, gain double")


def from_table(table, columns):
    place = {name: i for i, name in enumerate(columns)}
    return from_rows(columns, [(r["round"], r["slot"], place.get(r["feature"], -1), r["threshold"], r["value"], r["gain"])
                               for r in table.collect()])


def probability(model, spark):
    """A column function of the model's features: the chance of the label.

    The model is bounded by rounds and depth, so it is broadcast.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def chance(*columns: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-shared.value.margins(columns))))

    return chance(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in model.features])
