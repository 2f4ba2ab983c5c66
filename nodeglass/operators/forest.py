"""Isolation Forest (Liu, Ting and Zhou, 2008) trained and applied by Spark.

Spark draws the sample of every tree and groups it; a task builds one tree from
at most ``subsample`` rows. The finished forest is bounded by its parameters
(trees x 2 x subsample nodes), whatever the data size, and that alone is sent
to the scoring tasks.
"""

import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Window, functions as F

from nodeglass import settings as S
from nodeglass.operators.features import LOG_FEATURES, log_features, scaler_stats, standardise
from nodeglass.operators.order_stats import exact_quantile
from nodeglass.session import materialise, staged

# The functions below travel to the executors as code, so that the package need
# not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TREE_SCHEMA = "tree_id int, slot int, feature int, threshold double, leaf_size long"
_HASH_RANGE = 1 << 52

# Tables up to this length are spread over the cores before Python work.
SPREAD_ROWS = 1_000_000


@dataclass
class ForestModel:
    """Trees plus what scoring needs: scaling, fill value and offset."""

    trees: object  # DataFrame of _TREE_SCHEMA
    scaler: dict
    load_fill: float
    subsample: int
    offset: float = 0.0
    _shared: object = None

    def shared(self):
        """The packed trees as a broadcast, made once per model."""
        if self._shared is None:
            context = self.trees.sparkSession.sparkContext
            self._shared = context.broadcast(_packed(self.trees, self.subsample))
        return self._shared


def _hash(seed, *columns):
    """A row's place in [0, _HASH_RANGE): the same whatever the partitioning."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(_HASH_RANGE))


def tree_samples(features, trees, subsample, seed, row_count, key="log_id"):
    """Rows drawn for each tree, by hash of the row key.

    Enough rows for disjoint samples: one hash thins the table to eight times
    what the trees need and a second deals the rest out. Otherwise each row is
    thinned per tree. Either way a fixed number of rows, not the table, is
    shuffled, and the lowest hashes of each tree are its sample.
    """
    wanted = min(subsample, row_count)
    if row_count >= 1.5 * trees * wanted:
        limit = int(min(1.0, 8 * trees * wanted / row_count) * _HASH_RANGE)
        dealt = features.filter(_hash(seed, key) < limit).withColumn(
            "tree_id", F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.lit(trees)).cast("int")
        )
    else:
        # At most 1.5 x trees x subsample rows get here; they are spread out
        # first, since a small table often sits in one file.
        limit = int(min(1.0, (4 * wanted + 400) / row_count) * _HASH_RANGE)
        every_tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
        dealt = features.repartition(F.col(key)).withColumn("tree_id", every_tree).filter(
            _hash(seed, key, "tree_id") < limit
        )
    place = _hash(seed + 2, key, "tree_id")
    in_tree = Window.partitionBy("tree_id").orderBy("_place", key)
    return (
        dealt.withColumn("_place", place)
        .withColumn("_rank", F.row_number().over(in_tree))
        .filter(F.col("_rank") <= wanted)
    )


def _build_tree(sample, columns, seed, depth_limit):
    """Split at random until rows are alone, equal or at the depth limit.

    Slots number a full binary tree (children of i: 2i+1, 2i+2); a missing
    slot below a leaf is never reached.
    """
    tree_id = int(sample["tree_id"].iloc[0])
    points = sample.sort_values("_rank")[columns].to_numpy(dtype=float)
    rng = np.random.default_rng([seed, tree_id])
    out, todo = [], [(0, 0, points)]
    while todo:
        slot, depth, part = todo.pop()
        usable = []
        if depth < depth_limit and len(part) > 1:
            low, high = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(high > low)
        if len(usable) == 0:
            out.append((tree_id, slot, -1, None, len(part)))
            continue
        feature = int(rng.choice(usable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        left = part[:, feature] <= threshold
        out.append((tree_id, slot, feature, threshold, len(part)))
        todo += [(2 * slot + 1, depth + 1, part[left]), (2 * slot + 2, depth + 1, part[~left])]
    return pd.DataFrame(out, columns=["tree_id", "slot", "feature", "threshold", "leaf_size"])


def average_path(n):
    """Expected depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3)
    path = 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, path))


def fit_trees(scaled, trees=S.FOREST_TREES, subsample=S.FOREST_SUBSAMPLE, seed=S.SEED,
              row_count=None, columns=LOG_FEATURES, key="log_id"):
    """The forest as a table, one row per tree node."""
    row_count = scaled.count() if row_count is None else row_count
    samples = tree_samples(scaled.select(key, *columns), trees, subsample, seed, row_count, key)
    depth_limit = math.ceil(math.log2(max(min(subsample, row_count), 2)))
    build = lambda sample: _build_tree(sample, columns, seed, depth_limit)
    return samples.groupBy("tree_id").applyInPandas(build, _TREE_SCHEMA)


def _packed(trees, subsample):
    """Trees as arrays over full binary slots, for scoring by array lookups.

    Below a leaf every row goes left, so after ``depth`` steps the last slot
    tells the leaf; its value is the leaf's depth plus its average path.
    """
    table = trees.toPandas()
    depth = math.ceil(math.log2(max(subsample, 2)))
    count, inner = int(table["tree_id"].max()) + 1, (1 << depth) - 1
    feature = np.zeros((count, inner), dtype=np.int64)
    threshold = np.full((count, inner), np.inf)
    path = np.zeros((count, inner + 1))
    tree, slot = table["tree_id"].to_numpy(), table["slot"].to_numpy()
    split = table["feature"].to_numpy() >= 0
    feature[tree[split], slot[split]] = table["feature"].to_numpy()[split]
    threshold[tree[split], slot[split]] = table["threshold"].to_numpy()[split]
    level = np.floor(np.log2(slot + 1)).astype(int)
    value = level + average_path(table["leaf_size"].to_numpy())
    last = ((slot + 1) << (depth - level)) - 1 - inner
    path[tree[~split], last[~split]] = value[~split]
    present = np.unique(tree)
    return feature[present], threshold[present], path[present], depth


def _path_lengths(points, feature, threshold, path, depth):
    """Mean path length of each row over all trees.

    ``points`` has one line per feature. All rows step down a tree together, in
    buffers made once per batch.
    """
    rows = points.shape[1]
    flat, row = points.ravel(), np.arange(rows)
    slot, at = np.empty(rows, dtype=np.intp), np.empty(rows, dtype=np.intp)
    value, limit = np.empty(rows), np.empty(rows)
    right, total = np.empty(rows, dtype=bool), np.zeros(rows)
    for line, t, p in zip(feature * rows, threshold, path):
        slot.fill(0)
        for _ in range(depth):
            line.take(slot, out=at, mode="clip")
            np.add(at, row, out=at)
            flat.take(at, out=value, mode="clip")
            t.take(slot, out=limit, mode="clip")
            np.greater(value, limit, out=right)
            np.add(slot, slot, out=slot)
            np.add(slot, 1, out=slot)
            np.add(slot, right, out=slot)
        np.subtract(slot, len(t), out=slot)
        p.take(slot, out=value, mode="clip")
        np.add(total, value, out=total)
    return total / len(feature)


def score_features(features, model, columns=LOG_FEATURES):
    """Add ``anomaly_score`` to unscaled features; the features come out scaled.

    Lower is more anomalous, 0 is the cut.
    """
    scaled = standardise(features, model.scaler, columns)
    packed, scale, offset = model.shared(), float(average_path(model.subsample)), model.offset

    def score(batches):
        feature, threshold, path, depth = packed.value
        for batch in batches:
            points = np.stack([batch[c].to_numpy(dtype=float) for c in columns])
            length = _path_lengths(points, feature, threshold, path, depth)
            yield batch.assign(anomaly_score=-np.exp2(-length / scale) - offset)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scaled.schema)
    return scaled.mapInPandas(score, f"{kept}, anomaly_score double")


def fit_forest(features, load_fill, trees=S.FOREST_TREES, subsample=S.FOREST_SUBSAMPLE,
               contamination=S.CONTAMINATION, seed=S.SEED, columns=LOG_FEATURES):
    """Fit scaling, trees and the offset that flags a ``contamination`` share."""
    scaler = scaler_stats(features, columns).first().asDict()
    count = scaler.pop("row_count")
    if count == 0:
        raise ValueError("cannot fit a forest on an empty table")
    psi = min(subsample, count)
    scaled = standardise(features, scaler, columns)
    # Bounded by the forest's parameters; written once so all users see one forest.
    forest = materialise(fit_trees(scaled, trees, subsample, seed, count, columns))
    model = ForestModel(forest, scaler, load_fill, psi)
    # A short table may sit in one file; scoring it should still use all cores.
    spread = features.repartition("log_id") if count <= SPREAD_ROWS else features
    scores = score_features(spread, model, columns).select("anomaly_score")
    with staged(scores, "training-scores") as training:
        model.offset = exact_quantile(training, "anomaly_score", contamination)
    return model


def score_logs(logs, model, threshold=S.ANOMALY_THRESHOLD, fill=None):
    """Add ``anomaly_score`` and ``is_anomaly`` to logs with ``effective_load``."""
    features = log_features(logs, model.load_fill if fill is None else fill)
    return score_features(features, model).select(
        "log_id", "node_id", "anomaly_score", (F.col("anomaly_score") < threshold).alias("is_anomaly")
    )


def anomaly_records(scored, threshold=S.ANOMALY_THRESHOLD):
    """Records to store for the flagged logs, scores unrounded."""
    return scored.filter(F.col("anomaly_score") < threshold).select(
        "node_id", "log_id", "anomaly_score", F.lit(S.DETECTOR).alias("detector"),
        F.current_timestamp().alias("detected_at"),
    )


def save_forest(model, path):
    """Trees and the scalar parts as two Parquet tables."""
    spark = model.trees.sparkSession
    model.trees.write.mode("overwrite").parquet(f"{path}/trees")
    scalars = {**model.scaler, "load_fill": model.load_fill, "offset": model.offset}
    rows = [(k, float(v)) for k, v in scalars.items()] + [("subsample", float(model.subsample))]
    spark.createDataFrame(rows, "name string, value double").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/scalars"
    )


def load_forest(spark, path):
    """A saved model; a missing one is an error."""
    try:
        trees = spark.read.parquet(f"{path}/trees")
        scalars = {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/scalars").collect()}
    except AnalysisException as e:
        raise FileNotFoundError(f"no model at {path}; run the training job first") from e
    own = {k: scalars.pop(k) for k in ("load_fill", "offset", "subsample")}
    return ForestModel(trees, scalars, own["load_fill"], int(own["subsample"]), own["offset"])
