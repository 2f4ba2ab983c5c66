"""Supervised node classifier and its evaluation."""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from nodeglass import settings as S
from nodeglass.operators import boosting
from nodeglass.operators.features import NODE_FEATURES
from nodeglass.operators.running import running_totals


def class_balance(node_table, label="is_infected"):
    """Negatives per positive; 1.0 where there are no positives."""
    positives = F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0))
    counts = node_table.agg(F.count(F.lit(1)).alias("n"), positives.alias("positives"))
    return counts.select(
        "positives",
        (F.col("n") - F.col("positives")).alias("negatives"),
        F.when(F.col("positives") > 0, (F.col("n") - F.col("positives")) / F.col("positives"))
        .otherwise(1.0).alias("positive_weight"),
    )


def fit_classifier(node_table, rounds=S.BOOST_ROUNDS, depth=S.BOOST_DEPTH, rate=S.BOOST_RATE):
    """Boosted trees with the positive class weighted up to balance."""
    balance = class_balance(node_table).select("positive_weight").first()[0]
    return boosting.fit(node_table, NODE_FEATURES, "is_infected", rounds, depth, rate, float(balance))


def score_nodes(model, node_table, cut=0.5):
    """Add ``infected_prob`` and ``predicted_infected``; missing features are 0."""
    scored = node_table.na.fill(0, NODE_FEATURES).withColumn("infected_prob", boosting.probability(model, node_table.sparkSession))
    return scored.withColumn("predicted_infected", F.col("infected_prob") >= cut)


def confusion(scored, label="is_infected", prediction="predicted_infected"):
    return scored.groupBy(
        F.col(label).alias("actual"), F.col(prediction).alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))


def class_report(scored, label="is_infected", prediction="predicted_infected"):
    """Precision, recall, F1 and support per class."""
    cells = confusion(scored, label, prediction)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    report = None
    for name, wanted in (("Clean", False), ("Infected", True)):
        actual, predicted = F.col("actual") == wanted, F.col("predicted") == wanted
        count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
        sums = cells.agg(
            count(actual & predicted).alias("hit"), count(predicted).alias("said"), count(actual).alias("support")
        )
        rows = sums.select(
            F.lit(name).alias("class"),
            ratio(F.col("hit"), F.col("said")).alias("precision"),
            ratio(F.col("hit"), F.col("support")).alias("recall"),
            ratio(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"),
            "support",
        )
        report = rows if report is None else report.union(rows)
    return report


def rank_auc(scored, label="is_infected", score="infected_prob"):
    """One row: the area under the ROC curve, null without both classes.

    The share of (positive, negative) pairs in which the positive has the higher
    score, half for ties: rows are counted by score, and running totals over the
    sorted scores tell how many negatives lie below each.
    """
    hit = F.col(label).cast("boolean")
    counts = scored.where(hit.isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.count_if(hit).alias("positives"), F.count_if(~hit).alias("negatives"))
    below = running_totals(counts, ["score"], {"up_to": "negatives"})
    won = F.sum(F.col("positives") * (F.col("up_to") - F.col("negatives") / 2))
    pairs = F.sum("positives").cast("double") * F.sum("negatives")
    return below.agg(F.when(pairs > 0, won / pairs).alias("auc"))


def auc(scored, label="is_infected", probability="infected_prob"):
    return rank_auc(scored, label, probability).first()[0]


def save_classifier(spark, model, path):
    boosting.as_table(spark, model).coalesce(1).write.mode("overwrite").parquet(path)


def load_classifier(spark, path):
    """A saved model; a missing one is an error."""
    try:
        return boosting.from_table(spark.read.parquet(path), NODE_FEATURES)
    except AnalysisException as e:
        raise FileNotFoundError(f"no model at {path}; run the training job first") from e
