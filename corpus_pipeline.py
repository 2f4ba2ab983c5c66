"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the docs of the next one. The first four return the
columns of documents; the last one returns the packed sequences.
"""

import public_tokenizers
from pyspark.sql import functions as F

from nodeglass.llm import decontaminate, packing, pii, toxicity, trees
from nodeglass.llm.tables import free_name, stage, table
from nodeglass.operators.skew import checked_broadcast

TOXIC_FROM = 0.5


def drop_toxic(spark, docs, sf_dir):
    """Without documents whose toxicity score is ``TOXIC_FROM`` or more.

    The models learn from the labelled documents outside the held-out fold.
    Null and empty texts have no evidence and stay, repeated rows stay or go
    together, and an empty table stays empty.
    """
    train = toxicity.training_documents(spark, sf_dir, docs)
    score = free_name("toxicity", docs.columns)
    scored = toxicity.score_toxicity(docs, train, column=score)
    return scored.where(F.col(score) < TOXIC_FROM).select(*docs.columns)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near copies: the one with the smallest id.

    Near copies share 80 % or more of their five-word shingles, directly or
    through others. Rows equal in id and text are one document, of which one row
    stays; rows that share an id and have different texts go only as copies.
    Rows without words are copies of none, rows with a null id stay.
    """
    h = free_name("text_hash", docs.columns)
    found = stage(trees.jaccard_firsts(docs, shingle=5, percent=80).where("id IS NOT NULL"), "near-copies")
    copy = F.col("first").isNotNull() & ~F.struct("id", "h").eqNullSafe(F.col("first"))
    name = [F.col("id").alias("doc_id"), F.col("h").alias(h)]
    lost = stage(found.where(copy).select(*name).distinct(), "lost")
    hashed = docs.withColumn(h, F.xxhash64("text"))
    kept = hashed.join(checked_broadcast(lost), ["doc_id", h], "left_anti")
    again = stage(found.where(~copy).groupBy(*name).count().where("count > 1").select("doc_id", h), "repeated")
    if not again.isEmpty():
        again = checked_broadcast(again)
        kept = kept.join(again, ["doc_id", h], "left_anti").unionByName(
            kept.join(again, ["doc_id", h], "left_semi").dropDuplicates(["doc_id", h]))
    return kept.select(*docs.columns)


def drop_contaminated(spark, docs, sf_dir):
    """Without documents that hold a passage like a benchmark item.

    Null and empty texts stay, repeated rows stay or go together.
    """
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark, docs, sf_dir):
    """Personal data replaced by its kind; n_chars follows the new text.

    Null texts stay null and keep their n_chars; every row comes out.
    """
    clean = pii.redact(docs)
    size = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_sequences(spark, docs, sf_dir):
    """Each document's pieces and their places in sequences of 4096 tokens.

    A null text is empty and has the end mark alone; repeated rows are packed each.
    """
    return packing.pack_documents(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]
# Learned models and packing cannot be said in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages, one after the other, over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
