import hashlib
import random

import pytest
from pyspark.sql import functions as F

import brute
from nodeglass.llm import dataset_manifest as dm

SCHEMA = "key long, grp string, leaf string, altered string"
COLUMNS = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def random_rows(sizes, seed=1):
    rng, out = random.Random(seed), []
    for group, n in sizes.items():
        for key in range(n):
            leaf = hashlib.sha256(f"{group}{key}".encode()).hexdigest()
            out.append((key * 3 - 5, group, leaf, brute.sha(leaf) if rng.random() < 0.3 else None))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_equals_brute_force(spark, levels):
    rows = random_rows({"de": 1, "en": 8, "fr": 9, None: 3, "Ω": 530, "zz": 64, "": 65})
    out = dm.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), "key", "grp", levels)
    assert rows_of(out) == sorted(brute.dataset_manifest(rows), key=str)
    changed = {(k, leaf) for k, _, leaf, altered in rows if altered}
    assert {(r["key"], r["leaf"]) for r in out.where("NOT verified").collect()} == changed


def test_many_groups(spark):
    rows = random_rows({f"g{i:03d}": 1 + i % 3 for i in range(75)})
    out = dm.manifest(spark.createDataFrame(rows, SCHEMA), "key", "grp", 1)
    assert rows_of(out) == sorted(brute.dataset_manifest(rows), key=str)


def test_odd_rows(spark):
    leaf = [brute.sha(str(i)) for i in range(4)]
    rows = [(None, "a", leaf[0], None), (None, None, leaf[1], None), (2, "a", leaf[3], None), (2, "a", leaf[2], leaf[0]),
            (2, "a", leaf[2], leaf[0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(dm.manifest(df, "key", "grp")) == sorted(brute.dataset_manifest(rows), key=str)
    empty = dm.manifest(df.where("false"), "key", "grp")
    assert empty.count() == 0 and empty.columns == [*COLUMNS, "verified"]
    lone = dm.manifest(df.limit(1), "key", "grp").first()
    assert lone["leaf"] == lone["subroot"] == lone["root"] and lone["proof_sha256"] == brute.sha("") and lone["verified"]


def test_leaf_digest(spark):
    df = spark.createDataFrame([(-7, None, "Ü", 3, ""), (None, "s", None, None, "x" * 300_000)],
                               "doc_id long, source string, lang string, n_chars long, text string")
    got = [r[0] for r in df.select(dm.leaf_digest([F.col(c) for c in dm.FIELDS])).collect()]
    assert got == [brute.sha("2:-7", "-", "2:Ü", "1:3", "0:"), brute.sha("-", "1:s", "-", "-", "300000:" + "x" * 300_000)]


def test_clashing_columns(spark, edge_docs):
    df = edge_docs.select("doc_id", "lang", dm.leaf_digest([F.col("doc_id"), F.col("text")]).alias("leaf"),
                          F.lit(None).cast("string").alias("altered"), F.lit(1).alias("grp"), F.lit(2).alias("pos"))
    out = dm.manifest(df, "doc_id", "lang")
    assert out.count() == edge_docs.count() and out.where("NOT verified").isEmpty()
