"""The stages of the pipeline, each against a plain version on its own input."""

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_packing import check

from nodeglass.llm import packing, pii
from nodeglass.llm.tables import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, stage(step(spark, docs, SF), "test")
        out.append((before, docs))
    return out


def frame(df):
    return df.toPandas().sort_values("doc_id", ignore_index=True)


def test_columns(steps):
    for before, after in steps[:-1]:
        assert after.dtypes == before.dtypes


def test_toxic_documents_go(steps):
    before, after = map(frame, steps[0])
    gone = set(before["doc_id"]) - set(after["doc_id"])
    assert 0 < len(gone) < 0.3 * len(before) and set(after["doc_id"]) < set(before["doc_id"])


def test_one_of_each_group_stays(steps):
    before, after = map(frame, steps[1])
    links = brute.jaccard_links([set(brute.shingles(t, 5)) for t in before["text"]], 80)
    component = brute.components(before["doc_id"].tolist(), links)
    assert sorted(after["doc_id"]) == sorted(set(component)) and len(after) < len(before)


def test_contaminated_documents_go(spark, steps):
    before, after = map(frame, steps[2])
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()["text"]
    hit = {before["doc_id"][t] for t, _ in brute.contamination(before["text"], items)}
    assert set(after["doc_id"]) == set(before["doc_id"]) - hit


def test_personal_data_is_replaced(steps):
    before, after = map(frame, steps[3])
    assert before["doc_id"].tolist() == after["doc_id"].tolist()
    for old, new in zip(before["text"], after["text"]):
        assert not pii.base_spans(new)
        if not any(c in "0123456789@" for c in old):
            assert new == old
    assert (after["text"].str.len() == after["n_chars"]).all()


def test_packing(steps):
    used, least = check(steps[4][0], steps[4][1].collect(), packing.SEQUENCE_TOKENS)
    assert used <= least + 2


def test_run_is_the_stages(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, got.select("doc_id", "piece", "ids_crc32").collect())) == \
        sorted(map(str, steps[4][1].select("doc_id", "piece", "ids_crc32").collect()))


def test_edge_rows(spark, edge_docs):
    docs = edge_docs.withColumn("n_chars", F.length("text").cast("long"))
    for _, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF), "test")
    ids = {r["doc_id"] for r in docs.collect()}
    assert {0, 1, 2, None} <= ids and 9 not in ids


def test_near_copies_with_shared_ids(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text), (1, text), (2, text), (3, None), (3, None), (None, text), (None, None)]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(
        [(1, text), (3, None), (None, text), (None, None)], key=str)


def test_different_texts_with_one_id_stay(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (1, c), (1, c), (2, b + " more"), (3, a), (4, a + " end")]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted([(1, a), (1, b), (1, c)])


def test_empty_table(spark, no_docs):
    docs = no_docs.withColumn("n_chars", F.length("text").cast("long"))
    for _, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF), "test")
        assert docs.count() == 0
