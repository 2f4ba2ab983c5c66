import brute
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from nodeglass.llm import pii

ODD = st.text(st.sampled_from("a.@-+_ 1259()0%é\n"), max_size=60)


@settings(max_examples=400)
@given(ODD)
def test_base_spans_follow_the_patterns(text):
    got = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in pii.base_spans(text)]
    assert got == brute.base_spans(text)


def test_long_texts_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000, "a." * 100_000 + "@", "1." * 100_000, "+1 " * 60_000, "a@" * 100_000, "+1" + " " * 200_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(0)
    phone = lambda: f"{rng.integers(200, 999)}-555-{rng.integers(1000, 9999)}"
    rows = []
    for i in range(300):
        number = phone()
        rows.append((i, f"call +1-{number} or write to user{i}@mail.example.com version {rng.integers(9)}.{rng.integers(9)} in {rng.integers(1900, 2024)} and {number} end"))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_field_finds_repeats_without_their_prefix(sample):
    out = pii.find_personal_data(sample).collect()
    for row in out:
        spans = [(s["kind"], row["text"][s["start"]:s["end"]]) for s in row["spans"]]
        base = [s for s in row["spans"] if s["base"]]
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in base] == brute.base_spans(row["text"])
        assert all(kind in ("phone", "email") for kind, _ in spans)
    found = sum(any(not s["base"] and s["kind"] == "phone" for s in row["spans"]) for row in out)
    assert found > 0.9 * len(out)


def test_messages_are_exact_on_a_tree():
    """Three words in a row: belief propagation equals summing over all labellings."""
    rng = np.random.default_rng(2)
    weights = rng.normal(size=(pii.BUCKETS, pii.LABELS)), rng.normal(size=(pii.LABELS,) * 2), rng.normal(size=(pii.LABELS,) * 2)
    field = pii.Field()
    field.add(0, "a1 b2 c3", [])
    p = pii.pass_messages(weights, field, rounds=80)
    node = weights[0][field.arrays()[0]].sum(axis=1)
    joint = np.exp(node[0][:, None, None] + node[1][None, :, None] + node[2][None, None, :]
                   + weights[1][:, :, None] + weights[1][None, :, :])
    joint /= joint.sum()
    assert np.allclose(p, [joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))], atol=1e-6)


def test_skip_edges_are_one_per_repeat():
    field = pii.Field()
    field.add(0, " x ".join(["tel5550199"] * 50), [])
    assert len(field.arrays()[2]) == 2 * 49  # by the whole word and by its last digits


@pytest.mark.parametrize("lean", [0.0, 2.0])
def test_all_repeats_of_one_number_are_found(lean):
    """Fifty repeats, with the sure one first, last or between; words lean to no data."""
    weights = pii.learn(pii.Field())
    weights[0][:, 0] = lean / 5
    words = ["202-555-0101"] * 50
    for at in (0, 25, 50):
        text = " and ".join([*words[:at], "+1-202-555-0101", *words[at:]])
        spans, = pii.spans_of([text], weights)
        assert len(spans) == 51 and {kind for _, kind, _, _ in spans} == {3}


def test_a_document_does_not_depend_on_its_neighbours():
    rng = np.random.default_rng(4)
    weights = tuple(rng.normal(size=s) for s in ((pii.BUCKETS, pii.LABELS), (pii.LABELS,) * 2, (pii.LABELS,) * 2))
    texts = ["a1 b2 c3 tel5550199 x tel5550199", "+1-202-555-0101 9 " + "202-555-0101 7 " * 40]
    both, one = pii.Field(), pii.Field()
    for k, text in enumerate(texts):
        both.add(k, text, pii.base_spans(text))
    one.add(0, texts[0], [])
    p = pii.pass_messages(weights, one)
    assert (p == pii.pass_messages(weights, both)[:len(p)]).all()


def test_edge_rows(edge_docs, no_docs):
    out = pii.find_personal_data(edge_docs)
    assert sorted(out.columns) == sorted(edge_docs.columns) and out.count() == edge_docs.count()
    assert all(r["spans"] == [] for r in out.where("doc_id < 6").collect())
    assert pii.find_personal_data(no_docs).count() == 0
    clean = pii.redact(edge_docs)
    assert clean.schema == edge_docs.schema and clean.where("doc_id = 0 AND text IS NULL").count() == 1


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é write a.b@c.de, 10.0.0.1!"), (2, "nothing"), (3, None)], "doc_id long, text string")
    assert [r["text"] for r in pii.redact(docs).orderBy("doc_id").collect()] == ["é write [EMAIL], [IP]!", "nothing", None]


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas().set_index("doc_id")["text"]
    for row in pii.op2_personal_data(spark, "/root/testdata/sf0.001").collect():
        base = brute.base_spans(docs[row["doc_id"]])
        assert row["base_sha256"] == brute.digest(base)
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k) for s in base) for k in pii.KINDS]
        assert set(base) <= set(row["spans"].split(","))


def test_long_words_are_read_to_their_end():
    field, text = pii.Field(), "x" * 100 + "1 " + ",".join(["ab@cd.ef"] * 30) + " 7"
    field.add(0, text, pii.base_spans(text))
    assert field.label == [0, 1, 0]
    assert pii._shape("-" * 70 + "9") != pii._shape("-" * 70)
