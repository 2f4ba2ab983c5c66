import base64
import random

import pytest
from pyspark.sql import functions as F

from nodeglass import functions as X


def expected_serial(user_agent):
    word = user_agent.split()[-1]
    try:
        return base64.b64decode(word).decode("utf-8").strip()
    except Exception:
        return word


def decode_all(spark, texts):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, ua string")
    found = rows.select("i", X.decode_serial_number("ua").alias("serial")).collect()
    return [r["serial"] for r in sorted(found, key=lambda r: r["i"])]


def test_decodes_last_word(spark):
    texts = [f"Node/2.0 (Linux) {base64.b64encode(s.encode()).decode()}" for s in ("SN-9280", " SN-1 ", "ü", "")]
    texts[-1] = "Node/2.0 U04tOTI4MA==  \t "
    assert decode_all(spark, texts) == ["SN-9280", "SN-1", "ü", "SN-9280"]


@pytest.mark.parametrize("word", [
    "U04tOTI4MA==", "U04tOTI4MA=", "U04tOTI4MA", "@@@", "U04t@OTI4MA==", "/////w==", "=U04tOTI4MA==", "QQ==QQ==",
    "QUI=QUI=", "QQ=Q", "QQ=QQUJD", "Q=Q==", "====", "plain-text", "ünïcode", "QUJD=", "QUJDR", "QUJDRA=!=", "ICA=",
])
def test_odd_words_agree_with_the_lenient_decoder(spark, word):
    assert decode_all(spark, [f"agent {word}"]) == [expected_serial(f"agent {word}")]


def test_random_words_agree_with_the_lenient_decoder(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("QUJDabc09+/==-@") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    texts = [f"agent {w}" for w in words]
    assert decode_all(spark, texts) == [expected_serial(s) for s in texts]


def test_blank_user_agent_has_no_serial(spark):
    assert decode_all(spark, ["", "  ", None]) == [None, None, None]


def test_a_serial_is_decoded_in_one_chain(spark):
    rows = spark.createDataFrame([("agent U04tMQ==",)], "ua string").coalesce(1)
    plan = rows.select(X.decode_serial_number("ua").alias("serial"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("unbase64(") == 1
    assert plan.count("regexp_extract") == 4  # the word, its fitting part, whole groups, and the word as it is


def test_long_words_and_long_runs_of_spaces(spark):
    texts = ["agent " + "QUJD" * 50_000, "x" * 200_000 + " U04tMQ==" + " " * 1000, "a\n U04tMQ==\r\n", "U04tMQ==\u2028"]
    assert decode_all(spark, texts) == ["ABC" * 50_000, "SN-1", "SN-1", "SN-1"]


def test_labels(spark):
    codes = spark.createDataFrame([(c,) for c in (100, 200, 206, 404, 429, 499, 500, 503, 599)], "http_response_code int")
    got = {r[0]: (r[1], r[2]) for r in codes.select("http_response_code", X.http_label(), X.map_label()).collect()}
    assert got[200] == ("HEALTHY", "HEALTHY")
    assert got[206] == ("PARTIAL", "PARTIAL")
    assert got[429] == ("THROTTLED", "THROTTLED")
    assert got[404] == got[100] == got[499] == ("UNKNOWN", "CRITICAL")
    assert got[500] == got[503] == got[599] == ("CRITICAL", "CRITICAL")


def test_versions_agree_until_the_second_window_ends(spark):
    ids = spark.createDataFrame([(i,) for i in (0, 4999, 5000, 9999, 10000, 15000)], "log_id long")
    got = [tuple(r) for r in ids.select(X.load_version(), X.load_version(mode="step")).collect()]
    assert got == [(1, 1), (1, 1), (2, 2), (2, 2), (1, 2), (2, 2)]
    with pytest.raises(ValueError):
        X.load_version(mode="weekly")


def test_load_policies(make_logs):
    logs = make_logs([
        (0, 1, 200, 1, 0.1, 0.9), (1, 1, 200, 1, None, 0.9), (5000, 1, 200, 1, 0.1, 0.9),
        (5001, 1, 200, 1, 0.1, None), (5002, 1, 200, 1, None, None),
    ])
    version = X.load_version()
    got = logs.orderBy("log_id").select(
        X.effective_load(version), X.fallback_load(version), X.coalesced_load()
    ).collect()
    assert [tuple(r) for r in got] == [
        (0.1, 0.1, 0.1), (None, None, 0.9), (0.9, 0.9, 0.1), (None, 0.1, 0.1), (None, None, 0.3),
    ]


@pytest.mark.parametrize("average, hits, level", [
    (200.0, 0, "HIGH"), (200.01, 0, "CRITICAL"), (0.0, 10, "CRITICAL"), (0.0, 9, "HIGH"), (150.0, 0, "MEDIUM"),
    (150.5, 0, "HIGH"), (0.0, 5, "HIGH"), (120.0, 0, "LOW"), (120.1, 0, "MEDIUM"), (0.0, 2, "MEDIUM"), (0.0, 1, "LOW"),
])
def test_risk_limits(spark, average, hits, level):
    row = spark.range(1).select(X.risk_level(F.lit(average), F.lit(hits)))
    assert row.first()[0] == level


@pytest.mark.parametrize("top, timer", [(0, "-5000_PKTS"), (1, "-4999_PKTS"), (4999, "-0001_PKTS"), (5000, "-5000_PKTS")])
def test_rotation_timer(spark, top, timer):
    assert spark.range(1).select(X.rotation_timer(F.lit(top))).first()[0] == timer


def test_window_progress(spark):
    ids = spark.createDataFrame([(0,), (2500,), (4501,), (5000,)], "log_id long").orderBy("log_id")
    got = [tuple(r) for r in ids.select(*X.window_progress("log_id")).collect()]
    assert got == [(5000, 0, 0.0, False), (2500, 2500, 50.0, False), (499, 4501, 90.02, True), (5000, 0, 0.0, False)]


def test_text_helpers(spark):
    row = spark.range(1).select(
        X.ms_text(F.lit(120.0)), X.ms_text(F.lit(120.25)), X.ms_text(F.lit(7)), X.log_message(F.lit(429), F.lit(31)),
        X.iso_timestamp(F.lit("2024-01-01 10:00:00.5").cast("timestamp")), X.sync_status(F.lit("L_V1")),
        X.latency_bar_pct(F.lit(500.0)), X.latency_bar_pct(F.lit(None).cast("double")),
        X.iso_timestamp(F.lit(None).cast("timestamp")).isNotNull(),
    ).first()
    assert list(row) == [
        "120ms", "120.25ms", "7ms", "Forensic Packet Recv: 429 | RT=31ms", "2024-01-01T10:00:00.500000",
        "L_V1_LOCKED", 100.0, 0.0, True,
    ]
