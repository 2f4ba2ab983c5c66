"""The telemetry tables as views over the general test tables.

``events`` give the log stream and ``customer`` the device registry, so every
query runs on whole given tables at any scale factor.
"""

from pyspark.sql import functions as F

from nodeglass import settings as S
from nodeglass.functions import decode_serial_number, window_id


def logs(spark, sf_dir, window=S.WINDOW):
    return logs_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), window)


def logs_from_events(events, window=S.WINDOW):
    """Works on a batch or a streaming ``events`` table."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    load = F.when(k % 17 != 0, F.col("value") / 600)
    even_window = window_id("event_id", window) % 2 == 0
    return events.select(
        F.col("event_id").alias("log_id"),
        F.col("user_id").alias("node_id"),
        F.lit("OPERATIONAL").alias("json_status"),
        F.when((kind == "error") & (k < 36), 429)
        .when((kind == "signup") & (k < 36), 206)
        .when((kind == "error") & (k == 99), 503)
        .when((kind == "error") & (k == 98), 404)
        .otherwise(200).alias("http_response_code"),
        F.floor(F.col("value") + 40 + (F.col("user_id") * 37) % 130).cast("int").alias("response_time_ms"),
        F.when(even_window, load).alias("load_val"),
        F.when(~even_window, load).alias("l_v1"),
        F.col("ts").alias("ingested_at"),
    )


def raw_nodes(spark, sf_dir):
    """Registry as delivered: the serial is only inside the user agent."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    serial = F.concat(
        F.lit("SN-"), (key + 1000 - F.when(key % 50 == 49, 1).otherwise(0)).cast("string")
    )
    return customers.select(
        key.alias("node_uuid"),
        F.concat(F.lit("Node/2.0 (Linux) "), F.base64(serial.cast("binary"))).alias("user_agent"),
        (F.col("c_acctbal") < 540).alias("is_infected"),
    )


def nodes(spark, sf_dir):
    """Registry with the decoded serial.

    A registry file may be a single split, so its rows are dealt to all tasks
    before they are decoded.
    """
    dealt = raw_nodes(spark, sf_dir).repartition("node_uuid")
    return dealt.withColumn("serial_number", decode_serial_number("user_agent"))


def anomalies(spark, sf_dir, window=S.WINDOW):
    """Rule-based stand-in for model output, so reports can be checked in SQL."""
    return logs(spark, sf_dir, window).filter(
        (F.col("response_time_ms") > 200) & (F.col("http_response_code") != 200)
    ).select(
        "node_id", "log_id",
        F.round((200 - F.col("response_time_ms")) / F.lit(1000.0), 6).alias("anomaly_score"),
        F.lit(S.DETECTOR).alias("detector"),
        F.col("ingested_at").alias("detected_at"),
    )


def schema_config(spark, sf_dir, window=S.WINDOW):
    """One version per tumbling window of the logs, alternating the column."""
    number = window_id("event_id", window)
    windows = spark.read.parquet(f"{sf_dir}/events.parquet").select(number.alias("w")).distinct()
    return windows.select(
        (F.col("w") + 1).cast("int").alias("version"),
        (F.col("w") * window).alias("time_start"),
        F.when(F.col("w") % 2 == 0, "load_val").otherwise("L_V1").alias("active_column"),
    )
