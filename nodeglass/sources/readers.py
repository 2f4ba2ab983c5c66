"""Readers for the three CSV inputs and for tables written by this library."""

from pyspark.sql import functions as F

from nodeglass import settings as S
from nodeglass.functions import (
    decode_serial_number, effective_load, http_label, load_version, null_if_nan,
)
from nodeglass.session import path_exists


def read_table(spark, path, schema):
    """A Parquet table, or an empty one while nothing has been written yet."""
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def _read_csv(spark, path, types):
    """Read by header name, with tidy names; a malformed value becomes null.

    No type inference, so the files are scanned once, when they are used.
    """
    raw = spark.read.csv(path, header=True)
    tidy = raw.toDF(*[c.strip().lower() for c in raw.columns])
    return tidy.select([F.trim(F.col(c)).try_cast(t).alias(c) for c, t in types.items()])


def load_node_registry(spark, path):
    """Registry with the decoded ``serial_number``."""
    nodes = _read_csv(spark, path, {
        "node_uuid": "bigint", "user_agent": "string", "is_infected": "boolean",
    })
    return nodes.withColumn("serial_number", decode_serial_number("user_agent"))


def load_system_logs(spark, path, mode="step", window=S.WINDOW):
    """Logs with layout version, effective load and status label."""
    logs = _read_csv(spark, path, {
        "log_id": "bigint", "node_id": "bigint", "json_status": "string",
        "http_response_code": "int", "response_time_ms": "int",
        "load_val": "double", "l_v1": "double",
    })
    logs = logs.withColumns({c: null_if_nan(c) for c in ("load_val", "l_v1")})
    return logs.withColumn("active_schema_version", load_version("log_id", mode, window)).withColumns({
        "effective_load": effective_load("active_schema_version"),
        "http_status_label": http_label(),
    })


def load_schema_config(spark, path):
    config = _read_csv(spark, path, {
        "version": "int", "time_start": "bigint", "active_column": "string",
    })
    return config.orderBy("time_start")
