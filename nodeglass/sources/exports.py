"""Tables users download."""

from pyspark.sql import functions as F, types as T

from nodeglass.functions import display_status, ms_text


def registry_export(nodes, flag="is_infected"):
    return nodes.select(
        F.col("node_uuid").alias("node_id"),
        F.col("user_agent").alias("encoded_user_agent"),
        F.col("serial_number").alias("decoded_serial"),
        display_status(flag).alias("status"),
    )


def heatmap_export(heatmap):
    return heatmap.select(
        F.col("node_uuid").alias("node_id"),
        F.col("serial_number").alias("serial"),
        ms_text("avg_response_time_ms").alias("avg_rt"),
        ms_text("max_response_time_ms").alias("max_rt"),
        ms_text("p95_response_time_ms").alias("p95_rt"),
        F.col("log_count").alias("logs"),
        F.col("risk_level").alias("risk"),
    )


def write_export(table, path, fmt="csv"):
    """Write as ``csv`` (with header; lists joined by ``;``), ``json`` or ``parquet``."""
    if fmt == "csv":
        lists = [f.name for f in table.schema if isinstance(f.dataType, T.ArrayType)]
        table = table.withColumns({c: F.array_join(c, ";") for c in lists})
    table.write.mode("overwrite").format(fmt).option("header", True).save(path)
