"""Table schemas."""

from pyspark.sql import functions as F, types as T

NODES = T.StructType([
    T.StructField("node_uuid", T.LongType(), False),
    T.StructField("user_agent", T.StringType()),
    T.StructField("serial_number", T.StringType()),
    T.StructField("is_infected", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()),
])

LOGS = T.StructType([
    T.StructField("log_id", T.LongType(), False),
    T.StructField("node_id", T.LongType()),
    T.StructField("json_status", T.StringType()),
    T.StructField("http_response_code", T.IntegerType()),
    T.StructField("response_time_ms", T.IntegerType()),
    T.StructField("load_val", T.DoubleType()),
    T.StructField("l_v1", T.DoubleType()),
    T.StructField("ingested_at", T.TimestampType()),
])

SCHEMA_CONFIG = T.StructType([
    T.StructField("version", T.IntegerType(), False),
    T.StructField("time_start", T.LongType()),
    T.StructField("active_column", T.StringType()),
])

ANOMALIES = T.StructType([
    T.StructField("node_id", T.LongType()),
    T.StructField("log_id", T.LongType()),
    T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("detector", T.StringType()),
    T.StructField("detected_at", T.TimestampType()),
])


def conform(df, schema):
    """The columns of ``schema`` that ``df`` has, in its order and types."""
    return df.select([F.col(f.name).cast(f.dataType) for f in schema if f.name in df.columns])
