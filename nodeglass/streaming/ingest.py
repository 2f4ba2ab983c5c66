"""Log ingest in micro-batches.

A batch is written to all tables as parts that nothing lists yet, and one
snapshot commits them together with the next free id and the running totals
(``snapshots``). A batch that is repeated after a failure is written anew if it
was not committed and answered from the ledger if it was, so its rows are there
once. Full levels of small parts are compacted after the commit.
"""

from pyspark.sql import functions as F, types as T

from nodeglass import schemas, settings as S
from nodeglass.functions import fallback_load, load_version
from nodeglass.operators.changes import rotations_of
from nodeglass.operators.features import with_load
from nodeglass.operators.forest import anomaly_records, score_logs
from nodeglass.operators.latency import node_latency, statistics_of_counts
from nodeglass.operators.numbering import number_rows
from nodeglass.operators.quality import known_nodes_only, split_rows, unknown_nodes_only
from nodeglass.operators.windows import window_totals
from nodeglass.streaming.snapshots import FAN_IN, FULL_ROWS, Store

LEDGER = T.StructType([
    T.StructField(n, T.LongType()) for n in ("batch_id", "next_id", "ingested_count", "anomaly_count", "total_ingested", "total_anomalies")
])

_BATCH = [T.StructField("batch_id", T.LongType())]
_REJECTED = T.StructType([*schemas.LOGS, T.StructField("reasons", T.ArrayType(T.StringType())), *_BATCH])
_TOTALS = T.StructType([
    T.StructField(n, T.LongType()) for n in ("window_id", "log_count", "first_log_id", "last_log_id")
])
# Logs per id block, node and millisecond; adds up over batches.
_LATENCY = T.StructType([T.StructField(n, T.LongType()) for n in ("log_id", "node_id", "response_time_ms", "n")])
_TABLES = {
    "logs": T.StructType([*schemas.LOGS, *_BATCH]), "anomalies": T.StructType([*schemas.ANOMALIES, *_BATCH]),
    "rejected": _REJECTED, "window_totals": _TOTALS, "latency": _LATENCY, "ledger": LEDGER,
}


def _add_totals(parts):
    return parts.groupBy("window_id").agg(
        F.sum("log_count").alias("log_count"), F.min("first_log_id").alias("first_log_id"), F.max("last_log_id").alias("last_log_id"))


class Sink(Store):
    """Tables of one ingest stream under ``root``.

    The folder belongs to one stream checkpoint: starting the stream over with
    a new checkpoint needs a new root. With ``block``, the latencies of every
    ``block`` ids are kept as one histogram, which pays where a block holds many
    logs for each node and millisecond.
    """

    def __init__(self, root, fan_in=FAN_IN, full_rows=FULL_ROWS, block=None):
        super().__init__(root, _TABLES, {"window_totals": _add_totals}, fan_in, full_rows)
        self.block = block

    def stage(self, df):
        """Write rows of the batch in hand and read them back.

        One folder, replaced by every batch, so nothing piles up.
        """
        path = f"{self.root}/staging"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def ledger_row(self, spark, batch_id):
        """(next_id, ingested_count, anomaly_count) of a committed batch."""
        found = self.read(spark, "ledger").filter(F.col("batch_id") == batch_id).first()
        return found["next_id"], found["ingested_count"], found["anomaly_count"]

    def trailing(self, spark, window=S.WINDOW, table="logs"):
        """Rows of the trailing window; only the parts that reach into it are opened."""
        now = self.snapshot(spark)
        return self.read(spark, table, from_id=max(0, self.max_id(spark, "logs", now) - window), snapshot=now)

    def trailing_latency(self, spark, window=S.WINDOW):
        """Latency statistics per node over the trailing window.

        Blocks of ids that lie wholly in the window come from their stored
        histograms, the cut one at its start from the logs.
        """
        if self.block is None:
            return node_latency(self.trailing(spark, window))
        now = self.snapshot(spark)
        start = max(0, self.max_id(spark, "logs", now) - window)
        whole = -(-start // self.block) * self.block
        cut = latency_blocks(self.read(spark, "logs", from_id=start, to_id=whole - 1, snapshot=now), self.block)
        counts = self.read(spark, "latency", from_id=whole, snapshot=now).unionByName(cut)
        return statistics_of_counts(counts.groupBy("node_id", "response_time_ms").agg(F.sum("n").alias("n")))


def latency_blocks(logs, block):
    """Logs per block of ids (named by its first id), node and millisecond."""
    first = F.call_function("div", F.col("log_id"), F.lit(block).cast("long")) * block
    return logs.groupBy(first.alias("log_id"), "node_id", F.col("response_time_ms").cast("long").alias("response_time_ms")).agg(
        F.count(F.lit(1)).alias("n"))


def ingest_batch(batch, batch_id, sink, nodes=None, forest=None, order_by=None, first_id=0,
                 window=S.WINDOW):
    """Validate, number, store and score one batch; returns its ledger row.

    ``nodes`` None takes logs of any node; ``forest`` None stores them unscored.
    Rows that carry a ``log_id`` keep it. Loads are taken as the scorer of
    single requests takes them: the first one present, else the constant.
    """
    spark = batch.sparkSession
    before = sink.snapshot(spark)
    if batch_id <= before["last_batch"]:
        return sink.ledger_row(spark, batch_id)
    number = F.lit(batch_id).cast("long")
    batch = batch.persist()
    try:
        valid, rejected = split_rows(batch)
        if nodes is not None:
            unknown = unknown_nodes_only(valid, nodes).withColumn("reasons", F.array(F.lit("unknown node")))
            rejected = rejected.unionByName(unknown)
            valid = known_nodes_only(valid, nodes)
        start = before["state"].get("next_id", first_id)
        own_ids = "log_id" in batch.columns
        if not own_ids:
            valid = number_rows(valid, "log_id", start, order_by, sink.stage)
        parts = [sink.write(rejected.withColumn("batch_id", number), "rejected", batch_id)]
        parts.append(sink.write(valid.withColumn("batch_id", number), "logs", batch_id))
    finally:
        batch.unpersist()
    # What follows reads the stored batch, so scores and ids belong together.
    stored, ingested, flagged = sink.read_part(spark, parts[1]), parts[1]["rows"], 0
    if forest is not None:
        scored = score_logs(with_load(stored, "coalesce"), forest, fill=S.LOAD_FILL)
        parts.append(sink.write(anomaly_records(scored).withColumn("batch_id", number), "anomalies", batch_id))
        flagged = parts[-1]["rows"]
    parts.append(sink.write(window_totals(stored, window), "window_totals", batch_id))
    if sink.block is not None:
        parts.append(sink.write(latency_blocks(stored, sink.block), "latency", batch_id))
    after = start + ingested
    if own_ids and ingested:
        after = max(start, parts[1]["max_id"] + 1)
    totals = {"total_ingested": before["state"].get("total_ingested", 0) + ingested,
              "total_anomalies": before["state"].get("total_anomalies", 0) + flagged}
    row = spark.createDataFrame([(batch_id, after, ingested, flagged, *totals.values())], LEDGER)
    parts.append(sink.write(row.coalesce(1), "ledger", batch_id))
    sink.commit(spark, before, parts, last_batch=batch_id, state={"next_id": after, **totals})
    sink.compact(spark)
    return after, ingested, flagged


def stream_ingest(source, sink, checkpoint, trigger=None, **options):
    """Start ingesting a streaming DataFrame; ``options`` as ``ingest_batch``.

    Runs until the input is used up unless ``trigger`` says otherwise, for
    example ``{"processingTime": "500 milliseconds"}``.
    """
    handle = lambda batch, batch_id: ingest_batch(batch, batch_id, sink, **options) and None
    return (
        source.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_log_stream(spark, path, schema, fmt="parquet", files_per_batch=None, name_filter=None):
    """Files arriving in a folder, as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def drop_repeats(stream, delay="10 minutes"):
    """Drop a log delivered again within ``delay``.

    The state kept is bounded by the delay, which also means that a log more
    than ``delay`` older than the newest one seen counts as late and is left out.
    """
    timed = stream.withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    return timed.withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(
        ["node_id", "ingested_at", "log_id"]
    )


def committed_window_totals(spark, sink):
    """Logs per tumbling window over all committed batches."""
    return sink.read(spark, "window_totals")


def committed_rotations(spark, sink, window=S.WINDOW):
    """Rotation events so far, from the totals instead of the logs."""
    return rotations_of(committed_window_totals(spark, sink), window)


def current_window(spark, sink):
    """Totals of the newest window; they start over at each rotation."""
    totals = committed_window_totals(spark, sink)
    return totals.filter(F.col("window_id") == totals.agg(F.max("window_id")).scalar())


def batch_anomaly_totals(spark, sink):
    """Anomalies so far, per committed batch; each ledger row carries its total."""
    return sink.read(spark, "ledger").select("batch_id", "total_anomalies")


def with_rotating_load(stream, mode="cyclic", window=S.WINDOW):
    """Layout version and load of each log; stateless, for batch or stream."""
    return stream.withColumn("schema_version", load_version("log_id", mode, window)).withColumn(
        "load", fallback_load("schema_version")
    )
