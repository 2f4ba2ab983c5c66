"""Latest state per node, kept up to date by a stream."""

from pyspark.sql import functions as F, types as T

from nodeglass.operators.latest import latest_per_node
from nodeglass.streaming.snapshots import FAN_IN, Store

_STATE = ["http_response_code", "json_status"]
_TABLE = T.StructType([
    T.StructField("node_id", T.LongType()), T.StructField("log_id", T.LongType()),
    T.StructField("http_response_code", T.IntegerType()), T.StructField("json_status", T.StringType()),
])


class StateStore(Store):
    """A base of one row per node and the changes since, merged by node.

    A reader opens the base and a bounded number of changes, so its cost follows
    the nodes, however many batches there were.
    """

    def __init__(self, root, fan_in=FAN_IN):
        super().__init__(root, {"state": _TABLE}, {"state": lambda parts: latest_per_node(parts, _STATE)}, fan_in)

    def apply(self, changes, batch_id):
        """Commit a batch of changed nodes; one that was committed before is passed by."""
        spark = changes.sparkSession
        before = self.snapshot(spark)
        if batch_id > before["last_batch"]:
            self.commit(spark, before, [self.write(changes, "state", batch_id)], last_batch=batch_id)
            self.compact(spark)


def stream_latest_state(stream, root, checkpoint, trigger=None, fan_in=FAN_IN):
    """Write each batch's changed nodes under ``root``.

    Each batch is brought down to a row per node and merged into the store, so
    the stream itself keeps no state.
    """
    store = StateStore(root, fan_in)

    def handle(batch, batch_id):
        store.apply(latest_per_node(batch, _STATE), batch_id)

    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_latest_state(spark, root):
    """One row per node."""
    return StateStore(root).read(spark, "state")
