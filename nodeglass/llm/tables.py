"""Reading the input tables and writing intermediate ones.

Tables are read through Spark only, so a path may lie in any store it reaches.
Intermediate tables go to the folder in ``spark.checkpoint.dir``, which all
executors share; a lost executor costs the tasks it ran, never their inputs.
"""

import gc

import pyarrow as pa

from nodeglass.session import scratch_path

# Rows that a Python task is handed at once; keeps tasks small beside long texts.
BATCH_BYTES = 4 << 20


def table(spark, sf_dir, name):
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df, label):
    """Write ``df`` as Parquet to the shared folder and continue from there."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(name, columns):
    """``name``, made longer until no column has it."""
    while name in columns:
        name += "_"
    return name


def map_batches(df, function, schema):
    """``df.mapInArrow`` with batches of about ``BATCH_BYTES``.

    Sets the session's limit, as it is read when the work is planned. Rows stay
    whole; a longer one makes a batch of its own.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()  # workers live on

    return df.mapInArrow(run, schema)


def release(spark):
    """Let Spark delete the shuffle files of steps that are over.

    It does so once the driver has collected the garbage of their plans, which
    is asked for here, between steps that each fill the disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
