"""Session helpers: checkpoint folder and scratch folders for written tables."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(name="nodeglass", cores="*", shuffle_partitions=8, memory="8g"):
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark):
    """The folder named by ``spark.checkpoint.dir``; it must be shared storage.

    Only a local session without the setting gets a temporary folder, because
    there the driver's disk is the only disk.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and sc.getCheckpointDir() is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="nodeglass-"))
    return configured or sc.getCheckpointDir()


def scratch_path(spark, label):
    """A fresh folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def file_system(spark, path):
    """Hadoop path object and its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark, path):
    target, system = file_system(spark, path)
    return system.exists(target)


@contextmanager
def staged(df, label):
    """``df`` as a table in the checkpoint folder, removed at the end.

    For intermediate results as long as the data that are only needed until an
    operator returns.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    try:
        df.write.parquet(path)
        yield spark.read.parquet(path)
    finally:
        target, system = file_system(spark, path)
        system.delete(target, True)


def materialise(df):
    """Write ``df`` to the checkpoint folder and continue from the files.

    Used where later steps must all see the same rows (assigned ids, sampled
    brackets); reliable storage keeps that true when an executor is lost. With
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes the files
    once nothing refers to them.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
