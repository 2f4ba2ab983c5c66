"""Table writes.

Loads are insert-if-absent: rows are reduced to one per key, those already in
the table are removed with an anti join, and the rest is appended. Repeating a
load therefore adds nothing. Files are written in key order, so the bounds of the
keys that are loaded pass by all files that cannot hold one of them.
"""

from pyspark.sql import Observation, functions as F

from nodeglass import schemas, settings as S
from nodeglass.functions import decode_serial_number
from nodeglass.sources.readers import read_table


def _write_counted(df, write):
    """Run ``write`` and count the rows it wrote, in the same pass."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return seen.get["rows"]


def new_rows(rows, target, key):
    """One row per key, of keys the target does not hold."""
    return rows.dropDuplicates(key).join(target.select(key), key, "left_anti")


def within(target, rows, key, most=64):
    """Rows of ``target`` near the keys of ``rows``: inside one of up to ``most`` ranges.

    The range of the keys is cut into equal slots, of which each that is used
    gives its least and greatest key. These bounds reach the Parquet filter, so a
    load of scattered keys reads the files around them and not all in between.
    """
    first, last = rows.agg(F.min(key), F.max(key)).first()
    if first is None:
        return target.filter(F.lit(False))
    width = (last - first) // most + 1
    slot = F.call_function("div", F.col(key) - F.lit(first), F.lit(width).cast("long"))
    near = F.lit(False)
    for r in rows.where(F.col(key).isNotNull()).groupBy(slot.alias("slot")).agg(F.min(key).alias("a"), F.max(key).alias("b")).collect():
        near |= F.col(key).between(r["a"], r["b"])
    return target.filter(near)


def append_new(rows, path, key, schema):
    """Append rows with unseen keys to a Parquet table; returns how many.

    Only files that may hold keys near those of ``rows`` are compared.
    """
    rows = schemas.conform(rows, schema)
    target = within(read_table(rows.sparkSession, path, schema), rows, key[0])
    ordered = new_rows(rows, target, key).repartitionByRange(key[0]).sortWithinPartitions(*key)
    return _write_counted(ordered, lambda df: df.write.mode("append").parquet(path))


def seed_nodes(nodes, path):
    return append_new(nodes, path, ["node_uuid"], schemas.NODES)


def seed_schema_config(config, path):
    return append_new(config, path, ["version"], schemas.SCHEMA_CONFIG)


def seed_anomalies(anomalies, path):
    """Keyed on log and detector, so seeding twice adds no second record."""
    return append_new(anomalies, path, ["log_id", "detector"], schemas.ANOMALIES)


def append_logs(logs, path, ids_per_folder=S.IDS_PER_FOLDER):
    """Append logs in id order under coarse ``id_folder=`` partitions.

    Count windows are id ranges, so range partitioning on the id gives files
    whose min/max statistics let a window read skip all other files. A folder
    per window would mean thousands of tiny files per million logs.
    """
    placed = logs.withColumn(
        "id_folder", F.call_function("div", F.col("log_id"), F.lit(ids_per_folder).cast("long"))
    )
    ordered = placed.repartitionByRange("log_id").sortWithinPartitions("log_id")
    return _write_counted(
        ordered, lambda df: df.write.mode("append").partitionBy("id_folder").parquet(path)
    )


def seed_logs(logs, path, ids_per_folder=S.IDS_PER_FOLDER):
    """Insert logs with unseen ids; returns how many.

    The stored table is only compared within the id range being loaded.
    """
    target = read_table(logs.sparkSession, path, schemas.LOGS)
    logs = schemas.conform(logs, schemas.LOGS)
    first, last = logs.agg(F.min("log_id"), F.max("log_id")).first()
    if first is None:
        return 0
    target = target.filter(F.col("log_id").between(first, last))
    if "id_folder" in target.columns:
        target = target.filter(F.col("id_folder").between(first // ids_per_folder, last // ids_per_folder))
    return append_logs(new_rows(logs, target, ["log_id"]), path, ids_per_folder)


def refresh_reference_tables(raw_nodes, raw_config, nodes_path, config_path):
    """Replace registry and schema config; flags are read in any letter case."""
    nodes = raw_nodes.select(
        F.col("node_uuid").cast("bigint").alias("node_uuid"),
        "user_agent",
        decode_serial_number("user_agent").alias("serial_number"),
        (F.lower(F.trim(F.col("is_infected").cast("string"))) == "true").alias("is_infected"),
    )
    config = raw_config.select(
        F.col("version").cast("int").alias("version"),
        F.col("time_start").cast("bigint").alias("time_start"),
        "active_column",
    )
    overwrite = lambda path: (lambda df: df.write.mode("overwrite").parquet(path))
    return _write_counted(nodes, overwrite(nodes_path)), _write_counted(config, overwrite(config_path))
