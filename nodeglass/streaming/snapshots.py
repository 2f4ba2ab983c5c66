"""Tables that grow by micro-batches, read from a bounded number of folders.

Every batch writes its rows of each table to a folder of its own, a part. A
snapshot, one small JSON file, lists the parts that make up all tables, with the
number of rows and the least and greatest log id of each (a zone map). Renaming
the snapshot into place commits the whole batch; readers take the newest one, so
they see all tables of a batch or none and never list folders.

Parts are compacted in levels: ``fan_in`` parts of a level become one of the
next, in id order, or merged by key where a table has one row per key. Parts
that have grown to ``full_rows`` stay as they are. So after n batches a snapshot
lists at most about ``fan_in * log(n, fan_in)`` parts, besides the full ones,
and each row is rewritten ``log(n, fan_in)`` times. A part that was replaced is
deleted ``KEEP`` snapshots later, which leaves readers time to finish.

One writer at a time: a second one fails when it renames its snapshot.
"""

import json
import uuid

from pyspark.sql import Observation, functions as F

from nodeglass import schemas
from nodeglass.session import file_system

FAN_IN = 16
FULL_ROWS = 50_000_000
ROWS_PER_FILE = 5_000_000
KEEP = 10  # snapshots for which replaced parts stay readable

_NOTHING = {"version": 0, "last_batch": -1, "state": {}, "parts": [], "dropped": []}


def _levels(parts, table):
    found = {}
    for p in parts:
        if p["table"] == table:
            found.setdefault(p["level"], []).append(p)
    return found


def due(parts, table, fan_in=FAN_IN, full_rows=FULL_ROWS, keyed=False):
    """Parts of ``table`` to merge now, all of one level, or none.

    Parts without rows count too, as they cost a reader as much. Full parts are
    left alone unless the table is ``keyed``.
    """
    for _, members in sorted(_levels(parts, table).items()):
        open_ = [p for p in members if keyed or p["rows"] < full_rows]
        if len(open_) >= fan_in:
            return open_
    return []


class Store:
    """Tables under ``root``, one snapshot at a time.

    ``tables`` maps names to schemas. ``merges`` maps keyed tables to a function
    that brings a DataFrame of several parts down to one row per key.
    """

    def __init__(self, root, tables, merges=None, fan_in=FAN_IN, full_rows=FULL_ROWS):
        self.root, self.tables, self.merges = root, tables, merges or {}
        self.fan_in, self.full_rows = fan_in, full_rows

    # Snapshots

    def _versions(self, spark):
        folder, system = file_system(spark, f"{self.root}/_snapshots")
        if not system.exists(folder):
            return []
        names = [status.getPath().getName() for status in system.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, spark, version=None):
        """The newest snapshot, or a kept earlier one."""
        versions = self._versions(spark)
        if version is None and not versions:
            return json.loads(json.dumps(_NOTHING))
        path, system = file_system(spark, f"{self.root}/_snapshots/{versions[-1] if version is None else version:020d}.json")
        stream = system.open(path)
        try:
            return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, spark, snapshot):
        """Write a snapshot aside and rename it into place."""
        name = f"{snapshot['version']:020d}.json"
        final, system = file_system(spark, f"{self.root}/_snapshots/{name}")
        aside, _ = file_system(spark, f"{self.root}/_snapshots/.{name}-{uuid.uuid4().hex}")
        stream = system.create(aside, True)
        try:
            stream.write(bytearray(json.dumps(snapshot).encode()))
        finally:
            stream.close()
        if system.exists(final) or not system.rename(aside, final):
            system.delete(aside, False)
            raise RuntimeError(f"another writer has committed version {snapshot['version']} of {self.root}")

    def commit(self, spark, before, add=(), drop=(), **changes):
        """The snapshot after ``before`` with parts added and dropped, and old files removed."""
        gone = {p["path"] for p in drop}
        version = before["version"] + 1
        dropped = before["dropped"] + [[path, version] for path in sorted(gone)]
        old = [path for path, since in dropped if since <= version - KEEP]
        after = {
            **before, **changes, "version": version,
            "parts": [p for p in before["parts"] if p["path"] not in gone] + list(add),
            "dropped": [d for d in dropped if d[0] not in set(old)],
        }
        self._publish(spark, after)
        for path in old + [f"_snapshots/{v:020d}.json" for v in self._versions(spark) if v <= version - KEEP]:
            target, system = file_system(spark, f"{self.root}/{path}")
            system.delete(target, True)
        return after

    # Parts

    def write(self, df, table, first_batch, last_batch=None, level=0):
        """Write rows as a part that no snapshot lists yet; returns its entry."""
        rows = schemas.conform(df, self.tables[table])
        path = f"{table}/{level}-{first_batch}-{uuid.uuid4().hex}"
        seen, told = Observation(), [F.count(F.lit(1)).alias("rows")]
        if "log_id" in rows.columns:
            told += [F.min("log_id").alias("min_id"), F.max("log_id").alias("max_id")]
        rows.observe(seen, *told).write.parquet(f"{self.root}/{path}")
        return {"table": table, "path": path, "level": level, "first_batch": first_batch,
                "last_batch": first_batch if last_batch is None else last_batch, "min_id": None, "max_id": None, **seen.get}

    def _load(self, spark, table, parts):
        paths = [f"{self.root}/{p['path']}" for p in parts if p["rows"]]
        if not paths:
            return spark.createDataFrame([], self.tables[table])
        return spark.read.schema(self.tables[table]).parquet(*paths)

    def read_part(self, spark, part):
        return self._load(spark, part["table"], [part])

    def read(self, spark, table, from_id=None, to_id=None, snapshot=None):
        """Committed rows of a table, of log ids in ``from_id``..``to_id`` where given.

        Parts whose zone map lies outside are not opened; the ids also reach the
        Parquet filter, which passes by files within a large part.
        """
        found = snapshot or self.snapshot(spark)
        parts = [p for p in found["parts"] if p["table"] == table]
        if from_id is not None:
            parts = [p for p in parts if p["rows"] and p["max_id"] >= from_id]
        if to_id is not None:
            parts = [p for p in parts if p["rows"] and p["min_id"] <= to_id]
        rows = self._load(spark, table, parts)
        if from_id is not None:
            rows = rows.filter(F.col("log_id") >= from_id)
        if to_id is not None:
            rows = rows.filter(F.col("log_id") <= to_id)
        return self.merges[table](rows) if table in self.merges else rows

    def max_id(self, spark, table, snapshot=None):
        """The greatest log id of a table, from the zone maps alone; 0 for an empty one."""
        found = snapshot or self.snapshot(spark)
        return max([p["max_id"] for p in found["parts"] if p["table"] == table and p["rows"]], default=0)

    # Upkeep

    def compact(self, spark):
        """Merge levels that are full; returns the number of merges.

        The merged part is written first and takes the place of the others in
        one commit, so a crash in between leaves a folder that nothing lists.
        """
        merged = 0
        while True:
            now = self.snapshot(spark)
            todo = [(t, found) for t in self.tables if (found := due(now["parts"], t, self.fan_in, self.full_rows, t in self.merges))]
            if not todo:
                return merged
            add, drop = [], []
            for table, members in todo:
                add.append(self._merge(spark, table, members))
                drop += members
            self.commit(spark, now, add, drop)
            merged += len(add)

    def _merge(self, spark, table, members):
        rows = self._load(spark, table, members)
        files = max(1, -(-sum(p["rows"] for p in members) // ROWS_PER_FILE))
        if table in self.merges:
            rows = self.merges[table](rows).coalesce(files)
        elif "log_id" in rows.columns:
            rows = rows.repartitionByRange(files, "log_id").sortWithinPartitions("log_id")
        else:
            rows = rows.coalesce(files)
        return self.write(rows, table, min(p["first_batch"] for p in members), max(p["last_batch"] for p in members), members[0]["level"] + 1)

    def vacuum(self, spark):
        """Delete folders of crashed writes, which no kept snapshot lists; returns how many.

        Not to be run beside a writer, whose parts are not listed yet.
        """
        listed = set()
        for version in self._versions(spark):
            found = self.snapshot(spark, version)
            listed |= {p["path"] for p in found["parts"]} | {path for path, _ in found["dropped"]}
        gone = 0
        for table in self.tables:
            folder, system = file_system(spark, f"{self.root}/{table}")
            for status in system.listStatus(folder) if system.exists(folder) else ():
                if f"{table}/{status.getPath().getName()}" not in listed:
                    gone += bool(system.delete(status.getPath(), True))
        return gone
