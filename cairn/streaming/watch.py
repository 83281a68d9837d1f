"""Incremental maintenance by Structured Streaming: file events in, tables kept up to date.

Events (root, path, op, event_time) are coalesced per batch and root: a path both changed and deleted counts as
changed. Each batch writes a new version behind the last one. A version counts once its mark is there, which names the
stream and its batch: a batch that runs twice is written once, and a stream over a new checkpoint goes on where the last one ended.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENTS = "root string, path string, op string, event_time timestamp"


def coalesce_events(events: DataFrame) -> DataFrame:
    """(root, path, op): one row a path."""
    return events.groupBy("root", "path").agg(F.when(F.max((F.col("op") == "changed").cast("int")) == 1, "changed").otherwise("deleted").alias("op"))


def apply_events(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """The snapshot (root, path, ..., last_seen) after a batch."""
    latest = events.groupBy("root", "path").agg(F.max("event_time").alias("last_seen"))
    now = coalesce_events(events).join(latest, ["root", "path"])
    kept = snapshot.join(now.select("root", "path"), ["root", "path"], "left_anti")
    return kept.unionByName(now.where("op = 'changed'").select("root", "path", "last_seen"))


def _folder(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def committed(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(version, mark) of the versions that count, by Spark's own file system."""
    fs, path = _folder(spark, folder)
    if not fs.exists(path):
        return []
    out = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        marks = [f.getPath().getName() for f in fs.listStatus(status.getPath())] if name.startswith("version=") else []
        out += [(int(name[8:]), m[8:]) for m in marks if m.startswith("_marked.")]
    return sorted(out)


def commit(spark: SparkSession, folder: str, version: int, mark: str) -> None:
    """Makes a written version count; the mark appears as a whole or not at all."""
    fs, path = _folder(spark, f"{folder}/version={version}/_marked.{mark}")
    fs.create(path, True).close()


def versions(spark: SparkSession, folder: str) -> list[int]:
    return [v for v, _ in committed(spark, folder)]


def load_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The last snapshot; empty at first."""
    known = versions(spark, folder)
    if not known:
        return spark.createDataFrame([], "root string, path string, last_seen timestamp")
    return spark.read.parquet(f"{folder}/version={known[-1]}")


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark has given the stream of this checkpoint; a new checkpoint has a new one."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def in_versions(events: DataFrame, folder: str, checkpoint: str, write, after=None, trigger: dict | None = None):
    """Starts a stream that makes a version of each batch: write(batch, path of the version) unless it is there already, then after(batch, number)."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark = f"{stream_id(spark, checkpoint)}-{number}"
        done = committed(spark, folder)
        batch = batch.persist()
        if mark not in {m for _, m in done}:
            version = done[-1][0] + 1 if done else 0
            write(batch, f"{folder}/version={version}")
            commit(spark, folder, version, mark)
        if after is not None:
            after(batch, number)
        batch.unpersist()

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def maintain(events: DataFrame, folder: str, checkpoint: str, on_batch=None, trigger: dict | None = None):
    """Starts the stream of snapshots; on_batch(snapshot, changed, batch) runs behind each, for example to refresh ranks."""

    def write(batch: DataFrame, path: str) -> None:
        apply_events(load_snapshot(batch.sparkSession, folder), batch).write.mode("overwrite").parquet(path)

    def after(batch: DataFrame, number: int) -> None:
        on_batch(load_snapshot(batch.sparkSession, folder), coalesce_events(batch), number)

    return in_versions(events, folder, checkpoint, write, after if on_batch is not None else None, trigger)


class Cadence:
    """When a costly refresh is due: at the first batch, after `seconds`, or after `batches`, whichever comes first."""

    def __init__(self, seconds: float = 30, batches: int = 32):
        self.seconds, self.batches, self.last, self.since = seconds, batches, None, 0

    def due(self, now: float) -> bool:
        self.since += 1
        if self.last is None or now - self.last >= self.seconds or self.since >= self.batches:
            self.last, self.since = now, 0
            return True
        return False
