"""Incremental library scans: one pass, or a stream whose state is what each file was at the last scan."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators import changes
from ..sources import audio, datasource
from ..sources.store import Store

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merge_probed(tracks: DataFrame, probed: DataFrame, folder_id: int) -> DataFrame:
    """Tracks with the metadata of newly probed files; ids follow from paths, a null never erases."""
    new = probed.withColumn("track_id", changes.path_id("path")).withColumn("folder_id", F.lit(folder_id).cast("bigint"))
    new = new.withColumn("filename", F.regexp_extract("path", r"([^/]+)$", 1)).withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    out = changes.upsert(tracks, new, ["path"])
    return out.withColumn("status", F.coalesce("status", F.lit("new")))


def scan(spark: SparkSession, root: str, store: Store, folder_id: int = 1) -> dict[str, int]:
    """One pass over a folder: only new or changed files are opened, lost ones are pruned."""
    change = store.change()
    tracks = change.read("tracks")
    found = audio.listing(spark, root)
    todo = audio.changed(found, tracks.where(F.col("folder_id") == folder_id))
    contents = audio.read_contents(spark, root).join(todo.select("path"), "path", "left_semi")
    probed = audio.probe_files(contents).join(todo.select("path", "size_bytes", "mtime"), "path").persist()
    errors = probed.where("error IS NOT NULL").count()
    seen = probed.count()
    lost = changes.missing(tracks, found, folder_id).select("track_id", "path")
    counts = {"files": found.count(), "probed": seen, "cached": found.count() - seen, "errors": errors, "removed": lost.count()}
    # Only the rows that change are written.
    change.merge("tracks", merge_probed(tracks.join(probed.select("path"), "path", "left_semi"), probed, folder_id), ["track_id"], lost.select("track_id"))
    change.commit()
    probed.unpersist()
    return counts


class FileStates(StatefulProcessor):
    """Keeps size and time of every file; what a scan changes leaves as (path, change, size, time).

    A file has a timer that is due when a scan has passed it by: each scan that lists the file moves
    the timer behind its own time, which the watermark reaches only by the next scan.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("file", "size_bytes bigint, mtime double, due bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = max(rows, key=lambda r: r["scanned_ms"])
        if not key[0]:  # the row of the scan itself
            return
        due = last["scanned_ms"] + 1
        old = self.known.get() if self.known.exists() else None
        if old is not None:
            self.handle.deleteTimer(old[2])
        self.handle.registerTimer(due)
        self.known.update((last["size_bytes"], last["mtime"], due))
        if old is None or old[0] != last["size_bytes"] or abs(old[1] - last["mtime"]) >= audio.MTIME_SLACK:
            yield Row(path=key[0], change="added" if old is None else "changed", size_bytes=last["size_bytes"], mtime=last["mtime"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.known.exists():
            return
        size, mtime, due = self.known.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= due:
            self.known.clear()
            yield Row(path=key[0], change="removed", size_bytes=size, mtime=mtime)

    def close(self) -> None:
        pass


def file_changes(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (path, change, size_bytes, mtime): files added, changed and removed since the last scan.

    The state of a file lives where its path hashes to, so no task holds a listing. Needs the RocksDB
    state store, which this sets for the session.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    datasource.register(spark)
    listed = spark.readStream.format("audio").schema(datasource.LISTING).load(root).withWatermark("scanned_at", "0 seconds")
    listed = listed.withColumn("scanned_ms", F.unix_millis("scanned_at"))
    out = "path string, change string, size_bytes bigint, mtime double"
    return listed.groupBy("path").transformWithState(FileStates(), out, "Append", "EventTime")


def probe_paths(files: DataFrame, root: str) -> DataFrame:
    """Metadata of ``files`` (path), of which headers alone are read, where the rows are."""
    names = ["path", *(c.split()[0] for c in datasource.METADATA.split(", "))]
    schema = to_arrow_schema(StructType.fromDDL(f"path string, {datasource.METADATA}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from datasource.read_files(datasource.Files(root, [(p, 0, 0.0) for p in b.column(0).to_pylist()], 0), names, schema)

    return files.select("path").mapInArrow(run, f"path string, {datasource.METADATA}")


def stream(spark: SparkSession, root: str, store: Store, checkpoint: str, folder_id: int = 1, **trigger):
    """Keeps the tracks of a folder as the folder is: each scan that finds a difference writes the rows
    that it concerns, and nothing else.

    ``trigger`` is as for DataStreamWriter.trigger (by default one scan after the other). The checkpoint
    holds the files' states, so a later run sees what was changed or deleted meanwhile. A batch that is
    run again gives the same rows. A removal shows once the watermark has passed the scan that misses
    the file; a run with ``availableNow`` ends before that and leaves it to the next.
    """

    def merge(batch: DataFrame, _: int) -> None:
        b = batch.persist()
        try:
            if b.isEmpty():
                return
            with store.change() as change:
                tracks = change.read("tracks").where(F.col("folder_id") == folder_id)
                seen = b.where("change != 'removed'")
                probed = probe_paths(seen, root).join(seen.drop("change"), "path")
                new = merge_probed(tracks.join(seen.select("path"), "path", "left_semi"), probed, folder_id)
                lost = tracks.join(b.where("change = 'removed'").select("path"), "path", "left_semi")
                change.merge("tracks", new, ["track_id"], lost.select("track_id"))
        finally:
            b.unpersist()

    out = file_changes(spark, root).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append")
    return out.trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def rescan(spark: SparkSession, root: str, store: Store, checkpoint: str, folder_id: int = 1) -> None:
    """Runs ``stream`` until the tracks are as the folder is, removals too, and ends it."""
    query = stream(spark, root, store, checkpoint, folder_id)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
