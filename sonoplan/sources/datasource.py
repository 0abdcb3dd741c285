"""Audio files as a Spark data source: ``spark.read.format("audio").load(folder)``, batch or stream.

The reader opens files only as far as the columns asked for need it: a listing (path, size_bytes,
mtime, scanned_at) opens none, metadata reads headers, and ``content`` whole files. Spark doesn't
tell a Python source which columns a query uses, so ``schema`` names them:

    spark.read.format("audio").schema("path string, duration_sec double").load("/music")

Partitions are planned by what is read of the files: ``partitionBytes`` each, a file that is only
opened counting ``openBytes``. Folders are local or shared paths, or any that pyarrow's file systems
reach by URI. As a stream the source gives a whole listing for every scan that finds a difference,
with one row of an empty path per scan, so that a scan of nothing is seen too.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import os
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schema import AUDIO_EXTENSIONS

LISTING = "path string, size_bytes bigint, mtime double, scanned_at timestamp"
METADATA = "container string, codec string, sample_rate int, channels int, bit_depth int, bitrate_kbps double, duration_sec double, error string"
_LISTED = {c.split()[0] for c in LISTING.split(", ")}
#: Rows of a batch, and bytes of contents in one.
_ROWS, _BYTES = 1024, 64 << 20


def file_system(root: str):
    """(pyarrow file system, path in it) of a local path or URI; spaces and signs in local paths are plain."""
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), os.path.abspath(root)


def list_files(root: str, extensions: Sequence[str] = AUDIO_EXTENSIONS) -> list[tuple[str, int, float]]:
    """(path, size, time of change) of the files below a folder, sorted. A folder that is denied or goes
    meanwhile counts as empty, and so does a root that isn't there."""
    from pyarrow import fs

    own, top = file_system(root)
    wanted = lambda p: os.path.splitext(p)[1].lower() in extensions
    out, folders = [], [top]
    while folders:
        here = folders.pop()
        try:
            found = own.get_file_info(fs.FileSelector(here)) if own.get_file_info(here).type == fs.FileType.Directory else [own.get_file_info(here)]
        except OSError:
            continue
        for i in found:
            if i.type == fs.FileType.Directory and not (isinstance(own, fs.LocalFileSystem) and os.path.islink(i.path)):
                folders.append(i.path)
            elif i.type == fs.FileType.File and wanted(i.path):
                out.append((i.path, i.size, i.mtime_ns / 1e9 if i.mtime_ns is not None else 0.0))
    return sorted(out)


@dataclass
class Files(InputPartition):
    root: str
    files: list[tuple[str, int, float]]
    scanned_ms: int


def plan(root: str, files: list[tuple[str, int, float]], whole: bool, options: dict[str, str], scanned_ms: int) -> list[Files]:
    """Partitions of files in order, each with about ``partitionBytes`` to read."""
    most, cost = int(options.get("partitionbytes", 128 << 20)), int(options.get("openbytes", 256 << 10))
    out, weight = [Files(root, [], scanned_ms)], 0
    for f in files:
        own = cost + (f[1] if whole else 0)
        if out[-1].files and weight + own > most:
            out.append(Files(root, [], scanned_ms))
            weight = 0
        out[-1].files.append(f)
        weight += own
    return out


def read_files(part: Files, names: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    from . import audio

    own, _ = file_system(part.root)
    opened, whole = set(names) - _LISTED, "content" in names
    when = dt.datetime.fromtimestamp(part.scanned_ms / 1000, dt.timezone.utc)
    rows: list[dict] = []
    weight = 0
    for path, size, mtime in part.files:
        row = {"path": path, "size_bytes": size, "mtime": mtime, "scanned_at": when}
        if opened and path:
            try:
                with own.open_input_file(path) as f:
                    if whole:
                        row["content"] = f.read()
                        f.seek(0)
                    row |= audio.probe_file(f, path) if opened - {"content", "error"} else {}
            except Exception as e:  # noqa: BLE001 - one file's failure is its row's
                row["error"] = str(e)[:200]
        rows.append(row)
        weight += size if whole else 0
        if len(rows) >= _ROWS or weight >= _BYTES:
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema)
            rows, weight = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema)


class _Columns:
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        known = _LISTED | {c.split()[0] for c in METADATA.split(", ")} | {"content"}
        if unknown := [n for n in schema.names if n not in known]:
            raise ValueError(f"no such columns: {', '.join(unknown)}")
        if not options.get("path"):
            raise ValueError("a folder is needed: load(path)")
        self.root, self.options, self.names = options["path"], {k.lower(): v for k, v in options.items()}, schema.names
        self.schema = to_arrow_schema(schema)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return read_files(partition, self.names, self.schema)


class AudioReader(_Columns, DataSourceReader):
    def partitions(self) -> list[Files]:
        return plan(self.root, list_files(self.root), "content" in self.names, self.options, int(time.time() * 1000))


class AudioStreamReader(_Columns, DataSourceStreamReader):
    """Offsets are the times of scans; a scan that equals the last one takes its offset."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        super().__init__(options, schema)
        self.seen: tuple[str, int] | None = None
        self.files: dict[int, list[tuple[str, int, float]]] = {}

    def initialOffset(self) -> dict:
        return {"scan": 0}

    def latestOffset(self) -> dict:
        files = list_files(self.root)
        mark = hashlib.sha256(repr(files).encode()).hexdigest()
        if self.seen is None or self.seen[0] != mark:
            self.seen = mark, max(int(time.time() * 1000), (self.seen or ("", 0))[1] + 1)
            self.files[self.seen[1]] = files
        return {"scan": self.seen[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        if start["scan"] == end["scan"]:
            return []
        # A scan that a former run planned is made again: what follows compares states, not events.
        files = self.files.get(end["scan"])
        files = list_files(self.root) if files is None else files
        return plan(self.root, [("", 0, 0.0), *files], "content" in self.names, self.options, end["scan"])

    def commit(self, end: dict) -> None:
        self.files = {k: v for k, v in self.files.items() if k > end["scan"]}


class AudioFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "audio"

    def schema(self) -> str:
        return f"{LISTING}, {METADATA}"

    def reader(self, schema: StructType) -> AudioReader:
        return AudioReader(self.options, schema)

    def streamReader(self, schema: StructType) -> AudioStreamReader:
        return AudioStreamReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes ``format("audio")`` known to a session."""
    spark.dataSource.register(AudioFiles)
