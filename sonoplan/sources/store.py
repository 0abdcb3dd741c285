"""Tables of a library in any store that Hadoop reaches: a log of commits over files that never change.

A commit is a numbered manifest that names the parts of every table; it is created only if no
other writer has taken its number, so readers see all of a change or nothing, and of two writers
one is first. The other looks at what came between: where that left the tables alone on which its
own change rests, it takes the next number; else it raises ``Conflict`` and changes nothing.

A part of a table holds rows, and the keys of rows in earlier parts that are gone. Small changes
add a part, so they write in proportion to what they change; readers merge the parts. Many small
parts are folded into one, and into the table once they weigh as much as half of it.

Files stay until ``vacuum`` takes those that no recent commit names: a long read keeps its files.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..schema import SCHEMAS

#: Relations that a Library calls otherwise than the store.
FIELDS = {"pairs": "learning_pairs", "weights": "learning_weights", "noise": "noise_chunks", "reduced": "reduced_vectors"}
#: Parts of a table before they are folded, and times a commit is tried anew after others came first.
MOST_PARTS, MOST_TRIES = 16, 50


class Conflict(RuntimeError):
    """Another writer has changed a table that this change has read or replaces."""


class Store:
    def __init__(self, spark: SparkSession, root: str, most_parts: int = MOST_PARTS) -> None:
        self.spark, self.root, self.most_parts = spark, root.rstrip("/"), most_parts
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("_log"))
        self._read_at: dict[str, int] = {}

    def _path(self, *names: str):
        return self._hadoop.Path("/".join((self.root, *names)))

    # --- the log ---------------------------------------------------------------------------

    def versions(self) -> list[int]:
        """Numbers of the commits that are still there, in order."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path("_log"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The state after a commit (by default the last): version, and per table its parts and the
        commit that changed it last."""
        if version is None:
            version = max(self.versions(), default=0)
        if version:
            return self._json("_log", f"{version:020d}.json")
        # Before the first commit there may be tables of the former layout, a folder each.
        old = self._json("MANIFEST")["tables"] if self._fs.exists(self._path("MANIFEST")) else {}
        return {"version": 0, "tables": {n: {"parts": [{"rows": v, "gone": []}], "changed": 0} for n, v in old.items()}}

    def _json(self, *names: str) -> dict:
        stream = self._fs.open(self._path(*names))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, state: dict) -> bool:
        """Creates the manifest of ``state`` whole, or finds its number taken.

        A link (local folders) or a rename that doesn't overwrite (Hadoop file systems) decides; an
        object store needs one whose rename refuses existing names.
        """
        to, tmp = self._path("_log", f"{state['version']:020d}.json"), self._path("_log", f".{uuid.uuid4().hex}")
        data = json.dumps(state).encode()
        if self._fs.getUri().getScheme() == "file":
            at, own = to.toUri().getPath(), tmp.toUri().getPath()
            with open(own, "wb") as out:
                out.write(data)
                out.flush()
                os.fsync(out.fileno())
            try:
                os.link(own, at)
            except FileExistsError:
                return False
            finally:
                os.unlink(own)
            return True
        out = self._fs.create(tmp, True)
        out.write(bytearray(data))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(tmp), self._fs.makeQualified(to), none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            self._fs.delete(tmp, False)
            return False
        return True

    # --- reading ---------------------------------------------------------------------------

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The rows after the last commit, or after another that is still there; an empty table of the
        known schema where nothing was written. Columns that were added to the schema later read as null.

        Of a table that is read so and then written by ``write`` or ``write_all``, changes that others
        make in between are a conflict."""
        state = self.manifest(version)
        if version is None:
            self._read_at[name] = state["tables"].get(name, {}).get("changed", 0)
        return self._rows(name, state)

    def _rows(self, name: str, state: dict) -> DataFrame:
        df = self._merged(name, state["tables"].get(name, {}).get("parts", []))
        if df is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        if name not in SCHEMAS:
            return df
        return df.select(*df.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[name] if f.name not in df.columns])

    def _merged(self, name: str, parts: list[dict]) -> DataFrame | None:
        """Rows of all parts but those whose key a later part names as gone (nulls equal nulls)."""
        load = lambda p: self.spark.read.parquet(f"{self.root}/{name}/{p}")
        held = [(k, p["rows"]) for k, p in enumerate(parts) if p["rows"]]
        if not held:
            return None
        gone: dict[tuple[str, ...], list[DataFrame]] = {}
        for k, p in enumerate(parts):
            for g in p["gone"] if k > held[0][0] else ():
                gone.setdefault(tuple(g["on"]), []).append(load(g["path"]).withColumn("_gone_at", F.lit(k)))
        if not gone:
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [load(p) for _, p in held])
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [load(p).withColumn("_at", F.lit(k)) for k, p in held])
        for on, lists in gone.items():
            last = reduce(DataFrame.unionByName, lists).groupBy(*on).agg(F.max("_gone_at").alias("_gone_at"))
            last = last.select(*[F.col(c).alias(f"_gone_{c}") for c in on], "_gone_at")
            rows = rows.join(last, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_gone_{c}")) for c in on]) & (F.col("_at") < F.col("_gone_at")), "left_anti")
        return rows.drop("_at")

    # --- writing ---------------------------------------------------------------------------

    def change(self) -> Change:
        """A change of several tables at once, resting on what they hold now."""
        return Change(self)

    def write(self, name: str, rows: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        self.write_all({name: rows}, partition_by)

    def write_all(self, tables: dict[str, DataFrame], partition_by: tuple[str, ...] = ()) -> None:
        """Replaces all tables at once, or none. Raises Conflict if one of them has changed since it was
        read here last (or, not read here, since this call began)."""
        change = Change(self)
        change.rests_on |= {n: self._read_at[n] for n in tables if n in self._read_at}
        for name, rows in tables.items():
            change.write(name, rows, partition_by)
        change.commit()
        for name in tables:
            self._read_at.pop(name, None)

    def merge(self, name: str, rows: DataFrame | None = None, on: Sequence[str] = (), gone: DataFrame | None = None) -> None:
        """One small change: see ``Change.merge``. It rests on nothing, so of two on the same key the later wins."""
        change = Change(self)
        change.merge(name, rows, on, gone)
        change.commit()

    def put_setting(self, key: str, value: str) -> None:
        self.merge("settings", self.spark.createDataFrame([(key, value)], "key string, value string"), ["key"])

    def set_status(self, track_id: int, status: str, message: str | None = None) -> None:
        """Rewrites the one row."""
        from ..operators import changes

        change = Change(self)
        change.merge("tracks", changes.set_status(change.read("tracks").where(F.col("track_id") == track_id), track_id, status, message), ["track_id"])
        change.commit()

    def _weight(self, name: str, part: dict) -> int:
        paths = [p for p in (part["rows"], *(g["path"] for g in part["gone"])) if p]
        return sum(self._fs.getContentSummary(self._path(name, p)).getLength() for p in paths)

    def compact(self, name: str, fold: bool = False) -> None:
        """Rewrites a table as one part; ``fold``: only what came after its first part, as one part more."""
        change = Change(self)
        parts = change.state["tables"].get(name, {}).get("parts", [])
        if len(parts) < 2 + fold:
            return
        if not fold:
            change.write(name, change.read(name))
        else:
            rows, lists = self._merged(name, parts[1:]), {}
            for p in parts[1:]:
                for g in p["gone"]:
                    lists.setdefault(tuple(g["on"]), []).append(self.spark.read.parquet(f"{self.root}/{name}/{g['path']}"))
            part = {"rows": rows is not None and change.file(name, rows) or None, "gone": [{"path": change.file(name, reduce(DataFrame.unionByName, d).distinct()), "on": list(on)} for on, d in lists.items()]}
            change.rests_on[name] = change.state["tables"][name]["changed"]
            change.replaced[name] = [parts[0], part]
        change.commit()

    def vacuum(self, older_than: float = 7 * 86400.0) -> int:
        """Deletes commits before the last that are older (in seconds), and the files that no commit left
        names if they are as old: files of a change that never ended go so too. Number of folders deleted."""
        before = (time.time() - older_than) * 1000
        log = {int(f.getPath().getName()[:-5]): f for f in self._fs.listStatus(self._path("_log")) if f.getPath().getName().endswith(".json")}
        for version in sorted(log)[:-1]:
            if log[version].getModificationTime() < before:
                self._fs.delete(log[version].getPath(), False)
        named = set()
        for version in self.versions():
            for name, t in self.manifest(version)["tables"].items():
                named |= {(name, x) for p in t["parts"] for x in (p["rows"], *(g["path"] for g in p["gone"])) if x}
        count = 0
        for folder in self._fs.listStatus(self._path()):
            name = folder.getPath().getName()
            if name.startswith("_") or not folder.isDirectory():
                continue
            for f in self._fs.listStatus(folder.getPath()):
                if (name, f.getPath().getName()) not in named and f.getModificationTime() < before:
                    count += bool(self._fs.delete(f.getPath(), True))
        return count

    def tables(self) -> dict[str, DataFrame]:
        """All relations by the names that operators use, vectors as ``v`` (array<double>)."""
        back = {v: k for k, v in FIELDS.items()}
        out, state = {}, self.manifest()
        for name in SCHEMAS:
            self._read_at[name] = state["tables"].get(name, {}).get("changed", 0)
            df = self._rows(name, state)
            out[back.get(name, name)] = df.withColumn("v", vectors.doubles("vector")).drop("vector") if "vector" in df.columns else df
        return out

    def put(self, tables: dict[str, DataFrame]) -> None:
        """``write_all`` of relations as ``tables`` has them."""
        self.write_all({FIELDS.get(k, k): stored(FIELDS.get(k, k), df) for k, df in tables.items()})


class Change:
    """What one writer does to the tables, resting on their state when it began.

    Tables that it reads, or replaces, must be the same when it commits. Files are written as the
    change goes on; ``commit`` makes them part of the tables, or raises Conflict.
    """

    def __init__(self, store: Store) -> None:
        self.store, self.state = store, store.manifest()
        self.rests_on: dict[str, int] = {}
        self.replaced: dict[str, list[dict]] = {}
        self.added: dict[str, list[dict]] = {}

    def __enter__(self) -> Change:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()

    def _changed(self, name: str, state: dict) -> int:
        return state["tables"].get(name, {}).get("changed", 0)

    def read(self, name: str) -> DataFrame:
        """Rows of a table as it was when this change began."""
        self.rests_on.setdefault(name, self._changed(name, self.state))
        return self.store._rows(name, self.state)

    def file(self, name: str, rows: DataFrame, partition_by: Sequence[str] = ()) -> str:
        fresh = uuid.uuid4().hex
        rows.write.partitionBy(*partition_by).parquet(f"{self.store.root}/{name}/{fresh}")
        return fresh

    def write(self, name: str, rows: DataFrame, partition_by: Sequence[str] = ()) -> None:
        """Replaces a table."""
        self.rests_on.setdefault(name, self._changed(name, self.state))
        self.replaced[name], self.added[name] = [{"rows": self.file(name, rows, partition_by), "gone": []}], []

    def merge(self, name: str, rows: DataFrame | None = None, on: Sequence[str] = (), gone: DataFrame | None = None) -> None:
        """Adds ``rows``; rows of the table whose key ``on`` they have, or ``gone`` has, go. Without
        ``on`` nothing goes. Rows that repeat a key among themselves all stay."""
        if gone is not None and not on:
            raise ValueError("rows that go need a key")
        if name in SCHEMAS and rows is not None:
            rows = stored(name, rows)
        own = None if rows is None else self.file(name, rows)
        lists = []
        if on:
            keys = ([] if own is None else [self.store.spark.read.parquet(f"{self.store.root}/{name}/{own}").select(*on)]) + ([] if gone is None else [gone.select(*on)])
            if keys:
                lists = [{"path": self.file(name, reduce(DataFrame.unionByName, keys).distinct()), "on": list(on)}]
        self.added.setdefault(name, []).append({"rows": own, "gone": lists})

    def commit(self) -> int:
        """The number of the commit."""
        touched = [*dict.fromkeys([*self.replaced, *self.added])]
        for _ in range(MOST_TRIES):
            now = self.store.manifest()
            lost = [n for n, at in self.rests_on.items() if self._changed(n, now) != at]
            if lost:
                raise Conflict(f"{', '.join(sorted(lost))} changed since this change began")
            tables, version = dict(now["tables"]), now["version"] + 1
            for name in touched:
                parts = self.replaced.get(name, tables.get(name, {}).get("parts", []))
                tables[name] = {"parts": [*parts, *self.added.get(name, [])], "changed": version}
            if self.store._publish({"version": version, "tables": tables}):
                for name in self.added:
                    self._settle(name, tables[name]["parts"])
                return version
        raise Conflict(f"{MOST_TRIES} other changes came first")

    def _settle(self, name: str, parts: list[dict]) -> None:
        if len(parts) <= self.store.most_parts:
            return
        weights = [self.store._weight(name, p) for p in parts]
        try:
            self.store.compact(name, fold=2 * sum(weights[1:]) < weights[0])
        except Conflict:
            pass  # the other writer's change settles it


def stored(name: str, rows: DataFrame) -> DataFrame:
    """Rows with the columns of the stored relation: ``v`` as floats with its size and norm; unknown columns go."""
    if "v" in rows.columns:
        rows = rows.withColumns({"vector": F.col("v").cast("array<float>"), "dim": F.size("v"), "norm": vectors.norm("v")})
        rows = rows.withColumn("created_at", F.coalesce("created_at", F.current_timestamp()) if "created_at" in rows.columns else F.current_timestamp())
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType.simpleString()).alias(f.name) for f in SCHEMAS[name]])


def unpack_vector(blob: Column) -> Column:
    """Vectors of an imported library: little-endian float32 bytes as array<float>."""
    @F.pandas_udf("array<float>")
    def unpack(x: pd.Series) -> pd.Series:
        return x.map(lambda raw: None if raw is None else np.frombuffer(raw, "<f4"))

    return unpack(blob)


def pack_vector(v: Column) -> Column:
    """The inverse of ``unpack_vector``, for export."""
    @F.pandas_udf("binary")
    def pack(x: pd.Series) -> pd.Series:
        return x.map(lambda a: None if a is None else np.asarray(a, "<f4").tobytes())

    return pack(v)
