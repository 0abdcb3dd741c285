"""Playlist files: extended M3U lines, free file names, and copies of result files."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def m3u_lines(items: DataFrame) -> DataFrame:
    """playlist_id, n, line: the header, then two lines for each item in order.

    ``items``: playlist_id, position, path, filename, artist, title, duration_sec.
    """
    seconds = F.when(F.col("duration_sec").isNull(), -1).otherwise(F.bround("duration_sec", 0).cast("bigint"))
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    head = F.concat(F.lit("#EXTINF:"), seconds.cast("string"), F.lit(","), F.coalesce(some("artist"), F.lit("Unknown artist")), F.lit(" - "), F.coalesce(some("title"), "filename"))
    place = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(os.getcwd() + "/"), "path"))
    body = items.select("playlist_id", F.posexplode(F.array(head, place)).alias("k", "line"), "position").select("playlist_id", (F.col("position") * 2 + F.col("k") - 1).alias("n"), "line")
    top = items.select("playlist_id").distinct().select("playlist_id", F.lit(0).alias("n"), F.lit("#EXTM3U").alias("line"))
    return top.unionByName(body)


def write_m3u(items: DataFrame, playlist_id: int, path: str) -> str:
    """One playlist as a file; a playlist is a bounded list, written by the driver."""
    lines = [r["line"] for r in m3u_lines(items.where(F.col("playlist_id") == playlist_id)).orderBy("n").collect()] or ["#EXTM3U"]
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return path


def free_path(folder: str, stem: str) -> str:
    """``stem.m3u`` in a folder, or with -2, -3, ... where that exists."""
    path, k = os.path.join(folder, f"{stem}.m3u"), 2
    while os.path.exists(path):
        path, k = os.path.join(folder, f"{stem}-{k}.m3u"), k + 1
    return path


def copy_plan(files: DataFrame, present: DataFrame) -> DataFrame:
    """What copying results into a folder does: skip (same name and size), copy, or rename.

    ``files``: path, size_bytes; ``present``: name, size_bytes of the folder.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    p = present.select("name", F.col("size_bytes").alias("there"))
    both = files.withColumn("name", name).join(p, "name", "left")
    return both.select("path", "name", F.when(F.col("there").isNull(), "copy").when(F.col("there") == F.col("size_bytes"), "skip").otherwise("rename").alias("action"))


def copy_files(paths: list[str], folder: str) -> dict[str, str]:
    """Copies files; an identical one is skipped, another of the same name gets `` (2)``, ..."""
    os.makedirs(folder, exist_ok=True)
    done = {}
    for p in paths:
        stem, ext = os.path.splitext(os.path.basename(p))
        to, k = os.path.join(folder, stem + ext), 2
        while os.path.exists(to) and os.path.getsize(to) != os.path.getsize(p):
            to, k = os.path.join(folder, f"{stem} ({k}){ext}"), k + 1
        if not os.path.exists(to):
            shutil.copy2(p, to)
        done[p] = to
    return done
