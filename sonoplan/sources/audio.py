"""Audio files: discovery, probing and decoding.

Files are found on the driver (so that folders which can't be read are reported), probed and
decoded where the data is. ``containers`` reads headers and uncompressed samples; what it doesn't
know goes to command-line tools where these are installed.
"""

from __future__ import annotations

import io
import json
import os
import shutil
import subprocess
from collections.abc import Iterator, Sequence
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import AUDIO_EXTENSIONS
from . import containers

MTIME_SLACK = 1e-6


def check_read_access(path: str) -> str | None:
    """What keeps a folder from being read, or None."""
    try:
        with os.scandir(path) as entries:
            next(entries, None)
    except OSError as e:
        return str(e)
    return None


def find_files(root: str) -> tuple[list[str], list[tuple[str, str]]]:
    """Sorted audio files below a folder, and (folder, error) for what can't be read. Linked folders
    are not followed; one denied folder doesn't stop its siblings."""
    wanted = lambda p: os.path.splitext(p)[1].lower() in AUDIO_EXTENSIONS
    if os.path.isfile(root):
        return ([root] if wanted(root) else []), []
    files: list[str] = []
    denied: list[tuple[str, str]] = []
    for folder, _, names in os.walk(root, onerror=lambda e: denied.append((e.filename, str(e)))):
        files += [p for n in names if wanted(n) and os.path.isfile(p := os.path.join(folder, n))]
    return sorted(files), denied


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, size_bytes, mtime of the files, from the file system's own listing, without contents."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    own = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*AUDIO_EXTENSIONS)
    plain = F.url_decode(F.regexp_replace(F.regexp_replace("path", r"\+", "%2B"), "^file:/+", "/"))
    return f.where(own).select(plain.alias("path"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))


def changed(found: DataFrame, tracks: DataFrame) -> DataFrame:
    """Files to probe: unknown ones, and those whose codec is unknown or size or time differ."""
    known = tracks.where("codec IS NOT NULL").select("path", F.col("size_bytes").alias("s"), F.col("mtime").alias("m"))
    both = found.join(known, "path", "left")
    same = (F.col("size_bytes") == F.col("s")) & (F.abs(F.col("mtime") - F.col("m")) < MTIME_SLACK)
    return both.where(~F.coalesce(same, F.lit(False))).drop("s", "m")


def decode_wav(raw: bytes) -> tuple[np.ndarray, int]:
    """(samples averaged over channels as float32, rate) of an uncompressed WAV file."""
    if raw[:4] not in (b"RIFF", b"RF64"):
        raise ValueError("not a WAV file")
    return decode(raw, "wav")


def resampled(x: np.ndarray, rate: int, target_rate: int | None) -> tuple[np.ndarray, int]:
    """Samples (along the first axis) at another rate, by linear interpolation."""
    if not target_rate or rate == target_rate or not len(x):
        return x, rate
    n = max(1, int(round(len(x) * target_rate / rate)))
    old, new = np.linspace(0, max(len(x) - 1, 1), len(x)), np.linspace(0, max(len(x) - 1, 1), n)
    line = lambda c: np.interp(new, old, c).astype(np.float32)
    return (line(x) if x.ndim == 1 else np.stack([line(c) for c in x.T], 1)), target_rate


def decode(raw: bytes, path: str, target_rate: int | None = None, mono: bool = True) -> tuple[np.ndarray, int]:
    """Float32 samples of any file, averaged over channels or, unless ``mono``, as (n, channels).

    Uncompressed WAV, AIFF and AU directly, the rest through a decoder on the path.
    """
    found = containers.samples(raw)
    if found is not None:
        x, rate = found
        x = x.astype(np.float64).mean(1).astype(np.float32) if mono else x
        return resampled(x, rate, target_rate)
    tool = shutil.which("ffmpeg")
    if tool is None:
        raise RuntimeError(f"{path}: no decoder for this container")
    about = probe(raw, path)
    rate, channels = target_rate or about["sample_rate"] or 44_100, 1 if mono else about["channels"] or 2
    p = subprocess.run([tool, "-v", "error", "-i", "-", "-f", "f32le", "-ac", str(channels), "-ar", str(rate), "-"], input=raw, capture_output=True, timeout=600)
    if p.returncode:
        raise RuntimeError(f"{path}: {p.stderr.decode(errors='replace')[:200]}")
    x = np.frombuffer(p.stdout, "<f4")
    return (x if mono else x[: len(x) // channels * channels].reshape(-1, channels)), rate


def probe(raw: bytes, path: str) -> dict:
    """container, codec, sample_rate, channels, bit_depth, bitrate_kbps, duration_sec; unknown: None."""
    return probe_file(io.BytesIO(raw), path)


def probe_file(f: BinaryIO, path: str) -> dict:
    """As ``probe``, of a seekable file: by its header, or by a tool on the path where that says nothing."""
    out: dict = dict.fromkeys(containers.FIELDS)
    out["container"] = os.path.splitext(path)[1].lower().lstrip(".") or None
    try:
        found = containers.read_header(f)
    except ValueError:
        found = None
    if found is not None:
        return out | {k: v for k, v in found.items() if k != "container" or out["container"] is None}
    f.seek(0)
    head = f.read(4)
    tool = shutil.which("ffprobe")
    if tool and head != b"RIFF":
        try:
            got = json.loads(subprocess.run([tool, "-v", "error", "-print_format", "json", "-show_format", "-show_streams", "-"], input=head + f.read(), capture_output=True, timeout=30).stdout or b"{}")
            s = next((s for s in got.get("streams", []) if s.get("codec_type") == "audio"), {})
            num = lambda v, kind: kind(v) if str(v or "").replace(".", "", 1).isdigit() else None
            rate = num(s.get("bit_rate"), float) or num(got.get("format", {}).get("bit_rate"), float)
            out |= {"codec": s.get("codec_name"), "sample_rate": num(s.get("sample_rate"), int), "channels": num(s.get("channels"), int), "bit_depth": num(s.get("bits_per_raw_sample"), int) or num(s.get("bits_per_sample"), int)}
            out |= {"duration_sec": num(got.get("format", {}).get("duration"), float) or num(s.get("duration"), float), "bitrate_kbps": rate / 1000 if rate else None}
        except (subprocess.SubprocessError, ValueError):
            pass
    return out


_PROBED = "path string, container string, codec string, sample_rate int, channels int, bit_depth int, bitrate_kbps double, duration_sec double, error string"


def probe_files(files: DataFrame) -> DataFrame:
    """Metadata of ``files`` (path, content); a file that fails has an error and the rest go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _PROBED.split(", ")]
        for b in batches:
            rows = []
            for path, raw in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    rows.append({"path": path, "error": None, **probe(raw.as_py() or b"", path)})
                except Exception as e:  # noqa: BLE001
                    rows.append({"path": path, "error": str(e)[:200]})
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, kinds)], names=names)

    return files.select("path", "content").mapInArrow(run, _PROBED)


_CHUNK = "path string, idx int, start_sec double, end_sec double, rate int, samples array<float>, error string"


def decode_chunks(files: DataFrame, seconds: float = 20.0, overlap_percent: float = 50.0, target_rate: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Chunks of samples of ``files`` (path, content), one row each; errors as rows without samples.

    Columns of ``files`` that ``keep`` names go with each of their chunks, so that samples needn't be joined.
    """
    hop_share = 1 - min(max(float(overlap_percent), 0.0), 95.0) / 100

    def plan(n: int, rate: int) -> list[tuple[int, int]]:
        length = lambda s: max(1, int(round(s * rate)))
        size, hop, tail = length(seconds), length(seconds * hop_share), length(seconds * 0.25)
        last = max(0, -(-(n - size) // hop))
        if last and n - last * hop < tail:
            last -= 1
        return [(k * hop, n if k == last else min(k * hop + size, n)) for k in range(last + 1)] if n else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _CHUNK.split(", ")]
        kinds = (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.list_(pa.float32()), pa.string())
        for b in batches:
            for at, (path, raw) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                try:
                    x, rate = decode(raw.as_py() or b"", path, target_rate)
                    rows = [(path, i, s / rate, e / rate, rate, x[s:e], None) for i, (s, e) in enumerate(plan(len(x), rate))]
                except Exception as e:  # noqa: BLE001
                    rows = [(path, None, None, None, None, None, str(e)[:200])]
                if rows:
                    own = [c.take(pa.array([at] * len(rows))) for c in b.columns[2:]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows), kinds)), *own], names=[*names, *keep])

    kept = [f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep]
    return files.select("path", "content", *keep).mapInArrow(run, ", ".join([_CHUNK, *kept]))


_CHANNEL = "path string, channel int, rate int, samples array<float>, error string"


def decode_channels(files: DataFrame, target_rate: int | None = None) -> DataFrame:
    """Samples of ``files`` (path, content) by channel, from 0 on; errors as rows without samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _CHANNEL.split(", ")]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.string())
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    x, rate = decode(raw.as_py() or b"", path, target_rate, mono=False)
                    rows = [(path, c, rate, np.ascontiguousarray(x[:, c]), None) for c in range(x.shape[1])]
                except Exception as e:  # noqa: BLE001
                    rows = [(path, None, None, None, str(e)[:200])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return files.select("path", "content").mapInArrow(run, _CHANNEL)


def read_contents(spark: SparkSession, root: str) -> DataFrame:
    """path and content of the audio files below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    own = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*AUDIO_EXTENSIONS)
    plain = F.url_decode(F.regexp_replace(F.regexp_replace("path", r"\+", "%2B"), "^file:/+", "/"))
    return f.where(own).select(plain.alias("path"), "content")


def same_plan(stored: DataFrame, planned: DataFrame) -> DataFrame:
    """Per track: do the stored chunks equal the planned ones (number, places, spans to 1e-6)?"""
    s = stored.select("track_id", "idx", F.col("start_sec").alias("a"), F.col("end_sec").alias("b"))
    p = planned.select("track_id", "idx", F.col("start_sec").alias("c"), F.col("end_sec").alias("d"))
    fit = (F.abs(F.col("a") - F.col("c")) <= 1e-6) & (F.abs(F.col("b") - F.col("d")) <= 1e-6)
    both = s.join(p, ["track_id", "idx"], "full")
    return both.groupBy("track_id").agg(F.bool_and(F.coalesce(fit, F.lit(False))).alias("same"))


__all__ = ["changed", "check_read_access", "decode", "decode_channels", "decode_chunks", "decode_wav", "find_files", "listing", "probe", "probe_file", "probe_files", "read_contents", "resampled", "same_plan"]
