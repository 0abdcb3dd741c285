"""Named queries over files, which are rendered from the test tables, and over the table store."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import plugins
from ..operators import jobs, reads
from ..schema import SCHEMAS
from ..sources import audio, datasource
from ..sources.store import Store
from .queries import _SERIES, RATE, _waves, query, r, series

KINDS = ("wav", "aiff", "au", "flac", "ogg", "mp3")


def _chunk(name: bytes, body: bytes, order: str = ">") -> bytes:
    return name + struct.pack(f"{order}I", len(body)) + body + b"\0" * (len(body) % 2)


def render(kind: str, x: np.ndarray) -> bytes:
    """A file of values in [-1, 1]: wav (24 bits, stereo, the other channel negative), aiff (16 bits, stereo)
    and au (32-bit floats) with samples; flac, ogg and mp3 as headers alone."""
    n, both = len(x), np.stack([x, -x], 1)
    rate80 = struct.pack(">HQ", 16383 + 15, RATE << 48)
    if kind == "wav":
        whole = np.trunc(both * 8388607).astype("<i4").view(np.uint8).reshape(n, 2, 4)[..., :3].tobytes()
        body = b"WAVE" + _chunk(b"fmt ", struct.pack("<HHIIHH", 1, 2, RATE, RATE * 6, 6, 24), "<") + _chunk(b"data", whole, "<")
        return b"RIFF" + struct.pack("<I", len(body)) + body
    if kind == "aiff":
        body = b"AIFF" + _chunk(b"COMM", struct.pack(">hIh", 2, n, 16) + rate80) + _chunk(b"SSND", bytes(8) + np.trunc(both * 32767).astype(">i2").tobytes())
        return b"FORM" + struct.pack(">I", len(body)) + body
    if kind == "au":
        return struct.pack(">4sIIIII", b".snd", 24, 4 * n, 6, RATE, 1) + x.astype(">f4").tobytes()
    if kind == "flac":
        return b"fLaC\x80\0\0\x22" + bytes(10) + (RATE << 44 | 1 << 41 | 23 << 36 | n).to_bytes(8, "big") + bytes(16)
    if kind == "ogg":
        page = lambda granule, packet: b"OggS" + struct.pack("<BBqIIIB", 0, 2, granule, 5, 0, 0, 1) + bytes([len(packet)]) + packet
        return page(0, b"OpusHead" + struct.pack("<BBHIhB", 1, 2, 312, 44100, 0, 0)) + page(n + 312, bytes(40))
    head = b"\xff\xfb\x94\x00"  # layer III, 128 kbit/s, 48 kHz, stereo: frames of 384 bytes
    return (head + bytes(32) + b"Xing" + struct.pack(">III", 3, n, 384 * n)).ljust(384, b"\0") + head.ljust(384, b"\0")


def rendered(spark: SparkSession, d: str) -> DataFrame:
    """path, content: a file per user, by turns of the id of the kinds above."""

    @F.pandas_udf("binary")
    def draw(user: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([render(KINDS[u % len(KINDS)], np.clip(np.asarray(v) / 100, -1, 1)) for u, v in zip(user, x)])

    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("user_id") % len(KINDS) + 1).cast("int"))
    return series(spark, d).select(F.concat(F.lit("/files/"), F.col("user_id").cast("string"), F.lit("."), kind).alias("path"), draw("user_id", "x").alias("content"))


_KIND = _SERIES + """, k AS (SELECT user_id, x, len(x) AS n, ['wav', 'aiff', 'au', 'flac', 'ogg', 'mp3'][user_id % 6 + 1] AS kind FROM s)"""
_PROBE = """ AS path, kind AS container, CASE kind WHEN 'au' THEN 'float' WHEN 'flac' THEN 'flac' WHEN 'ogg' THEN 'opus' WHEN 'mp3' THEN 'mp3' ELSE 'pcm' END AS codec, 48000 AS sample_rate, CASE kind WHEN 'au' THEN 1 ELSE 2 END AS channels,
 CASE kind WHEN 'wav' THEN 24 WHEN 'aiff' THEN 16 WHEN 'au' THEN 32 WHEN 'flac' THEN 24 END AS bit_depth, round(CASE kind WHEN 'wav' THEN 2304 WHEN 'aiff' THEN 1536 WHEN 'au' THEN 1536 WHEN 'flac' THEN 42 * 8 * 48.0::DOUBLE / n WHEN 'ogg' THEN 115 * 8 * 48.0::DOUBLE / n ELSE 128 END, 6)::DOUBLE AS bitrate_kbps,
 round(CASE kind WHEN 'mp3' THEN n * 1152 / 48000.0::DOUBLE ELSE n / 48000.0::DOUBLE END, 9) AS duration_sec, NULL::VARCHAR AS error FROM k"""


def _near(df: DataFrame) -> DataFrame:
    return df.withColumn("bitrate_kbps", r("bitrate_kbps")).withColumn("duration_sec", F.round("duration_sec", 9))


@query(_KIND + " SELECT '/files/' || user_id || '.' || kind" + _PROBE)
def q_probe_containers(lib, spark, d):
    """Six containers by their headers alone, without a tool."""
    return _near(audio.probe_files(rendered(spark, d)))


@query(_KIND + """, y AS (SELECT user_id, kind, n, greatest(-1, least(1, unnest(x) / 100)) AS v FROM k WHERE kind IN ('wav', 'aiff', 'au')),
t AS (SELECT user_id, kind, any_value(n) AS n, sum(CASE kind WHEN 'wav' THEN (trunc(v * 8388607) / 8388608)::FLOAT::DOUBLE WHEN 'aiff' THEN (trunc(v * 32767) / 32768)::FLOAT::DOUBLE ELSE v::FLOAT::DOUBLE END) AS total FROM y GROUP BY user_id, kind)
SELECT '/files/' || user_id || '.' || kind AS path, c AS channel, 48000 AS rate, n::INT AS n, round(CASE c WHEN 0 THEN total ELSE -total END, 6) + 0.0 AS total FROM t, (VALUES (0), (1)) v(c) WHERE c = 0 OR kind <> 'au'""")
def q_decode_channels(lib, spark, d):
    """24-bit, big-endian and float samples, channel by channel."""
    c = audio.decode_channels(rendered(spark, d).where(F.regexp_extract("path", r"([a-z]+)$", 1).isin("wav", "aiff", "au")))
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return c.select("path", "channel", "rate", F.size("samples").alias("n"), r(total).alias("total"))


def _scratch(spark: SparkSession) -> str:
    """A fresh folder among those that all executors share; a local one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{named or '/tmp/sonoplan'}/files-{uuid.uuid4().hex}"


@query(_KIND + " SELECT user_id || '.' || kind" + _PROBE.replace("FROM k", "FROM k WHERE kind IN ('wav', 'flac', 'mp3')"))
def q_audio_source(lib, spark, d):
    """The same files written to a folder, and read by ``format("audio")``: of the extensions that it knows."""
    root = _scratch(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, top = datasource.file_system(root)
        own.create_dir(top, recursive=True)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                with own.open_output_stream(f"{top}/{path.rpartition('/')[2]}") as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["path"])

    rendered(spark, d).mapInArrow(write, "path string").count()
    datasource.register(spark)
    found = spark.read.format("audio").option("partitionBytes", 4 << 20).schema(f"path string, {datasource.METADATA}").load(root)
    return _near(found.withColumn("path", F.regexp_extract("path", r"([^/]+)$", 1)))


@query("""SELECT chunk_id, model, text, CASE WHEN chunk_id % 3 = 0 THEN score + 1 ELSE score END AS score FROM tags WHERE model <> 'muqlan' OR chunk_id % 5 <> 0
UNION ALL SELECT DISTINCT 1000000000 + chunk_id, 'new', 'x', 0.5 FROM tags""")
def q_store_merge(lib, spark, d):
    """A table of the store after an upsert, a deletion by another key set and an append, read as merged parts."""
    store = Store(spark, _scratch(spark))
    tags = lib.tags.select("chunk_id", "model", "text", F.col("score").cast("double").alias("score"))
    store.write("tags", tags)
    store.merge("tags", tags.where("chunk_id % 3 = 0").withColumn("score", F.col("score") + 1), ["chunk_id", "model", "text"])
    with store.change() as change:
        change.merge("tags", None, ["chunk_id", "model"], change.read("tags").where("model = 'muqlan' AND chunk_id % 5 = 0"))
        change.merge("tags", tags.select((F.col("chunk_id") + 1_000_000_000).alias("chunk_id"), F.lit("new").alias("model"), F.lit("x").alias("text"), F.lit(0.5).alias("score")).distinct())
    return store.read("tags")


class _Moments(plugins.Windowed):
    """Mean, mean square and largest value of windows of 20 samples that share 6."""

    name, title, dim, sample_rate, window_sec, overlap_sec, batch = "moments", "Moments", 3, RATE, 20.5 / RATE, 6.5 / RATE, 7

    def _embed_windows(self, windows, rate):
        return np.array([[w.mean(dtype=np.float64), np.square(w.astype(np.float64)).mean(), w.max()] for w in windows])


@query(_SERIES + """, w AS (SELECT user_id, x, len(x) AS n, 20 AS size, 14 AS step, (len(x) - 20) // 14 AS k FROM s),
v AS (SELECT *, k * step AS last, n - size AS tail, CASE WHEN n <= size THEN [0] ELSE range(0, k * step + 1, step) END AS plain FROM w),
u AS (SELECT user_id, x, unnest(CASE WHEN n <= size OR tail <= last THEN plain WHEN tail - last >= 5 THEN list_append(plain, tail) ELSE list_append(plain[1:len(plain) - 1], tail) END)::BIGINT AS start FROM v),
p AS (SELECT user_id, start, unnest(x[start + 1:start + 20])::FLOAT::DOUBLE AS y FROM u),
f AS (SELECT user_id, avg(y) AS a, avg(y * y) AS b, max(y) AS c FROM p GROUP BY user_id, start),
m AS (SELECT user_id, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM f GROUP BY user_id)
SELECT user_id AS chunk_id, 'moments' AS model, unnest([0, 1, 2]) AS pos, round(unnest([a, b, c]) / sqrt(a * a + b * b + c * c), 6) + 0.0 AS x FROM m""")
def q_window_pooling(lib, spark, d):
    """Windows through a model in mixed batches, their mean per chunk at unit length."""
    samples = series(spark, d).select(F.col("user_id").alias("chunk_id"), F.lit(RATE).alias("rate"), F.col("x").cast("array<float>").alias("samples"))
    v = plugins.embed_chunks(samples, _Moments())
    return v.select("chunk_id", "model", F.posexplode("v").alias("pos", "x")).withColumn("x", r("x"))


@query("SELECT chunk_id, track_id, row_number() OVER (ORDER BY chunk_id) - 1 AS place FROM chunks")
def q_numbered(lib, spark, d):
    """Places of all chunks in the order of ids, without one task for all."""
    return reads.numbered(lib.chunks.select("chunk_id", "track_id"), "chunk_id", "place").select("chunk_id", "track_id", F.col("place").cast("bigint").alias("place"))


class _Levels(plugins.Plugin):
    """Mean, mean square and largest value of a chunk."""

    name, title, dim = "levels", "Levels", 3

    def _embed(self, chunks, rate):
        return [np.array([c.mean(dtype=np.float64), np.square(c.astype(np.float64)).mean(), c.max()]) for c in chunks]


@query(_SERIES + """, w AS (SELECT user_id, x, len(x) AS n, greatest(0, ceil((len(x) - 32) / 16.0)::BIGINT) AS l FROM s),
c AS (SELECT user_id, x, n, CASE WHEN l > 0 AND n - l * 16 < 8 THEN l - 1 ELSE l END AS last FROM w),
k AS (SELECT user_id, x, n, last, unnest(range(0, last + 1)) AS idx FROM c),
p AS (SELECT user_id, idx, unnest(x[idx * 16 + 1:CASE WHEN idx = last THEN n ELSE least(idx * 16 + 32, n) END]) AS v FROM k),
y AS (SELECT user_id, idx, (trunc(greatest(-1, least(1, v / 100)) * 32767) / 32768)::FLOAT::DOUBLE AS y FROM p),
f AS (SELECT user_id, idx, avg(y) AS a, avg(y * y) AS b, max(y) AS c FROM y GROUP BY user_id, idx)
SELECT user_id::BIGINT AS track_id, 'analyzed' AS status, NULL AS status_message, idx::INT AS idx, unnest([0, 1, 2]) AS pos, round(unnest([a, b, c])::FLOAT::DOUBLE, 6) + 0.0 AS x FROM f
UNION ALL SELECT -1, 'error', 'Decode failed', NULL, NULL, NULL""")
def q_analyze_job(lib, spark, d):
    """The analysis job over a rendered file per user and a broken one, as stored: chunks, vectors (floats of 4 bytes), status."""
    waves = _waves(spark, d).withColumn("track_id", F.regexp_extract("path", r"([0-9]+)\.wav$", 1).cast("bigint"))
    broken = spark.range(1).select(F.lit("/waves/broken.wav").alias("path"), F.lit(b"RIFFbroken").alias("content"), F.lit(-1).cast("bigint").alias("track_id"))
    files = waves.unionByName(broken).withColumn("mtime", F.lit(1.0)).withColumn("size", F.length("content").cast("bigint"))
    store = Store(spark, _scratch(spark))
    blank = lambda f: F.lit("new" if f.name == "status" else None).cast(f.dataType)
    store.write("tracks", files.select(*[F.col(f.name) if f.name in ("track_id", "path") else blank(f).alias(f.name) for f in SCHEMAS["tracks"]]))
    plugins.register("levels", _Levels)
    try:
        jobs.analyze_into(store, files, ["levels"], 32 / RATE, 50.0)
    finally:
        plugins.unregister("levels")
    out = store.tables()
    x = out["vectors"].join(out["chunks"], "chunk_id").select("track_id", "idx", F.posexplode("v").alias("pos", "x"))
    message = F.regexp_extract("status_message", "^[^:]*", 0)
    return out["tracks"].select("track_id", "status", message.alias("status_message")).join(x, "track_id", "left").withColumn("x", r("x"))
