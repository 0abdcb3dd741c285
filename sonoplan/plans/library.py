"""A library: its relations as DataFrames, read from a table folder or mapped from test tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import SCHEMAS


@dataclass
class Library:
    """Relations by name. ``vectors`` has chunk_id, model, v (array<double>); see schema.SCHEMAS."""

    tracks: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    tags: DataFrame | None = None
    centroids: DataFrame | None = None
    pairs: DataFrame | None = None
    weights: DataFrame | None = None
    noise: DataFrame | None = None
    playlists: DataFrame | None = None
    playlist_items: DataFrame | None = None
    reduced: DataFrame | None = None

    @classmethod
    def of(cls, tables: dict[str, DataFrame]) -> Library:
        """The relations of ``tables`` that searches read."""
        return cls(**{f.name: tables[f.name] for f in fields(cls) if f.name in tables})

    def track_vectors(self) -> DataFrame:
        """track_id, chunk_id, idx, model, v; vectors whose chunk is gone drop out."""
        return self.vectors.join(self.chunks.select("chunk_id", "track_id", "idx"), "chunk_id")

    @property
    def spark(self) -> SparkSession:
        return self.tracks.sparkSession

    @classmethod
    def read(cls, spark: SparkSession, root: str) -> Library:
        """From a folder with one Parquet table per relation, or a ``Store``'s; absent ones are empty."""
        from ..sources.store import Store

        log = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_log")
        if log.getFileSystem(spark._jsc.hadoopConfiguration()).exists(log):
            return cls.of(Store(spark, root).tables())
        names = {"pairs": "learning_pairs", "weights": "learning_weights", "noise": "noise_chunks", "reduced": "reduced_vectors"}

        def one(field: str) -> DataFrame:
            name = names.get(field, field)
            try:
                df = spark.read.option("mergeSchema", "true").parquet(f"{root}/{name}")
            except Exception as e:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                    raise
                df = spark.createDataFrame([], SCHEMAS[name])
            return df.withColumn("v", F.col("vector").cast("array<double>")).drop("vector") if "vector" in df.columns else df

        return cls(**{f.name: one(f.name) for f in fields(cls)})


def from_tables(spark: SparkSession, sf_dir: str) -> Library:
    """The driver's tables seen as a library.

    Vectors of 64 components are model ``full``, their halves are ``lo`` and ``hi`` (``hi``
    lacks every fifth chunk); a label is a track, parts give its metadata, events its tags,
    orders and line items playlists. Noise flags, pairs and weights follow from ids.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    e = read("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("bigint").alias("track_id"), F.col("embedding").cast("array<double>").alias("v"))
    order = W.partitionBy("track_id").orderBy("chunk_id")
    chunks = e.select("chunk_id", "track_id", (F.row_number().over(order) - 1).alias("idx"))
    chunks = chunks.select("*", (F.col("idx") * 10.0).alias("start_sec"), (F.col("idx") * 10.0 + 20).alias("end_sec"))
    model = lambda name, v: (F.lit(name).alias("model"), v.alias("v"))
    vectors = (
        e.select("chunk_id", *model("full", F.col("v")))
        .unionByName(e.select("chunk_id", *model("lo", F.slice("v", 1, 32))))
        .unionByName(e.where("chunk_id % 5 != 0").select("chunk_id", *model("hi", F.slice("v", 33, 32))))
    )
    p = read("part").withColumn("track_id", F.col("p_partkey") - 1)
    ext = F.when(F.col("track_id") % 11 == 0, "wav").when(F.col("track_id") % 2 == 0, "mp3").otherwise("flac")
    p = p.withColumn("extension", ext).withColumn("filename", F.concat(F.col("track_id").cast("string"), F.lit("."), "extension"))
    tracks = p.select(
        "track_id", (F.col("track_id") % 5).alias("folder_id"),
        F.concat(F.lit("/music/"), F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("/"), "filename").alias("path"), "filename", "extension",
        F.col("p_brand").alias("artist"), F.when(F.col("track_id") % 13 != 0, F.col("p_name")).alias("title"),
        F.when(F.col("track_id") % 17 != 0, F.col("p_size") * 60.0 + 0.5).alias("duration_sec"), (F.col("p_retailprice") * 1000).cast("bigint").alias("size_bytes"),
        F.when(F.col("track_id") % 3 == 0, "analyzed").when(F.col("track_id") % 7 == 0, "error").otherwise("new").alias("status"),
        F.when(F.col("track_id") % 7 == 0, F.concat(F.lit("clap failed: out of memory; "), "p_brand", F.lit(" unavailable;; done"))).alias("status_message"),
    )
    newest = W.partitionBy("user_id", F.col("event_id") % 2, "event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    tags = read("events").withColumn("r", F.row_number().over(newest)).where("r = 1").select(
        F.col("user_id").alias("chunk_id"), F.when(F.col("event_id") % 2 == 0, "clap").otherwise("muqlan").alias("model"), F.col("event_type").alias("text"), F.col("value").alias("score")
    )
    flags = [("full", "hdbscan", 7), ("full", "optics", 11), ("lo", "hdbscan", 13)]
    noise = None
    for dataset, method, k in flags:
        part = e.where(F.col("chunk_id") % k == 0).select(F.lit(dataset).alias("dataset"), F.lit(method).alias("method"), "chunk_id")
        noise = part if noise is None else noise.unionByName(part)
    pairs = spark.createDataFrame([(1, 0, 1), (2, 2, 3), (3, 4, 5), (4, 3, 2), (5, 6, 6)], "pair_id bigint, track_a bigint, track_b bigint")
    weights = spark.range(64).select(F.lit("full").alias("model"), F.col("id").cast("int").alias("component_index"), F.when(F.col("id") % 4 == 0, 4.0).otherwise(0.0).alias("weight"))
    o = read("orders")
    playlists = o.select(F.col("o_orderkey").alias("playlist_id"), F.concat(F.lit("Mix "), "o_orderpriority", F.lit(" / "), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("seed_track_id"), F.lit("full").alias("method"))
    li = read("lineitem")
    items = li.select(F.col("l_orderkey").alias("playlist_id"), (F.col("l_partkey") - 1).alias("track_id"), F.col("l_linenumber").alias("position"), (1 / F.col("l_linenumber")).alias("similarity"))
    reduced = e.where("chunk_id % 4 != 0").select(F.lit(1).cast("bigint").alias("reduction_id"), "chunk_id", F.slice("v", 1, 3).alias("v"))
    reduced = reduced.unionByName(spark.range(3).select(F.lit(1).cast("bigint").alias("reduction_id"), (F.col("id") + 1_000_000_000).alias("chunk_id"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("v")))
    return Library(tracks, chunks, vectors, tags, None, pairs, weights, noise, playlists, items, reduced)


#: The same mapping for DuckDB: a WITH list that oracle SQL continues.
DUCK_TABLES = """
WITH e AS (SELECT vec_id AS chunk_id, label::BIGINT AS track_id, embedding::DOUBLE[] AS v FROM embeddings),
chunks AS (SELECT *, idx * 10.0::DOUBLE AS start_sec, idx * 10.0::DOUBLE + 20 AS end_sec FROM (SELECT chunk_id, track_id, (row_number() OVER (PARTITION BY track_id ORDER BY chunk_id) - 1)::INT AS idx FROM e)),
vectors AS (SELECT chunk_id, 'full' AS model, v FROM e UNION ALL SELECT chunk_id, 'lo', v[1:32] FROM e UNION ALL SELECT chunk_id, 'hi', v[33:64] FROM e WHERE chunk_id % 5 <> 0),
tv AS (SELECT c.track_id, c.chunk_id, c.idx, x.model, x.v FROM vectors x JOIN chunks c USING (chunk_id)),
tracks AS (SELECT track_id, track_id % 5 AS folder_id, '/music/' || replace(p_type, ' ', '/') || '/' || track_id || '.' || extension AS path, track_id || '.' || extension AS filename, extension, p_brand AS artist,
 CASE WHEN track_id % 13 <> 0 THEN p_name END AS title, CASE WHEN track_id % 17 <> 0 THEN p_size * 60.0::DOUBLE + 0.5 END AS duration_sec, trunc(p_retailprice * 1000)::BIGINT AS size_bytes,
 CASE WHEN track_id % 3 = 0 THEN 'analyzed' WHEN track_id % 7 = 0 THEN 'error' ELSE 'new' END AS status,
 CASE WHEN track_id % 7 = 0 THEN 'clap failed: out of memory; ' || p_brand || ' unavailable;; done' END AS status_message
 FROM (SELECT *, p_partkey - 1 AS track_id, CASE WHEN (p_partkey - 1) % 11 = 0 THEN 'wav' WHEN (p_partkey - 1) % 2 = 0 THEN 'mp3' ELSE 'flac' END AS extension FROM part)),
tags AS (SELECT user_id AS chunk_id, CASE WHEN event_id % 2 = 0 THEN 'clap' ELSE 'muqlan' END AS model, event_type AS text, value AS score FROM events
 QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 2, event_type ORDER BY ts DESC, event_id DESC) = 1),
noise AS (SELECT d AS dataset, m AS method, chunk_id FROM e, (VALUES ('full', 'hdbscan', 7), ('full', 'optics', 11), ('lo', 'hdbscan', 13)) f(d, m, k) WHERE chunk_id % k = 0),
pairs AS (SELECT * FROM (VALUES (1::BIGINT, 0::BIGINT, 1::BIGINT), (2, 2, 3), (3, 4, 5), (4, 3, 2), (5, 6, 6)) p(pair_id, track_a, track_b)),
weights AS (SELECT 'full' AS model, i::INT AS component_index, CASE WHEN i % 4 = 0 THEN 4.0 ELSE 0.0 END::DOUBLE AS weight FROM range(64) r(i)),
playlists AS (SELECT o_orderkey AS playlist_id, 'Mix ' || o_orderpriority || ' / ' || o_orderkey AS name, o_orderdate AS created_at, o_custkey AS seed_track_id, 'full' AS method FROM orders),
items AS (SELECT l_orderkey AS playlist_id, l_partkey - 1 AS track_id, l_linenumber AS position, 1.0::DOUBLE / l_linenumber AS similarity FROM lineitem),
reduced AS (SELECT 1::BIGINT AS reduction_id, chunk_id, v[1:3] AS v FROM e WHERE chunk_id % 4 <> 0 UNION ALL SELECT 1, 1000000000 + i, [1.0, 2.0, 3.0]::DOUBLE[] FROM range(3) r(i)),
cm AS (SELECT track_id, model, pos, avg(x) AS x FROM (SELECT track_id, model, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM tv) GROUP BY track_id, model, pos),
cn AS (SELECT track_id, model, list(x ORDER BY pos) AS m, sqrt(sum(x * x)) AS norm FROM cm GROUP BY track_id, model),
centroids AS (SELECT track_id, model, CASE WHEN norm > 0 THEN list_transform(m, lambda x: x / norm) ELSE list_transform(m, lambda x: 0.0) END AS v FROM cn)
"""
