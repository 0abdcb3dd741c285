"""Named queries over the test tables, and the SQL that must give the same rows in DuckDB."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import plugins
from ..functions import scalars, signal, vectors
from ..operators import changes, derive, jobs, nearest, noise, reads, similarity
from ..schema import SCHEMAS
from ..sources import audio, playlists, store, text
from .library import DUCK_TABLES, Library, from_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SEED = 1
DIGITS = 6


def r(x: Column | str) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, DIGITS) + 0.0


def query(oracle: str | None = None, name: str | None = None):
    """Registers a function of (library, spark, sf_dir); ``oracle`` goes on after the table mapping."""

    def add(f):
        key = name or f.__name__.removeprefix("q_")
        QUERIES[key] = lambda spark, d: f(from_tables(spark, d), spark, d)
        if oracle is not None:
            ORACLE_SQL[key] = DUCK_TABLES + oracle
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def long(df: DataFrame, v: str, *keys: str) -> DataFrame:
    """An array column as rows (pos from 0, x rounded)."""
    return df.select(*keys, F.posexplode(v).alias("pos", "x")).select(*keys, "pos", r("x").alias("x"))


# --- lookups, filters, listings ----------------------------------------------------------


@query("SELECT * FROM tracks WHERE track_id = 7")
def q_track_lookup(lib, spark, d):
    return reads.get_track(lib, 7)


@query("SELECT track_id, path, status FROM tracks WHERE folder_id = 3 ORDER BY path")
def q_track_listing(lib, spark, d):
    return reads.list_tracks(lib, 3).select("track_id", "path", "status")


@query("SELECT chunk_id, track_id, idx, start_sec, end_sec FROM chunks WHERE track_id IN (1, 4, 6)")
def q_chunks_for_tracks(lib, spark, d):
    return reads.chunks_for_tracks(lib, [1, 4, 6])


@query("SELECT chunk_id, model, text, score FROM tags WHERE chunk_id = 8")
def q_chunk_tags_ranked(lib, spark, d):
    return reads.chunk_tags(lib, 8)


_TEXTS = """, texts AS (SELECT track_id, 'ollama:' || substr(artist, 1, 8) AS model FROM tracks)
SELECT DISTINCT model FROM texts WHERE track_id = 5 AND starts_with(model, 'ollama:')"""


@query(_TEXTS)
def q_text_datasets_of_seed(lib, spark, d):
    named = lib.tracks.select("track_id", F.concat(F.lit("ollama:"), F.substring("artist", 1, 8)).alias("model"))
    return reads.text_datasets_of(named, 5)


@query("""SELECT b.track_id, count(*) AS n FROM tv a JOIN tv b ON len(a.v) = len(b.v) WHERE a.track_id = 1 AND a.model = 'lo' AND a.idx = 0 AND b.track_id <> 1 GROUP BY b.track_id""")
def q_dim_mismatch(lib, spark, d):
    tv = lib.track_vectors()
    one = F.broadcast(tv.where("track_id = 1 AND model = 'lo' AND idx = 0").select(F.size("v").alias("dim")))
    return tv.where("track_id != 1").join(one, F.size("v") == F.col("dim")).groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))


_COVER = """, total AS (SELECT track_id, count(*) AS total FROM chunks GROUP BY track_id), have AS (SELECT track_id, model, count(DISTINCT chunk_id) AS n FROM tv WHERE model IN ('full', 'lo') GROUP BY ALL),
full_ AS (SELECT track_id FROM have JOIN total USING (track_id) WHERE n >= total GROUP BY track_id HAVING count(*) = 2)
SELECT t.track_id, CASE WHEN extension = 'wav' THEN 'wav' WHEN status = 'analyzed' AND f.track_id IS NOT NULL THEN 'done' WHEN coalesce(duration_sec > 1200, false) THEN 'long' ELSE 'start' END AS decision
FROM tracks t LEFT JOIN full_ f ON t.track_id = f.track_id"""


@query(_COVER)
def q_analysis_worklist(lib, spark, d):
    return reads.analysis_worklist(lib, ["full", "lo"])


_PATHS = """, p AS (SELECT list_filter(string_split(path, '/'), lambda x: x <> '') AS names FROM tracks),
n AS (SELECT names, unnest(range(1, len(names) + 1)) AS depth FROM p)
SELECT DISTINCT '/' || array_to_string(names[1:depth], '/') AS path, depth = len(names) AS is_file FROM n WHERE len(list_filter(names, lambda x: contains(lower(x), 'tin'))) > 0"""


@query(_PATHS)
def q_path_filter(lib, spark, d):
    return reads.path_filter(lib.tracks, "TIN")


@query("SELECT track_id, path FROM tracks WHERE starts_with(path, '/music/PROMO/')")
def q_folder_refs(lib, spark, d):
    return reads.folder_references(lib.tracks, "/music/PROMO", most=None).select("track_id", "path")


# --- joins -------------------------------------------------------------------------------


@query(f"SELECT chunk_id, track_id, model, idx, path, len(v)::INT AS dim, round(list_sum(v), {DIGITS}) + 0.0 AS total FROM tv JOIN tracks USING (track_id) WHERE model IN ('lo', 'hi')")
def q_chunk_vector_rows(lib, spark, d):
    rows = reads.vector_rows(lib, ["lo", "hi"])
    return rows.select("chunk_id", "track_id", "model", "idx", "path", F.size("v").alias("dim"), r(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("SELECT DISTINCT track_id, model FROM tv")
def q_track_models(lib, spark, d):
    return reads.track_models(lib)


@query("SELECT chunk_id, model, text, score, idx FROM tags JOIN chunks USING (chunk_id) WHERE track_id = 2")
def q_track_tags(lib, spark, d):
    return reads.track_tags(lib, 2)


@query(f"SELECT chunk_id, track_id, (generate_subscripts(v, 1) - 1)::INT AS pos, round(unnest(v), {DIGITS}) + 0.0 AS x FROM reduced JOIN chunks USING (chunk_id) WHERE reduction_id = 1")
def q_reduced_vectors(lib, spark, d):
    return long(reads.reduced_rows(lib, 1), "v", "chunk_id", "track_id")


@query("SELECT playlist_id, position, track_id, path, title, similarity FROM items JOIN tracks USING (track_id)")
def q_playlist_items(lib, spark, d):
    return reads.playlist_rows(lib).select("playlist_id", "position", "track_id", "path", "title", "similarity")


@query("SELECT pair_id, track_a, track_b, a.path AS path_a, b.path AS path_b FROM pairs JOIN tracks a ON a.track_id = track_a JOIN tracks b ON b.track_id = track_b")
def q_pair_listing(lib, spark, d):
    return reads.pair_rows(lib).select("pair_id", "track_a", "track_b", "path_a", "path_b")


@query("SELECT DISTINCT b.track_id FROM tv a JOIN tv b USING (model) WHERE a.track_id = 1 AND b.track_id <> 1")
def q_candidates_auto(lib, spark, d):
    return reads.sharing_candidates(lib, SEED)


@query("SELECT DISTINCT track_id FROM tv WHERE model = 'hi' AND track_id <> 1")
def q_candidates_dataset(lib, spark, d):
    return reads.dataset_candidates(lib, SEED, "hi")


@query("SELECT chunk_id, track_id, model FROM tv WHERE model = 'full' AND chunk_id NOT IN (SELECT chunk_id FROM noise WHERE dataset = 'full')")
def q_noise_antijoin(lib, spark, d):
    flags = reads.noise_union(lib.noise, "full", ["hdbscan", "optics"])
    return reads.without_noise(lib.track_vectors().where("model = 'full'"), flags).select("chunk_id", "track_id", "model")


@query(f"SELECT a.chunk_id, c.track_id, round(a.v[3], {DIGITS}) + 0.0 AS x, round(b.v[5], {DIGITS}) + 0.0 AS y FROM vectors a JOIN vectors b USING (chunk_id) JOIN chunks c USING (chunk_id) WHERE a.model = 'lo' AND b.model = 'hi'")
def q_cross_model_points(lib, spark, d):
    return reads.cross_model_points(lib, "lo", 2, "hi", 4).select("chunk_id", "track_id", r("x").alias("x"), r("y").alias("y"))


@query(f"SELECT chunk_id, (generate_subscripts(v, 1) - 1)::INT AS pos, round(unnest(v), {DIGITS}) + 0.0 AS x FROM (SELECT a.chunk_id, list_concat(a.v, b.v) AS v FROM vectors a JOIN vectors b USING (chunk_id) WHERE a.model = 'hi' AND b.model = 'lo')")
def q_hstack_models(lib, spark, d):
    return long(reads.joint_vectors(lib, ["lo", "hi"]), "v", "chunk_id")


@query("SELECT track_id, path FROM tracks WHERE folder_id = 2 AND track_id % 4 = 0")
def q_prune_missing(lib, spark, d):
    return changes.missing(lib.tracks, lib.tracks.where("track_id % 4 != 0"), 2).select("track_id", "path")


_PEND = """, now AS (SELECT track_id, count(*) AS n, sum(chunk_id) AS s FROM tv WHERE model = 'full' GROUP BY track_id)
SELECT track_id FROM now WHERE track_id % 3 <> 0 AND n >= 6"""


@query(_PEND)
def q_noise_pending(lib, spark, d):
    now = reads.signatures(lib.track_vectors().where("model = 'full'"))
    stored = now.where("track_id % 3 != 1").withColumn("vector_sum", F.when(F.col("track_id") % 3 == 2, F.col("vector_sum") + 1).otherwise(F.col("vector_sum")))
    return reads.pending_tracks(stored, now)


@query("""SELECT chunk_id FROM noise WHERE dataset = 'full' AND method = 'hdbscan' AND chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE track_id = 2)
UNION SELECT chunk_id FROM chunks WHERE track_id = 2 AND idx % 9 = 0""")
def q_noise_merge(lib, spark, d):
    kept = lib.noise.where("dataset = 'full' AND method = 'hdbscan'")
    own = lib.chunks.where("track_id = 2")
    return reads.merge_flags(kept, own, own.where("idx % 9 = 0"))


# --- counts ------------------------------------------------------------------------------


@query("SELECT track_id, model, count(*) AS n FROM tv GROUP BY ALL")
def q_model_counts(lib, spark, d):
    return reads.model_counts(lib)


@query("SELECT track_id, model, count(*) AS n FROM tv WHERE track_id = 3 GROUP BY ALL")
def q_track_model_counts(lib, spark, d):
    return reads.model_counts(lib, 3)


@query("SELECT model, count(*) AS n FROM vectors GROUP BY model")
def q_vector_counts(lib, spark, d):
    return reads.vector_counts(lib)


_COVERAGE = """, total AS (SELECT track_id, count(*) AS n_chunks FROM chunks GROUP BY track_id), cov AS (SELECT track_id, model, count(DISTINCT chunk_id) AS covered FROM tv GROUP BY ALL)"""


@query(_COVERAGE + " SELECT track_id, model, covered, n_chunks FROM cov JOIN total USING (track_id)")
def q_coverage(lib, spark, d):
    return reads.coverage(lib)


@query(_COVERAGE + " SELECT track_id, min(model) AS model FROM cov JOIN total USING (track_id) WHERE covered = n_chunks GROUP BY track_id")
def q_fully_covered_models(lib, spark, d):
    return reads.fully_covered_models(lib)


@query("SELECT track_id, count(*) AS n_chunks, sum(chunk_id)::BIGINT AS chunk_sum FROM tv WHERE model = 'lo' GROUP BY track_id")
def q_noise_signatures(lib, spark, d):
    return reads.signatures(lib.track_vectors().where("model = 'lo'")).drop("vector_sum")


@query("SELECT model, count(DISTINCT track_id) AS n_tracks, count(DISTINCT track_id) >= 2 AS enabled FROM centroids GROUP BY model")
def q_dataset_picker(lib, spark, d):
    return reads.dataset_picker(similarity.centroids(lib.track_vectors()))


@query("SELECT DISTINCT model FROM vectors")
def q_distinct_models(lib, spark, d):
    return lib.vectors.select("model").distinct().orderBy("model")


@query("SELECT covered, current, covered < current AS stale FROM (SELECT (SELECT count(*) FROM reduced WHERE reduction_id = 1 AND chunk_id IN (SELECT chunk_id FROM e)) AS covered, (SELECT count(*) FROM vectors WHERE model = 'full') AS current)")
def q_reduction_staleness(lib, spark, d):
    return reads.reduction_staleness(lib, 1, "full")


@query("""SELECT track_id, 'Music tags: ' || string_agg(text, ', ' ORDER BY total DESC, text) AS description FROM (
 SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY total DESC, text) AS rn FROM (SELECT track_id, text, sum(score) AS total FROM tags JOIN chunks USING (chunk_id) GROUP BY ALL)) WHERE rn <= 8 GROUP BY track_id""")
def q_track_description(lib, spark, d):
    return reads.track_description(lib)


@query(f"SELECT track_id, model, (generate_subscripts(v, 1) - 1)::INT AS pos, round(unnest(v), {DIGITS}) + 0.0 AS x FROM centroids")
def q_centroids(lib, spark, d):
    return long(similarity.centroids(lib.track_vectors()), "v", "track_id", "model")


@query(f"SELECT (pos - 1)::INT AS pos, round(avg(x), {DIGITS}) + 0.0 AS mean, round(stddev_pop(x), {DIGITS}) + 0.0 AS std FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY pos")
def q_component_stats(lib, spark, d):
    return derive.component_stats(lib.vectors.where("model = 'full'")).select("pos", r("mean").alias("mean"), r("std").alias("std"))


_FOLDERS = """, t AS (SELECT track_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS names FROM tracks WHERE extension <> 'wav'),
f AS (SELECT track_id, '/' || array_to_string(names[1:k], '/') AS folder FROM (SELECT *, unnest(range(1, len(names))) AS k FROM t)),
m AS (SELECT DISTINCT track_id, model FROM tv)
SELECT folder, model, count(m.track_id) AS ready, count(*) AS total, round_even(count(m.track_id) / count(*) * 100, 0)::INT || '%' AS shown
FROM f CROSS JOIN (VALUES ('full'), ('hi'), ('clap')) x(model) LEFT JOIN m USING (track_id, model) GROUP BY folder, model"""


@query(_FOLDERS)
def q_folder_progress(lib, spark, d):
    return reads.folder_progress(lib, ["full", "hi", "clap"])


@query(f"SELECT round(sum(duration_sec) / 60 / (7200.0 / 3600), {DIGITS}) AS min_per_hour FROM tracks")
def q_throughput_rate(lib, spark, d):
    return reads.throughput(lib.tracks, 7200.0).select(r("min_per_hour").alias("min_per_hour"))


@query(f"SELECT dataset, method, count(DISTINCT chunk_id) AS n_noise, n_vectors, round(count(DISTINCT chunk_id) / greatest(1, n_vectors) * 100, {DIGITS}) AS share FROM noise JOIN (SELECT model AS dataset, count(*) AS n_vectors FROM vectors GROUP BY model) USING (dataset) GROUP BY dataset, method, n_vectors")
def q_noise_share(lib, spark, d):
    return reads.noise_share(lib).withColumn("share", r("share"))


@query(f"SELECT user_id, round(CASE WHEN min(value) > 0 THEN exp(avg(ln(CASE WHEN value > 0 THEN value ELSE 1 END))) ELSE 0 END, {DIGITS}) AS score FROM events GROUP BY user_id")
def q_geomean(lib, spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(r(scalars.geometric_mean("value")).alias("score"))


# --- ranks and sets ----------------------------------------------------------------------


@query("SELECT track_id, (row_number() OVER (ORDER BY first) - 1)::INT AS color FROM (SELECT track_id, min(chunk_id) AS first FROM chunks GROUP BY track_id)")
def q_track_colors(lib, spark, d):
    return reads.track_colors(lib.chunks.select("track_id", F.col("chunk_id").alias("pos")))


@query("""SELECT o_orderkey AS filter_id, o_orderpriority AS method, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'F'
 QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def q_latest_filter(lib, spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("filter_id"), F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("method"), F.col("o_orderdate").alias("created_at"))
    return reads.newest_runs(runs, "F").drop("dataset")


@query("""SELECT DISTINCT chunk_id FROM noise WHERE method IN ('hdbscan')""")
def q_noise_union(lib, spark, d):
    return reads.noise_union(lib.noise, "auto", ["hdbscan"])


@query("""SELECT pos, trim(tag) AS tag FROM (SELECT event_id AS pos, CASE WHEN event_id % 5 = 0 THEN '  ' WHEN event_id % 2 = 0 THEN upper(event_type) ELSE ' ' || event_type || ' ' END AS tag FROM events) WHERE trim(tag) <> ''
 QUALIFY row_number() OVER (PARTITION BY lower(trim(tag)) ORDER BY pos) = 1""")
def q_tag_dedupe(lib, spark, d):
    tag = F.when(F.col("event_id") % 5 == 0, "  ").when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.lit(" "), "event_type", F.lit(" ")))
    return reads.dedupe_tags(table(spark, d, "events").select(F.col("event_id").alias("pos"), tag.alias("tag")))


_RANK = """, w AS (SELECT 'full' AS model, (pos - 1)::INT AS component_index, round(avg(x), 6) AS weight FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY pos),
k AS (SELECT *, row_number() OVER (ORDER BY weight DESC, component_index) AS hi, row_number() OVER (ORDER BY weight, component_index DESC) AS lo FROM w)
SELECT model, component_index, weight + 0.0 AS weight, (CASE WHEN hi <= 3 THEN hi ELSE -lo END)::INT AS place FROM k WHERE hi <= 3 OR lo <= 3"""


@query(_RANK)
def q_weight_ranking(lib, spark, d):
    s = derive.component_stats(lib.vectors.where("model = 'full'"))
    return reads.weight_ranking(s.select(F.lit("full").alias("model"), F.col("pos").alias("component_index"), r("mean").alias("weight")))


@query("""SELECT name, is_file, row_number() OVER (ORDER BY is_file, lower(name), name)::INT AS place FROM (SELECT DISTINCT p_type AS name, false AS is_file FROM part UNION ALL SELECT DISTINCT p_brand, true FROM part)""")
def q_tree_order(lib, spark, d):
    p = table(spark, d, "part")
    nodes = p.select(F.col("p_type").alias("name"), F.lit(False).alias("is_file")).distinct().unionByName(p.select(F.col("p_brand").alias("name"), F.lit(True).alias("is_file")).distinct())
    return reads.tree_order(nodes).withColumn("place", F.row_number().over(W.orderBy("is_file", F.lower("name"), "name")))


@query("SELECT chunk_id, track_id FROM chunks ORDER BY md5(chunk_id::VARCHAR), chunk_id LIMIT 100")
def q_subsample(lib, spark, d):
    return reads.subsample(lib.chunks.select("chunk_id", "track_id"), 100)


@query(f"SELECT chunk_id AS id, round(sqrt(power(v[1] - 0.1, 2) + power(v[2] + 0.05, 2)), {DIGITS}) AS d FROM e ORDER BY d, id LIMIT 1")
def q_nearest_point(lib, spark, d):
    p = lib.vectors.where("model = 'full'").select(F.col("chunk_id").alias("id"), vectors.component("v", 0).alias("x"), vectors.component("v", 1).alias("y"))
    return reads.nearest_point(p, 0.1, -0.05, 10.0).select("id", r("d").alias("d"))


@query("""SELECT model FROM (SELECT model, list_position(['clap', 'full', 'lo'], model) AS place FROM tv GROUP BY model HAVING count(DISTINCT track_id) >= 2)
ORDER BY model NOT LIKE 'ollama:%', place NULLS LAST, model LIMIT 1""")
def q_resolve_dataset(lib, spark, d):
    have = reads.track_models(lib).select("track_id", "model")
    return spark.createDataFrame([(reads.resolve_dataset(have, ("clap", "full", "lo")),)], "model string")


_HAVE = """, have AS (SELECT DISTINCT track_id, model FROM tv WHERE model <> 'full' OR track_id % 3 <> 1 UNION SELECT track_id, 'ollama:' || (track_id % 2) FROM tv),
fit AS (SELECT s.track_id AS seed, h.model FROM (SELECT DISTINCT track_id FROM have) s, have h GROUP BY s.track_id, h.model HAVING bool_or(h.track_id = s.track_id) AND count(DISTINCT h.track_id) >= 2)
SELECT seed, model FROM fit QUALIFY row_number() OVER (PARTITION BY seed ORDER BY model NOT LIKE 'ollama:%' OR seed % 2 = 1, coalesce(list_position(['clap', 'full', 'lo'], model), 99), model) = 1"""


@query(_HAVE.replace("OR seed % 2 = 1", "") + " AND seed < 3 UNION ALL SELECT -seed, model FROM (SELECT * FROM fit WHERE model NOT LIKE 'ollama:%' QUALIFY row_number() OVER (PARTITION BY seed ORDER BY coalesce(list_position(['clap', 'full', 'lo'], model), 99), model) = 1) WHERE seed < 3 AND seed > 0")
def q_resolve_dataset_seed(lib, spark, d):
    """What auto means to a seed that has, or lacks, the first dataset; text datasets come first (ids
    over 0: all datasets; the same negated: without texts)."""
    plain = reads.track_models(lib).select("track_id", "model").where("model != 'full' OR track_id % 3 != 1")
    texts = plain.select("track_id", F.concat(F.lit("ollama:"), (F.col("track_id") % 2).cast("string")).alias("model")).distinct()
    order = ("clap", "full", "lo")
    rows = [(seed, reads.resolve_dataset(plain.unionByName(texts), order, seed)) for seed in range(3)]
    return spark.createDataFrame(rows + [(-seed, reads.resolve_dataset(plain, order, seed)) for seed in (1, 2)], "seed bigint, model string")


@query("""SELECT 1 AS place, 'full' AS dataset, 'Full' AS title, (SELECT count(DISTINCT track_id) FROM chunks) AS n_tracks, true AS enabled, false AS outdated
UNION ALL SELECT 2, 'clap', 'Clap', 0, false, false
UNION ALL SELECT 3, 'red:1', 'three', 0, true, (SELECT count(*) FROM reduced WHERE chunk_id IN (SELECT chunk_id FROM e)) < (SELECT count(*) FROM e)
UNION ALL SELECT 4, 'red:2', 'none yet', 0, true, true
UNION ALL SELECT 5, 'ollama:t', 'Description (t)', (SELECT count(DISTINCT track_id) FROM chunks), true, false""")
def q_dataset_choices(lib, spark, d):
    reductions = spark.createDataFrame([(1, "three", "full"), (2, "none yet", "full")], "reduction_id bigint, name string, source_model string")
    c = similarity.centroids(lib.track_vectors().where("model = 'full'"))
    return reads.dataset_choices([("full", "Full"), ("clap", "Clap")], lib, c.unionByName(c.withColumn("model", F.lit("ollama:t"))), reductions)


# --- scalars -----------------------------------------------------------------------------


@query(r"SELECT chunk_id, model, 'dim=' || len(v) || ' [' || array_to_string(list_transform(v[1:4], lambda x: printf('%+.3f', x)), ', ') || ', …]' AS preview FROM vectors WHERE model = 'lo'")
def q_vector_preview(lib, spark, d):
    return lib.vectors.where("model = 'lo'").select("chunk_id", "model", reads.vector_preview("v").alias("preview"))


@query("SELECT event_id, CASE WHEN value <= 0 THEN '— (score 0)' ELSE printf('%.2f', log10(value)) END AS shown FROM events")
def q_tag_log10(lib, spark, d):
    return table(spark, d, "events").select("event_id", scalars.log_score("value").alias("shown"))


_SERIES = ", s AS (SELECT user_id, list(value ORDER BY ts, event_id) AS x FROM events GROUP BY user_id)"


def series(spark: SparkSession, d: str) -> DataFrame:
    """Per user the values in order of time: user_id, x."""
    z = F.sort_array(F.collect_list(F.struct("ts", "event_id", "value")))
    return table(spark, d, "events").groupBy("user_id").agg(z.alias("z")).select("user_id", F.col("z")["value"].alias("x"))


@query(f"""SELECT user_id, round(m, {DIGITS}) AS mean, round(sqrt(m2), {DIGITS}) AS std, round(CASE WHEN m2 > 0 THEN m3 / power(m2, 1.5) ELSE 0 END, {DIGITS}) AS skew, round(CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 ELSE 0 END, {DIGITS}) AS kurtosis FROM (
 SELECT user_id, any_value(m) AS m, avg(power(value - m, 2)) AS m2, avg(power(value - m, 3)) AS m3, avg(power(value - m, 4)) AS m4 FROM events JOIN (SELECT user_id, avg(value) AS m FROM events GROUP BY user_id) USING (user_id) GROUP BY user_id)""")
def q_moment_stats(lib, spark, d):
    m = series(spark, d).select("user_id", signal.moment_stats("x").alias("m"))
    return m.select("user_id", *[r(F.col("m")[c]).alias(c) for c in ("mean", "std", "skew", "kurtosis")])


@query(f"""SELECT user_id, round(-sum(CASE WHEN value <> 0 THEN value * value / t * log2(value * value / t) ELSE 0 END), {DIGITS}) + 0.0 AS bits FROM events JOIN (SELECT user_id, sum(value * value) AS t FROM events GROUP BY user_id) USING (user_id) GROUP BY user_id""")
def q_entropy(lib, spark, d):
    return series(spark, d).select("user_id", r(scalars.entropy_bits("x")).alias("bits"))


@query()
def q_hurst(lib, spark, d):
    @F.pandas_udf("double")
    def hurst(x: pd.Series) -> pd.Series:
        return x.map(signal.hurst)

    return series(spark, d).select("user_id", hurst("x").alias("hurst"))


@query(f"SELECT user_id, round(CASE WHEN lo = hi THEN lo - 0.5 ELSE lo - (hi - lo) * 0.05 END, {DIGITS}) AS lo, round(CASE WHEN lo = hi THEN hi + 0.5 ELSE hi + (hi - lo) * 0.05 END, {DIGITS}) AS hi FROM (SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY user_id)")
def q_axis_range(lib, spark, d):
    lo, hi = scalars.padded_range("lo", "hi")
    return table(spark, d, "events").groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).select("user_id", r(lo).alias("lo"), r(hi).alias("hi"))


@query("""SELECT track_id, CASE WHEN s IS NULL THEN '?' WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS shown
 FROM (SELECT track_id, round_even(duration_sec, 0)::BIGINT AS s FROM tracks)""")
def q_format_duration(lib, spark, d):
    return lib.tracks.select("track_id", scalars.format_duration("duration_sec").alias("shown"))


_SIZE = """, z AS (SELECT track_id, (size_bytes * power(10, track_id % 8 - 4))::BIGINT AS n FROM tracks)
SELECT track_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824.0::DOUBLE) ELSE printf('%.1f TB', n / 1099511627776.0::DOUBLE) END AS shown FROM z"""


@query(_SIZE)
def q_format_size(lib, spark, d):
    n = F.round(F.col("size_bytes") * F.pow(F.lit(10.0), F.col("track_id") % 8 - 4)).cast("bigint")
    return lib.tracks.select("track_id", scalars.format_size(n).alias("shown"))


@query("""SELECT track_id, CASE WHEN status = 'error' THEN status_message ELSE coalesce(array_to_string(list_filter(list_transform(string_split(coalesce(status_message, ''), ';'), lambda x: trim(x)), lambda x: contains(x, 'failed:') OR contains(x, 'unavailable')), ' | '), '') END AS shown FROM tracks""")
def q_status_warnings(lib, spark, d):
    return lib.tracks.select("track_id", F.array_join(scalars.warnings("status", "status_message"), " | ").alias("shown"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events")
def q_json_settings(lib, spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").select("event_id", F.coalesce(k, F.lit(-1)).alias("k"))


@query(r"SELECT playlist_id, CASE WHEN s = '' THEN 'playlist' ELSE s END AS slug FROM (SELECT playlist_id, regexp_replace(regexp_replace(trim(name), '[^0-9A-Za-z_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM playlists)")
def q_playlist_slug(lib, spark, d):
    return lib.playlists.select("playlist_id", scalars.slug("name").alias("slug"))


@query("SELECT DISTINCT 'chamfer:' || dataset || '+' || method AS label FROM noise")
def q_search_label(lib, spark, d):
    return lib.noise.select(scalars.search_label(F.lit("chamfer"), "dataset", F.array("method")).alias("label")).distinct()


@query("SELECT model, 'PCA-3 of ' || model AS name, n, true AS pca, n <= 15000 AS tsne, n <= 200000 AS umap FROM (SELECT model, count(*) AS n FROM vectors GROUP BY model)")
def q_reduction_caps(lib, spark, d):
    return reads.reduction_caps(lib).withColumn("name", scalars.reduction_name(F.lit("pca"), F.lit(3), "model"))


# --- changes -----------------------------------------------------------------------------


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 6 IN (2, 4) THEN 'new' || c_name ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 1 THEN NULL ELSE c_acctbal END AS size FROM customer""")
def q_track_upsert(lib, spark, d):
    c = table(spark, d, "customer")
    stored = c.where("c_custkey % 3 != 0 OR c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("size"))
    fresh = c.where("c_custkey % 2 = 0 OR c_custkey % 3 = 0")
    name = F.when(F.col("c_custkey") % 3 == 0, F.when(F.col("c_custkey") % 2 == 1, F.col("c_name"))).otherwise(F.concat(F.lit("new"), "c_name"))
    new = fresh.select(F.col("c_custkey").alias("id"), name.alias("name"), F.lit(None).cast("double").alias("size"), F.lit(1).alias("unknown"))
    return changes.upsert(stored, new, ["id"])


@query("SELECT chunk_id, model, text, score FROM tags")
def q_dedupe_latest(lib, spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("chunk_id"), F.when(F.col("event_id") % 2 == 0, "clap").otherwise("muqlan").alias("model"), F.col("event_type").alias("text"), F.col("value").alias("score"), "ts", "event_id")
    return changes.latest(e, ["chunk_id", "model", "text"], [F.col("ts").desc(), F.col("event_id").desc()]).drop("ts", "event_id")


def _tables(lib: Library) -> dict[str, DataFrame]:
    return {"tracks": lib.tracks, "chunks": lib.chunks, "vectors": lib.vectors, "tags": lib.tags, "playlists": lib.playlists, "playlist_items": lib.playlist_items, "pairs": lib.pairs, "noise": lib.noise}


def _sizes(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


_SIZES = """SELECT 'tracks' AS name, count(*) AS n FROM tracks WHERE {t} UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE {c} UNION ALL SELECT 'vectors', count(*) FROM tv WHERE {c}
UNION ALL SELECT 'tags', count(*) FROM tags WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE NOT ({c})) UNION ALL SELECT 'playlists', count(*) FROM playlists
UNION ALL SELECT 'playlist_items', count(*) FROM items WHERE {t} UNION ALL SELECT 'pairs', count(*) FROM pairs WHERE {p} UNION ALL SELECT 'noise', count(*) FROM noise WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE NOT ({c}))"""


@query(_SIZES.format(t="track_id % 5 <> 1", c="track_id % 5 <> 1", p="track_a % 5 <> 1 AND track_b % 5 <> 1"))
def q_cascade_delete(lib, spark, d):
    return _sizes(changes.remove_folder(_tables(lib), 1))


@query("SELECT track_id, CASE WHEN track_id = 3 THEN 'new' ELSE status END AS status, CASE WHEN track_id <> 3 THEN status_message END AS status_message, coalesce(n, 0) AS n FROM tracks LEFT JOIN (SELECT track_id, count(*) AS n FROM tv WHERE track_id <> 3 GROUP BY track_id) USING (track_id)")
def q_clear_analysis(lib, spark, d):
    t = changes.clear_analysis(_tables(lib), 3)
    n = t["vectors"].join(t["chunks"], "chunk_id").groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    return t["tracks"].join(n, "track_id", "left").select("track_id", "status", "status_message", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT min(pair_id) AS pair_id, least(track_a, track_b) AS track_a, greatest(track_a, track_b) AS track_b FROM pairs WHERE track_a <> track_b GROUP BY 2, 3")
def q_pair_dedupe(lib, spark, d):
    return changes.canonical_pairs(lib.pairs)


@query("""SELECT path FROM tracks WHERE track_id % 4 = 0 OR track_id % 9 = 1 OR track_id % 10 = 3 OR track_id % 21 = 5""")
def q_rescan_changed(lib, spark, d):
    known = lib.tracks.where("track_id % 4 != 0").select("path", F.when(F.col("track_id") % 9 != 1, "mp3").alias("codec"), F.when(F.col("track_id") % 10 == 3, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"), (F.col("track_id") * 1.0).alias("mtime"))
    found = lib.tracks.select("path", "size_bytes", F.when(F.col("track_id") % 21 == 5, F.col("track_id") + 0.5).otherwise(F.col("track_id") + 1e-8).alias("mtime"))
    return audio.changed(found, known).select("path")


@query("""SELECT playlist_id, (position * 2 - 1)::INT AS n, '#EXTINF:' || CASE WHEN duration_sec IS NULL THEN '-1' ELSE (round_even(duration_sec, 0)::BIGINT)::VARCHAR END || ',' || coalesce(artist, 'Unknown artist') || ' - ' || coalesce(title, filename) AS line FROM items JOIN tracks USING (track_id)
 UNION ALL SELECT playlist_id, position * 2, path FROM items JOIN tracks USING (track_id) UNION ALL SELECT DISTINCT playlist_id, 0, '#EXTM3U' FROM items JOIN tracks USING (track_id)""")
def q_m3u_lines(lib, spark, d):
    return playlists.m3u_lines(lib.playlist_items.join(lib.tracks, "track_id"))


@query("""SELECT path, filename AS name, CASE WHEN track_id % 3 = 0 THEN 'copy' WHEN track_id % 3 = 1 THEN 'skip' ELSE 'rename' END AS action FROM tracks""")
def q_copy_plan(lib, spark, d):
    present = lib.tracks.where("track_id % 3 != 0").select(F.col("filename").alias("name"), F.when(F.col("track_id") % 3 == 1, F.col("size_bytes")).otherwise(F.col("size_bytes") + 1).alias("size_bytes"))
    return playlists.copy_plan(lib.tracks, present)


# --- similarity --------------------------------------------------------------------------

_TOP = "SELECT s.track_id, t.path, t.filename, t.artist, t.title, round(s.score, 6) + 0.0 AS score, '{method}' AS method FROM ({scores} ORDER BY score DESC, track_id LIMIT {k}) s JOIN tracks t USING (track_id)"
_SEED = " UNION ALL SELECT track_id, path, filename, artist, title, 1.0, '{method}' FROM tracks WHERE track_id = 1"


def _top(scores: str, method: str, k: int = 5, seed: bool = True) -> str:
    return (_TOP + (_SEED if seed else "")).format(method=method, scores=scores, k=k)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", r("score"))


_CENTROID = "SELECT c.track_id, list_cosine_similarity(c.v, s.v) AS score FROM centroids c, centroids s WHERE s.track_id = 1 AND c.track_id <> 1 AND c.model = 'full' AND s.model = 'full'"


@query(_top(_CENTROID, "full"))
def q_similar_centroid(lib, spark, d):
    lib.weights = None
    return _rounded(similarity.similar_tracks(lib, SEED, "full", limit=5))


_DENOISED = """, dm AS (SELECT track_id, pos, avg(x) AS x FROM (SELECT track_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM tv WHERE model = 'full' AND chunk_id NOT IN (SELECT chunk_id FROM noise WHERE dataset = 'full')) GROUP BY ALL),
dc AS (SELECT track_id, list(x ORDER BY pos) AS v FROM dm GROUP BY track_id) """


@query(_DENOISED + _top("SELECT c.track_id, list_cosine_similarity(c.v, s.v) AS score FROM dc c, dc s WHERE s.track_id = 1 AND c.track_id <> 1", "full"))
def q_similar_centroid_denoised(lib, spark, d):
    lib.weights = None
    return _rounded(similarity.similar_tracks(lib, SEED, "full", limit=5, discard_noise=["hdbscan", "optics"]))


_WEIGHTED = """, wc AS (SELECT track_id, list_transform(v, lambda x, i: CASE WHEN i % 4 = 1 THEN x * 2 ELSE 0 END) AS v FROM centroids WHERE model = 'full') """


@query(_WEIGHTED + _top("SELECT c.track_id, list_cosine_similarity(c.v, s.v) AS score FROM wc c, wc s WHERE s.track_id = 1 AND c.track_id <> 1", "full"))
def q_similar_weighted(lib, spark, d):
    return _rounded(similarity.similar_tracks(lib, SEED, "full", limit=5))


_OBJ = """, o AS (SELECT t.chunk_id, t.model, round(list_cosine_similarity(t.v, c.v), 9) AS o FROM tv t JOIN centroids c USING (track_id, model) WHERE track_id = 1),
om AS (SELECT DISTINCT chunk_id, m.model FROM o, (SELECT DISTINCT model FROM o) m),
ov AS (SELECT om.chunk_id, om.model, coalesce(o.o, -1.0) AS o FROM om LEFT JOIN o USING (chunk_id, model)),
dom AS (SELECT DISTINCT a.chunk_id FROM (SELECT a.chunk_id, b.chunk_id AS other, min(b.o - a.o) AS lo, max(b.o - a.o) AS hi FROM ov a JOIN ov b USING (model) GROUP BY 1, 2) a WHERE lo >= 0 AND hi > 0),
surf AS (SELECT DISTINCT chunk_id FROM o WHERE chunk_id NOT IN (SELECT chunk_id FROM dom)) """


def _objectives(lib: Library) -> DataFrame:
    tv = lib.track_vectors()
    return similarity.objectives(tv, similarity.centroids(tv.where(F.col("track_id") == SEED)), SEED).drop("track_id")


@query(_OBJ + f"SELECT chunk_id, (row_number() OVER (PARTITION BY chunk_id ORDER BY model) - 1)::INT AS pos, round(o, {DIGITS}) + 0.0 AS x FROM ov")
def q_pareto_objectives(lib, spark, d):
    return long(_objectives(lib), "objectives", "chunk_id")


@query(_OBJ + "SELECT chunk_id FROM surf")
def q_pareto_surface(lib, spark, d):
    return similarity.pareto_surface(_objectives(lib)).select("chunk_id")


_SINGLE = """, so AS (SELECT t.chunk_id, round(list_cosine_similarity(t.v, c.v), 9) AS score FROM tv t JOIN centroids c USING (track_id, model) WHERE track_id = 1 AND model = 'full'),
ssurf AS (SELECT chunk_id, score FROM so WHERE score = (SELECT max(score) FROM so)) """


@query(_SINGLE + f"SELECT chunk_id, round(score, {DIGITS}) AS score FROM ssurf")
def q_surface_single(lib, spark, d):
    tv = lib.track_vectors()
    return _rounded(similarity.surface_single(tv, similarity.centroids(tv), SEED, "full"))


def _psvi(surface: str, models: str) -> str:
    return f"""SELECT track_id, avg(x) AS score FROM (SELECT track_id, model, avg(x) AS x FROM (SELECT b.track_id, b.model, a.chunk_id, max(list_cosine_similarity(a.v, b.v)) AS x FROM tv a JOIN tv b USING (model)
 WHERE a.track_id = 1 AND b.track_id <> 1 AND model IN ({models}) AND a.chunk_id IN (SELECT chunk_id FROM {surface}) GROUP BY ALL) GROUP BY ALL) GROUP BY track_id"""


@query(_SINGLE + _top(_psvi("ssurf", "'full'"), "pareto:full"))
def q_similar_psvi(lib, spark, d):
    lib.weights = None
    return _rounded(similarity.similar_tracks(lib, SEED, "full", "psvi", 5))


@query(_OBJ + _top(_psvi("surf", "'full', 'lo', 'hi'"), "pareto:auto"))
def q_similar_psvi_auto(lib, spark, d):
    lib.weights = None
    return _rounded(similarity.similar_tracks(lib, SEED, "auto", "pareto", 5))


def _chamfer(models: str) -> str:
    return f""", cc AS (SELECT b.track_id, b.model, a.chunk_id AS a, b.chunk_id AS b, 1 - list_cosine_similarity(a.v, b.v) AS c FROM tv a JOIN tv b USING (model) WHERE a.track_id = 1 AND b.track_id <> 1 AND model IN ({models})),
ch AS (SELECT track_id, model, (avg_a + avg_b) / 2 AS d FROM (SELECT track_id, model, avg(c) AS avg_a FROM (SELECT track_id, model, a, min(c) AS c FROM cc GROUP BY ALL) GROUP BY ALL) JOIN (SELECT track_id, model, avg(c) AS avg_b FROM (SELECT track_id, model, b, min(c) AS c FROM cc GROUP BY ALL) GROUP BY ALL) USING (track_id, model)) """


_CHAMFER_SCORES = "SELECT track_id, 1 / (1 + avg(d)) AS score FROM ch GROUP BY track_id"


@query(_chamfer("'full'") + _top(_CHAMFER_SCORES, "chamfer:full"))
def q_similar_chamfer(lib, spark, d):
    lib.weights = None
    return _rounded(similarity.similar_tracks(lib, SEED, "full", "chamfer", 5))


@query(_chamfer("'full', 'lo', 'hi'") + _top(_CHAMFER_SCORES, "chamfer:auto"))
def q_similar_chamfer_auto(lib, spark, d):
    lib.weights = None
    return _rounded(similarity.similar_tracks(lib, SEED, "auto", "chamfer", 5))


@query()
def q_similar_emd(lib, spark, d):
    lib.weights = None
    return _rounded(similarity.similar_tracks(lib, SEED, "full", "emd", 5))


@query("SELECT b.track_id, round(1 / (1 + avg(1 - list_cosine_similarity(a.v, b.v))), 5) + 0.0 AS score FROM tv a, tv b WHERE a.model = 'lo' AND b.model = 'lo' AND a.track_id = 1 AND a.idx = 0 AND b.track_id <> 1 GROUP BY b.track_id")
def q_emd_single_chunk(lib, spark, d):
    """A set of one vector: the transport cost is the mean cost."""
    rows = lib.track_vectors().where("model = 'lo'").where((F.col("track_id") != SEED) | (F.col("idx") == 0))
    return similarity.emd_scores(rows, SEED).select("track_id", (F.round("score", 5) + 0.0).alias("score"))


_MULTI = """SELECT track_id, CASE WHEN min(x) > 0 THEN exp(avg(ln(CASE WHEN x > 0 THEN x ELSE 1 END))) ELSE 0 END AS score FROM (SELECT c.track_id, s.track_id AS seed, list_cosine_similarity(c.v, s.v) AS x
 FROM centroids c, centroids s WHERE c.model = 'full' AND s.model = 'full' AND s.track_id IN (1, 2, 3) AND c.track_id NOT IN (1, 2, 3)) GROUP BY track_id HAVING count(*) = 3"""


@query(_top(_MULTI, "full", seed=False))
def q_similar_multi(lib, spark, d):
    lib.weights = None
    return _rounded(similarity.similar_to_all(lib, [1, 2, 3], "full", limit=5))


@query(f"SELECT a.track_id AS a, b.track_id AS b, round(list_cosine_similarity(a.v, b.v), {DIGITS}) + 0.0 AS score FROM centroids a, centroids b WHERE a.model = 'full' AND b.model = 'full' AND a.track_id < b.track_id")
def q_centroid_matrix(lib, spark, d):
    return _rounded(similarity.centroid_matrix(similarity.centroids(lib.track_vectors()), "full"))


_PAIR = "SELECT a.track_id, b.track_id AS other, round(list_cosine_similarity(a.v, b.v), 9) + 0.0 AS score FROM centroids a JOIN centroids b ON a.model = b.model AND a.track_id <> b.track_id WHERE a.model = 'full'"


@query(f"SELECT track_id, rank, other, round(score, {DIGITS}) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, other)::INT AS rank FROM ({_PAIR})) WHERE rank <= 5")
def q_centroid_neighbors(lib, spark, d):
    return _rounded(nearest.nearest_tracks(similarity.centroids(lib.track_vectors()), "full", 5))


@query(f"SELECT 77::BIGINT AS playlist_id, track_id, row_number() OVER (ORDER BY score DESC, track_id)::INT AS position, round(score, {DIGITS}) + 0.0 AS similarity FROM (SELECT * FROM (SELECT * FROM ({_CENTROID}) ORDER BY score DESC, track_id LIMIT 5) UNION ALL SELECT 1, 1.0)")
def q_playlist_build(lib, spark, d):
    lib.weights = None
    p = similarity.playlist_from(similarity.similar_tracks(lib, SEED, "full", limit=5), 77)
    return p.withColumn("similarity", r("similarity"))


# --- derived datasets --------------------------------------------------------------------

_Z = """, zs AS (SELECT pos, avg(x) AS m, CASE WHEN stddev_pop(x) < 1e-9 THEN 1 ELSE stddev_pop(x) END AS s FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY pos),
z AS (SELECT chunk_id, track_id, pos, (x - m) / s AS x FROM (SELECT chunk_id, track_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) JOIN zs USING (pos)) """


@query(_Z + f"SELECT chunk_id, (pos - 1)::INT AS pos, round(x, {DIGITS}) + 0.0 AS x FROM z")
def q_zscore(lib, spark, d):
    return long(derive.zscore(lib.vectors.where("model = 'full'")), "v", "chunk_id")


@query(_Z + f"SELECT chunk_id, (pos - 1)::INT AS pos, round(x, {DIGITS}) + 0.0 AS x FROM z")
def q_standardize(lib, spark, d):
    return long(derive.standardize(lib.vectors.where("model = 'full'")), "v", "chunk_id")


@query(_Z + f""", za AS (SELECT track_id, pos, avg(x) AS x FROM z GROUP BY ALL), zn AS (SELECT track_id, sqrt(sum(x * x)) AS n FROM za GROUP BY ALL)
SELECT track_id, (pos - 1)::INT AS pos, round(x / n, {DIGITS}) + 0.0 AS x FROM za JOIN zn USING (track_id)""")
def q_zscore_centroids(lib, spark, d):
    z = derive.zscore(lib.track_vectors().where("model = 'full'"))
    return long(similarity.centroids(z), "v", "track_id")


_LEARN = """, pr AS (SELECT DISTINCT least(track_a, track_b) AS a, greatest(track_a, track_b) AS b FROM pairs WHERE track_a <> track_b),
g AS (SELECT (x.pos - 1)::INT AS component_index, avg(power(x.x - y.x, 2)) AS c FROM pr JOIN (SELECT track_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM centroids WHERE model = 'full') x ON x.track_id = a
 JOIN (SELECT track_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM centroids WHERE model = 'full') y ON y.track_id = b AND y.pos = x.pos GROUP BY 1),
l AS (SELECT *, greatest(avg(c) OVER () / 2, 1e-12) AS l2, sum(c) OVER (ORDER BY c, component_index ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (ORDER BY c, component_index) AS k, count(*) OVER () AS dim FROM g),
lv AS (SELECT *, (2 * l2 + s) / k AS level FROM l), lm AS (SELECT max_by(level, k) AS level FROM lv WHERE level > c)
SELECT component_index, round(greatest(0, (lm.level - c) / (2 * l2)) * dim, 6) + 0.0 AS weight FROM lv, lm"""


@query(_LEARN)
def q_learn_weights(lib, spark, d):
    w = derive.learn_weights(lib.pairs, similarity.centroids(lib.track_vectors().where("model = 'full'")))
    return w.select("component_index", r("weight").alias("weight"))


@query()
def q_pca(lib, spark, d):
    out, shares = derive.pca(lib.vectors.where("model = 'full'").select("chunk_id", "v"), 3)
    return long(out, "v", "chunk_id").withColumn("share", F.element_at(F.array(*map(F.lit, shares)), F.col("pos") + 1))


@query("SELECT round(sum(s), 6) AS total FROM (SELECT var_pop(x) AS s FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY pos)")
def q_total_variance(lib, spark, d):
    """The whole variance, by way of the moments that PCA works from."""

    n, s, ss = derive.moments(lib.vectors.where("model = 'full'"))
    return spark.createDataFrame([(float(np.round(np.trace(ss / n - np.outer(s / n, s / n)), DIGITS)),)], "total double")


@query()
def q_similar_reduced(lib, spark, d):
    out, _ = derive.pca(lib.vectors.where("model = 'full'").select("chunk_id", "v"), 4)
    lib.reduced, lib.weights = out.select(F.lit(9).cast("bigint").alias("reduction_id"), "chunk_id", "v"), None
    return _rounded(similarity.similar_tracks(lib, SEED, "red:9", limit=5))


@query()
def q_tsne(lib, spark, d):
    return long(derive.tsne(lib.vectors.where("model = 'lo'"), 2, limited=False), "v", "chunk_id")


@query()
def q_umap(lib, spark, d):
    return long(derive.umap(lib.vectors.where("model = 'lo'"), 2, limited=False), "v", "chunk_id")


@query()
def q_umap_landmarks(lib, spark, d):
    """Fitted to 200 landmarks; every other vector is placed where it is stored."""
    return long(derive.umap(lib.vectors.where("model = 'lo'"), 2, landmarks=200), "v", "chunk_id")


@query()
def q_text_embed_similar(lib, spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("track_id"), "text")
    lib.centroids = text.embed_texts(docs, text.hashing_embedder(), "ollama:hashing")
    return _rounded(similarity.similar_tracks(lib, SEED, "ollama:hashing", limit=5))


# --- noise -------------------------------------------------------------------------------

_REACH = """, un AS (SELECT track_id, chunk_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM tv WHERE model = 'full'),
pd AS (SELECT a.track_id, a.chunk_id, b.chunk_id AS other, sqrt(list_sum(list_transform(list_zip(a.u, b.u), lambda z: power(z[1] - z[2], 2)))) AS d FROM un a JOIN un b USING (track_id) WHERE a.chunk_id <> b.chunk_id),
kr AS (SELECT track_id, chunk_id, avg(d) AS reach FROM (SELECT *, row_number() OVER (PARTITION BY track_id, chunk_id ORDER BY d, other) AS rn FROM pd) WHERE rn <= 4 GROUP BY ALL) """


@query(_REACH + f"SELECT track_id, chunk_id, round(reach, {DIGITS}) AS reach FROM kr")
def q_knn_reach(lib, spark, d):
    return noise.knn_reach(lib.track_vectors().where("model = 'full'")).withColumn("reach", r("reach"))


@query(_REACH + f"SELECT track_id, chunk_id, round(reach, {DIGITS}) AS reach, round(reach / median(reach) OVER (PARTITION BY track_id), {DIGITS}) AS ratio, reach / median(reach) OVER (PARTITION BY track_id) > 2 AS outlier FROM kr")
def q_reach_outliers(lib, spark, d):
    return noise.reach_outliers(lib.track_vectors().where("model = 'full'")).withColumn("reach", r("reach")).withColumn("ratio", r("ratio"))


def _planted(lib: Library) -> DataFrame:
    """Chunks near a few centres, and every twelfth one far from all."""
    v = lib.track_vectors().where("model = 'full'")
    near = F.transform("v", lambda x, i: x * 0.05 + F.when(i == F.col("track_id") % 3, 1.0).otherwise(0.0))
    return v.select("track_id", "chunk_id", F.when(F.col("idx") % 12 == 5, F.col("v")).otherwise(near).alias("v"))


@query()
def q_noise_hdbscan(lib, spark, d):
    return noise.song_flags(_planted(lib), "hdbscan")


@query()
def q_noise_optics(lib, spark, d):
    return noise.song_flags(_planted(lib), "optics")


@query("SELECT chunk_id, CASE WHEN count(DISTINCT method) > 1 THEN 'both' ELSE min(method) END AS tint FROM noise GROUP BY chunk_id")
def q_noise_tint(lib, spark, d):
    return reads.noise_tint(lib)


@query(r"""SELECT track_id, chunk_id, idx, printf('%.2f s', start_sec) AS start, printf('%.2f s', end_sec) AS "end", coalesce(g.tags, '—') AS tags, p.previews FROM chunks
 LEFT JOIN (SELECT chunk_id, string_agg(t, '; ' ORDER BY t) AS tags FROM (SELECT chunk_id, model || ': ' || string_agg(text || ' ' || CASE WHEN score <= 0 THEN '— (score 0)' ELSE printf('%.2f', log10(score)) END, ', ' ORDER BY score DESC, text) AS t FROM tags GROUP BY chunk_id, model) GROUP BY chunk_id) g USING (chunk_id)
 LEFT JOIN (SELECT chunk_id, string_agg(model || ' dim=' || len(v) || ' [' || array_to_string(list_transform(v[1:4], lambda x: printf('%+.3f', x)), ', ') || ', …]', ' | ' ORDER BY model) AS previews FROM vectors GROUP BY chunk_id) p USING (chunk_id)""")
def q_chunk_grid(lib, spark, d):
    return reads.chunk_grid(lib)


# --- signals -----------------------------------------------------------------------------

_PLAN = """, sz AS (SELECT user_id, len(x) AS n, 4 AS rate FROM s), pl AS (SELECT user_id, n, rate, 24 AS size, 12 AS hop, 6 AS tail, greatest(0, ceil((n - 24) / 12))::INT AS last FROM sz),
pm AS (SELECT *, CASE WHEN last > 0 AND n - last * hop < tail THEN last - 1 ELSE last END AS cnt FROM pl),
px AS (SELECT *, unnest(range(0, cnt + 1))::INT AS idx FROM pm)
SELECT user_id, idx, round(idx * hop / rate, 6) AS start_sec, round((CASE WHEN idx = cnt THEN n ELSE least(idx * hop + size, n) END) / rate, 6) AS end_sec FROM px"""


@query(_SERIES + _PLAN)
def q_chunk_plan(lib, spark, d):
    plan = series(spark, d).select("user_id", F.inline(signal.chunk_plan(F.size("x"), F.lit(4), 6.0, 50.0)))
    return plan.select("user_id", "idx", r("start_sec").alias("start_sec"), r("end_sec").alias("end_sec"))


@query(_SERIES + """, m AS (SELECT user_id, x, len(x) AS n, greatest(1, round_even(len(x) * 3.0::DOUBLE / 2, 0))::BIGINT AS m FROM s),
k AS (SELECT *, unnest(range(0, m)) AS k FROM m), p AS (SELECT *, CASE WHEN m > 1 THEN least(k * ((n - 1) / (m - 1)), n - 1) ELSE 0 END AS p FROM k),
i AS (SELECT *, least(floor(p), greatest(n - 2, 0))::INT AS i FROM p)
SELECT user_id, k::INT AS pos, round(x[i + 1] + (coalesce(x[i + 2], x[i + 1]) - x[i + 1]) * (p - i), 9) + 0.0 AS x FROM i""")
def q_resample(lib, spark, d):
    y = series(spark, d).select("user_id", F.posexplode(signal.resample("x", 2, 3)).alias("pos", "x"))
    return y.select("user_id", "pos", (F.round("x", 9) + 0.0).alias("x"))


@query(_SERIES + """, w AS (SELECT user_id, len(x) AS n, unnest(range(0, greatest(len(x), 1), 16)) AS start FROM s)
SELECT user_id, start, least(start + 16, n) AS stop FROM w WHERE n <= 16 AND start = 0 OR least(start + 16, n) - start >= 2 AND n > 16""")
def q_fft_windows(lib, spark, d):
    return series(spark, d).select("user_id", F.inline(signal.plain_windows(F.size("x"), 16)))


@query(_SERIES + """, w AS (SELECT user_id, len(x) AS n, 20 AS size, 14 AS step, (len(x) - 20) // 14 AS k FROM s),
v AS (SELECT user_id, n, size, k * step AS last, n - size AS tail, CASE WHEN n <= size THEN [0] ELSE range(0, k * step + 1, step) END AS plain FROM w)
SELECT user_id, unnest(CASE WHEN n <= size OR tail <= last THEN plain WHEN tail - last >= 5 THEN list_append(plain, tail) ELSE list_append(plain[1:len(plain) - 1], tail) END)::BIGINT AS start FROM v""")
def q_window_starts(lib, spark, d):
    return series(spark, d).select("user_id", F.explode(signal.window_starts(F.size("x"), 20, 6)).alias("start"))


#: A Hann window and a discrete Fourier transform by sums, over each whole series.
_DFT = _SERIES + """, x AS (SELECT user_id, n, i, x[i + 1] AS raw, x[i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS y FROM (SELECT user_id, x, len(x) AS n, unnest(range(0, len(x))) AS i FROM s WHERE len(x) > 1)),
f AS (SELECT user_id, n, k, sqrt(power(sum(y * cos(2 * pi() * (k * i % n) / n)), 2) + power(sum(y * sin(2 * pi() * (k * i % n) / n)), 2)) / n * CASE WHEN k = 0 THEN 1 ELSE 2 END AS a
 FROM x JOIN (SELECT user_id, unnest(range(0, len(x) // 2 + 1)) AS k FROM s) USING (user_id) GROUP BY user_id, n, k),
loud AS (SELECT user_id, sqrt(avg(raw * raw)) AS loud FROM x GROUP BY user_id) """


def amplitudes(spark: SparkSession, d: str) -> DataFrame:
    """user_id, n, loud, k, a: one-sided amplitudes of each series, by the plugin's transform."""

    @F.pandas_udf("array<double>")
    def transform(x: pd.Series) -> pd.Series:
        return x.map(lambda v: signal.amplitudes(np.asarray(v, float)).tolist())

    s = series(spark, d).where(F.size("x") > 1)
    s = s.select("user_id", F.size("x").alias("n"), F.sqrt(F.aggregate("x", F.lit(0.0), lambda t, v: t + v * v) / F.size("x")).alias("loud"), transform("x").alias("a"))
    return s.select("user_id", "n", "loud", F.posexplode("a").alias("k", "a"))


@query(_DFT + "SELECT user_id, k::INT AS k, round(a, 6) + 0.0 AS a FROM f")
def q_dft_amplitudes(lib, spark, d):
    return amplitudes(spark, d).select("user_id", "k", r("a").alias("a"))


@query(_DFT + """SELECT user_id, CASE WHEN k * 8 < n THEN 0 WHEN k * 4 < n THEN 1 ELSE 2 END AS band, round(avg(a) / any_value(loud), 6) AS mean, round(stddev_pop(a) / any_value(loud), 6) AS std, round(sqrt(avg(a * a)) / any_value(loud), 6) AS rms, round(max(a) / sqrt(avg(a * a)), 6) AS crest
 FROM f JOIN loud USING (user_id) GROUP BY 1, 2""")
def q_band_stats(lib, spark, d):
    band = F.when(F.col("k") * 8 < F.col("n"), 0).when(F.col("k") * 4 < F.col("n"), 1).otherwise(2)
    rms, loud = F.sqrt(F.avg(F.col("a") * F.col("a"))), F.first("loud")
    g = amplitudes(spark, d).groupBy("user_id", band.alias("band"))
    return g.agg(r(F.avg("a") / loud).alias("mean"), r(F.stddev_pop("a") / loud).alias("std"), r(rms / loud).alias("rms"), r(F.max("a") / rms).alias("crest"))


@query(_DFT + """SELECT user_id, max_by(k, a)::INT AS dominant, round(sum(k * a) / sum(a) * 2 / any_value(n), 6) AS centroid, round(-sum(CASE WHEN a > 0 THEN power(a, 4) / t * log2(power(a, 4) / t) ELSE 0 END) / log2(count(*)), 6) AS entropy
 FROM f JOIN (SELECT user_id, sum(power(a, 4)) AS t FROM f GROUP BY user_id) USING (user_id) GROUP BY user_id""")
def q_spectral_whole(lib, spark, d):
    f = amplitudes(spark, d).withColumn("p", F.pow("a", F.lit(4.0)))
    f = f.withColumn("q", F.col("p") / F.sum("p").over(W.partitionBy("user_id")))
    bits = F.sum(F.when(F.col("q") > 0, -F.col("q") * F.log2("q")).otherwise(0.0)) / F.log2(F.count(F.lit(1)).cast("double"))
    return f.groupBy("user_id").agg(F.max_by("k", "a").alias("dominant"), r(F.sum(F.col("k") * F.col("a")) / F.sum("a") * 2 / F.first("n")).alias("centroid"), r(bits).alias("entropy"))


#: Samples a second of the queries' signals: the highest band begins at 15 kHz.
RATE = 48_000


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return series(spark, d).select(F.col("user_id").alias("chunk_id"), F.lit(RATE).alias("rate"), F.col("x").cast("array<float>").alias("samples"))


@query()
def q_fft_features(lib, spark, d):
    return long(plugins.embed_chunks(_samples(spark, d), plugins.get_plugin("fft")), "v", "chunk_id")


_ZERO = """, tg AS (SELECT track_id::VARCHAR AS text, v FROM centroids WHERE model = 'lo'), sm AS (SELECT t.chunk_id, tg.text, 100 * list_cosine_similarity(t.v, tg.v) AS z FROM tv t, tg WHERE t.model = 'lo'),
ex AS (SELECT *, exp(z - max(z) OVER (PARTITION BY chunk_id)) AS ez FROM sm), pr2 AS (SELECT chunk_id, text, ez / sum(ez) OVER (PARTITION BY chunk_id) AS score FROM ex)
SELECT chunk_id, rank::INT AS rank, text, round(score, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, text) AS rank FROM pr2) WHERE rank <= 3"""


@query(_ZERO)
def q_zero_shot_tags(lib, spark, d):
    tags = similarity.centroids(lib.track_vectors().where("model = 'lo'")).select(F.col("track_id").cast("string").alias("text"), "v")
    return _rounded(plugins.zero_shot_tags(lib.vectors.where("model = 'lo'").select("chunk_id", "v"), tags))


@query("""SELECT track_id, count(*) = count(CASE WHEN idx % 40 <> 39 AND track_id % 2 = 0 THEN 1 END) AS same FROM chunks GROUP BY track_id""")
def q_same_plan(lib, spark, d):
    planned = lib.chunks.where("idx % 40 != 39").withColumn("start_sec", F.when(F.col("track_id") % 2 == 0, F.col("start_sec") + 1e-9).otherwise(F.col("start_sec") + 1e-3))
    return audio.same_plan(lib.chunks, planned)


def _waves(spark: SparkSession, d: str) -> DataFrame:
    """A WAV file per user, from the user's values: path, content."""


    @F.pandas_udf("binary")
    def render(x: pd.Series) -> pd.Series:
        def one(v):
            f = io.BytesIO()
            with wave.open(f, "wb") as w:
                w.setnchannels(1), w.setsampwidth(2), w.setframerate(RATE)
                w.writeframes((np.clip(np.asarray(v) / 100, -1, 1) * 32767).astype("<i2").tobytes())
            return f.getvalue()

        return x.map(one)

    return series(spark, d).select(F.concat(F.lit("/waves/"), F.col("user_id").cast("string"), F.lit(".wav")).alias("path"), render("x").alias("content"))


@query(_SERIES + """, y AS (SELECT user_id, unnest(x) AS v FROM s)
SELECT '/waves/' || user_id || '.wav' AS path, count(*)::INT AS n, round(sum((trunc(greatest(-1, least(1, v / 100)) * 32767) / 32768)::FLOAT::DOUBLE), 6) + 0.0 AS total FROM y GROUP BY user_id""")
def q_wav_decode(lib, spark, d):
    c = audio.decode_chunks(_waves(spark, d), 1e9, 0)
    return c.select("path", F.size("samples").alias("n"), r(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double"))).alias("total"))


@query(_SERIES + """SELECT '/waves/' || user_id || '.wav' AS path, 'wav' AS container, 'pcm' AS codec, 48000 AS sample_rate, 1 AS channels, 16 AS bit_depth, 768.0::DOUBLE AS bitrate_kbps, len(x) / 48000.0::DOUBLE AS duration_sec, NULL::VARCHAR AS error FROM s""")
def q_probe(lib, spark, d):
    return audio.probe_files(_waves(spark, d))


@query()
def q_analyze_pipeline(lib, spark, d):
    """Files to chunks to feature vectors to centroids, in one plan."""
    c = audio.decode_chunks(_waves(spark, d), 32 / RATE, 50.0).where("error IS NULL")
    c = c.withColumn("chunk_id", F.xxhash64("path", "idx")).withColumn("track_id", F.xxhash64("path"))
    v = plugins.embed_chunks(c, plugins.get_plugin("fft"))
    return long(similarity.centroids(v.join(c.select("chunk_id", "track_id"), "chunk_id")), "v", "track_id", "model")


# --- state changes -----------------------------------------------------------------------


def _counts(tables: dict[str, DataFrame], *names: str) -> DataFrame:
    out = None
    for n in names:
        one = tables[n].agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT playlist_id, track_id, position, round(similarity, 6) AS similarity FROM items WHERE playlist_id <> 1
UNION ALL SELECT 1, track_id, row_number() OVER (ORDER BY track_id DESC)::INT, 0.25 FROM tracks WHERE track_id < 9""")
def q_playlist_replace(lib, spark, d):
    new = lib.tracks.where("track_id < 9").select("track_id", F.lit(0.25).alias("similarity"), (-F.col("track_id")).alias("ord"))
    return changes.replace_items(lib.playlist_items, 1, new).withColumn("similarity", F.round("similarity", 6))


@query("SELECT 'playlists' AS name, count(*) - 1 AS n FROM playlists UNION ALL SELECT 'playlist_items', count(*) FROM items WHERE playlist_id <> (SELECT max(playlist_id) FROM playlists)")
def q_playlist_delete(lib, spark, d):
    """A playlist is made, one that was there goes."""
    last = changes.next_id(lib.playlists, "playlist_id") - 1
    p, i = changes.create_playlist(lib.playlists, "new", 3, "full")
    t = changes.delete_playlist({"playlists": p, "playlist_items": lib.playlist_items}, last)
    t = changes.delete_playlist(t, i)
    return _counts(t, "playlists", "playlist_items")


@query("SELECT playlist_id, name, row_number() OVER (ORDER BY created_at DESC, playlist_id DESC)::INT AS place FROM playlists")
def q_newest_playlists(lib, spark, d):
    return reads.newest_numbered(lib.playlists, "playlist_id", "place").select("playlist_id", "name", F.col("place").cast("int").alias("place"))


@query("SELECT path FROM (SELECT DISTINCT regexp_extract(path, '^/[^/]+/[^/]+') AS path FROM tracks) UNION SELECT '/music/PROMO'")
def q_folder_insert(lib, spark, d):
    """Known folders are left alone, new ones come in once."""
    top = lib.tracks.select(F.regexp_extract("path", "^/[^/]+/[^/]+", 0).alias("path"))
    known = spark.createDataFrame([(1, "/music/PROMO", None)], "folder_id bigint, path string, added_at timestamp")
    return changes.add_folders(known, top.unionAll(top)).select("path")


@query("""SELECT c.chunk_id, c.track_id, c.idx FROM chunks c WHERE track_id <> 3 UNION ALL SELECT 900000 + chunk_id, track_id, idx FROM chunks WHERE track_id = 3 AND idx % 2 = 0""")
def q_chunk_replace(lib, spark, d):
    own = ["chunk_id", "track_id", "idx"]
    new = lib.chunks.where("track_id = 3 AND idx % 2 = 0").select((F.col("chunk_id") + 900000).alias("chunk_id"), "track_id", "idx")
    return changes.replace_rows(lib.chunks.select(*own), new, ["track_id"])


@query("SELECT track_id, CASE WHEN track_id = 4 THEN 'analyzed' WHEN track_id = 5 THEN 'error' ELSE status END AS status, CASE WHEN track_id = 5 THEN 'lost' WHEN track_id <> 4 THEN status_message END AS status_message, track_id = 4 AS stamped FROM tracks")
def q_status_transition(lib, spark, d):
    t = lib.tracks.select("track_id", "status", "status_message", F.lit(None).cast("timestamp").alias("last_analyzed_at"))
    t = changes.set_status(changes.set_status(t, 4, "analyzed"), 5, "error", "lost")
    return t.select("track_id", "status", "status_message", F.col("last_analyzed_at").isNotNull().alias("stamped"))


@query("""SELECT event_type AS key, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'set' ELSE 'old' END AS value FROM (SELECT DISTINCT event_type FROM events) UNION ALL SELECT 'ollama_models', '["a", "b"]'""")
def q_settings_upsert(lib, spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("key")).distinct().withColumn("value", F.lit("old"))
    s = changes.put_setting(e, e.agg(F.min("key")).first()[0], "set")
    return changes.save_text_models(s, changes.text_models(changes.save_text_models(s, ["a", "b"])))


@query("SELECT chunk_id, (generate_subscripts(v, 1) - 1)::INT AS pos, round(unnest(v), 6) + 0.0 AS x FROM e")
def q_vector_codec(lib, spark, d):
    """Vectors of an imported library: packed as bytes, and unpacked again."""
    packed = lib.vectors.where("model = 'full'").select("chunk_id", store.pack_vector(F.col("v")).alias("blob"))
    return long(packed.select("chunk_id", store.unpack_vector(F.col("blob")).alias("v")), "v", "chunk_id")


def _state(lib: Library) -> dict[str, DataFrame]:
    """The relations as a store has them, without runs and with one reduction."""
    empty = lambda n: lib.spark.createDataFrame([], SCHEMAS[n])
    t = {"tracks": lib.tracks, "chunks": lib.chunks, "vectors": lib.vectors, "reduced": lib.reduced, "noise": lib.noise, "pairs": lib.pairs, "weights": lib.weights}
    t |= {n: empty(n) for n in ("noise_filters", "noise_run_tracks")}
    t["centroids"] = similarity.centroids(lib.track_vectors())
    t["reductions"] = changes.put_reduction(empty("reductions"), "halves", "full", "pca", {}, 3)[0]
    return t


@query("""SELECT 1::BIGINT AS reduction_id, 'halves again' AS name, 'full' AS source_model, 4 AS n_components, (SELECT count(*) FROM e) AS n_vectors, 4 AS shares, (SELECT count(*) FROM e) AS stored, (SELECT count(DISTINCT track_id) FROM e) AS centroids""")
def q_reduction_refresh(lib, spark, d):
    """A reduction fitted anew under its id: record, vectors and centroids."""
    t = _state(lib)
    out, i = jobs.reduce_dataset(t, "halves again", "full", "pca", 4, refresh=1)
    n, c = (x.agg(F.count(F.lit(1)).alias(a)) for x, a in ((out["reduced"], "stored"), (out["centroids"].where(F.col("model") == f"red:{i}"), "centroids")))
    red = out["reductions"].select("reduction_id", "name", "source_model", "n_components", "n_vectors", F.size(F.from_json("explained_variance", "array<double>")).alias("shares"))
    return red.crossJoin(n).crossJoin(c)  # one row each


@query("SELECT 'reductions' AS name, 0::BIGINT AS n UNION ALL SELECT 'reduced', 0 UNION ALL SELECT 'centroids', (SELECT count(*) FROM (SELECT DISTINCT track_id, model FROM tv)) UNION ALL SELECT 'noise', (SELECT count(*) FROM noise) UNION ALL SELECT 'noise_filters', 0")
def q_reduction_delete(lib, spark, d):
    """A reduction goes with its vectors, centroids and noise runs."""
    t = _state(lib)
    t["centroids"] = t["centroids"].unionByName(t["centroids"].where("model = 'lo'").withColumn("model", F.lit("red:1")))
    rows = jobs.dataset_rows(t, "red:1")
    t = changes.store_noise_run(t, "red:1", "optics", rows.where("chunk_id % 3 = 0"), reads.signatures(rows))
    return _counts(changes.delete_reduction(t, 1), "reductions", "reduced", "centroids", "noise", "noise_filters")


@query("""SELECT 'full' AS dataset, 'hdbscan' AS method, 1::BIGINT AS filter_id, (SELECT count(*) FROM e) AS n_vectors, (SELECT count(*) FROM e WHERE chunk_id % 5 = 0) AS n_noise, (SELECT count(DISTINCT track_id) FROM e) AS tracks, (SELECT count(*) FROM noise WHERE dataset <> 'full' OR method <> 'hdbscan') AS others""")
def q_noise_store(lib, spark, d):
    """A run replaces the one before; flags of other runs stay."""
    t, v = _state(lib), jobs.dataset_rows(_state(lib), "full")
    t = changes.store_noise_run(t, "full", "hdbscan", v.where("chunk_id % 2 = 0"), reads.signatures(v.where("track_id < 3")), n_vectors=1)
    t = changes.store_noise_run(t, "full", "hdbscan", v.where("chunk_id % 5 = 0"), reads.signatures(v), n_vectors=v.count(), in_place=True)
    other = t["noise"].where("dataset != 'full' OR method != 'hdbscan'").agg(F.count(F.lit(1)).alias("others"))
    seen = t["noise_run_tracks"].agg(F.count(F.lit(1)).alias("tracks"))
    return t["noise_filters"].select("dataset", "method", "filter_id", "n_vectors", "n_noise").crossJoin(seen).crossJoin(other)  # one row each


_PAIRS = """, pr AS (SELECT DISTINCT least(track_a, track_b) AS a, greatest(track_a, track_b) AS b FROM pairs WHERE track_a <> track_b), has AS (SELECT DISTINCT track_id FROM e WHERE track_id <> 4)
SELECT 'full' AS model, count(*) AS pairs_stored, count(*) FILTER (a IN (SELECT track_id FROM has) AND b IN (SELECT track_id FROM has)) AS pairs_used FROM pr"""


@query(_PAIRS)
def q_learn_and_store(lib, spark, d):
    """How many pairs a model's weights were learned from; track 4 has no centroid."""
    t = _state(lib)
    t["centroids"] = t["centroids"].where("track_id != 4")
    _, said = jobs.learn_and_store(t, "full")
    return spark.createDataFrame([(said["model"], said["pairs_stored"], said["pairs_used"])], "model string, pairs_stored bigint, pairs_used bigint")


@query("SELECT track_id, count(*) AS n FROM chunks WHERE track_id IN (1, 2) GROUP BY track_id")
def q_noise_sweep(lib, spark, d):
    """Only tracks without a valid record are fitted; then none is pending."""
    t, v = _state(lib), jobs.dataset_rows(_state(lib), "full")
    v = v.where("track_id IN (1, 2)")
    t["vectors"] = v.select("chunk_id", F.lit("full").alias("model"), "v")
    t = changes.store_noise_run(t, "full", "hdbscan", v.limit(0), reads.signatures(v.where("track_id = 1")))
    t = t | jobs.noise_sweep(t, "hdbscan")
    return t["noise_run_tracks"].select("track_id", F.col("n_chunks").alias("n"))


from . import files  # noqa: E402,F401 - registers its queries
