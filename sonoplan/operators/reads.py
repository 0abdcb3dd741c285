"""Relational reads over a library: lookups, listings, joins, counts and rollups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars, vectors
from ..plans.library import Library
from ..schema import MODEL_ORDER, Dataset

# --- lookups and listings ----------------------------------------------------------------


def get_track(lib: Library, track_id: int) -> DataFrame:
    return lib.tracks.where(F.col("track_id") == track_id)


def get_track_by_path(lib: Library, path: str) -> DataFrame:
    return lib.tracks.where(F.col("path") == path)


def list_tracks(lib: Library, folder_id: int | None = None) -> DataFrame:
    """By path; of one folder or of all."""
    t = lib.tracks if folder_id is None else lib.tracks.where(F.col("folder_id") == folder_id)
    return t.orderBy("path")


def _among(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """None: no filter; an empty list: no rows."""
    return df if values is None else df.where(F.col(column).isin(list(values))) if values else df.limit(0)


def chunks_for_tracks(lib: Library, track_ids: Sequence[int] | None) -> DataFrame:
    return _among(lib.chunks, "track_id", track_ids).orderBy("track_id", "idx")


def chunk_vectors(lib: Library, chunk_id: int, model: str | None = None) -> DataFrame:
    v = lib.vectors.where(F.col("chunk_id") == chunk_id)
    return (v if model is None else v.where(F.col("model") == model)).orderBy("model")


def chunk_tags(lib: Library, chunk_id: int, model: str | None = None) -> DataFrame:
    """Highest score first, then by text; a null score comes last."""
    t = lib.tags.where(F.col("chunk_id") == chunk_id)
    return (t if model is None else t.where(F.col("model") == model)).orderBy(F.col("score").desc_nulls_last(), "text")


def track_tags(lib: Library, track_id: int, model: str | None = None) -> DataFrame:
    """Tags of a track's chunks, highest score first."""
    t = lib.tags if model is None else lib.tags.where(F.col("model") == model)
    c = lib.chunks.where(F.col("track_id") == track_id).select("chunk_id", "idx")
    return t.join(c, "chunk_id").orderBy(F.col("score").desc_nulls_last(), "text", "idx")


def text_datasets_of(aggregates: DataFrame, track_id: int) -> DataFrame:
    """Text datasets (``ollama:...``) in which a track has a vector, by name."""
    own = aggregates.where((F.col("track_id") == track_id) & F.col("model").startswith("ollama:"))
    return own.select("model").distinct().orderBy("model")


def newest_first(df: DataFrame, id_column: str) -> DataFrame:
    return df.orderBy(F.col("created_at").desc(), F.col(id_column).desc())


def newest_numbered(df: DataFrame, id_column: str, name: str) -> DataFrame:
    """``df`` with its place from 1 on in the order of newest_first, numbered where rows lie: ranges of the
    whole order (so equal times are parted by id) are numbered each by itself, after those before it. The
    ranges are kept on the executors; the driver holds a count per range."""
    order = [F.col("created_at").desc(), F.col(id_column).desc()]
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()).persist()
    sizes = {r["_range"]: r["n"] for r in dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = [F.lit(sum(n for k, n in sizes.items() if k < j)).cast("bigint") for j in range(parts)]
    own = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return dealt.withColumn(name, own + F.element_at(F.array(*starts), F.col("_range") + 1)).drop("_range")


def path_filter(tracks: DataFrame, needle: str) -> DataFrame:
    """Tree nodes (path, is_file) that a search shows: a match, what is above it and below it.

    Paths explode into their prefixes once; a node matches by its own name. What is below a
    match holds the needle in some name of its path; what is above is a prefix of a match.
    """
    names = F.filter(F.split("path", "/"), lambda x: x != "")
    n = F.size("names")
    node = tracks.select(names.alias("names")).where(n > 0).select("names", F.explode(F.sequence(F.lit(1), n)).alias("depth"))
    node = node.select("names", "depth", (F.col("depth") == n).alias("is_file"), F.concat(F.lit("/"), F.array_join(F.slice("names", F.lit(1), F.col("depth")), "/")).alias("node"))
    hit = lambda name: F.contains(F.lower(name), F.lit(needle.lower()))
    own_or_above = F.exists(F.slice("names", F.lit(1), F.col("depth")), hit)
    below = F.exists("names", hit)  # a match further down this very path
    return node.where(own_or_above | below).select(F.col("node").alias("path"), "is_file").distinct()


def folder_references(tracks: DataFrame, folder: str, most: int | None = 400) -> DataFrame:
    """Tracks below a folder, by path; more than ``most`` are refused (None: any number)."""
    out = tracks.where(F.col("path").startswith(folder.rstrip("/") + "/")).orderBy("path")
    if most is not None and out.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} tracks below {folder}")
    return out


def analysis_worklist(lib: Library, models: Sequence[str], skip_wav: bool = True, skip_long: bool = True, force: bool = False, long_sec: float = 1200.0) -> DataFrame:
    """track_id and decision (wav, done, long or start) of every track.

    done: analysed, and each model covers every chunk. A null duration is never long.
    """
    total = lib.chunks.groupBy("track_id").agg(F.count(F.lit(1)).alias("total"))
    need = lib.spark.createDataFrame([(m,) for m in models], "model string")
    have = lib.track_vectors().join(F.broadcast(need), "model", "left_semi").groupBy("track_id", "model").agg(F.countDistinct("chunk_id").alias("n"))
    full = have.join(total, "track_id").where("n >= total").groupBy("track_id").agg(F.count(F.lit(1)).alias("covered")).where(F.col("covered") >= len(set(models))).select("track_id", F.lit(True).alias("full"))
    t = lib.tracks.join(full, "track_id", "left")
    wav = F.lit(skip_wav) & (F.lower("extension") == "wav")
    done = F.lit(not force) & (F.col("status") == "analyzed") & F.coalesce("full", F.lit(False))
    long = F.lit(skip_long and not force) & F.coalesce(F.col("duration_sec") > long_sec, F.lit(False))
    return t.select("track_id", F.when(wav, "wav").when(done, "done").when(long, "long").otherwise("start").alias("decision"))


# --- joins -------------------------------------------------------------------------------


def vector_rows(lib: Library, models: Sequence[str] | None = None) -> DataFrame:
    """The wide read: vector, chunk and track side by side."""
    v = _among(lib.vectors, "model", models)
    return v.join(lib.chunks, "chunk_id").join(lib.tracks.select("track_id", "path", "artist", "title"), "track_id")


def track_models(lib: Library) -> DataFrame:
    return lib.track_vectors().select("track_id", "model").distinct()


def playlist_rows(lib: Library, playlist_id: int | None = None) -> DataFrame:
    p = lib.playlist_items if playlist_id is None else lib.playlist_items.where(F.col("playlist_id") == playlist_id)
    return p.join(lib.tracks, "track_id").orderBy("playlist_id", "position")


def pair_rows(lib: Library) -> DataFrame:
    t = lib.tracks.select("track_id", "path")
    a, b = t.select(F.col("track_id").alias("track_a"), F.col("path").alias("path_a")), t.select(F.col("track_id").alias("track_b"), F.col("path").alias("path_b"))
    return lib.pairs.join(a, "track_a").join(b, "track_b").orderBy("pair_id")


def reduced_rows(lib: Library, reduction_id: int, track_id: int | None = None) -> DataFrame:
    """A reduction's vectors with their tracks; those of lost chunks drop out."""
    c = lib.chunks if track_id is None else lib.chunks.where(F.col("track_id") == track_id)
    return lib.reduced.where(F.col("reduction_id") == reduction_id).join(c, "chunk_id")


def sharing_candidates(lib: Library, seed: int) -> DataFrame:
    """Other tracks that share a model with the seed."""
    tm = track_models(lib)
    own = tm.where(F.col("track_id") == seed).select("model")
    return tm.where(F.col("track_id") != seed).join(own, "model", "left_semi").select("track_id").distinct()


def dataset_candidates(lib: Library, seed: int, model: str) -> DataFrame:
    return lib.track_vectors().where((F.col("model") == model) & (F.col("track_id") != seed)).select("track_id").distinct()


def without_noise(rows: DataFrame, noise: DataFrame) -> DataFrame:
    """Rows whose chunk carries no flag."""
    return rows.join(noise.select("chunk_id").distinct(), "chunk_id", "left_anti")


def cross_model_points(lib: Library, model_x: str, x: int, model_y: str, y: int) -> DataFrame:
    """One component of each of two models for the chunks that have both (numbers from 0)."""
    a = lib.vectors.where(F.col("model") == model_x).select("chunk_id", vectors.component("v", x).alias("x"))
    b = lib.vectors.where(F.col("model") == model_y).select("chunk_id", vectors.component("v", y).alias("y"))
    return a.join(b, "chunk_id").join(lib.chunks.select("chunk_id", "track_id"), "chunk_id")


def joint_vectors(lib: Library, models: Sequence[str]) -> DataFrame:
    """Vectors of several models side by side, for the chunks that have all of them."""
    names = sorted(set(models))
    have = F.sort_array(F.collect_list(F.struct("model", "v")))
    got = _among(lib.vectors, "model", names).groupBy("chunk_id").agg(have.alias("z")).where(F.size("z") == len(names))
    return got.select("chunk_id", F.flatten(F.transform("z", lambda z: z["v"])).alias("v"))


# --- counts ------------------------------------------------------------------------------


def model_counts(lib: Library, track_id: int | None = None) -> DataFrame:
    tv = lib.track_vectors()
    return (tv if track_id is None else tv.where(F.col("track_id") == track_id)).groupBy("track_id", "model").agg(F.count(F.lit(1)).alias("n"))


def vector_counts(lib: Library) -> DataFrame:
    return lib.vectors.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def coverage(lib: Library) -> DataFrame:
    """Per track and model: covered chunks, and all chunks of the track."""
    total = lib.chunks.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return lib.track_vectors().groupBy("track_id", "model").agg(F.countDistinct("chunk_id").alias("covered")).join(total, "track_id")


def fully_covered_models(lib: Library) -> DataFrame:
    """Per track, the first model (by name) that covers all of its chunks."""
    return coverage(lib).where("covered = n_chunks").groupBy("track_id").agg(F.min("model").alias("model"))


def signatures(track_vectors: DataFrame) -> DataFrame:
    """What tells a track's chunks from other ones: count, sum of ids, and a hash of the vectors."""
    return track_vectors.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("chunk_id").alias("chunk_sum"), F.sum(F.xxhash64("v").cast("decimal(38,0)")).alias("vector_sum")
    )


def dataset_picker(aggregates: DataFrame) -> DataFrame:
    """Datasets of centroids with the tracks each has; enabled from two on."""
    return aggregates.groupBy("model").agg(F.countDistinct("track_id").alias("n_tracks")).withColumn("enabled", F.col("n_tracks") >= 2)


def reduction_staleness(lib: Library, reduction_id: int, source_model: str) -> DataFrame:
    """Covered and current vector counts of a reduction; stale when it covers fewer."""
    now = lib.vectors.where(F.col("model") == source_model)
    have = lib.reduced.where(F.col("reduction_id") == reduction_id).join(now.select("chunk_id"), "chunk_id", "left_semi")
    a, b = have.agg(F.count(F.lit(1)).alias("covered")), now.agg(F.count(F.lit(1)).alias("current"))
    return a.crossJoin(b).withColumn("stale", F.col("covered") < F.col("current"))  # one row each


def track_description(lib: Library, most: int = 8) -> DataFrame:
    """Tags of each track by summed score: the ``most`` highest, ties by text."""
    s = lib.tags.join(lib.chunks.select("chunk_id", "track_id"), "chunk_id").groupBy("track_id", "text").agg(F.sum("score").alias("total"))
    rank = F.row_number().over(W.partitionBy("track_id").orderBy(F.col("total").desc(), "text"))
    top = s.withColumn("r", rank).where(F.col("r") <= most).groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("r", "text"))).alias("z"))
    return top.select("track_id", F.concat(F.lit("Music tags: "), F.array_join(F.transform("z", lambda z: z["text"]), ", ")).alias("description"))


def folder_progress(lib: Library, models: Sequence[str], excluded: Sequence[str] = ("wav",)) -> DataFrame:
    """Share of ready tracks below every folder, per model; excluded files don't count.

    A rollup along the path: each track explodes into the folders above it.
    """
    names = F.filter(F.split("path", "/"), lambda x: x != "")
    t = lib.tracks.where(~F.lower("extension").isin(*excluded)).select("track_id", names.alias("names")).where(F.size("names") > 1)
    above = F.transform(F.sequence(F.lit(1), F.size("names") - 1), lambda d: F.concat(F.lit("/"), F.array_join(F.slice("names", F.lit(1), d), "/")))
    ready = track_models(lib).withColumn("ready", F.lit(1))
    each = t.select("track_id", F.explode(above).alias("folder"), F.lit(0).alias("z"))
    each = each.withColumn("model", F.explode(F.array(*map(F.lit, models)))).join(ready, ["track_id", "model"], "left")
    out = each.groupBy("folder", "model").agg(F.count("ready").alias("ready"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("shown", F.concat(F.bround(F.col("ready") / F.col("total") * 100, 0).cast("int").cast("string"), F.lit("%")))


def throughput(tracks: DataFrame, elapsed_sec: float) -> DataFrame:
    """Minutes of audio per hour of wall time."""
    return tracks.agg((F.coalesce(F.sum("duration_sec"), F.lit(0.0)) / 60 / (elapsed_sec / 3600)).alias("min_per_hour"))


def noise_share(lib: Library) -> DataFrame:
    """Percent of a dataset's vectors that each method flags."""
    total = lib.vectors.groupBy(F.col("model").alias("dataset")).agg(F.count(F.lit(1)).alias("n_vectors"))
    n = lib.noise.groupBy("dataset", "method").agg(F.countDistinct("chunk_id").alias("n_noise")).join(total, "dataset")
    return n.withColumn("share", F.col("n_noise") / F.greatest(F.lit(1), F.col("n_vectors")) * 100)


# --- ranks, sets and state ---------------------------------------------------------------


def newest_runs(filters: DataFrame, dataset: str) -> DataFrame:
    """Per method the newest run of a dataset; ``auto`` looks at all datasets."""
    own = filters if dataset == "auto" else filters.where(F.col("dataset") == dataset)
    keys = ["method"] if dataset != "auto" else ["dataset", "method"]
    r = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("created_at").desc(), F.col("filter_id").desc()))
    return own.withColumn("r", r).where("r = 1").drop("r")


def noise_union(noise: DataFrame, dataset: str, methods: Sequence[str]) -> DataFrame:
    """Distinct flagged chunks of the methods; ``auto`` pools all datasets; no run, no rows."""
    own = noise.where(F.col("method").isin(list(methods))) if methods else noise.limit(0)
    return (own if dataset == "auto" else own.where(F.col("dataset") == dataset)).select("chunk_id").distinct()


def pending_tracks(stored: DataFrame, current: DataFrame, least_chunks: int = 6) -> DataFrame:
    """Tracks whose signature is new or differs from the stored one."""
    s = stored.select("track_id", *[F.col(c).alias(f"s_{c}") for c in ("n_chunks", "chunk_sum", "vector_sum")])
    both = current.where(F.col("n_chunks") >= least_chunks).join(s, "track_id", "left")
    same = F.col("n_chunks").eqNullSafe(F.col("s_n_chunks")) & F.col("chunk_sum").eqNullSafe(F.col("s_chunk_sum")) & F.col("vector_sum").eqNullSafe(F.col("s_vector_sum"))
    return both.where(~same).select("track_id")


def merge_flags(kept: DataFrame, stale: DataFrame, fresh: DataFrame) -> DataFrame:
    """Flags after a partial refit: the kept ones but for refitted chunks, and the fresh ones."""
    return kept.join(stale, "chunk_id", "left_anti").select("chunk_id").unionByName(fresh.select("chunk_id")).distinct()


def dedupe_tags(tags: DataFrame) -> DataFrame:
    """A candidate list (pos, tag) trimmed, without blanks, each name once in any case, in order."""
    t = tags.withColumn("tag", F.trim("tag")).where("tag != ''")
    r = F.row_number().over(W.partitionBy(F.lower("tag")).orderBy("pos"))
    return t.withColumn("r", r).where("r = 1").select("pos", "tag").orderBy("pos")


def weight_ranking(weights: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` highest and lowest components of every model (place from 1; negative from the end)."""
    up, down = W.partitionBy("model").orderBy(F.col("weight").desc(), "component_index"), W.partitionBy("model").orderBy("weight", F.col("component_index").desc())
    r = weights.withColumn("hi", F.row_number().over(up)).withColumn("lo", F.row_number().over(down))
    return r.where((F.col("hi") <= k) | (F.col("lo") <= k)).select("model", "component_index", "weight", F.when(F.col("hi") <= k, F.col("hi")).otherwise(-F.col("lo")).alias("place"))


def tree_order(nodes: DataFrame) -> DataFrame:
    """Folders before files, then by name without case, then by name."""
    return nodes.orderBy("is_file", F.lower("name"), "name")


def subsample(df: DataFrame, cap: int, id_column: str = "chunk_id") -> DataFrame:
    """A fixed sample of at most ``cap`` rows, by hash of the id, in id order."""
    return df.orderBy(F.md5(F.col(id_column).cast("string").cast("binary")), id_column).limit(cap).orderBy(id_column)


def nearest_point(points: DataFrame, x: float, y: float, radius: float = 10.0) -> DataFrame:
    d = F.hypot(F.col("x") - x, F.col("y") - y)
    return points.withColumn("d", d).where(F.col("d") <= radius).orderBy("d", "id").limit(1).select("id", "d")


def numbered(rows: DataFrame, order: str, name: str, buckets: int | None = None) -> DataFrame:
    """``rows`` with their place from 0 on in ``order`` (a number, each once, not null), numbered where
    they are: quantiles cut the range into buckets, each is numbered by itself, and starts after those
    before it. The driver holds a border and a count per bucket."""
    spark = rows.sparkSession
    n = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    borders = rows.agg(F.percentile_approx(order, [k / n for k in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    borders = sorted(set(borders)) if n > 1 else []
    bucket = reduce(lambda a, b: a + b, [(F.col(order) > b).cast("int") for b in borders], F.lit(0))
    dealt = rows.withColumn("_bucket", bucket)
    sizes = {r["_bucket"]: r["n"] for r in dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = [sum(sizes.get(j, 0) for j in range(k)) for k in range(len(borders) + 1)]
    own = F.row_number().over(W.partitionBy("_bucket").orderBy(order)) - 1
    return dealt.withColumn(name, own + F.element_at(F.array(*[F.lit(x).cast("bigint") for x in starts]), F.col("_bucket") + 1)).drop("_bucket")


def track_colors(points: DataFrame) -> DataFrame:
    """Colour number of each track, in order of its first point (``pos``, one track's alone)."""
    return numbered(points.groupBy("track_id").agg(F.min("pos").alias("first")), "first", "color").select("track_id", F.col("color").cast("int").alias("color"))


def dataset_tracks(have: DataFrame, seed: int | None = None) -> DataFrame:
    """Per dataset of ``have`` (track_id, model): its number of tracks, and whether the seed is one."""
    own = F.lit(False) if seed is None else F.coalesce(F.bool_or(F.col("track_id") == seed), F.lit(False))
    return have.groupBy("model").agg(F.countDistinct("track_id").alias("n_tracks"), own.alias("has_seed"))


def resolve_dataset(have: DataFrame, order: Sequence[str] = MODEL_ORDER, seed: int | None = None, wanted: str = "auto") -> str:
    """The dataset that a search by centroids uses, of those in ``have`` (track_id, model).

    ``auto`` takes a text dataset first, then models in order, then others by name; reductions never.
    A dataset needs two tracks, the seed among them where there is one. A dataset that is named must
    fulfil that too (a reduction or text dataset needs two tracks; what its seed lacks the search says).
    ValueError if none does.
    """
    kind = Dataset(wanted).kind
    if kind == "reduction" and not wanted[4:].isdigit():
        raise ValueError(f"unknown reduction {wanted!r}")
    if kind != "auto":
        have = have.where(F.col("model") == wanted)
    fit = {r["model"]: r["has_seed"] for r in dataset_tracks(have, seed).where("n_tracks >= 2").collect()}  # a row per dataset
    if kind == "model" and seed is not None:
        fit = {m: own for m, own in fit.items() if own}
    if kind != "auto":
        if wanted not in fit:
            raise ValueError(f"dataset {wanted!r} can't be compared: it needs two analysed tracks" + (f", track {seed} among them" if seed is not None and kind == "model" else ""))
        return wanted
    usable = [m for m, own in fit.items() if (own or seed is None) and not m.startswith("red:")]
    text = sorted(m for m in usable if m.startswith("ollama:"))
    named = [*text, *(m for m in order if m in usable), *sorted(m for m in usable if m not in order and m not in text)]
    if not named:
        raise ValueError("no dataset has two tracks" + (f", track {seed} among them" if seed is not None else ""))
    return named[0]


def dataset_choices(models: Sequence[tuple[str, str]], lib: Library, aggregates: DataFrame, reductions: DataFrame) -> DataFrame:
    """Rows of a dataset picker: place, dataset, title, n_tracks, enabled, outdated.

    Registered models (name, title) in their order, enabled where there are chunk vectors; reductions,
    outdated where they cover fewer vectors than their model has now; then text datasets by name.
    """
    spark = lib.spark
    counts = dataset_tracks(aggregates).select(F.col("model").alias("dataset"), "n_tracks")
    now = lib.vectors.groupBy("model").agg(F.count(F.lit(1)).alias("current"))
    known = spark.createDataFrame([(k, *m) for k, m in enumerate(models)], "n bigint, dataset string, title string")
    first = known.join(now.withColumnRenamed("model", "dataset"), "dataset", "left").select(F.lit(0).alias("g"), "n", "dataset", "title", F.col("current").isNotNull().alias("enabled"), F.lit(False).alias("outdated"))
    alive = lib.reduced.join(lib.vectors.select("chunk_id", "model"), "chunk_id").join(reductions.select("reduction_id", F.col("source_model").alias("model")), ["reduction_id", "model"], "left_semi")
    covered = alive.groupBy("reduction_id").agg(F.countDistinct("chunk_id").alias("covered"))
    red = reductions.join(covered, "reduction_id", "left").join(now.withColumnRenamed("model", "source_model"), "source_model", "left")
    late = F.coalesce("covered", F.lit(0)) < F.coalesce("current", F.lit(0))
    second = red.select(F.lit(1).alias("g"), F.col("reduction_id").alias("n"), F.concat(F.lit("red:"), F.col("reduction_id").cast("string")).alias("dataset"), F.col("name").alias("title"), F.lit(True).alias("enabled"), late.alias("outdated"))
    text = counts.where(F.startswith("dataset", F.lit("ollama:")))
    third = text.select(F.lit(2).alias("g"), F.lit(0).cast("bigint").alias("n"), "dataset", F.concat(F.lit("Description ("), F.substr("dataset", F.lit(8)), F.lit(")")).alias("title"), F.lit(True).alias("enabled"), F.lit(False).alias("outdated"))
    rows = first.unionByName(second).unionByName(third).join(counts, "dataset", "left")
    place = F.row_number().over(W.orderBy("g", "n", "dataset"))  # a row per dataset
    return rows.select(place.alias("place"), "dataset", "title", F.coalesce("n_tracks", F.lit(0)).alias("n_tracks"), "enabled", "outdated")


def chunk_grid(lib: Library) -> DataFrame:
    """Per chunk: span, tags by model, and the first four components of every model's vector."""
    tag = lib.tags.groupBy("chunk_id", "model").agg(F.sort_array(F.collect_list(F.struct(-F.col("score"), "text", scalars.log_score("score").alias("shown")))).alias("z"))
    tag = tag.select("chunk_id", F.concat("model", F.lit(": "), F.array_join(F.transform("z", lambda z: F.concat(z["text"], F.lit(" "), z["shown"])), ", ")).alias("t"))
    tag = tag.groupBy("chunk_id").agg(F.array_join(F.sort_array(F.collect_list("t")), "; ").alias("tags"))
    vec = lib.vectors.select("chunk_id", F.concat("model", F.lit(" "), vector_preview("v")).alias("p")).groupBy("chunk_id").agg(F.array_join(F.sort_array(F.collect_list("p")), " | ").alias("previews"))
    out = lib.chunks.join(tag, "chunk_id", "left").join(vec, "chunk_id", "left")
    return out.select("track_id", "chunk_id", "idx", F.format_string("%.2f s", F.col("start_sec")).alias("start"), F.format_string("%.2f s", F.col("end_sec")).alias("end"), F.coalesce("tags", F.lit("—")).alias("tags"), F.coalesce("previews", F.lit("⚠")).alias("previews"))


def vector_preview(v: str | Column) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    head = F.transform(F.slice(v, 1, 4), lambda x: F.format_string("%+.3f", x))
    return F.concat(F.lit("dim="), F.size(v).cast("string"), F.lit(" ["), F.array_join(head, ", "), F.lit(", …]"))


def noise_tint(lib: Library) -> DataFrame:
    """hdbscan, optics or both for every flagged chunk, over all datasets."""
    n = lib.noise.groupBy("chunk_id").agg(F.array_sort(F.collect_set("method")).alias("m"))
    return n.select("chunk_id", F.when(F.size("m") > 1, "both").otherwise(F.col("m")[0]).alias("tint"))


def reduction_caps(lib: Library, tsne: int = 15_000, umap: int = 200_000) -> DataFrame:
    """Which reductions a dataset's size allows."""
    return vector_counts(lib).select("model", "n", F.lit(True).alias("pca"), (F.col("n") <= tsne).alias("tsne"), (F.col("n") <= umap).alias("umap"))
