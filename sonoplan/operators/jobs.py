"""Jobs that change a library: analysis, reductions, noise runs, aggregates, learned weights.

A job takes the relations as a dict (``Store.tables``) and returns those that it changes; the
caller stores them with ``Store.put``, which swaps all at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import plugins
from ..plans.library import Library
from ..schema import Dataset
from ..sources import audio
from ..sources.store import Store
from . import changes, derive, noise, reads, similarity

Tables = dict[str, DataFrame]


def dataset_rows(tables: Tables, dataset: str) -> DataFrame:
    """track_id, chunk_id, v of a model or a reduction; vectors of lost chunks drop out."""
    d, chunks = Dataset(dataset), tables["chunks"].select("chunk_id", "track_id")
    rows = tables["vectors"].where(F.col("model") == dataset) if d.kind == "model" else tables["reduced"].where(F.col("reduction_id") == d.reduction_id)
    return rows.join(chunks, "chunk_id").select("track_id", "chunk_id", "v")


# --- aggregates and weights --------------------------------------------------------------


def refresh_centroids(tables: Tables, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Centroids of every model that tracks have vectors of, and, with ``embed``, the vectors that it
    gives to (track_id, text) of the descriptions. Aggregates of other datasets stay as they are."""
    fresh = similarity.centroids(Library.of(tables).track_vectors())
    if embed is not None:
        texts = tables["tracks"].where("description IS NOT NULL AND trim(description) != ''").select("track_id", F.col("description").alias("text"))
        fresh = fresh.unionByName(embed(texts).select("track_id", "model", "v"))
    old = tables["centroids"].select("track_id", "model", "v").join(tables["tracks"].select("track_id"), "track_id", "left_semi")
    return changes.replace_rows(old, fresh, ["track_id", "model"])


def learn_and_store(tables: Tables, model: str) -> tuple[Tables, dict]:
    """Weights of a model from the stored pairs, and how many pairs were used or had no centroid."""
    own = tables["centroids"].where(F.col("model") == model).select("track_id", "v")
    pairs = changes.canonical_pairs(tables["pairs"])
    known = own.select("track_id")
    used = pairs.join(known.withColumnRenamed("track_id", "track_a"), "track_a", "left_semi").join(known.withColumnRenamed("track_id", "track_b"), "track_b", "left_semi")
    stored, n = pairs.count(), used.count()
    if not stored:
        raise ValueError("there are no pairs to learn from")
    if not n:
        raise ValueError(f"no pair has centroids of {model!r}")
    w = derive.learn_weights(used, own).select(F.lit(model).alias("model"), "component_index", "weight")
    kept = tables["weights"].where(F.col("model") != model)
    return {"weights": kept.unionByName(w.select(*kept.columns))}, {"model": model, "pairs_stored": stored, "pairs_used": n, "pairs_missing": stored - n}


# --- reductions --------------------------------------------------------------------------


def reduce_dataset(tables: Tables, name: str, source_model: str, method: str, k: int, refresh: int | None = None, **options) -> tuple[Tables, int]:
    """Fits a reduction and stores its vectors, centroids and result; ``refresh`` keeps that id."""
    rows = dataset_rows(tables, source_model).select("chunk_id", "v")
    reductions, i = changes.put_reduction(tables["reductions"], name, source_model, method, options, k, refresh)
    out, shares = derive.reduce_rows(rows, method, k, **options)
    reduced = tables["reduced"]
    vectors = out.select(F.lit(i).cast("bigint").alias("reduction_id"), "chunk_id", "v")
    changed = tables | {"reduced": reduced.select("reduction_id", "chunk_id", "v").where(F.col("reduction_id") != i).unionByName(vectors)}
    dataset = f"red:{i}"
    fresh = similarity.centroids(dataset_rows(changed, dataset).withColumn("model", F.lit(dataset)))
    changed["centroids"] = tables["centroids"].where(F.col("model") != dataset).select("track_id", "model", "v").unionByName(fresh)
    changed["reductions"] = changes.reduction_result(reductions, i, out.count(), shares or None)
    return {n: changed[n] for n in ("reductions", "reduced", "centroids")}, i


# --- noise runs --------------------------------------------------------------------------


def noise_run(tables: Tables, dataset: str, method: str) -> Tables:
    """A full run over a dataset, song by song; replaces the run before."""
    rows = dataset_rows(tables, dataset)
    flags, signatures = noise.fit(rows, dataset, method, most=None), reads.signatures(rows)
    return _noise_tables(changes.store_noise_run(tables, dataset, method, flags, signatures.where(F.col("n_chunks") >= noise.LEAST_TRACK_CHUNKS), n_vectors=rows.count()))


def noise_sweep(tables: Tables, method: str) -> Tables:
    """Fits the pending tracks of every dataset that has a run of the method; others' flags stay."""
    out = tables
    for r in tables["noise_filters"].where(F.col("method") == method).select("dataset").distinct().collect():  # one row per dataset
        rows = dataset_rows(out, r["dataset"])
        mine = (F.col("dataset") == r["dataset"]) & (F.col("method") == method)
        todo = noise.pending(rows, out["noise_run_tracks"].where(mine))
        if todo.isEmpty():
            continue
        flags = noise.refit(rows, out["noise"].where(mine).select("chunk_id"), todo, method)
        signed = reads.signatures(rows.join(todo, "track_id", "left_semi"))
        out = changes.store_noise_run(out, r["dataset"], method, flags, signed, n_vectors=rows.count(), in_place=True)
    return _noise_tables(out)


def _noise_tables(tables: Tables) -> Tables:
    return {n: tables[n] for n in ("noise_filters", "noise", "noise_run_tracks")}


# --- analysis ----------------------------------------------------------------------------


def analyze(tables: Tables, files: DataFrame, models: Sequence[str], seconds: float = 20.0, overlap_percent: float = 50.0, force: bool = False, options: dict | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, held: list[DataFrame] | None = None) -> Tables:
    """Analyses the tracks of ``files`` (track_id, path, content, mtime, size), all in one set of plans.

    A track whose file and chunk plan are as stored keeps its chunks, and models that cover them
    are skipped (unless ``force``); else its chunks are replaced and all that hangs on them goes.
    Tags give the description. A track ends ``analyzed`` if some model covers all its chunks, else
    ``error`` with what went wrong; one track's failure doesn't stop the others.

    Samples are decoded and embedded once and kept on the executors until the caller is done: what
    is kept is added to ``held``, to be released (``analyze_into`` does so). Ids and plans are settled on
    keys alone; samples meet nothing but the tracks that need no work.
    """
    held = [] if held is None else held
    f = files.select("track_id", "path", "content", F.col("mtime").alias("new_mtime"), F.col("size").alias("new_size"))
    decoded = audio.decode_chunks(f, seconds, overlap_percent, keep=["track_id", "new_mtime", "new_size"]).persist()
    held.append(decoded)
    failed = decoded.where("error IS NOT NULL").select("track_id", F.concat(F.lit("Decode failed: "), "error").alias("problem"))
    good = decoded.where("error IS NULL")
    empty = f.join(decoded.select("track_id"), "track_id", "left_anti").select("track_id", F.lit("the file has no samples").alias("problem"))

    stored = tables["chunks"].join(f.select("track_id"), "track_id", "left_semi")
    t = tables["tracks"].select("track_id", "source_mtime", "source_size").join(f.select("track_id", "new_mtime", "new_size"), "track_id")
    stable = F.col("source_mtime").isNull() | ((F.abs(F.col("source_mtime") - F.col("new_mtime")) < 1e-6) & (F.col("source_size").isNull() | (F.col("source_size") == F.col("new_size"))))
    same = audio.same_plan(stored, good).where("same").join(t.where(stable).select("track_id"), "track_id", "left_semi").select("track_id")
    # New ids where chunks are replaced: what hung on the old ones must not seem to hang on these.
    fresh = F.abs(F.xxhash64("track_id", "idx", "start_sec", "end_sec", "new_mtime", "new_size", F.lit("chunk")))
    old = stored.join(same, "track_id", "left_semi").select("track_id", "idx", F.col("chunk_id").alias("old_id"))
    samples = good.withColumn("chunk_id", fresh)
    keys = samples.select(F.col("chunk_id").alias("new_id"), "track_id", "idx", "start_sec", "end_sec").join(old, ["track_id", "idx"], "left").withColumn("chunk_id", F.coalesce("old_id", "new_id"))
    named = keys.select("new_id", "chunk_id")
    chunks = keys.select("chunk_id", "track_id", "idx", "start_sec", "end_sec")
    lost = stored.join(same, "track_id", "left_anti").select("chunk_id")
    vectors = changes.without(tables["vectors"].select("chunk_id", "model", "v"), lost, "chunk_id")
    tags = changes.without(tables["tags"], lost, "chunk_id")

    notes = [failed, empty]
    total = chunks.groupBy("track_id").agg(F.count(F.lit(1)).alias("total"))
    for name in models:
        try:
            plugin = plugins.get_plugin(name)
        except KeyError:
            notes.append(f.select("track_id", F.lit(f"unknown model {name!r} skipped").alias("problem")))
            continue
        if not plugin.is_available():
            notes.append(f.select("track_id", F.lit(f"{plugin.title} unavailable ({plugin.availability_error()})").alias("problem")))
            continue
        plugin.apply_config(options or {})
        have = vectors.where(F.col("model") == name).join(chunks, "chunk_id").groupBy("track_id").agg(F.countDistinct("chunk_id").alias("n"))
        done = have.join(total, "track_id").where("n >= total").select("track_id") if not force else have.limit(0).select("track_id")
        todo = samples.join(done, "track_id", "left_anti")
        made = plugins.embed_chunks(todo, plugin, errors=True).persist()
        held.append(made)
        made = made.withColumnRenamed("chunk_id", "new_id").join(named, "new_id").drop("new_id")
        broken = made.where("error IS NOT NULL").join(chunks, "chunk_id").groupBy("track_id").agg(F.concat(F.lit(f"{plugin.title} failed: "), F.min("error")).alias("problem"))
        notes.append(broken)
        vectors = changes.replace_rows(vectors, made.where("error IS NULL").select("chunk_id", "model", "v"), ["chunk_id", "model"])
        if plugin.describes:
            new = plugins.describe_chunks(todo.join(broken, "track_id", "left_anti"), plugin)
            new = new.withColumnRenamed("chunk_id", "new_id").join(named, "new_id").drop("new_id")
            tags = changes.replace_rows(tags, new.select(*tags.columns), ["chunk_id", "model"])

    out = tables | {"chunks": changes.replace_rows(tables["chunks"], chunks.select(*tables["chunks"].columns), ["track_id"]), "vectors": vectors, "tags": tags}
    for name, key in (("reduced", "chunk_id"), ("noise", "chunk_id")):
        if name in tables:
            out[name] = changes.without(tables[name], lost, key)
    covered = vectors.join(chunks, "chunk_id").groupBy("track_id", "model").agg(F.countDistinct("chunk_id").alias("n")).join(total, "track_id").where("n >= total").select("track_id").distinct()
    message = notes[0]
    for n in notes[1:]:
        message = message.unionByName(n)
    message = message.groupBy("track_id").agg(F.array_join(F.sort_array(F.collect_set("problem")), "; ").alias("status_message"))
    ends = samples.groupBy("track_id").agg(F.max("end_sec").alias("duration_sec"), F.first("rate").alias("sample_rate"))
    described = reads.track_description(Library.of(out | {"tags": tags.join(chunks.select("chunk_id"), "chunk_id", "left_semi")}))
    news = f.select("track_id", F.col("new_mtime").alias("source_mtime"), F.col("new_size").alias("source_size")).join(ends, "track_id", "left")
    news = news.join(covered.withColumn("ok", F.lit(True)), "track_id", "left").join(message, "track_id", "left").join(described, "track_id", "left")
    tracks, mine = tables["tracks"], news.select("track_id", *[F.col(c).alias(f"n_{c}") for c in news.columns if c != "track_id"], F.lit(True).alias("mine"))
    both = tracks.join(mine, "track_id", "left")
    ok = F.coalesce("n_ok", F.lit(False))
    value = {
        "status": F.when(ok, "analyzed").otherwise("error"), "status_message": F.col("n_status_message"), "description": F.coalesce("n_description", "description"),
        "source_mtime": F.col("n_source_mtime"), "source_size": F.col("n_source_size"), "duration_sec": F.coalesce("n_duration_sec", "duration_sec"),
        "sample_rate": F.coalesce("sample_rate", "n_sample_rate"), "last_analyzed_at": F.when(ok, F.current_timestamp()).otherwise(F.col("last_analyzed_at")),
    }
    out["tracks"] = both.select(*[F.when(F.col("mine"), value[c]).otherwise(F.col(c)).cast(dict(tracks.dtypes)[c]).alias(c) if c in value else F.col(c) for c in tracks.columns])
    out["centroids"] = refresh_centroids(out, embed)
    return {n: out[n] for n in ("tracks", "chunks", "vectors", "tags", "reduced", "noise", "centroids") if n in out}


def analyze_into(store: Store, files: DataFrame, models: Sequence[str], *args, **options) -> None:
    """``analyze`` with its result stored as one commit; what it kept on the executors is released, come what may."""
    held: list[DataFrame] = []
    try:
        store.put(analyze(store.tables(), files, models, *args, **options, held=held))
    finally:
        for df in held:
            df.unpersist()
