"""State changes as new table versions: upserts, replacements, cascades.

Each function returns the rows that a table has after the change; sources.store swaps them in
atomically. Nothing is updated in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def path_id(path: str | Column) -> Column:
    """A stable id from a path."""
    return F.abs(F.xxhash64(path))


def add_folders(folders: DataFrame, paths: DataFrame) -> DataFrame:
    """Folders with new paths appended; known ones are left alone."""
    new = paths.select("path").distinct().join(folders.select("path"), "path", "left_anti")
    new = new.select(path_id("path").alias("folder_id"), "path", F.current_timestamp().alias("added_at"))
    return folders.unionByName(new)


def upsert(stored: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``stored`` with the non-null values of ``new``, and the new rows; columns that
    ``stored`` doesn't know are ignored."""
    values = [c for c in stored.columns if c not in key]
    known = [c for c in values if c in new.columns]
    n = new.select(*key, *[F.col(c).alias(f"new_{c}") for c in known])
    both = stored.join(n, list(key), "full")
    return both.select(*key, *[F.coalesce(f"new_{c}", c).alias(c) if c in known else F.col(c) for c in values]).select(*stored.columns)


def replace_rows(stored: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """All rows whose key occurs in ``new`` give way to the rows of ``new``."""
    return stored.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new.select(*stored.columns))


def latest(rows: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    """The last writer of each key wins."""
    r = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_r", r).where("_r = 1").drop("_r")


def missing(stored: DataFrame, seen: DataFrame, folder_id: int | None = None) -> DataFrame:
    """Tracks (of a folder) whose path wasn't seen."""
    own = stored if folder_id is None else stored.where(F.col("folder_id") == folder_id)
    return own.join(seen.select("path").distinct(), "path", "left_anti")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A cascade step: dependents of ``gone`` go too."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def remove_tracks(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Deletes tracks with all that hangs on them; playlists lose only their seed."""
    out = dict(tables)
    chunks = tables["chunks"].join(gone.select("track_id").distinct(), "track_id", "left_semi").select("chunk_id")
    for name in ("tracks", "chunks", "centroids", "playlist_items", "noise_run_tracks"):
        if name in out:
            out[name] = without(out[name], gone, "track_id")
    for name in ("vectors", "tags", "reduced", "noise"):
        if name in out:
            out[name] = without(out[name], chunks, "chunk_id")
    if "pairs" in out:
        for side in ("track_a", "track_b"):
            out["pairs"] = without(out["pairs"], gone.select(F.col("track_id").alias(side)), side)
    if "playlists" in out:
        lost = gone.select(F.col("track_id").alias("seed_track_id"), F.lit(True).alias("lost")).distinct()
        p = out["playlists"].join(lost, "seed_track_id", "left")
        out["playlists"] = p.withColumn("seed_track_id", F.when(F.col("lost").isNull(), F.col("seed_track_id"))).select(*out["playlists"].columns)
    return out


def remove_folder(tables: dict[str, DataFrame], folder_id: int) -> dict[str, DataFrame]:
    out = remove_tracks(tables, tables["tracks"].where(F.col("folder_id") == folder_id))
    if "folders" in out:
        out["folders"] = out["folders"].where(F.col("folder_id") != folder_id)
    return out


def clear_analysis(tables: dict[str, DataFrame], track_id: int) -> dict[str, DataFrame]:
    """Takes a track's chunks, vectors, tags and aggregates; status new, texts null; the time of
    the last analysis stays."""
    one = tables["tracks"].where(F.col("track_id") == track_id)
    out = remove_tracks({k: v for k, v in tables.items() if k not in ("tracks", "playlists", "playlist_items", "pairs")}, one)
    out |= {k: tables[k] for k in ("playlists", "playlist_items", "pairs") if k in tables}
    own = F.col("track_id") == track_id
    t = tables["tracks"]
    for c, v in (("status", F.lit("new")), ("status_message", F.lit(None)), ("description", F.lit(None))):
        if c in t.columns:
            t = t.withColumn(c, F.when(own, v.cast("string")).otherwise(F.col(c)))
    return out | {"tracks": t}


def set_status(tracks: DataFrame, track_id: int, status: str, message: str | None = None) -> DataFrame:
    """A status, and its message; ``analyzed`` stamps the time."""
    if status not in ("new", "analyzing", "analyzed", "error"):
        raise ValueError(f"unknown status {status!r}")
    own = F.col("track_id") == track_id
    out = tracks.withColumn("status", F.when(own, status).otherwise(F.col("status"))).withColumn("status_message", F.when(own, F.lit(message).cast("string")).otherwise(F.col("status_message")))
    if status == "analyzed" and "last_analyzed_at" in tracks.columns:
        out = out.withColumn("last_analyzed_at", F.when(own, F.current_timestamp()).otherwise(F.col("last_analyzed_at")))
    return out


def add_pair(pairs: DataFrame, a: int, b: int) -> DataFrame:
    """A pair in either order is one pair; a track with itself is refused."""
    if a == b:
        raise ValueError("a pair needs two tracks")
    new = pairs.sparkSession.createDataFrame([(a, b)], "track_a bigint, track_b bigint")
    last = pairs.agg(F.coalesce(F.max("pair_id"), F.lit(0)).alias("m"))
    return canonical_pairs(pairs.unionByName(new.crossJoin(last).select((F.col("m") + 1).alias("pair_id"), "track_a", "track_b")))  # one row


def canonical_pairs(pairs: DataFrame) -> DataFrame:
    """Undirected pairs once each, the first id; no track with itself."""
    p = pairs.where("track_a != track_b").select("pair_id", F.least("track_a", "track_b").alias("track_a"), F.greatest("track_a", "track_b").alias("track_b"))
    return p.groupBy("track_a", "track_b").agg(F.min("pair_id").alias("pair_id")).select("pair_id", "track_a", "track_b")


def next_id(rows: DataFrame, column: str) -> int:
    return (rows.agg(F.max(column)).first()[0] or 0) + 1


def _row(like: DataFrame, **values) -> DataFrame:
    """One row with the columns of ``like``; those not given are null."""
    return like.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) if not isinstance(values.get(f.name), Column) else values[f.name].alias(f.name) for f in like.schema])


# --- playlists ---------------------------------------------------------------------------


def create_playlist(playlists: DataFrame, name: str, seed_track_id: int | None = None, method: str | None = None) -> tuple[DataFrame, int]:
    i = next_id(playlists, "playlist_id")
    return playlists.unionByName(_row(playlists, playlist_id=i, name=name, created_at=F.current_timestamp(), seed_track_id=seed_track_id, method=method)), i


def replace_items(items: DataFrame, playlist_id: int, new: DataFrame) -> DataFrame:
    """``new`` (track_id, similarity, ord) as the items of a playlist, at places 1, 2, ... by ``ord``."""
    place = F.row_number().over(W.orderBy("ord"))  # the items of one playlist
    new = new.select(F.lit(playlist_id).cast("bigint").alias("playlist_id"), "track_id", place.alias("position"), "similarity")
    return items.where(F.col("playlist_id") != playlist_id).unionByName(new.select(*items.columns))


def delete_playlist(tables: dict[str, DataFrame], playlist_id: int) -> dict[str, DataFrame]:
    return tables | {k: tables[k].where(F.col("playlist_id") != playlist_id) for k in ("playlists", "playlist_items") if k in tables}


# --- reductions and noise runs -----------------------------------------------------------


def put_reduction(reductions: DataFrame, name: str, source_model: str, method: str, params: dict, n_components: int, reduction_id: int | None = None) -> tuple[DataFrame, int]:
    """A new reduction, or a known one overwritten under its id; a name that another has is refused."""
    import json

    if not reductions.where((F.col("name") == name) & (F.col("reduction_id") != (reduction_id or -1))).isEmpty():
        raise ValueError(f"a dataset named {name!r} already exists")
    values = {"name": name, "method": method, "params": json.dumps(params, ensure_ascii=False), "n_components": n_components}
    if reduction_id is None:
        i = next_id(reductions, "reduction_id")
        return reductions.unionByName(_row(reductions, reduction_id=i, source_model=source_model, created_at=F.current_timestamp(), **values)), i
    own = F.col("reduction_id") == reduction_id
    return reductions.withColumns({k: F.when(own, F.lit(v)).otherwise(F.col(k)).cast(dict(reductions.dtypes)[k]) for k, v in values.items()}), reduction_id


def reduction_result(reductions: DataFrame, reduction_id: int, n_vectors: int, explained: Sequence[float] | None) -> DataFrame:
    import json

    own, shares = F.col("reduction_id") == reduction_id, None if explained is None else json.dumps([float(x) for x in explained])
    return reductions.withColumn("n_vectors", F.when(own, F.lit(n_vectors)).otherwise(F.col("n_vectors"))).withColumn("explained_variance", F.when(own, F.lit(shares).cast("string")).otherwise(F.col("explained_variance")))


def delete_reduction(tables: dict[str, DataFrame], reduction_id: int) -> dict[str, DataFrame]:
    """Takes its vectors, the centroids made from them and its noise runs along."""
    out, dataset = dict(tables), f"red:{reduction_id}"
    keep = {"reductions": F.col("reduction_id") != reduction_id, "reduced": F.col("reduction_id") != reduction_id, "centroids": F.col("model") != dataset}
    keep |= dict.fromkeys(("noise_filters", "noise", "noise_run_tracks"), F.col("dataset") != dataset)
    return out | {k: out[k].where(c) for k, c in keep.items() if k in out}


def store_noise_run(tables: dict[str, DataFrame], dataset: str, method: str, flags: DataFrame, signatures: DataFrame, params: str = "{}", n_vectors: int = 0, in_place: bool = False) -> dict[str, DataFrame]:
    """A run of a method over a dataset: its flags (chunk_id) replace the former ones, and the tracks
    it saw (``signatures``) are recorded. ``in_place`` keeps the id and the other tracks' records."""
    other = (F.col("dataset") != dataset) | (F.col("method") != method)
    mine = lambda df: df.select(F.lit(dataset).alias("dataset"), F.lit(method).alias("method"), *df.columns)
    flags, filters, runs = flags.select("chunk_id").distinct(), tables["noise_filters"], tables["noise_run_tracks"]
    old = filters.where(~other).agg(F.max("filter_id")).first()[0]
    i = old if in_place and old is not None else next_id(filters, "filter_id")
    row = _row(filters, filter_id=i, dataset=dataset, method=method, params=params, n_vectors=n_vectors, created_at=F.current_timestamp())
    row = row.drop("n_noise").crossJoin(flags.agg(F.count(F.lit(1)).alias("n_noise"))).select(*filters.columns)  # one row each
    seen = mine(signatures.select("track_id", "n_chunks", "chunk_sum", "vector_sum")).select(*[F.col(f.name).cast(f.dataType) for f in runs.schema])
    kept = runs.where(other) if not in_place else runs.where(other).unionByName(runs.where(~other).join(signatures.select("track_id"), "track_id", "left_anti").select(*runs.columns))
    return tables | {"noise_filters": filters.where(other).unionByName(row), "noise": tables["noise"].where(other).unionByName(mine(flags)), "noise_run_tracks": kept.unionByName(seen)}


def delete_noise_run(tables: dict[str, DataFrame], dataset: str, method: str) -> dict[str, DataFrame]:
    other = (F.col("dataset") != dataset) | (F.col("method") != method)
    return tables | {k: tables[k].where(other) for k in ("noise_filters", "noise", "noise_run_tracks") if k in tables}


def put_setting(settings: DataFrame, key: str, value: str) -> DataFrame:
    new = settings.sparkSession.createDataFrame([(key, value)], "key string, value string")
    return replace_rows(settings, new, ["key"])


def get_setting(settings: DataFrame, key: str, default: str | None = None) -> str | None:
    r = settings.where(F.col("key") == key).select("value").first()
    return default if r is None else r["value"]


def save_text_models(settings: DataFrame, models: Sequence[str]) -> DataFrame:
    import json

    return put_setting(settings, "ollama_models", json.dumps(list(models)))


def text_models(settings: DataFrame) -> list[str]:
    """The stored list of text models; what isn't a JSON list reads as empty."""
    r = settings.where("key = 'ollama_models'").select(F.coalesce(F.from_json("value", "array<string>"), F.array().cast("array<string>")).alias("m")).first()
    return list(r["m"]) if r else []
