"""Relations of a chunk-vector library, as Spark schemas, and the values that name datasets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Model names in the order in which "auto" prefers them, with the size of their vectors.
MODEL_DIMS = {"clap": 512, "mert": 768, "mert330": 1024, "m2dclap": 768, "muq": 1024, "muqlan": 512, "lpmc": 768, "qwen2audio": 1280, "openl3": 512, "fft": 40}
MODEL_ORDER = tuple(MODEL_DIMS)
AUDIO_EXTENSIONS = (".mp3", ".wav", ".flac", ".ape", ".aac", ".m4a")

_L, _S, _D, _I, _TS = T.LongType(), T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampType()
_V = T.ArrayType(T.FloatType(), False)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SCHEMAS: dict[str, T.StructType] = {
    "folders": _schema(folder_id=_L, path=_S, added_at=_TS),
    "tracks": _schema(
        track_id=_L, folder_id=_L, path=_S, filename=_S, extension=_S, container=_S, codec=_S, title=_S, artist=_S, album=_S, genre=_S, year=_S, track_no=_S,
        size_bytes=_L, mtime=_D, duration_sec=_D, bitrate_kbps=_D, sample_rate=_I, channels=_I, bit_depth=_I, status=_S, status_message=_S, description=_S,
        source_size=_L, source_mtime=_D, last_analyzed_at=_TS,
    ),
    "chunks": _schema(chunk_id=_L, track_id=_L, idx=_I, start_sec=_D, end_sec=_D),
    "vectors": _schema(chunk_id=_L, model=_S, dim=_I, vector=_V, norm=_D, created_at=_TS),
    "tags": _schema(chunk_id=_L, model=_S, text=_S, score=_D),
    "centroids": _schema(track_id=_L, model=_S, dim=_I, vector=_V, norm=_D, created_at=_TS),
    "playlists": _schema(playlist_id=_L, name=_S, created_at=_TS, seed_track_id=_L, method=_S),
    "playlist_items": _schema(playlist_id=_L, track_id=_L, position=_I, similarity=_D),
    "settings": _schema(key=_S, value=_S),
    "reductions": _schema(reduction_id=_L, name=_S, source_model=_S, method=_S, params=_S, n_components=_I, n_vectors=_L, explained_variance=_S, source_version=_L, created_at=_TS),
    "reduced_vectors": _schema(reduction_id=_L, chunk_id=_L, dim=_I, vector=_V, norm=_D, created_at=_TS),
    "noise_filters": _schema(filter_id=_L, dataset=_S, method=_S, params=_S, n_vectors=_L, n_noise=_L, created_at=_TS),
    "noise_chunks": _schema(dataset=_S, method=_S, chunk_id=_L),
    "noise_run_tracks": _schema(dataset=_S, method=_S, track_id=_L, n_chunks=_L, chunk_sum=_L, vector_sum=T.DecimalType(38, 0)),
    "learning_pairs": _schema(pair_id=_L, track_a=_L, track_b=_L),
    "learning_weights": _schema(model=_S, component_index=_I, weight=_D),
}


@dataclass(frozen=True)
class Dataset:
    """What a search ranks by: a model, a reduction ``red:<id>``, a text model ``ollama:<model>`` or ``auto``."""

    name: str

    @property
    def kind(self) -> str:
        head, sep, _ = self.name.partition(":")
        return {"red": "reduction", "ollama": "text"}.get(head, "model") if sep else "auto" if self.name == "auto" else "model"

    @property
    def reduction_id(self) -> int | None:
        return int(self.name[4:]) if self.kind == "reduction" else None

    @property
    def weighted(self) -> bool:
        """Learned weights belong to plain models alone."""
        return self.kind == "model"


#: Former method names: (dataset, algorithm).
LEGACY_ALGORITHMS = {"pareto": "pareto", "psvi": "pareto", "emd": "emd", "chamfer": "chamfer"}


def split_legacy(method: str) -> tuple[str, str]:
    """A method string that names either an algorithm (then dataset auto) or a dataset (then centroid)."""
    return ("auto", LEGACY_ALGORITHMS[method]) if method in LEGACY_ALGORITHMS else (method, "centroid")


def algorithm_of(name: str) -> str:
    """The canonical algorithm name; raises for an unknown one."""
    known = {"centroid": "centroid", **LEGACY_ALGORITHMS}
    if name not in known:
        raise ValueError(f"unknown algorithm {name!r}; known: {', '.join(sorted(known))}")
    return known[name]


NOISE_METHODS = ("hdbscan", "optics")


def noise_methods_of(names) -> tuple[str, ...]:
    """Valid noise methods, each once, in the order given; raises for an unknown one."""
    names = tuple(dict.fromkeys(names or ()))
    for n in names:
        if n not in NOISE_METHODS:
            raise ValueError(f"unknown noise method {n!r}")
    return names
