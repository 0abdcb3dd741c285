"""Embedding plugins: black boxes that turn chunks of samples into vectors and tags.

A plugin is named, says whether it is available, loads itself once per worker on first use,
and is run over Arrow batches. Neural models register from outside; ``fft`` is built in.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .functions import signal
from .schema import MODEL_ORDER
from .sources.audio import resampled


class Plugin:
    """Override ``_load``, ``_embed`` and, for tags, ``_describe``."""

    name, title, dim, sample_rate = "", "", 0, 48_000
    describes = False

    def __init__(self) -> None:
        self._lock, self._loaded = threading.Lock(), False
        self.config: dict = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_lock", "_loaded")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._lock, self._loaded = threading.Lock(), False

    def apply_config(self, config: dict) -> None:
        self.config = dict(config)

    def availability_error(self) -> str | None:
        return None

    def is_available(self) -> bool:
        return self.availability_error() is None

    def _load(self) -> None: ...

    def ensure_loaded(self) -> None:
        with self._lock:
            if not self._loaded:
                self._load()
                self._loaded = True

    def unload(self) -> None:
        self._loaded = False

    def embed(self, chunks: Sequence[np.ndarray], rate: int) -> list[np.ndarray]:
        self.ensure_loaded()
        return self._embed(chunks, rate)

    def describe(self, chunks: Sequence[np.ndarray], rate: int, top_k: int = 3) -> list[list[tuple[str, float]]]:
        if not self.describes:
            return [[] for _ in chunks]
        self.ensure_loaded()
        return self._describe(chunks, rate, max(1, top_k))

    def _embed(self, chunks, rate):
        raise NotImplementedError

    def _describe(self, chunks, rate, top_k):
        raise NotImplementedError


class Spectrum(Plugin):
    """Band and spectrum statistics."""

    name, title, dim = "fft", "Spectrum statistics", signal.FEATURES

    def _embed(self, chunks, rate):
        return [signal.feature_vector(c, rate, float(self.config.get("fft_window_sec", 1.0))) for c in chunks]


class Windowed(Plugin):
    """A model for windows of limited length: override ``_embed_windows``.

    Chunks are resampled to the model's rate and cut as ``signal.window_starts`` cuts; the windows of
    all chunks go through the model together, ``batch`` at a time, whichever chunk they are of. A chunk's
    vector is the mean of its windows' at unit length; without samples, or where the mean is zero, zero.
    """

    window_sec, overlap_sec, batch = 10.0, 1.0, 8

    def _embed_windows(self, windows: list[np.ndarray], rate: int) -> np.ndarray:
        raise NotImplementedError

    def _embed(self, chunks, rate):
        size, overlap = (max(1, int(s * self.sample_rate)) if s else 0 for s in (self.window_sec, self.overlap_sec))
        parts = [resampled(np.asarray(c, np.float32), rate, self.sample_rate)[0] for c in chunks]
        cuts = [(i, s) for i, x in enumerate(parts) if len(x) for s in window_places(len(x), size, overlap)]
        total, count = np.zeros((len(parts), self.dim)), np.zeros(len(parts))
        for at in range(0, len(cuts), self.batch):
            some = cuts[at : at + self.batch]
            v = np.asarray(self._embed_windows([parts[i][s : s + size] for i, s in some], self.sample_rate), np.float64)
            owner = [i for i, _ in some]
            np.add.at(total, owner, v)
            np.add.at(count, owner, 1)
        mean = total / np.maximum(count, 1)[:, None]
        norm = np.linalg.norm(mean, axis=1, keepdims=True)
        return list(np.divide(mean, norm, out=np.zeros_like(mean), where=norm > 0))


def window_places(n: int, size: int, overlap: int) -> list[int]:
    """``signal.window_starts`` of one length."""
    step = max(size - overlap, 1)
    starts = list(range(0, max(n - size, 0) + 1, step))
    rest = n - size - starts[-1]
    if rest >= size // 4 and rest > 0:
        starts.append(n - size)
    elif rest > 0:
        starts[-1] = n - size
    return starts


_CLASSES: dict[str, Callable[[], Plugin]] = {"fft": Spectrum}
_MADE: dict[str, Plugin] = {}


def register(name: str, make: Callable[[], Plugin]) -> None:
    _CLASSES[name] = make
    _MADE.pop(name, None)


def unregister(name: str) -> None:
    _CLASSES.pop(name, None)
    _MADE.pop(name, None)


def get_plugin(name: str) -> Plugin:
    """One instance per process; KeyError for an unknown name."""
    if name not in _MADE:
        _MADE[name] = _CLASSES[name]()
    return _MADE[name]


def list_plugins() -> list[Plugin]:
    """In the order in which models are preferred, then by name."""
    place = {m: i for i, m in enumerate(MODEL_ORDER)}
    return [get_plugin(n) for n in sorted(_CLASSES, key=lambda n: (place.get(n, len(place)), n))]


def plugin_info() -> list[dict]:
    return [{"name": p.name, "display_name": p.title, "dim": p.dim, "available": p.is_available(), "error": p.availability_error()} for p in list_plugins()]


def embed_chunks(samples: DataFrame, plugin: Plugin, batch: int = 16, errors: bool = False) -> DataFrame:
    """``samples`` (chunk_id, rate, samples array<float>) to (chunk_id, model, v); with ``errors`` a
    failing batch has null vectors and its error instead of failing the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                s = b.slice(at, batch)
                vs, error = _in_batches(s, lambda x, r: plugin.embed(x, r), errors)
                lists = pa.array([None if v is None else np.asarray(v, np.float64).tolist() for v in vs], pa.list_(pa.float64()))
                out = [s.column(0), pa.array([plugin.name] * len(vs)), lists]
                yield pa.RecordBatch.from_arrays([*out, pa.array(error, pa.string())][: 4 if errors else 3], names=["chunk_id", "model", "v", "error"][: 4 if errors else 3])

    return samples.select("chunk_id", "rate", "samples").mapInArrow(run, "chunk_id bigint, model string, v array<double>" + (", error string" if errors else ""))


def _in_batches(s: pa.RecordBatch, call: Callable, errors: bool) -> tuple[list, list[str | None]]:
    """``call`` on the chunks of each rate together; a failure is the error of that rate's chunks."""
    rates = s.column(1).to_numpy()
    out: list = [None] * s.num_rows
    error: list[str | None] = [None] * s.num_rows
    for rate in np.unique(rates):
        own = np.flatnonzero(rates == rate).tolist()
        chunks = [s.column(2)[i].values.to_numpy().astype(np.float32) for i in own]
        try:
            for i, v in zip(own, call(chunks, int(rate))):
                out[i] = v
        except Exception as e:  # noqa: BLE001
            if not errors:
                raise
            for i in own:
                error[i] = str(e)[:200]
    return out, error


def describe_chunks(samples: DataFrame, plugin: Plugin, top_k: int = 3, batch: int = 16) -> DataFrame:
    """``samples`` to (chunk_id, model, text, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                s = b.slice(at, batch)
                tags, _ = _in_batches(s, lambda x, r: plugin.describe(x, r, top_k), False)
                out = [(i, plugin.name, t, float(p)) for i, found in zip(s.column(0).to_pylist(), tags) for t, p in found or ()]
                cols = list(zip(*out)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.float64()))], names=["chunk_id", "model", "text", "score"])

    return samples.select("chunk_id", "rate", "samples").mapInArrow(run, "chunk_id bigint, model string, text string, score double")


class Captions(Plugin):
    """A plugin whose texts are captions: each is a tag of score 1. Override ``_embed`` and ``_captions``."""

    describes = True

    def _captions(self, chunks, rate) -> list[list[str]]:
        raise NotImplementedError

    def _describe(self, chunks, rate, top_k):
        return [[(text, 1.0) for text in found] for found in self._captions(chunks, rate)]


def zero_shot_tags(vectors_df: DataFrame, tags: DataFrame, top_k: int = 3) -> DataFrame:
    """The ``top_k`` tags of every vector: softmax of 100 times the cosines to the tags' vectors.

    ``tags`` (text, v) is a model's tag list, a bounded table, broadcast as one row.
    """
    from pyspark.sql import functions as F

    from .functions import vectors as V

    t = tags.groupBy().agg(F.sort_array(F.collect_list(F.struct("text", V.unit("v").alias("v")))).alias("t"))
    both = vectors_df.crossJoin(F.broadcast(t)).select("chunk_id", "t", F.transform("t", lambda z: V.dot(z["v"], V.unit("v"))).alias("sim"))
    p = both.select("chunk_id", F.arrays_zip(V.softmax("sim").alias("p"), F.transform("t", lambda z: z["text"]).alias("text")).alias("z"))
    best = F.slice(F.array_sort(F.transform("z", lambda z: F.struct((-z["p"]).alias("n"), z["text"].alias("text")))), 1, max(1, top_k))
    return p.select("chunk_id", F.posexplode(best).alias("rank", "b")).select("chunk_id", (F.col("rank") + 1).alias("rank"), F.col("b.text").alias("text"), (-F.col("b.n")).alias("score"))
