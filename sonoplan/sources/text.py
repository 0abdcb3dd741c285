"""Text vectors for track descriptions: an HTTP embedding server, or hashing without one."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Parts of names that tell embedding models where a server doesn't say so itself.
NAME_HINTS = ("embed", "minilm", "bge", "mxbai", "arctic")


class TextServer:
    """Client of an embedding server: /api/tags, /api/embed, and the older /api/embeddings."""

    def __init__(self, host: str, timeout: float = 60.0, send: Callable | None = None) -> None:
        self.host, self.timeout = host.rstrip("/"), timeout
        self._send = send or self._http

    def _http(self, path: str, body: dict | None) -> tuple[int, dict]:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.host + path, data, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, {}

    def is_running(self) -> bool:
        try:
            return self._send("/api/tags", None)[0] == 200
        except (OSError, ValueError):
            return False

    def embedding_models(self) -> list[str]:
        """By stated capability; else by name; else by trying each."""
        try:
            entries = self._send("/api/tags", None)[1].get("models") or []
        except (OSError, ValueError):
            return []
        named = [(str(e.get("name") or e.get("model") or "").strip(), e.get("capabilities") or ()) for e in entries]
        named = [(n, c) for n, c in named if n]
        for pick in (lambda n, c: "embedding" in c, lambda n, c: any(h in n.lower() for h in NAME_HINTS), lambda n, c: self._answers(n)):
            if found := [n for n, c in named if pick(n, c)]:
                return found
        return []

    def _answers(self, model: str) -> bool:
        try:
            return bool(self.embed(["probe"], model))
        except (OSError, ValueError, RuntimeError):
            return False

    def embed(self, texts: Sequence[str], model: str) -> list[list[float]]:
        if not model:
            raise RuntimeError("a model name is needed")
        if not texts:
            return []
        status, got = self._send("/api/embed", {"model": model, "input": list(texts)})
        if status == 200:
            out = got.get("embeddings")
            if not isinstance(out, list) or len(out) != len(texts):
                raise RuntimeError(f"{model}: wrong number of vectors")
            return [[float(x) for x in v] for v in out]
        if status != 404:
            raise RuntimeError(f"{model}: HTTP {status}")
        out = []
        for t in texts:  # the older interface takes one text at a time
            status, got = self._send("/api/embeddings", {"model": model, "prompt": t})
            if status != 200 or not isinstance(got.get("embedding"), list):
                raise RuntimeError(f"{model}: HTTP {status}")
            out.append([float(x) for x in got["embedding"]])
        return out


def hashing_embedder(dim: int = 64) -> Callable[[Sequence[str]], list[list[float]]]:
    """Signed feature hashing of words to unit vectors; needs no server and never changes."""
    import zlib

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for row, t in zip(out, texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                row[h % dim] += 1 if h >> 31 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0).tolist()

    return embed


def in_turn(b: pa.RecordBatch, size: int) -> Iterator[list[tuple[int, str]]]:
    """(id, text) of a batch of two columns, ``size`` that are not blank at a time; no more are Python objects."""
    held: list[tuple[int, str]] = []
    for at in range(0, b.num_rows, size):
        held += [(i, t) for i, t in zip(*(c.to_pylist() for c in b.slice(at, size).columns)) if t and t.strip()]
        if len(held) >= size:
            yield held[:size]
            held = held[size:]
    if held:
        yield held


def embed_texts(texts: DataFrame, embed: Callable[[Sequence[str]], list[list[float]]], model: str, batch: int = 64) -> DataFrame:
    """``texts`` (track_id, text) to (track_id, model, v); blanks are skipped, failed batches too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in in_turn(b, batch):
                try:
                    vs = embed([t for _, t in part])
                except (OSError, RuntimeError, ValueError):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([model] * len(part)), pa.array(vs, pa.list_(pa.float64()))], names=["track_id", "model", "v"])

    return texts.select("track_id", "text").mapInArrow(run, "track_id bigint, model string, v array<double>")
