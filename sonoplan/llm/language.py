"""Language identification by a byte convolutional network, trained and run in numpy.

A window is ``WINDOW`` bytes of a text (zero-padded at its end). Filters of several widths
run over the bytes, each filter keeps its maximum over the window (after a ReLU), and a
softmax layer gives the languages. A text's prediction averages its windows, all of them,
weighted by their bytes. The first layer is a table per width and offset, indexed by the
byte, so a filter bank costs one row lookup per byte and offset.

One more class stands for what is no text of a learned language: training windows with their
characters in random order, and random letters, digits and signs. It takes no part in the
choice among the languages; its probability tells how far a text can be read at all.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, free_name
from .textcore import blocks

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bounds of the training sample: documents per language, of all languages together (one each at
#: least), and windows per document.
DOCS_PER_LANG = 400
SAMPLE_DOCS = 40_000
WINDOWS_PER_DOC = 4
UNKNOWN = "und"
#: A text is no language that was learned when this share of it or more reads as noise.
LEAST_NOISE = 0.9
_SIGNS = "0123456789+/=#%&@$*~^|<>{}[]()_-.,:;!? \n"
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: More labels than this are joined by a shuffle instead of a broadcast.
BROADCAST_LANGS = 10_000


@dataclass
class ByteCnn:
    """``tables[k]``: (width, 256, FILTERS); ``bias``: one per filter; then the softmax layer, which
    has a column for every language and a last one for noise."""

    langs: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def features(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Pooled activations (windows, filters) of byte windows, and the winning positions."""
        pooled, at = [], []
        for table in self.tables:
            n = x.shape[1] - len(table) + 1
            a = table[0][x[:, :n]]
            for j in range(1, len(table)):
                a += table[j][x[:, j : j + n]]
            if where:
                best = a.argmax(1)
                at.append(best)
                pooled.append(np.take_along_axis(a, best[:, None], 1)[:, 0])
            else:
                pooled.append(a.max(1))
        return np.maximum(np.concatenate(pooled, 1) + self.bias, 0), np.concatenate(at, 1) if where else None

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.features(x)[0] @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def gradients(net: ByteCnn, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the mean weighted cross entropy, for the tables, the bias and the softmax layer."""
    h, at = net.features(x, where=True)
    z = h @ net.out + net.out_bias
    z = np.exp(z - z.max(1, keepdims=True))
    z /= z.sum(1, keepdims=True)
    z[np.arange(len(x)), y] -= 1
    z *= (weight / len(x))[:, None]
    dh = (z @ net.out.T) * (h > 0)
    grads = [np.zeros_like(t) for t in net.tables] + [dh.sum(0), h.T @ z, z.sum(0)]
    for k, w in enumerate(WIDTHS):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        pos, d = at[:, cols], dh[:, cols]
        unit = np.broadcast_to(np.arange(FILTERS), pos.shape)
        for j in range(w):
            np.add.at(grads[k][j], (np.take_along_axis(x, pos + j, 1), unit), d)
    return grads


def train(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 4, batch: int = 64, seed: int = 5, rate: float = 0.003) -> ByteCnn:
    """Adam on cross entropy; classes weigh the same whatever their share of the sample.

    ``y`` counts through ``langs``; len(langs) is noise.
    """
    rng = np.random.default_rng(seed)
    f = len(WIDTHS) * FILTERS
    net = ByteCnn(
        langs,
        [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(f, np.float32), rng.normal(0, 0.1, (f, len(langs) + 1)).astype(np.float32), np.zeros(len(langs) + 1, np.float32),
    )
    params = [*net.tables, net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = (1 / np.maximum(np.bincount(y, minlength=len(langs) + 1), 1))[y]
    weight = (weight / weight.mean()).astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            xb, step = x[own], step + 1
            grads = gradients(net, xb, y[own], weight[own])
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text of each window, bytes in it): fixed-length windows over whole texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    per = -(-sizes // WINDOW)
    flat = np.zeros(int(per.sum()) * WINDOW, np.uint8)
    at = 0
    for t, k in zip(texts, per):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += int(k) * WINDOW
    owner = np.repeat(np.arange(len(texts)), per)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    return flat.reshape(-1, WINDOW), owner, np.minimum(sizes[owner] - inner * WINDOW, WINDOW)


def training_sample(docs: DataFrame, learn: Column) -> list[tuple[str, list[str]]]:
    """Labelled windows: DOCS_PER_LANG texts of each language at most, those of least hash, and
    WINDOWS_PER_DOC windows of each at places chosen by hash. A text counts once, however often
    it repeats. With so many languages that SAMPLE_DOCS would be passed, each has fewer, one at
    least. Null texts and labels are left out; an empty table gives an empty list."""
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    text_hash = F.xxhash64("text", F.lit(11))
    kinds = cut(labelled.groupBy(F.col("lang").alias("l")).agg(F.approx_count_distinct(text_hash, 0.02).alias("texts")))
    n = kinds.count()
    each = max(1, min(DOCS_PER_LANG, SAMPLE_DOCS // max(n, 1)))
    # More than twice as many as wanted pass the draw; the least hashes of these are the least of all.
    rates = kinds.select("l", (F.lit(2.0 * each + 20) / F.col("texts")).alias("rate"))
    if n <= BROADCAST_LANGS:
        rates = F.broadcast(rates)
    draw = F.pmod(F.shiftrightunsigned(text_hash, 11), F.lit(1_000_003)) / 1_000_003.0
    chosen = labelled.join(rates, F.col("lang") == F.col("l")).where(draw < F.col("rate"))
    start = lambda k: F.pmod(F.xxhash64("text", F.lit(100 + k)), F.greatest(F.length("text") - WINDOW + 1, F.lit(1))).cast("int") + 1
    cuts = F.array(*[F.substring("text", start(k), F.lit(WINDOW)) for k in range(WINDOWS_PER_DOC)])
    once = chosen.select("lang", draw.alias("draw"), text_hash.alias("h"), cuts.alias("cuts")).groupBy("lang", "draw", "h").agg(F.min("cuts").alias("cuts"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("draw", "h"))
    return [(r[0], r[1]) for r in once.withColumn("place", place).where(F.col("place") <= each).select("lang", "cuts").collect()]


def noise_windows(cuts: list[str], n: int, seed: int = 6) -> list[str]:
    """``n`` windows of noise: by turns characters of a window in random order, letters, and signs."""
    rng = random.Random(seed)
    kinds = (lambda t: "".join(rng.sample(t, len(t))), lambda t: "".join(rng.choices(_LETTERS, k=len(t))), lambda t: "".join(rng.choices(_LETTERS + 4 * _SIGNS, k=len(t))))
    return [kinds[k % 3](rng.choice(cuts)) for k in range(n)]


def train_on(docs: DataFrame, learn: Column) -> ByteCnn | None:
    """The network learned from the rows where ``learn`` holds; None where there are none.

    Nulls, repeated texts and long ones: as in training_sample. Ties between rows don't matter:
    the sample is sorted, so the same texts give the same network.
    """
    sample = sorted((lang, sorted(set(cuts))) for lang, cuts in training_sample(docs, learn))
    if not sample:
        return None
    langs = sorted({lang for lang, _ in sample})
    texts = [(c, langs.index(lang)) for lang, cuts in sample for c in cuts]
    texts += [(c, len(langs)) for c in noise_windows([c for c, _ in texts], max(3, len(texts) // len(langs)))]
    x = [np.frombuffer(c.encode()[:WINDOW].ljust(WINDOW, b"\0"), np.uint8) for c, _ in texts]
    return train(np.stack(x), np.array([y for _, y in texts]), langs)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def predict(docs: DataFrame, net: ByteCnn | None, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, ...] = ("lang_pred", "score"), block: int = 512) -> DataFrame:
    """``keep`` columns with lang_pred, score (mean probability of the predicted language among the
    learned ones) and, where ``names`` has a third name, the share of the text that is noise.

    Only the text is looked at. ``und`` with score 0 and noise 1 where the text is null or has no
    letter (or nothing could be learned). Whole texts, in blocks of ``block`` windows. Repeated rows
    get one answer each; of languages that tie the first in order is taken. Empty table: empty result.
    """

    # The text travels once, also where it is kept.
    at = keep.index("text") if "text" in keep else len(keep)
    column = "text" if "text" in keep else free_name([*keep, *names], "lang_text")
    extra = [] if "text" in keep else [F.col("text").alias(column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in blocks(b, column, 1 << 20):  # some texts at a time, whole ones
                texts = [t.as_py() if t.is_valid else "" for t in s.column(at)]
                live = [i for i, t in enumerate(texts) if net is not None and has_letter(t)]
                lang, score, noise = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.ones(len(texts))
                if live:
                    x, owner, size = windows_of([texts[i].encode() for i in live])
                    total = np.zeros((len(live), len(net.langs) + 1))
                    for a in range(0, len(x), block):
                        p = net.probabilities(x[a : a + block]) * size[a : a + block, None]
                        np.add.at(total, owner[a : a + block], p)
                    noise[live] = total[:, -1] / total.sum(1)
                    total = total[:, :-1] + 1e-30
                    total /= total.sum(1, keepdims=True)
                    lang[live] = np.array(net.langs, object)[total.argmax(1)]
                    score[live] = total.max(1)
                found = [pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(np.clip(noise, 0, 1))]
                yield pa.RecordBatch.from_arrays([*s.columns[: len(keep)], *found[: len(names)]], names=[*keep, *names])

    kinds = dict(docs.dtypes)
    added = [f"`{n}` {t}" for n, t in zip(names, ("string", "double", "double"))]
    return docs.select(*keep, *extra).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *added]))


def lettered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a letter, the ones that ``predict`` can name a language for.

    Null and empty texts go; repeated rows stay as often as they are; all columns pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in blocks(b, "text", 1 << 20):
                texts = s.column(s.schema.get_field_index("text"))
                yield s.filter(pa.array([t.is_valid and has_letter(t.as_py()) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def op7_language(spark, sf_dir):
    """Held-out rows are those whose id's crc32 mod 5 is 0; they are never learned from.

    Nulls, empty and very long texts, repeated rows, empty tables: as in predict.
    """
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train_on(docs, fold(F.col("doc_id"), 5) != 0)
    return predict(docs, net).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
