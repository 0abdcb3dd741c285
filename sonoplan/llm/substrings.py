"""Substring dedup: passages that also occur in an earlier document go.

A window of ``LENGTH`` words is hashed into by its anchor, the least of its ``GRAM``-gram
hashes; equal windows have equal anchors. Consecutive windows with one anchor form a piece
of at most 2 * LENGTH - GRAM words. The shards of the FM-index hold pieces by anchor, so
every occurrence of a window lies in one shard, and a document streams each of its pieces
through one shard, not the whole corpus through all.

Rows are dealt to chunks by hash; chunks and shards exchange packed arrays:

1. a chunk sends its distinct anchors; the shard answers with one bit each: in two chunks or
   in two documents of one? The others' windows are in one document and drop out here.
2. a chunk sends its distinct pieces under repeated anchors, with the least document of
   each. A shard builds the index over all its distinct pieces, streams them through it by
   backward search, and finds for each window its rows and the least document among them.
3. the chunk takes these answers and removes the words of windows with an earlier document.

A passage in a third of all documents is sent once per chunk, whatever its copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks_for, in_chunks, text_bytes
from .fmindex import FmIndex
from .ngramlm import _pack, _unpack
from .textcore import U64, Words, mix, ngrams, releasing, words_of

LENGTH, GRAM = 13, 5
NO_ID = np.iinfo(np.int64).max


class Pieces:
    """Windows of a chunk, grouped into pieces: ``start[i]``, ``windows[i]`` and ``anchor[i]``."""

    def __init__(self, words: Words, h: np.ndarray) -> None:
        g, at = ngrams(h, words.first, GRAM)
        span = LENGTH - GRAM + 1
        full = np.full(len(h), np.iinfo(np.uint64).max, np.uint64)
        full[at] = g
        _, begin = ngrams(h, words.first, LENGTH)
        best, least = begin.copy(), full[begin]
        for k in range(1, span):  # the leftmost least hash of each window
            v = full[begin + k]
            lower = v < least
            least[lower] = v[lower]
            best[lower] = begin[lower] + k
        new = np.ones(len(begin), bool)
        new[1:] = (best[1:] != best[:-1]) | (begin[1:] != begin[:-1] + 1)
        cut = np.flatnonzero(new)
        self.start = begin[cut]
        self.windows = np.diff(np.append(cut, len(begin)))
        self.anchor = full[best[cut]]
        # Two windows that overlap or touch cover the piece, so their hashes name its content.
        w = ngram_at(h, np.concatenate([self.start, self.start + self.windows - 1]))
        n = len(cut)
        self.name = mix(w[:n] * U64(0x9E3779B97F4A7C15) + (w[n:] ^ self.windows.astype(U64)))

    def text(self) -> np.ndarray:
        return self.windows + LENGTH - 1


def ngram_at(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    g = np.zeros(len(at), U64)
    for k in range(LENGTH):
        g = (g ^ h[at + k]) * U64(0x9E3779B97F4A7C15)
        g ^= g >> U64(31)
    return mix(g)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range, one after the other."""
    total = np.cumsum(size)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(start - (total - size), size)


def _read(docs: pa.Table) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, word hashes and document order of a chunk; an id that is null comes last."""
    texts = docs.column("text").cast(pa.large_string()).combine_chunks()
    words = words_of(texts)
    ids = docs.column("doc_id").fill_null(NO_ID).to_numpy().astype(np.int64)
    return words, words.hashes(), ids


def _split(bucket: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(own):
            yield int(bucket[own[0]]), own


def _bucket(anchor: np.ndarray, n: int) -> np.ndarray:
    return ((anchor >> U64(20)) % U64(n)).astype(np.int64)


def _anchors(p: Pieces, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors, sorted, and whether two documents of the chunk have them."""
    order = np.argsort(p.anchor, kind="stable")
    a = p.anchor[order]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
    d = doc[order]
    many = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first) if len(a) else np.zeros(0, bool)
    return a[first], many


def _piece_docs(words: Words, p: Pieces, ids: np.ndarray) -> np.ndarray:
    return ids[np.searchsorted(words.first, p.start, side="right") - 1]


_SENT = "chunk int, bucket int, payload binary"


def _rows(found: list[tuple[int, int, bytes]]) -> pa.Table:
    c, b, x = zip(*found) if found else ((), (), ())
    return pa.table([pa.array(c, pa.int32()), pa.array(b, pa.int32()), pa.array(x, pa.binary())], names=["chunk", "bucket", "payload"])


def _send_anchors(n: int):
    def send(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        words, h, ids = _read(docs)
        p = Pieces(words, h)
        a, many = _anchors(p, _piece_docs(words, p, ids))
        return _rows([(key[0].as_py(), b, _pack(a[own], many[own].astype(np.uint8))) for b, own in _split(_bucket(a, n))])

    return releasing(send)


@releasing
def _answer_anchors(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
    got = [_unpack(x.as_buffer(), "u8", "u1") for x in sent.column("payload")]
    a, many = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    _, back, count = np.unique(a, return_inverse=True, return_counts=True)
    repeated = ((count + np.bincount(back, many))[back] > 1).astype(np.uint8)
    cuts = np.cumsum([len(g[0]) for g in got])[:-1]
    bits = [np.packbits(x).tobytes() for x in np.split(repeated, cuts)]
    return pa.table([sent.column("chunk"), sent.column("bucket"), pa.array(bits, pa.binary())], names=["chunk", "bucket", "payload"])


def _send_pieces(n: int):
    def send(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return _rows([])
        words, h, ids = _read(docs)
        p = Pieces(words, h)
        doc = _piece_docs(words, p, ids)
        a, _ = _anchors(p, doc)
        bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("payload")))
        repeated = np.zeros(len(a), bool)
        for b, own in _split(_bucket(a, n)):
            repeated[own] = np.unpackbits(np.frombuffer(bits[b].as_buffer(), np.uint8), count=len(own))
        keep = np.flatnonzero(repeated[np.searchsorted(a, p.anchor)])
        order = keep[np.lexsort((doc[keep], p.name[keep]))]
        name = p.name[order]
        order = order[np.append(True, name[1:] != name[:-1])] if len(order) else order  # least document of each
        out = []
        for b, own in _split(_bucket(p.anchor[order], n)):
            own = order[own]
            size = p.text()[own]
            text = h[_ranges(p.start[own], size)]
            used, code = np.unique(text, return_inverse=True)
            code = code.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
            out.append((key[0].as_py(), b, _pack(p.name[own], size.astype(np.uint8), doc[own], used, code.view(np.uint8))))
        return _rows(out)

    return releasing(send)


@releasing
def _search_shard(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
    """Index of the shard's distinct pieces; answers each chunk's pieces, window by window."""
    got = [_unpack(x.as_buffer(), "u8", "u1", "i8", "u8", "u1") for x in sent.column("payload")]
    used, back = np.unique(np.concatenate([g[3] for g in got]), return_inverse=True)
    back = back + 1
    text, at = [], 0
    for g in got:
        own = back[at : at + len(g[3])]
        at += len(g[3])
        text.append(own[g[4].view(np.uint16 if len(g[3]) <= 1 << 16 else np.uint32)].astype(np.int32))
    text = np.concatenate(text)
    name, size, doc = (np.concatenate([g[k] for g in got]) for k in range(3))
    size = size.astype(np.int64)
    start = np.cumsum(size) - size
    # Distinct pieces with the least document of each.
    order = np.lexsort((doc, name))
    new = np.append(True, name[order][1:] != name[order][:-1])
    rep, which = order[new], np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    size, least = size[rep], doc[rep]
    step = size + 1
    begin = np.cumsum(step) - step
    joined = np.zeros(int(step.sum()), np.int64)
    joined[_ranges(begin, size)] = text[_ranges(start[rep], size)]
    del text
    index = FmIndex(joined, len(used) + 1)
    group, _ = index.group(LENGTH)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    owner = np.repeat(np.arange(len(rep)), step)[index.order]
    earliest = np.minimum.reduceat(least[owner], starts)
    row_group = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1
    windows = size - LENGTH + 1
    offset = np.cumsum(windows) - windows
    answer = np.full(int(windows.sum()), NO_ID, np.int64)
    for piece, at, length, lo, _ in index.matching(joined, begin, begin + size, LENGTH):
        hit = length == LENGTH
        p = piece[hit]
        answer[offset[p] + at[hit] - begin[p]] = earliest[row_group[lo[hit]]]
    out, at = [], 0
    for g, chunk in zip(got, sent.column("chunk")):
        own = which[at : at + len(g[0])]
        at += len(g[0])
        out.append((chunk.as_py(), key[0].as_py(), _pack(g[0], answer[_ranges(offset[own], windows[own])])))
    return _rows(out)


_KEPT = "doc_id bigint, kept_text string, n_words bigint, n_removed bigint, removed array<struct<first:bigint,last:bigint>>"


@releasing
def _removals(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
    words, h, ids = _read(docs)
    p = Pieces(words, h)
    covered = np.zeros(len(h) + 1, np.int64)
    if answers.num_rows:
        got = [_unpack(x.as_buffer(), "u8", "i8") for x in answers.column("payload")]
        name, least = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        order = np.argsort(p.name, kind="stable")
        # The pieces were sent in the order of their buckets and names, each once.
        first = order[np.searchsorted(p.name[order], name)]
        windows = p.windows[first]
        offset = np.cumsum(windows) - windows
        by = np.argsort(name)
        at = np.minimum(np.searchsorted(name[by], p.name), len(name) - 1)
        mine = np.flatnonzero(name[by][at] == p.name)
        doc = _piece_docs(words, p, ids)[mine]
        begin, size = p.start[mine], p.windows[mine]
        window = _ranges(begin, size)
        gone = window[least[_ranges(offset[by][at[mine]], size)] < np.repeat(doc, size)]
        np.add.at(covered, gone, 1)
        np.add.at(covered, gone + LENGTH, -1)
    keep = np.cumsum(covered[:-1]) == 0
    return _kept_table(words, keep, docs.column("doc_id"))


def _kept_table(words: Words, keep: np.ndarray, ids: pa.ChunkedArray) -> pa.Table:
    n = len(words.first) - 1
    counts = words.counts()
    kept_n = np.add.reduceat(np.append(keep, False).astype(np.int64), np.minimum(words.first[:-1], len(keep))) * (counts > 0) if n else counts
    edge = np.diff(np.concatenate([[0], (~keep).astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # Ranges end with their document.
    doc = words.doc_of()
    inner = np.flatnonzero((doc[1:] != doc[:-1]) & ~keep[1:] & ~keep[:-1]) + 1 if len(doc) else begin
    begin, end = np.sort(np.append(begin, inner)), np.sort(np.append(end, inner))
    own = doc[begin] if len(begin) else begin
    spans = pa.StructArray.from_arrays([pa.array(begin - words.first[own]), pa.array(end - 1 - words.first[own])], ["first", "last"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(n + 1)), pa.int32()), spans)
    texts, step = [], 1 << 19
    a = 0
    while a < n:  # some documents at a time: the byte index takes eight times their size
        b = max(a + 1, int(np.searchsorted(words.first, words.first[a] + step, side="right")) - 1)
        own = np.flatnonzero(keep[words.first[a] : words.first[b]]) + words.first[a]
        size = words.ends[own] - words.starts[own]
        out = np.full(int(size.sum()) + len(own), 0x20, np.uint8)
        place = np.cumsum(size + 1) - size - 1
        out[_ranges(place, size)] = words.data[_ranges(words.starts[own], size)]
        raw = out.tobytes()
        cut = np.searchsorted(own, words.first[a : b + 1])
        ends = np.append(place, len(out))
        texts += [raw[ends[i] : max(ends[j] - 1, ends[i])].decode() for i, j in zip(cut, cut[1:])]
        a = b
    return pa.table([ids, pa.array(texts, pa.string()), pa.array(counts), pa.array(counts - kept_n), spans], names=["doc_id", "kept_text", "n_words", "n_removed", "removed"])


def dedup_substrings(docs: DataFrame, least_chunk: int = 12 << 20, shard_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, kept_text, n_words, n_removed and removed (word ranges, last included).

    A word goes if a window of 13 words that holds it also starts in a document with a
    smaller doc_id; windows are judged on the input. Null text: no words. A null doc_id comes
    after all others; rows that share a doc_id are not earlier than one another. Kept words
    are joined by one space. Other columns are not read. Empty table: empty result.
    """
    docs = docs.select("doc_id", "text")
    size = text_bytes(docs)
    shards = max(12, -(-size // shard_bytes))
    docs = in_chunks(docs, chunks_for(size, least_chunk))
    sent = docs.groupBy("chunk").applyInArrow(_send_anchors(shards), _SENT)
    bits = sent.groupBy("bucket").applyInArrow(_answer_anchors, _SENT)
    pieces = docs.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(_send_pieces(shards), _SENT)
    answers = pieces.groupBy("bucket").applyInArrow(_search_shard, _SENT)
    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_removals, _KEPT)


def op1_substrings(spark, sf_dir):
    """doc_id, n_words, n_removed and the hash of the kept text, for every document.

    Nulls, empty and very long texts, repeated rows, empty tables: as in dedup_substrings.
    """
    from .common import table

    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT k, doc_id, p, array_to_string(w[p:p + 12], ' ') AS t FROM (SELECT k, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
m AS (SELECT t, min(doc_id) AS least FROM g GROUP BY t),
gone AS (SELECT DISTINCT k, unnest(range(p, p + 13)) AS pos FROM g JOIN m USING (t) WHERE least < coalesce(doc_id, 9223372036854775807)),
x AS (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
o AS (SELECT x.k, count(gone.pos) AS n, string_agg(word, ' ' ORDER BY x.pos) FILTER (gone.pos IS NULL) AS kept FROM x LEFT JOIN gone ON x.k = gone.k AND x.pos = gone.pos GROUP BY x.k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (k)
"""
