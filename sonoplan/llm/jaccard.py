"""N-gram Jaccard join: documents whose shingle sets agree to ``percent`` or more, as components.

1. Documents with equal sets fall into one class at once (a hash of the set).
2. Frequencies. Documents are dealt to chunks, elements to buckets, and the two exchange packed
   arrays: a chunk sends its distinct elements, the bucket answers in how many sets of the corpus
   each occurs. A set with too many elements of its own can't be linked and drops out.
3. Candidates. In the order of frequency, rarest first, linked sets share an element of the
   first few, so many as the threshold allows to differ and one more. Sets that share one may be
   similar; their components bound where links can lie. Elements meet in sorted partitions as a
   stream, so that one which a third of all documents has is no group to be held.
4. Prefix-tree join. The sets of a candidate component are put in one global order (most
   frequent n-gram first) and stored in a trie. All sets walk the trie together, so that a
   shared beginning is intersected once; a set leaves a subtree when the n-grams that remain
   can't bring the overlap to the threshold, or when it is linked to the leaf already.

A large component goes to random blocks, each one trie, cut in two ways; only sets that the
largest component found so far doesn't hold then meet all blocks.

Every link between different sets is found or implied by links found; no pair of a group is
written out. The result of a group is a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks_for, cut, free_name, in_chunks, text_bytes, text_key
from .graph import components, forest
from .textcore import U64, blocks, mix, ngrams, release, releasing, words_of

#: op3's shingle length and least similarity; the operators below take others.
SHINGLE = 3
PERCENT = 90
#: Bounds of a trie: sets and n-grams in one block.
BLOCK_SETS, BLOCK_GRAMS = 200, 500_000
#: Text whose elements meet in one partition, or make up a bucket, and the least of a chunk.
MEET_BYTES = 8 << 20
#: More rows than this (some 20 bytes each) meet texts or sets in a shuffle instead of a broadcast.
BROADCAST_ROWS = 1_000_000


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(elements, first): distinct 56-bit shingle hashes of each text, sorted.

    Fewer than ``shingle`` words: the whole sequence is the one element. No words: none.
    """
    words = words_of(texts, lower=True)
    h, n = words.hashes(), words.counts()
    g, at = ngrams(h, words.first, shingle)
    doc = np.searchsorted(words.first, at, side="right") - 1
    for k in range(1, shingle):
        own = np.flatnonzero(n == k)
        s = np.full(len(own), k, U64)
        for j in range(k):
            s = mix(s * U64(0x9E3779B97F4A7C15) + h[words.first[own] + j])
        g, doc = np.append(g, s), np.append(doc, own)
    if len(own := np.flatnonzero(n < shingle)):
        order = np.argsort(doc, kind="stable")
        g, doc = g[order], doc[order]
    cuts = np.searchsorted(doc, np.arange(0, len(n) + 256, 256))
    parts, sizes = [], np.zeros(len(n), np.int64)
    for base, (a, b) in enumerate(zip(cuts, cuts[1:])):
        # 256 texts at a time: eight bits for the text, 56 for the shingle, one plain sort.
        key = np.sort((doc[a:b] - 256 * base).astype(U64) << U64(56) | g[a:b] >> U64(8))
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        own = np.bincount((key >> U64(56)).astype(np.int64), minlength=256)
        sizes[256 * base : 256 * base + 256] = own[: len(sizes) - 256 * base]
        parts.append(key & U64((1 << 56) - 1))
    return np.concatenate(parts) if parts else np.zeros(0, U64), np.append(0, np.cumsum(sizes))


def class_keys(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set, as int64; equal sets have equal keys."""
    n = np.diff(first)
    total = np.zeros(len(n), U64)
    has = n > 0
    if has.any():
        total[has] = np.add.reduceat(mix(elements), first[:-1][has])
    return mix(total ^ (n.astype(U64) * U64(0x9E3779B97F4A7C15))).view(np.int64)


def size_classes(most: int, percent: int = PERCENT) -> np.ndarray:
    """Lower bounds of size classes: sets that can be linked are in one class or in neighbours."""
    low = [1, 2]
    while low[-1] <= most:
        low.append(max(low[-1] + 1, (low[-1] - 1) * 100 // percent + 1))
    return np.array([*low, max(low[-1] + 1, (low[-1] - 1) * 100 // percent + 1)])


# --- frequencies: chunks of documents and buckets of elements -----------------------------


def _chunk_sets(texts: pa.Table, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elements, first, class) of the texts of a chunk."""
    elements, sizes, keys = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b in texts.select(["text"]).to_batches():
        for s in blocks(b, "text"):
            e, first = shingle_sets(s.column(0), shingle)
            elements.append(e), sizes.append(np.diff(first)), keys.append(class_keys(e, first))
    return np.concatenate(elements), np.append(0, np.cumsum(np.concatenate(sizes))), np.concatenate(keys)


def _places(elements: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket, and 32 more bits: elements that fall together count as one, which only adds candidates."""
    x = mix(elements ^ U64(0x5DEECE66D1234567))
    return (x & U64(0xFFFFFFFF)) % U64(buckets) << U64(32) | x >> U64(32)


def _one_of_each(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first text of each class of the chunk that has shingles."""
    pick = np.zeros(len(keys), bool)
    pick[np.unique(keys, return_index=True)[1]] = True
    return pick & (n > 0)


def _by_bucket(place: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted places."""
    bucket = (place >> U64(32)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield int(bucket[a]), a, b


_SENT = "chunk int, bucket int, payload binary"
_MOST = np.iinfo(np.uint16).max


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    c, b, x = zip(*rows) if rows else ((), (), ())
    return pa.table([pa.array(c, pa.int32()), pa.array(b, pa.int32()), pa.array(x, pa.binary())], names=["chunk", "bucket", "payload"])


def _send_elements(shingle: int, buckets: int):
    def send(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        elements, first, keys = _chunk_sets(docs, shingle)
        n = np.diff(first)
        own = elements[np.repeat(_one_of_each(keys, n), n)]
        place, count = np.unique(_places(own, buckets), return_counts=True)
        rest, count = place.astype(np.uint32), np.minimum(count, _MOST).astype(np.uint16)
        return _sent([(key[0].as_py(), k, rest[a:b].tobytes() + count[a:b].tobytes()) for k, a, b in _by_bucket(place)])

    return releasing(send)


@releasing
def _count_elements(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
    raw = [x.as_buffer() for x in sent.column("payload")]
    sizes = [x.size // 6 for x in raw]
    rest = np.concatenate([np.frombuffer(x, np.uint32, n) for x, n in zip(raw, sizes)])
    count = np.concatenate([np.frombuffer(x, np.uint16, n, 4 * n) for x, n in zip(raw, sizes)])
    _, back = np.unique(rest, return_inverse=True)
    total = np.minimum(np.bincount(back, count), _MOST).astype(np.uint16)[back]
    cuts = np.cumsum(sizes)[:-1]
    return pa.table([sent.column("chunk"), sent.column("bucket"), pa.array([x.tobytes() for x in np.split(total, cuts)], pa.binary())], names=["chunk", "bucket", "payload"])


_ROWS = "doc_id bigint, key binary, n bigint, class bigint, set binary, rare binary"


def _judge(shingle: int, percent: int, buckets: int):
    """Rows of a chunk; a set that may be linked comes along, packed, and its rarest elements."""

    def judge(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        elements, first, keys = _chunk_sets(docs, shingle)
        n = np.diff(first)
        own = _one_of_each(keys, n)
        place = _places(elements, buckets)
        known = np.unique(place[np.repeat(own, n)])
        held = dict(zip(answers.column("bucket").to_pylist(), answers.column("payload")))
        often = [np.frombuffer(held[k].as_buffer(), np.uint16) for k, _, _ in _by_bucket(known)]
        often = np.concatenate(often)[np.searchsorted(known, place)] if often else np.zeros(0, np.uint16)
        shared = np.add.reduceat(np.append(often > 1, False).astype(np.int64), np.minimum(first[:-1], len(often))) if len(n) else n
        may = np.flatnonzero(own & (shared >= (percent * n + 99) // 100))
        sets, rare = np.full(len(n), None, object), np.full(len(n), None, object)
        for i in may:
            e, f = elements[first[i] : first[i + 1]], often[first[i] : first[i + 1]]
            order = np.lexsort((e, f))[: n[i] - (percent * n[i] + 99) // 100 + 1]
            sets[i], rare[i] = e.tobytes(), e[order[f[order] > 1]].tobytes()
        return pa.table([docs.column("doc_id"), docs.column("key"), pa.array(n), pa.array(keys), pa.array(sets, pa.binary()), pa.array(rare, pa.binary())], names=["doc_id", "key", "n", "class", "set", "rare"])

    return releasing(judge)


# --- candidates: rare elements that sets share --------------------------------------------


def _rare_signatures(batches: Iterator[pa.RecordBatch], percent: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (p, s, class, null): rare elements (class, n, rare), for the set's size class and the next;
    and rows (p, 0, u, v) for classes joined within the batch."""
    for b in batches:
        n = b.column(1).to_numpy()
        elements, first = _unpacked(b, 2)
        own = np.searchsorted(size_classes(int(n.max(initial=1)) + 1, percent), n, side="right") - 1
        of = np.repeat(np.arange(len(n)), np.diff(first))
        sig = [mix(elements ^ mix((own[of] + up).astype(U64) << U64(32))) for up in (0, 1)]
        yield from _signature_rows(np.concatenate(sig), b.column(0).to_numpy()[np.append(of, of)], buckets)


def _unpacked(b: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements and offsets of a column of packed sets."""
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(at)]
    return np.concatenate(sets) if sets else np.zeros(0, U64), np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int64)


def _signature_rows(sig: np.ndarray, c: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of a block: each signature once, and edges for the classes that share one."""
    order = np.lexsort((c, sig))
    sig, c = sig[order], c[order]
    new = np.append(True, sig[1:] != sig[:-1]) if len(sig) else np.zeros(0, bool)
    lead = c[np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))] if len(c) else c
    u, v = forest(c[~new], lead[~new])
    sig, c, m = sig[new], c[new], len(u)
    bucket = np.append(sig, mix(u.view(U64))) & U64(0xFFFFFFFF)
    rest = (sig >> U64(32)).astype(np.uint32).view(np.int32)
    no_edge = np.append(np.ones(len(c), bool), np.zeros(m, bool))
    yield pa.RecordBatch.from_arrays(
        [pa.array((bucket % U64(buckets)).astype(np.int32)), pa.array(np.append(rest, np.zeros(m, np.int32))), pa.array(np.append(c, u)), pa.array(np.append(np.zeros(len(c), np.int64), v), mask=no_edge)],
        names=["p", "s", "c", "v"],
    )


def _meet(batches: Iterator[pa.RecordBatch], held_edges: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Stars of the classes that share a signature. Rows come sorted by (p, s), so a signature of any
    number of rows streams through; what is held are the last lead and ``held_edges`` edges or so."""
    last, lead = None, 0
    us, vs, n = [], [], 0

    def out() -> Iterator[pa.RecordBatch]:
        u, v = forest(np.concatenate(us), np.concatenate(vs))
        for a in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(u[a : a + (1 << 16)]), pa.array(v[a : a + (1 << 16)])], names=["u", "v"])

    for b in batches:
        edge = b.column(3).is_valid().to_numpy(zero_copy_only=False)
        c = b.column(2).to_numpy()
        if edge.any():
            us.append(c[edge]), vs.append(b.column(3).drop_null().to_numpy())
        key = (b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy().view(np.uint32))[~edge]
        c = c[~edge]
        if len(c):
            new = np.append(key[0] != last, key[1:] != key[:-1])
            at = np.maximum.accumulate(np.where(new, np.arange(len(c)), -1))
            leads = np.where(at >= 0, c[at], lead)
            last, lead = key[-1], leads[-1]
            other = c != leads
            us.append(c[other]), vs.append(leads[other])
        n += len(us[-1]) if us else 0
        if n > held_edges:
            yield from out()
            us, vs, n = [], [], 0
    if us:
        yield from out()
    release()


# --- the prefix tree ----------------------------------------------------------------------


def trie_links(sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that span the components of the sets; only between different sides if there are two."""
    count = len(sets)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(count), size)
    gram, back, often = np.unique(flat, return_inverse=True, return_counts=True)
    # N-grams of one set alone can't be shared: they only count as missed.
    order = np.argsort(-often, kind="stable")
    order = order[often[order] > 1]
    rank = np.full(len(gram), -1)
    rank[order] = np.arange(len(order))
    r = rank[back]
    shared = r >= 0
    member = np.zeros((count, len(order)), bool)
    member[owner[shared], r[shared]] = True
    paths = [np.flatnonzero(m) for m in member]
    by = sorted(range(count), key=lambda i: paths[i].astype(">u4").tobytes())
    length = np.array([len(paths[i]) for i in by])
    common = np.zeros(count + 1, np.int64)
    for k in range(1, count):
        a, b = paths[by[k - 1]], paths[by[k]]
        m = min(len(a), len(b))
        d = np.flatnonzero(a[:m] != b[:m])
        common[k] = d[0] if len(d) else m
    two = len(np.unique(side)) > 1
    comp = np.arange(count)
    by = np.array(by)
    left, right = [], []
    total = size[by]
    least_below = lambda lo, hi: total[lo:hi].min()
    # A node is an interval of the sorted sets; queries are positions in the same order.
    stack = [(0, count, 0, np.arange(count), np.zeros(count, np.int64))]
    while stack:
        lo, hi, depth, q, got = stack.pop()
        q_sets = by[q]
        if hi - lo == 1:
            y = by[lo]
            ok = (q > lo) & (comp[q_sets] != comp[y])
            if two:
                ok &= side[q_sets] != side[y]
            q, got, q_sets = q[ok], got[ok], q_sets[ok]
            end = int(length[lo])
        else:
            end = int(common[lo + 1 : hi].min())
        # The largest overlap the subtree can reach must do for its smallest set.
        path, reach = paths[by[lo]], length[lo:hi].max()
        need = (percent * (size[q_sets] + least_below(lo, hi)) + 99 + percent) // (100 + percent)
        for a in range(depth, end, 128):
            if not len(q):
                break
            step = path[a : min(a + 128, end)]
            got = got + member[np.ix_(q_sets, step)].sum(1)
            ok = got + (reach - min(a + 128, end)) >= need
            q, got, q_sets, need = q[ok], got[ok], q_sets[ok], need[ok]
        if not len(q):
            continue
        if hi - lo == 1:
            y = by[lo]
            linked = 100 * got >= percent * (size[q_sets] + size[y] - got)
            for x in q_sets[linked]:
                if comp[x] != comp[y]:
                    left.append(int(x)), right.append(int(y))
                    comp[comp == comp[x]] = comp[y]
            continue
        cuts = [lo, *(np.flatnonzero(common[lo + 1 : hi] == end) + lo + 1).tolist(), hi]
        kids = sorted(zip(cuts, cuts[1:]), key=lambda k: k[0] - k[1])
        stack += [(a, b, end, q, got) for a, b in kids]
    return np.array(left, np.int64), np.array(right, np.int64)


def _join_blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of each group of rows (root, i, j), which come one group after the other."""
    held: list[tuple] = []
    now = None

    def out() -> pa.RecordBatch:
        keys = np.array([h[0] for h in held], np.int64)
        left, right = trie_links([np.frombuffer(h[2], np.uint64) for h in held], np.array([h[1] for h in held]), percent)
        u, v = forest(keys[left], keys[right])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), now[1] is not None))], names=["u", "v", "split"])

    for b in batches:
        for root, i, j, mine, c, s in zip(*(b.column(k) for k in range(6))):
            key = root.as_py(), i.as_py(), j.as_py()
            if key != now and held:
                yield out()
                held = []
            now = key
            if held and held[-1][0] == c.as_py():  # a class that several blocks of texts sent
                continue
            held.append((c.as_py(), mine.as_py() or 0, s.as_buffer()))
    if held:
        yield out()
    release()


def _with_blocks(members: DataFrame) -> DataFrame:
    """``members`` (root, class, n) with the number of blocks that their group is cut to."""
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("grams"))
    amount = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    return members.join(sizes.select("root", amount.alias("blocks")), "root")


def _first_deal() -> Column:
    """A small group is one trie. A set of a large group goes to two random blocks of it: copies of one
    text are linked within every block, and two ways to cut the group tie the blocks together."""
    none = F.lit(None).cast("int")
    block = lambda salt: F.pmod(F.xxhash64("class", F.lit(salt)), F.col("blocks")).cast("int")
    to = lambda i, j: F.struct(i.alias("i"), j.alias("j"), F.lit(0).cast("bigint").alias("side"))
    return F.when(F.col("blocks") == 1, F.array(to(none, none))).otherwise(F.array(*[to(F.lit(salt), block(salt)) for salt in (0, 1)]))


def _tries(dealt: DataFrame, parts: int, percent: int) -> DataFrame:
    """Links (u, v, split) of the tries, one for each (root, i, j) of ``dealt`` (root, to, class, set)."""
    rows = dealt.select("root", "to.i", "to.j", "to.side", "class", "set").repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j", "class")
    return cut(rows.mapInArrow(partial(_join_blocks, percent=percent), "u bigint, v bigint, split boolean"))


def _rest_links(sets: DataFrame, joined: DataFrame, parts: int, percent: int) -> DataFrame:
    """Links (u, v) between sets of a large group that ``joined`` (node, root) hasn't connected yet.

    The largest component of a group needs no look inside, so only the rest meets all blocks.
    """
    comp = joined.select(F.col("node").alias("class"), F.col("root").alias("comp"))
    rows = cut(sets.select("root", "class", "blocks", (F.length("set") / 8).cast("bigint").alias("n")).dropDuplicates(["class"]).join(comp, "class", "left").withColumn("comp", F.coalesce("comp", "class")))
    size = rows.groupBy("root", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("root").agg(F.max_by("comp", F.struct("k", "comp")).alias("most"))
    rows = rows.join(size, "root")
    rest = rows.where("comp != most")
    amount = _with_blocks(rest.select("root", "class", "n")).groupBy("root").agg(F.max("blocks").alias("rest_blocks"))
    rows = cut(rows.join(amount, "root").select("class", "comp", "most", "rest_blocks"))
    if rows.isEmpty():
        return sets.sparkSession.createDataFrame([], "u bigint, v bigint")
    own, mine = F.pmod(F.xxhash64("class", F.lit(0)), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("class", F.lit(2)), F.col("rest_blocks")).cast("int")
    to = lambda i, j: F.struct(i.alias("i"), j.alias("j"), F.col("comp").alias("side"))
    with_all = F.transform(F.sequence(F.lit(0), F.col("rest_blocks") - 1), lambda i: to(i, own))
    with_rest = F.when(F.col("comp") != F.col("most"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: to(mine, j))).otherwise(F.array().cast("array<struct<i:int,j:int,side:bigint>>"))
    dealt = sets.join(rows, "class").select("root", F.explode(F.concat(with_all, with_rest)).alias("to"), "class", "set")
    return _tries(dealt, parts, percent).select("u", "v")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, key (of the row), n_shingles, component_id (least doc_id reachable by links), root.

    One row for every row of ``docs``; rows of a component share ``root``. Rows are linked whose
    sets of ``shingle`` words agree to ``percent`` or more.

    Null or wordless text: no shingles, linked with nothing, component_id is its own doc_id.
    Rows with equal sets are linked; a null doc_id is never the least unless all are null.
    Rows that share a doc_id are judged by their own texts. Other columns are not read.
    """
    docs = docs.select("doc_id", "text", text_key(F.col("doc_id"), F.col("text")).alias("key"))
    size = text_bytes(docs)
    buckets = max(12, -(-size // MEET_BYTES))
    docs = in_chunks(docs, chunks_for(size, MEET_BYTES))
    sent = docs.groupBy("chunk").applyInArrow(_send_elements(shingle, buckets), _SENT)
    counts = sent.groupBy("bucket").applyInArrow(_count_elements, _SENT)
    rows = cut(docs.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(_judge(shingle, percent, buckets), _ROWS))
    one = rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    packed = rows.where("set IS NOT NULL")
    rare = packed.select("class", "n", "rare").mapInArrow(partial(_rare_signatures, percent=percent, buckets=8 * buckets), "p int, s int, c bigint, v bigint")
    groups = components(rare.repartition(buckets, "p").sortWithinPartitions("p", "s").mapInArrow(_meet, "u bigint, v bigint"), dense=False)
    members = packed.select("class", "n").dropDuplicates(["class"]).join(groups, groups["node"] == F.col("class")).select("root", "class", "n")
    members = cut(_with_blocks(members))
    known = members.select("root", "blocks", "class")
    sets = packed.select("class", "set").join(F.broadcast(known) if members.count() <= BROADCAST_ROWS else known, "class")
    parts = buckets
    links = _tries(sets.select("root", F.explode(_first_deal()).alias("to"), "class", "set"), parts, percent)
    found = links.where("not split").select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    if not members.where("blocks > 1").isEmpty():
        links = links.where("split").select("u", "v")
        found = found.unionByName(components(links.unionByName(_rest_links(sets.where("blocks > 1"), components(links), parts, percent))))
    named = one.select("class", "least").join(found, F.col("class") == F.col("node"), "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("class", "root", "component_id")
    out = rows.select("doc_id", "key", "n", "class").join(named.hint("shuffle_hash"), "class", "left")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), alone.alias("component_id"), "root")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the one of least doc_id (null ids last), then least
    row key, then, among rows of equal id and text, the one whose other columns come first as JSON.

    Rows without shingles are linked with nothing and all stay, repeated ones too. Empty table:
    empty result. Columns of any name pass through.
    """
    key, row, whole = (free_name(docs.columns, n) for n in ("jj_key", "jj_row", "jj_whole"))
    spoken = near_duplicates(docs, shingle, percent).where("n_shingles > 0")
    first = spoken.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("f")).select("f.key")
    # What isn't the plain case, one row for each key: a row that goes, or one that repeats and stays once.
    many = spoken.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).join(first.withColumn("stays", F.lit(True)), "key", "left")
    odd = cut(many.where("stays IS NULL OR rows > 1").select(F.col("key").alias(key), F.col("stays").isNotNull().alias(whole)))
    odd = F.broadcast(odd) if odd.count() <= BROADCAST_ROWS else odd
    rows = docs.withColumn(row, text_key(F.col("doc_id"), F.col("text"))).join(odd, F.col(row) == F.col(key), "left")
    plain = rows.where(F.col(key).isNull()).select(*docs.columns)
    tie = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)]), {"ignoreNullFields": "false"})
    once = rows.where(F.col(whole)).groupBy(row).agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), tie).alias(whole))
    return plain.unionByName(once.select(*[F.col(whole)[c].alias(c) for c in docs.columns]))


def op3_jaccard(spark, sf_dir):
    """doc_id, n_shingles, component_id of every document, by 3-word shingles at 90 %.

    Nulls, empty and very long texts, repeated rows, empty tables: as in near_duplicates.
    """
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT k, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
c AS (SELECT a.k AS i, b.k AS j, count(*) AS m FROM s a JOIN s b ON a.x = b.x AND a.k < b.k GROUP BY a.k, b.k),
l AS (SELECT i, j FROM c JOIN n p ON p.k = i JOIN n q ON q.k = j WHERE 100 * m >= 90 * (p.n + q.n - m)),
e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
r AS (SELECT k, k AS o FROM n UNION SELECT r.k, e.j FROM r JOIN e ON r.o = e.i),
b AS (SELECT r.k, min(doc_id) AS least FROM r JOIN d ON d.k = r.o GROUP BY r.k)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, CASE WHEN n.n IS NULL THEN doc_id ELSE least END AS component_id FROM d LEFT JOIN n USING (k) LEFT JOIN b USING (k)
"""
