"""Texts of a batch become Python objects a few at a time."""

import tracemalloc

import pyarrow as pa

from sonoplan.sources import text


def test_few_texts_at_once():
    long = [chr(97 + k % 26) * 100_000 for k in range(400)]
    b = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(long)], names=["track_id", "text"])
    del long
    tracemalloc.start()
    assert sum(len(part) for part in text.in_turn(b, 16)) == 400
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20  # all of them have 40 MB


def test_blanks_don_t_count():
    texts = [None if k % 3 == 0 else "  " if k % 3 == 1 else f"t{k}" for k in range(100)]
    b = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(texts)], names=["track_id", "text"])
    rows = [(k, t) for k, t in enumerate(texts) if t and t.strip()]
    assert list(text.in_turn(b, 8)) == [rows[at : at + 8] for at in range(0, len(rows), 8)]
    assert list(text.in_turn(b.slice(0, 2), 8)) == []
