"""What a worker holds for a slice of 4 MB of text."""

import tracemalloc

import numpy as np
import pyarrow as pa

from sigweave.functions import arrays
from sigweave.llm import slices
from sigweave.llm import substring_dedup as S


def peak_mb(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_strings_are_hashed_some_at_a_time_with_the_same_hashes(monkeypatch):
    words = [f"wort{i * 7919}" + "ß" * (i % 5) for i in range(200_000)] + ["", "x" * 700_000, "", "y", ""]
    got, mb = peak_mb(lambda: arrays.hash_strings(pa.array(words), 3))
    assert mb < 60
    monkeypatch.setattr(arrays, "HASHED_AT_ONCE", 1 << 40)
    assert np.array_equal(got, arrays.hash_strings(pa.array(words), 3))
    for limit in (1, 9):
        monkeypatch.setattr(arrays, "HASHED_AT_ONCE", limit)
        assert np.array_equal(got[-900:], arrays.hash_strings(pa.array(words[-900:]), 3))


def test_windows_of_a_slice_take_little_more_than_what_is_kept():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 90_000, 600)) for _ in range(1100)]
    rows = pa.table({"id": pa.array(range(1100), pa.int64()), "text": texts}).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    _, h = S.Places(pa.array(texts)).anchors(S.STAGE_WINDOW)
    keys = np.unique(h)
    found = [{"bucket": b, "flags": S.bits(np.ones(z - a, bool))} for b, a, z in slices.bucket_edges(keys, 12)]
    row = {"data": pa.scalar(sink.getvalue().to_pybytes(), pa.binary()), "anchors": pa.scalar(found)}
    w, mb = peak_mb(lambda: S.Windows(row, S.STAGE_WINDOW, 12, 64))
    assert len(w.start) > 500_000 and mb < 60


def test_what_a_row_took_goes_back_before_the_next(monkeypatch):
    seen = []
    monkeypatch.setattr(slices, "give_back", lambda: seen.append("back"))
    for row in slices.one_by_one([pa.record_batch({"slice": [1, 2, 3]})]):
        seen.append(row["slice"].as_py())
    assert seen == [1, "back", 2, "back", 3, "back"]
