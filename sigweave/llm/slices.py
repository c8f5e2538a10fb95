"""Slices: some megabytes of documents as one row, and what slices tell each other about hashed keys.

Texts are written once, as slices of about `limit` bytes of text (compressed Arrow data, other columns along with it).
Where words, n-grams or windows of all documents meet, a slice sends its distinct keys, in order, to buckets by key;
a bucket answers every slice with one row, in the order of the keys it got. So a key that is everywhere costs one number
per slice, buckets are even, and there are slices x buckets rows at most, none per document or occurrence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.functions.arrays import give_back

from .common import materialise, text_slices

LEVEL = 6  # of compression


def press(a: np.ndarray) -> bytes:
    """Numbers of one type, byte plane by byte plane."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()) if len(a) else b""


def unpress(data: bytes, kind) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    kind = np.dtype(kind)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(kind.itemsize, -1).T).view(kind).ravel()


def press_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys, as differences."""
    return press(np.diff(keys, prepend=keys.dtype.type(0)))


def unpress_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpress(data, np.uint64), dtype=np.uint64)


def sliced(docs: DataFrame, text: str, limit: int, apart=None) -> DataFrame:
    """docs, written as slices (slice, apart, size, data) of about `limit` bytes of the text column; rows for which apart(batch) is true have slices of their own."""

    def run(batches):
        number = np.random.default_rng()  # slices' numbers are fixed by being written; results don't depend on them

        def emit(parts, own):
            table = pa.Table.from_batches(parts).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
                out.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([int(number.integers(2**62))]), pa.array([own]), pa.array([held[own]]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["slice", "apart", "size", "data"])

        parts: dict[bool, list] = {False: [], True: []}
        held = {False: 0, True: 0}
        for whole in batches:
            for batch in text_slices(whole, text, limit):
                role = np.zeros(batch.num_rows, bool) if apart is None else apart(batch)
                for own in (False, True):
                    some = batch if not own and not role.any() else batch.filter(pa.array(role == own))
                    if not some.num_rows:
                        continue
                    parts[own].append(some)
                    held[own] += (pc.sum(pc.binary_length(some.column(text))).as_py() or 0) + 16 * some.num_rows
                    if held[own] >= limit:
                        yield emit(parts[own], own)
                        parts[own], held[own] = [], 0
        for own in (False, True):
            if parts[own]:
                yield emit(parts[own], own)

    return materialise(docs.mapInArrow(run, "slice long, apart boolean, size long, data binary"), "none")


def rows_of(data) -> pa.RecordBatch:
    """The rows of a slice."""
    (batch,) = pa.ipc.open_stream(data).read_all().combine_chunks().to_batches()
    return batch


def bucket_edges(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of sorted keys that go to one bucket."""
    b = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    edges = np.append(np.flatnonzero(np.diff(b, prepend=-1)), len(b))
    return [(int(b[a]), int(a), int(z)) for a, z in zip(edges[:-1], edges[1:], strict=True)]


def gathered(answers: DataFrame, *columns: str) -> DataFrame:
    """(slice, answers): a slice's answers in one row, one entry per bucket (and n-gram order) at most."""
    return answers.groupBy("slice").agg(F.collect_list(F.struct("bucket", *columns)).alias("answers"))


def one_by_one(batches):
    """The rows of batches, each opened only when its turn comes; what the one before took goes back first."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i] for name, column in zip(batch.schema.names, batch.columns, strict=True)}
            give_back()
