"""Arrow and numpy kernels over columns of text: words, their hashes, and hashes of runs of them.

Hashes have 64 bits and depend on nothing but their input, so that tasks that run again on another executor give the same rows.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)

HASHED_AT_ONCE = 1 << 18

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it


def give_back() -> None:
    """Returns to the system what a worker that goes on living holds but doesn't use."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20):
    """Slices of a batch with about `limit` bytes of text at most, or one row."""
    n = batch.num_rows
    if not n:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


def listed(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, bounds, vocabulary) of lists of words, without empty ones: list i holds the words vocabulary[codes[bounds[i]:bounds[i + 1]]]."""
    words = lists.flatten()
    bounds = np.asarray(lists.offsets).astype(np.int64)
    bounds = bounds - bounds[0]
    full = np.asarray(pc.binary_length(words)) > 0
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        bounds = before[bounds]
        words = words.filter(pa.array(full))
    coded = words.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), bounds, coded.dictionary


def split_units(texts: pa.Array, separators: str = " \n") -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, bounds, vocabulary) of the units between runs of separators; null text has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    for c in separators[1:]:
        texts = pc.replace_substring(texts, c, separators[0])
    return listed(pc.split_pattern(texts, separators[0]))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def string_bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string array without nulls."""
    if strings.offset or not len(strings):
        strings = pa.concat_arrays([strings, pa.array([""], strings.type)]).slice(0, len(strings)) if strings.offset else strings
    wide = pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type)
    _, offsets, data = strings.buffers()
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32, len(strings) + 1 + strings.offset)[strings.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def hash_strings(strings: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string: the sum of a random value for each (place, byte), mixed with the length."""
    raw, bounds = string_bytes(strings)
    lengths = np.diff(bounds)
    total = np.zeros(len(strings), np.uint64)
    a = 0
    while bounds[a] < bounds[-1]:  # HASHED_AT_ONCE bytes or one string at a time: a byte takes some 50 bytes here
        z = max(a + 1, int(np.searchsorted(bounds, bounds[a] + HASHED_AT_ONCE, side="right")) - 1)
        some = np.flatnonzero(lengths[a:z]) + a
        if len(some):
            place = np.arange(bounds[a], bounds[z]) - np.repeat(bounds[a:z], lengths[a:z])
            each = mix64((place.astype(np.uint64) * np.uint64(256) + raw[bounds[a] : bounds[z]] + np.uint64(seed << 40) + np.uint64(1)) * _MUL)
            total[some] = np.add.reduceat(each, bounds[some] - bounds[a])
        a = z
    return mix64(total + lengths.astype(np.uint64) * _MUL)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbours in h."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    last = len(h) - n + 1
    out = h[:last].copy()
    for i in range(1, n):
        out *= _MUL
        out += h[i : i + last]
    out += np.uint64(n)
    return mix64(out)


def run_starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """Of places 0 .. bounds[-1] - n, those whose n neighbours stay within one text."""
    total = int(bounds[-1])
    if total < n:
        return np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.arange(total - n + 1)
    return starts[owner[: total - n + 1] == owner[n - 1 :]]


# ---------------------------------------------------------------- portable hashes, see sigweave.functions.hashing


def polynomials(strings: pa.Array) -> np.ndarray:
    """Unsigned 32-bit polynomial hashes (base 31, on code points) of strings."""
    code = np.frombuffer("".join(strings.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.asarray(pc.utf8_length(strings)).astype(np.int64)
    out = np.zeros(len(strings), np.uint64)
    if not len(code):
        return out
    power = np.ones(int(sizes.max()), np.uint64)
    for i in range(1, len(power)):
        power[i] = power[i - 1] * np.uint64(31) & _LOW
    ends = np.cumsum(sizes)
    some = sizes > 0
    each = code * power[np.repeat(ends, sizes) - 1 - np.arange(len(code))] & _LOW
    out[some] = np.add.reduceat(each, (ends - sizes)[some]) & _LOW
    return out


def sequences(h: np.ndarray, k: int) -> np.ndarray:
    """Unsigned 32-bit hashes of all runs of k neighbours in h, which are such hashes."""
    last = max(0, len(h) - k + 1)
    out = np.ones(last, np.uint64)
    for i in range(k):
        out = (out * np.uint64(31) + h[i : i + last]) & _LOW
    return out


_LOW = np.uint64(2**32 - 1)
