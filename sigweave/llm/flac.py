"""FLAC media columns: lossless 8-bit mono streams in, verified PCM blocks with seekable sample offsets out.

Streams follow the public format (RFC 9639): stream information with the samples' MD5, a seek table, frames of
BLOCK samples with constant, verbatim, fixed or linear predictors and Rice residuals, CRC-8 of each header, CRC-16 of each frame.

Encoding and decoding work on all frames of a slice of rows side by side: frames of one length are the rows of a
matrix, Rice codes are read in lockstep (one code of every frame per step), and so are predictors and checksums.
Frame starts are found by their sync codes, header checksums and running numbers. What the lockstep reader doesn't
take (several Rice partitions, escapes, other sample sizes, a sync code within data) goes to a plain reader of one
stream, so that any mono stream of the format is read. Streams that fail a checksum raise CorruptStream.

Defined results: null text is an empty one; texts of any length are stored whole, frame by frame; a payload is its
UTF-8 bytes and zeros up to a positive multiple of PAD; equal payloads give equal streams, whatever stands beside
them; repeated rows are stored each; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import materialise, string_bytes, table, text_slices

PAD = 64
BLOCK = 1024
RATE = 8000
LPC_ORDER = 4
PRECISION = 12
SEEK_EVERY = 16  # frames from one seek point to the next
SLICE = 8 << 20
FRAMES = 1024  # encoded side by side

# Fixed values of the format.
SYNC = 0xFFF8
CRC8_POLYNOMIAL, CRC16_POLYNOMIAL = 0x07, 0x8005
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}


class CorruptStream(ValueError):
    """A stream or frame whose checksum or structure is wrong."""


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    out = []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (polynomial if c >> (bits - 1) else 0)
            c &= (1 << bits) - 1
        out.append(c)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(CRC8_POLYNOMIAL, 8), _crc_table(CRC16_POLYNOMIAL, 16)


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes starts..ends of each span as columns, set against the bottom; zeros above."""
    height = int((ends - starts).max())
    at = ends[None, :] - height + np.arange(height)[:, None]
    return np.where(at >= starts[None, :], data[np.maximum(at, 0)], 0).astype(np.uint16)


def crc8(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(starts), np.uint16)
    for row in _spans(data, starts, ends):  # leading zeros leave a CRC that starts at 0 as it is
        crc = _CRC8[crc ^ row]
    return crc


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(starts), np.uint16)
    for row in _spans(data, starts, ends):
        crc = (crc << np.uint16(8)) ^ _CRC16[(crc >> np.uint16(8)) ^ row]
    return crc


# ---------------------------------------------------------------- encoding


class _Bits:
    """Collects fields of up to 17 bits for known bit places of one buffer."""

    def __init__(self, size: int):
        self.size, self.at, self.what = size, [], []

    def put(self, place: np.ndarray, bits: np.ndarray | int, value: np.ndarray) -> None:
        shift = 24 - (place & 7) - bits
        word = (value << shift).astype(np.uint32)
        byte = (place >> 3).ravel()
        parts = word.reshape(-1).view(np.uint8).reshape(-1, 4)  # little-endian: bytes 2, 1, 0 are the field's
        for k in range(3):
            self.at.append(byte + k)
            self.what.append(parts[:, 2 - k])

    def bytes(self) -> np.ndarray:
        out = np.zeros(self.size + 4)
        few = [i for i, at in enumerate(self.at) if len(at) < self.size // 8]
        many = [i for i, at in enumerate(self.at) if len(at) >= self.size // 8]
        for own in ([few] if few else []) + [[i] for i in many]:
            at, what = (np.concatenate([v[i] for i in own]) if len(own) > 1 else v[own[0]] for v in (self.at, self.what))
            out += np.bincount(at, what, self.size + 4)  # fields don't overlap, so sums are unions
        return out[: self.size].astype(np.uint8)


def _levinson(r: np.ndarray, order: int) -> np.ndarray:
    """Predictor coefficients from autocorrelations, one row each."""
    a = np.zeros((len(r), order))
    error = r[:, 0].astype(float) + 1e-9
    for i in range(order):
        acc = r[:, i + 1].astype(float)
        for j in range(i):
            acc = acc - a[:, j] * r[:, i - j]
        k = acc / error
        new = a.copy()
        new[:, i] = k
        for j in range(i):
            new[:, j] = a[:, j] - k * a[:, i - 1 - j]
        a, error = new, np.maximum(error * (1 - k * k), 1e-9)
    return a


def _predicted(x: np.ndarray, coefficients: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Residuals x[i] - (sum(c[j] * x[i - 1 - j]) >> shift) for i >= order."""
    order, n = coefficients.shape[1], x.shape[1]
    total = np.zeros((len(x), n - order), np.int32)
    for j in range(order):
        total += coefficients[:, j : j + 1].astype(np.int32) * x[:, order - 1 - j : n - 1 - j]
    return x[:, order:] - (total >> shift[:, None].astype(np.int32))


def _rice(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(zigzag values, best Rice parameter, bits) of residual rows."""
    u = np.where(e < 0, -2 * e - 1, 2 * e)
    mean = u.sum(1, dtype=np.int64) // max(1, u.shape[1])
    guess = np.frexp(mean.astype(float))[1] - 1
    best, bits = np.zeros(len(u), np.int64), np.full(len(u), np.iinfo(np.int64).max)
    for step in (-1, 0, 1):
        k = np.clip(guess + step, 0, 14).astype(np.int64)
        b = (k + 1) * u.shape[1] + (u >> k[:, None].astype(u.dtype)).sum(1, dtype=np.int64)
        best, bits = np.where(b < bits, k, best), np.minimum(b, bits)
    return u, best, bits


def _utf8_number(numbers: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bytes of coded frame numbers: for byte 0, 1, ...: (which have it, values)."""
    size = np.searchsorted([0x80, 0x800, 0x10000, 0x200000, 0x4000000], numbers, side="right") + 1
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0, 0xF8, 0xFC])[size]
    out = [(np.ones(len(numbers), bool), lead | numbers >> (6 * (size - 1)))]
    for k in range(1, int(size.max(initial=1))):
        some = size > k
        out.append((some, 0x80 | numbers >> (6 * np.maximum(size - 1 - k, 0)) & 0x3F))
    return out


def _frames(x: np.ndarray, numbers: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of the frames of sample rows x, all of one length."""
    frames, n = x.shape
    x = x.astype(np.int32)
    order = np.zeros(frames, np.int64)  # of the predictor; LPC frames have order LPC_ORDER and lpc set
    u, k, bits = _rice(x)
    residual = {("fixed", 0): u}
    kind = np.full(frames, 0)
    plans = [("fixed", o) for o in (0, 1, 2)] + ([("lpc", LPC_ORDER)] if n > 32 else [])
    coefficients, shift = np.zeros((frames, LPC_ORDER), np.int64), np.zeros(frames, np.int64)
    bits = bits + 10
    for i, (name, o) in enumerate(plans[1:], 1):
        if name == "fixed":
            c, s = np.tile(np.array(FIXED[o]), (frames, 1)), np.zeros(frames, np.int64)
            extra = 10 + 8 * o
        else:
            r = np.stack([(x[:, lag:] * x[:, : n - lag]).sum(1, dtype=np.int64) for lag in range(o + 1)], 1)
            a = _levinson(r, o)
            top = np.frexp(np.abs(a).max(1))[1]
            s = np.clip(PRECISION - 1 - top, 0, 15).astype(np.int64)
            c = np.clip(np.rint(a * (1 << s)[:, None]), -(1 << PRECISION - 1), (1 << PRECISION - 1) - 1).astype(np.int64)
            coefficients, shift = c, s
            extra = 10 + 8 * o + 9 + PRECISION * o
        w, kk, b = _rice(_predicted(x, c, s))
        better = b + extra < bits
        residual[name, o] = w
        kind, k, bits = np.where(better, i, kind), np.where(better, kk, k), np.where(better, b + extra, bits)
    verbatim = bits >= 8 * n
    constant = (x == x[:, :1]).all(1)
    body = np.where(constant, 16, 8 + np.where(verbatim, 8 * n, bits))
    number = _utf8_number(numbers)
    number_size = sum(some.astype(np.int64) for some, _ in number)
    head = 4 + number_size + (0 if n == block else 2) + 1
    size = head + (body + 7) // 8 + 2
    bounds = np.concatenate([[0], np.cumsum(size)])
    start = bounds[:-1] * 8
    out = _Bits(int(bounds[-1]))
    code = (block.bit_length() - 1 if n == block else 7) << 4 | 4
    for i, v in enumerate((SYNC >> 8, SYNC & 255, code, 0x02)):
        out.put(start + 8 * i, 8, np.full(frames, v))
    for i, (some, v) in enumerate(number):
        out.put(start[some] + 8 * (4 + i), 8, v[some])
    if n != block:
        out.put(start + 8 * (head - 3), 16, np.full(frames, n - 1))
    at = start + 8 * head
    coded = ~constant & ~verbatim
    orders = np.array([o for _, o in plans])[kind]
    lpc = np.array([name == "lpc" for name, _ in plans])[kind]
    kinds = np.where(constant, 0, np.where(verbatim, 1, np.where(lpc, 32 + orders - 1, 8 + orders)))
    out.put(at, 8, kinds << 1)
    out.put(at[constant] + 8, 8, x[constant, 0] & 255)
    if (plain := np.flatnonzero(verbatim & ~constant)).size:
        out.put(at[plain, None] + 8 + 8 * np.arange(n), 8, x[plain] & 255)
    for i, (name, o) in enumerate(plans):
        own = np.flatnonzero(coded & (kind == i))
        if not own.size:
            continue
        p = at[own] + 8
        for j in range(o):
            out.put(p + 8 * j, 8, x[own, j] & 255)
        p = p + 8 * o
        if name == "lpc":
            out.put(p, 4, np.full(len(own), PRECISION - 1))
            out.put(p + 4, 5, shift[own])
            for j in range(o):
                out.put(p + 9 + PRECISION * j, PRECISION, coefficients[own, j] & (1 << PRECISION) - 1)
            p = p + 9 + PRECISION * o
        out.put(p, 10, k[own])  # method 0, partition order 0, parameter
        w, kk = residual[name, o][own].astype(np.int64), k[own][:, None]
        q = w >> kk
        length = q + 1 + kk
        place = (p + 10)[:, None] + np.cumsum(length, 1) - length + q
        out.put(place, kk + 1, (1 << kk) | (w & ((1 << kk) - 1)))
    data = out.bytes()
    data[bounds[:-1] + head - 1] = crc8(data, bounds[:-1], bounds[:-1] + head - 1)
    check = crc16(data, bounds[:-1], bounds[1:] - 2)
    data[bounds[1:] - 2], data[bounds[1:] - 1] = check >> 8, check & 255
    return data, bounds


def encode(payloads: list[bytes | np.ndarray], block: int = BLOCK) -> list[bytes]:
    """A FLAC stream of each payload; byte b is sample b - 128."""
    raw = [np.frombuffer(p, np.uint8) if isinstance(p, bytes) else p for p in payloads]
    doc, number, length, at = [], [], [], []
    offset = 0
    for i, p in enumerate(raw):
        m = -(-len(p) // block)
        doc.append(np.full(m, i))
        number.append(np.arange(m))
        at.append(offset + block * np.arange(m))
        length.append(np.minimum(block, len(p) - block * np.arange(m)))
        offset += len(p)
    doc, number, length, at = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (doc, number, length, at))
    samples = np.concatenate(raw).astype(np.int16) - 128 if raw else np.zeros(0, np.int16)
    frames: list[bytes] = [b""] * len(doc)
    for n in np.unique(length):
        every = np.flatnonzero(length == n)
        for own in np.split(every, range(FRAMES, len(every), FRAMES)):
            data, bounds = _frames(samples[at[own][:, None] + np.arange(n)], number[own], block)
            whole = data.tobytes()
            for f, a, z in zip(own.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                frames[f] = whole[a:z]
    first = np.searchsorted(doc, np.arange(len(raw) + 1))
    return [_stream(frames[first[i] : first[i + 1]], p, block) for i, p in enumerate(raw)]


def _stream(frames: list[bytes], payload: np.ndarray, block: int) -> bytes:
    sizes = [len(f) for f in frames]
    info = block.to_bytes(2) * 2 + min(sizes, default=0).to_bytes(3) + max(sizes, default=0).to_bytes(3)
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8) + hashlib.md5((payload ^ np.uint8(128)).tobytes()).digest()
    points, offset = [], 0
    for i, s in enumerate(sizes):
        if i % SEEK_EVERY == 0:
            points.append((i * block).to_bytes(8) + offset.to_bytes(8) + min(block, len(payload) - i * block).to_bytes(2))
        offset += s
    seek = b"".join(points)
    return b"".join([b"fLaC", b"\0", len(info).to_bytes(3), info, b"\x83", len(seek).to_bytes(3), seek, *frames])


# ---------------------------------------------------------------- decoding


def metadata(stream: bytes) -> dict:
    """Stream information, seek points (first sample, byte, samples) and where frames start."""
    if stream[:4] != b"fLaC":
        raise CorruptStream("no FLAC stream")
    at, last, out = 4, False, {"seek": []}
    while not last:
        last, kind, size = bool(stream[at] >> 7), stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4])
        body = stream[at + 4 : at + 4 + size]
        if len(body) < size:
            raise CorruptStream("the metadata ends early")
        if kind == 0:
            v = int.from_bytes(body[10:18])
            out |= {"block": int.from_bytes(body[2:4]), "rate": v >> 44, "channels": (v >> 41 & 7) + 1, "bits": (v >> 36 & 31) + 1, "samples": v & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            out["seek"] = [(int.from_bytes(body[i : i + 8]), int.from_bytes(body[i + 8 : i + 16]), int.from_bytes(body[i + 16 : i + 18])) for i in range(0, size, 18)]
        at += 4 + size
    out["frames"] = at
    return out


class _Reader:
    def __init__(self, data: bytes, at: int):
        self.data, self.bit = data, 8 * at

    def take(self, n: int) -> int:
        end = self.bit + n
        if end > 8 * len(self.data):
            raise CorruptStream("the stream ends early")
        v = int.from_bytes(self.data[self.bit >> 3 : (end + 7) >> 3]) >> (-end & 7) & ((1 << n) - 1)
        self.bit = end
        return v

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def zeros(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _crc(table: np.ndarray, bits: int, data: bytes) -> int:
    c = 0
    for b in data:
        c = (c << 8 & (1 << bits) - 1) ^ int(table[(c >> (bits - 8)) ^ b])
    return c


def read_frame(data: bytes, at: int, bits: int = 8) -> tuple[int, list[int], int]:
    """(frame or sample number, samples, end) of the mono frame at a byte, by the format's rules one by one."""
    r = _Reader(data, at)
    if r.take(15) != SYNC >> 1:
        raise CorruptStream("no frame here")
    r.take(1)
    size_code, rate_code, channels, size = r.take(4), r.take(4), r.take(4), r.take(3)
    r.take(1)
    lead = r.take(8)
    ones = 8 - (lead ^ 255).bit_length()
    number = lead & (0x7F >> ones)
    for _ in range(max(0, ones - 1)):
        number = number << 6 | r.take(8) & 0x3F
    n = {1: 192, 6: 0, 7: 0}.get(size_code, 576 << (size_code - 2) if 2 <= size_code <= 5 else 1 << size_code)
    if size_code in (6, 7):
        n = r.take(8 * (size_code - 5)) + 1
    r.take({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
    if r.take(8) != _crc(_CRC8, 8, data[at : (r.bit >> 3) - 1]):
        raise CorruptStream("a frame header's CRC-8 is wrong")
    if channels:
        raise CorruptStream("only mono streams are read")
    bits = {0: bits, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[size]
    r.take(1)
    kind, wasted = r.take(6), 0
    if r.take(1):
        wasted = r.zeros() + 1
    bits -= wasted
    if kind == 0:
        x = [r.signed(bits)] * n
    elif kind == 1:
        x = [r.signed(bits) for _ in range(n)]
    else:
        order = kind - 31 if kind >= 32 else kind - 8
        if not 0 <= order <= 32 or 12 < kind < 32:
            raise CorruptStream("a reserved subframe type")
        x, shift, c = [r.signed(bits) for _ in range(order)], 0, FIXED.get(order)
        if kind >= 32:
            precision = r.take(4) + 1
            shift = r.signed(5)
            c = [r.signed(precision) for _ in range(order)]
        method, parts = r.take(2), r.take(4)
        width = 4 + method
        for p in range(1 << parts):
            k = r.take(width)
            raw = r.take(5) if k == (1 << width) - 1 else None
            for _ in range((n >> parts) - (order if not p else 0)):
                if raw is not None:
                    e = r.signed(raw)
                else:
                    u = r.zeros() << k | r.take(k)
                    e = u >> 1 ^ -(u & 1)
                x.append(e + (sum(c[j] * x[-1 - j] for j in range(order)) >> shift))
    r.bit = (r.bit + 7) & ~7
    end = r.bit >> 3
    if r.take(16) != _crc(_CRC16, 16, data[at:end]):
        raise CorruptStream("a frame's CRC-16 is wrong")
    return number, [v << wasted for v in x], end + 2


def read_stream(data: bytes) -> np.ndarray:
    """Samples of one stream, frame after frame."""
    info = metadata(data)
    at, out = info["frames"], []
    while at < len(data):
        _, x, at = read_frame(data, at, info["bits"])
        out += x
    if info["samples"] and len(out) != info["samples"]:
        raise CorruptStream("samples are missing")
    return np.array(out, np.int64)


_LEADING = (16 - np.frexp(np.arange(65536.0))[1]).astype(np.int64)  # leading zeros of 16 bits


def _lockstep_rice(window: np.ndarray, bit: np.ndarray, k: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(residuals, good): a column for each frame, of counts[frame] residuals; not good are frames with a code of over 31 zeros.

    window[i] holds 64 bits from byte i on. Frames with fewer residuals than others read on beyond them, to no effect."""
    n = int(counts.max())
    out, good = np.empty((n, len(bit)), np.int32), np.ones(len(bit), bool)
    ku, k1 = k.astype(np.uint64), k + 1
    one, low = np.uint64(1), np.uint64(63) - ku
    bit, last = bit.copy(), len(window) - 1
    w = np.empty(len(bit), np.uint64)
    for i in range(n):
        w[:] = window[np.minimum(bit >> 3, last)]
        w <<= (bit & 7).view(np.uint64)
        q = _LEADING.take((w >> np.uint64(48)).view(np.int64))
        far = np.flatnonzero(q == 16)
        if len(far):
            q[far] += _LEADING[((w[far] >> np.uint64(32)) & np.uint64(65535)).view(np.int64)]
            good[far[(q[far] == 32) & (i < counts[far])]] = False
        z = q.view(np.uint64)
        w <<= z
        w <<= one
        w >>= one
        w >>= low
        w |= z << ku
        np.bitwise_xor((w >> one).view(np.int64), -(w & one).view(np.int64), out=out[i], casting="unsafe")
        bit += q
        bit += k1
    return out, good


def _frames_of(data: np.ndarray, n: int, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples, read) of frames of n 8-bit samples, whose subframes start at bytes `at`; read is False for what the plain reader must take."""
    samples, read = np.zeros((len(at), n), np.int16), np.zeros(len(at), bool)
    padded = np.concatenate([data, np.zeros(64, np.uint8)])
    window = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    kind = data[at] >> 1
    plain = (data[at] & 129) == 0
    own = np.flatnonzero(plain & (kind == 0))
    samples[own], read[own] = data[at[own] + 1].astype(np.int8)[:, None], True
    own = np.flatnonzero(plain & (kind == 1) & (at + 1 + n <= end))
    samples[own], read[own] = data[at[own][:, None] + 1 + np.arange(n)].astype(np.int8), True
    take = lambda b, width: (window[b >> 3].astype(np.uint64) << (b & 7).astype(np.uint64)) >> np.uint64(64 - width)
    groups = []  # (frames, order, first samples, coefficients, shift, place of the residual, its parameter)
    for code in np.unique(kind[plain & (((kind >= 8) & (kind <= 12)) | (kind >= 32))]).tolist():
        own = np.flatnonzero(plain & (kind == code))
        lpc, order = code >= 32, code - 31 if code >= 32 else code - 8
        if order > n:
            continue
        first = data[at[own] + 1 + np.arange(order)[:, None]].astype(np.int8) if order else np.zeros((0, len(own)), np.int8)
        bit = (at[own] + 1 + order) * 8
        shift, c = np.zeros(len(own), np.int32), np.tile(np.array(FIXED.get(order, ()), np.int32)[:, None], (1, len(own)))
        good = np.ones(len(own), bool)
        if lpc:
            precision = take(bit, 4).astype(np.int64) + 1
            shift = take(bit + 4, 5).astype(np.int32)
            good = (shift < 16) & (precision == precision[0])
            width = int(precision[0])
            c = np.stack([take(bit + 9 + width * j, width).astype(np.int32) for j in range(order)])
            c -= (c >> (width - 1)) << width
            bit = bit + 9 + width * order
        method, parts = take(bit, 2).astype(np.int64), take(bit + 2, 4).astype(np.int64)
        wide = 4 + (method & 1)
        k = np.where(method == 0, take(bit + 6, 4), take(bit + 6, 5)).astype(np.int64)
        pick = np.flatnonzero(good & (method < 2) & (parts == 0) & (k < (1 << wide) - 1) & (k <= 24))
        groups.append((own[pick], order, first[:, pick], c[:, pick], shift[pick], (bit + 6 + wide)[pick], k[pick]))
    groups = [g for g in groups if len(g[0])]
    if not groups:
        return samples, read
    counts = np.concatenate([np.full(len(g[0]), n - g[1]) for g in groups])
    residual, good = _lockstep_rice(window, np.concatenate([g[5] for g in groups]), np.concatenate([g[6] for g in groups]), counts)
    column = 0
    for own, order, first, c, shift, *_ in groups:
        x = np.empty((n, len(own)), np.int32)
        x[:order] = first
        x[order:] = residual[: n - order, column : column + len(own)]
        fine = good[column : column + len(own)]
        column += len(own)
        if order:
            for i in range(order, n):
                total = c[0] * x[i - 1]
                for j in range(1, order):
                    total += c[j] * x[i - 1 - j]
                total >>= shift
                x[i] += total
        samples[own], read[own] = x.T, fine
    return samples, read


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """Samples of each stream, with all frames' checksums and the stream's MD5 verified."""
    infos = [metadata(s) for s in streams]
    data = np.frombuffer(b"".join(streams), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in streams])]).astype(np.int64)
    out: list[np.ndarray | None] = [None] * len(streams)
    usual = [i for i, m in enumerate(infos) if m["channels"] == 1 and m["bits"] == 8 and m["samples"] and m["block"] & (m["block"] - 1) == 0 and 256 <= m["block"] <= 32768]
    if usual:
        _decode_usual(data, bounds, infos, np.array(usual), out)
    for i, x in enumerate(out):
        if x is None:
            out[i] = x = read_stream(streams[i])
        if infos[i]["bits"] == 8 and any(infos[i]["md5"]) and hashlib.md5(x.astype(np.int8).tobytes()).digest() != infos[i]["md5"]:
            raise CorruptStream("the samples' MD5 is wrong")
    return out


def _decode_usual(data: np.ndarray, bounds: np.ndarray, infos: list[dict], usual: np.ndarray, out: list) -> None:
    block, samples, first = (np.array([infos[i][k] for i in usual]) for k in ("block", "samples", "frames"))
    start, end = bounds[usual] + first, bounds[usual + 1]
    wanted = -(-samples // block)
    # headers: sync code, block size, rate and sample size codes, running number, CRC-8
    at = np.flatnonzero((data[:-1] == SYNC >> 8) & (data[1:] == SYNC & 255))
    doc = np.searchsorted(start, at, side="right") - 1
    at, doc = at[doc >= 0], doc[doc >= 0]
    inside = at + 8 < end[doc]
    at, doc = at[inside], doc[inside]
    full = np.frexp(block.astype(float))[1] - 1
    code = data[at + 2] >> 4
    good = (data[at + 3] & 0xF1 == 0) & ((code == full[doc]) | (code == 7)) & (data[at + 2] & 15 < 12)
    at, doc, code = at[good], doc[good], code[good]
    lead = data[at + 4].astype(np.int64)
    more = np.where(lead < 0x80, 0, np.searchsorted([0xE0, 0xF0, 0xF8, 0xFC], lead, side="right") + 1)
    number = np.where(more == 0, lead, lead & (0x3F >> more))
    for j in range(1, int(more.max(initial=0)) + 1):
        has = more >= j
        number[has] = number[has] << 6 | data[np.minimum(at[has] + 4 + j, len(data) - 1)] & 0x3F
    crc_at = at + 5 + more + 2 * (code == 7)
    good = crc_at < end[doc]
    at, doc, code, number, crc_at = (v[good] for v in (at, doc, code, number, crc_at))
    if not len(at):
        return
    good = data[crc_at] == crc8(data, at, crc_at)
    at, doc, code, number, crc_at = (v[good] for v in (at, doc, code, number, crc_at))
    length = np.where(code == 7, data[crc_at - 2].astype(np.int64) << 8 | data[crc_at - 1], block[doc] - 1) + 1
    low, high = np.searchsorted(doc, np.arange(len(usual))), np.searchsorted(doc, np.arange(len(usual)), side="right")
    rank = np.arange(len(at)) - low[doc]
    # of a stream with just its frames, each at its number, and all checksums right, nothing is left to guess
    stop = np.where(rank + 1 < (high - low)[doc], np.append(at[1:], 0), end[doc])
    fits = (number == rank) & (length == np.minimum(block[doc], samples[doc] - rank * block[doc])) & (stop - 2 > crc_at)
    whole = (high - low == wanted) & (np.bincount(doc, ~fits, len(usual)) == 0)
    keep = whole[doc]
    at, doc, crc_at, length, stop, rank = (v[keep] for v in (at, doc, crc_at, length, stop, rank))
    if not len(at):
        return
    right = crc16(data, at, stop - 2) == (data[stop - 2].astype(np.uint16) << np.uint16(8) | data[stop - 1])
    whole[doc[~right]] = False
    x = np.zeros(int(samples.sum()), np.int16)
    base = np.cumsum(samples) - samples
    for n in np.unique(length):
        own = np.flatnonzero((length == n) & whole[doc])
        if own.size:
            got, read = _frames_of(data, int(n), crc_at[own] + 1, stop[own] - 2)
            x[(base[doc[own]] + rank[own] * block[doc[own]])[:, None] + np.arange(n)] = got
            whole[doc[own[~read]]] = False
    for j, i in enumerate(usual):
        if whole[j]:
            out[i] = x[base[j] : base[j] + samples[j]]


def seek(stream: bytes, sample: int) -> tuple[int, np.ndarray]:
    """(first sample, samples) of the frame holding a sample, reading from the nearest seek point before it."""
    info = metadata(stream)
    at = info["frames"] + max((p for p in info["seek"] if p[0] <= sample), default=(0, 0, 0))[1]
    while at < len(stream):
        number, x, at = read_frame(stream, at, info["bits"])
        if number * info["block"] <= sample < number * info["block"] + len(x):
            return number * info["block"], np.array(x)
    raise IndexError(sample)


# ---------------------------------------------------------------- columns


def padded(texts: pa.Array, pad: int = PAD) -> list[np.ndarray]:
    raw, bounds = string_bytes(pc.fill_null(texts, ""))
    out = []
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        payload = np.zeros(max(pad, -(-(z - a) // pad) * pad), np.uint8)
        payload[: z - a] = raw[a:z]
        out.append(payload)
    return out


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each text's payload as a FLAC stream."""
    schema = T.StructType([docs.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, text, SLICE):
                n = pc.fill_null(pc.cast(pc.binary_length(batch.column(text)), pa.int64()), 0)
                yield pa.RecordBatch.from_arrays([batch.column(key), n, pa.array(encode(padded(batch.column(text))), pa.binary())], names=[key, "n_bytes", "media"])

    return docs.select(key, text).mapInArrow(run, schema)


def _pcm(streams: list[bytes], block: int):
    """For each stream, its decoded and verified signed 8-bit samples as blocks (first sample, bytes)."""
    for x in decode(streams):
        pcm = x.astype(np.int8).tobytes()
        yield [(p, pcm[p : p + block]) for p in range(0, len(pcm), block)]


def pcm_blocks(media: DataFrame, key: str = "doc_id", column: str = "media", block: int = BLOCK) -> DataFrame:
    """(key, block, sample_offset, n_samples, pcm): decoded and verified signed 8-bit samples, in blocks that can be read from any sample offset."""
    schema = T.StructType([media.schema[key], *(T.StructField(c, T.LongType()) for c in ("block", "sample_offset", "n_samples")), T.StructField("pcm", T.BinaryType())])

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, column, SLICE):
                some = [i for i, m in enumerate(batch.column(column)) if m.is_valid]
                rows = [(i, p // block, p, len(x), x) for i, blocks in zip(some, _pcm([batch.column(column)[i].as_py() for i in some], block), strict=True) for p, x in blocks]
                columns = [batch.column(key).take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)), pa.array([r[4] for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return media.select(key, column).mapInArrow(run, schema)


class Digest:
    """What features() tells of a stream, block of samples by block."""

    def __init__(self):
        self.sha, self.bytes, self.square, self.crossings, self.peak, self.sign, self.tail = hashlib.sha256(), 0, 0, 0, 0, None, b""

    def add(self, pcm: bytes) -> None:
        x = np.frombuffer(pcm, np.int8).astype(np.int32)
        payload = (x + 128).astype(np.uint8).tobytes()
        self.sha.update(payload)
        self.bytes += len(payload)
        self.tail = (self.tail + payload)[-PAD:]
        self.square += int((x * x).sum())
        below = x < 0
        self.crossings += int(np.count_nonzero(below[1:] != below[:-1])) + (self.sign is not None and bool(below[0]) != self.sign)
        self.sign, self.peak = bool(below[-1]), max(self.peak, int(np.abs(x).max()))

    def row(self, stream: bytes) -> tuple:
        feature = f"rms={float(np.sqrt(self.square / self.bytes)):.6f};crossings={self.crossings};peak={self.peak}"
        return self.bytes, self.sha.hexdigest(), zlib.crc32(self.tail), len(stream), hashlib.sha256(stream).hexdigest(), feature


def features(media: DataFrame, key: str = "doc_id", column: str = "media", block: int = BLOCK) -> DataFrame:
    """Digests and features of the payloads read back from streams, PCM block by block: root mean square, zero crossings and peak of the samples."""
    fields = [("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")]
    kinds = {"long": T.LongType(), "string": T.StringType()}
    schema = T.StructType([media.schema[key], *(T.StructField(n, kinds[t]) for n, t in fields)])

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, column, SLICE):
                streams = batch.column(column).to_pylist()
                rows = []
                for stream, blocks in zip(streams, _pcm(streams, block), strict=True):
                    digest = Digest()
                    for _, pcm in blocks:
                        digest.add(pcm)
                    rows.append(digest.row(stream))
                columns = [pa.array([r[k] for r in rows], pa.string() if k in (1, 4, 5) else pa.int64()) for k in range(6)]
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("n_bytes"), *columns], names=[f.name for f in schema])

    return media.select(key, "n_bytes", column).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = materialise(store(table(spark, sf_dir, "documents").select("doc_id", "text")), "zstd", **{"parquet.compression.codec.zstd.level": "9"})
    return features(media)
