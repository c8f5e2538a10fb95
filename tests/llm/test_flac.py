import hashlib
import zlib

import numpy as np
import pytest

from sigweave.llm import flac
from sigweave.llm.common import materialise

TEXTS = [None, "", "a", "x" * 64, "x" * 65, "héé ñ 日本 😀 " * 300, "plain words of a text. " * 2000, "\x00\x01" * 700, "zZ" * 32 + "\n" * 900, "one two\nthree"]


def payloads():
    rng = np.random.default_rng(4)
    wave = (128 + 90 * np.sin(np.arange(64 * 70) / 9)).astype(np.uint8)
    out = [bytes(64), b"a" * 128, bytes(rng.integers(0, 256, 64 * 33, dtype=np.uint8)), wave.tobytes(), bytes(np.repeat(rng.integers(0, 256, 64, dtype=np.uint8), 50)[:3200])]
    out += [b"\xff\xf8\xa4\x02" * 16 * 40, bytes(rng.integers(100, 110, 1024 * 20, dtype=np.uint8)), bytes([0, 255] * 512 * 3)]
    return out


def test_round_trips_by_both_readers():
    streams = flac.encode(payloads())
    for p, s, x in zip(payloads(), streams, flac.decode(streams), strict=True):
        assert (x + 128).astype(np.uint8).tobytes() == p
        assert (flac.read_stream(s) + 128).astype(np.uint8).tobytes() == p


def test_streams_do_not_depend_on_what_stands_beside_them():
    together = flac.encode(payloads())
    assert together == [flac.encode([p])[0] for p in payloads()]


def test_predictors_make_smooth_signals_small():
    wave = payloads()[3]
    assert len(flac.encode([wave])[0]) < 0.6 * len(wave)


def test_every_damaged_byte_is_noticed():
    (stream,) = flac.encode([b"some text that is stored " * 64])
    frames = flac.metadata(stream)["frames"]
    for at in range(frames, len(stream), 7):
        bad = bytearray(stream)
        bad[at] ^= 0x10
        with pytest.raises(flac.CorruptStream):
            flac.decode([bytes(bad)])


def test_seek_reads_the_frame_that_holds_a_sample():
    p = payloads()[6]
    (stream,) = flac.encode([p])
    x = np.frombuffer(p, np.uint8).astype(int) - 128
    for sample in (0, 1023, 1024, 17000, len(x) - 1):
        first, got = flac.seek(stream, sample)
        assert first <= sample < first + len(got) and (got == x[first : first + len(got)]).all()
    with pytest.raises(IndexError):
        flac.seek(stream, len(x))


class Bits:
    def __init__(self):
        self.s = ""

    def put(self, v, n):
        self.s += format(v & ((1 << n) - 1), f"0{n}b") if n else ""
        return self

    def bytes(self):
        s = self.s + "0" * (-len(self.s) % 8)
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8))


def foreign(partition_order, escape, method):
    """A stream of another encoder's kind: 256 samples, several Rice partitions, method 1, an escaped partition."""
    rng = np.random.default_rng(partition_order)
    x = np.cumsum(rng.integers(-3, 4, 256)).clip(-120, 120)
    e = np.concatenate([[0], np.diff(x)])
    b = Bits().put(0xFFF8, 16).put(0x80, 8).put(0x02, 8).put(0, 8)
    b.put(flac._crc(flac._CRC8, 8, b.bytes()), 8)
    b.put((8 + 1) << 1, 8).put(int(x[0]), 8).put(method, 2).put(partition_order, 4)
    n = 256 >> partition_order
    for p in range(1 << partition_order):
        own = e[max(1, p * n) : (p + 1) * n]
        if escape and p == 1:
            b.put((1 << (4 + method)) - 1, 4 + method).put(5, 5)
            for v in own:
                b.put(int(v), 5)
            continue
        b.put(p % 3, 4 + method)
        for v in own:
            u = 2 * int(v) if v >= 0 else -2 * int(v) - 1
            b.put(1, (u >> p % 3) + 1).put(u, p % 3)
    frame = b.bytes()
    frame += flac._crc(flac._CRC16, 16, frame).to_bytes(2)
    info = (256).to_bytes(2) * 2 + bytes(6) + (8000 << 44 | 7 << 36 | 256).to_bytes(8) + hashlib.md5(x.astype(np.int8).tobytes()).digest()
    return b"fLaC\x80" + len(info).to_bytes(3) + info + frame, x


@pytest.mark.parametrize("how", [(0, False, 0), (3, False, 0), (2, True, 0), (0, False, 1), (2, True, 1)])
def test_streams_of_other_encoders(how):
    stream, x = foreign(*how)
    assert (flac.decode([stream])[0] == x).all() and (flac.read_stream(stream) == x).all()


def wanted(text):
    raw = (text or "").encode()
    p = raw + bytes(-len(raw) % 64 if raw else 64)
    return len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])


def test_columns(spark):
    df = spark.createDataFrame([(i, t, "x", b"m") for i, t in enumerate([*TEXTS, *TEXTS[-2:]])] + [(None, "no id", "x", b"m")], "doc_id long, text string, feature string, media binary")
    rows = flac.features(flac.store(df)).collect()
    assert len(rows) == len(TEXTS) + 3
    by_text = {}
    for r in rows:
        text = "no id" if r.doc_id is None else [*TEXTS, *TEXTS[-2:]][r.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == wanted(text)
        assert by_text.setdefault(text or "", tuple(r)[1:]) == tuple(r)[1:]
    assert flac.features(flac.store(df.limit(0))).count() == 0
    blocks = flac.pcm_blocks(flac.store(df)).where("doc_id = 6").orderBy("block").collect()
    assert [b.sample_offset for b in blocks] == list(range(0, blocks[-1].sample_offset + 1, 1024))
    pcm = np.frombuffer(b"".join(b.pcm for b in blocks), np.int8).astype(int) + 128
    assert pcm.astype(np.uint8).tobytes().rstrip(b"\0") == TEXTS[6].encode()


def plain_feature(text):
    raw = (text or "").encode()
    x = [b - 128 for b in raw + bytes(-len(raw) % 64 if raw else 64)]
    rms = (sum(v * v for v in x) / len(x)) ** 0.5
    return f"rms={rms:.6f};crossings={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))};peak={max(map(abs, x))}"


def test_features_and_media_columns_are_those_of_what_is_stored(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    media = {r.doc_id: bytes(r.media) for r in flac.store(df).collect()}
    for block in (64, 1024, 1 << 20):
        for r in flac.features(flac.store(df), block=block).collect():
            stream = media[r.doc_id]
            assert (r.media_bytes, r.media_sha256, r.feature) == (len(stream), hashlib.sha256(stream).hexdigest(), plain_feature(TEXTS[r.doc_id]))
            # what is stored holds the text, by the format's rules one by one
            raw = (flac.read_stream(stream) + 128).astype(np.uint8).tobytes()
            assert raw[: r.n_bytes] == (TEXTS[r.doc_id] or "").encode() and not any(raw[r.n_bytes :])


def test_media_are_written_before_they_are_read(spark, monkeypatch):
    written = []
    monkeypatch.setattr(flac, "materialise", lambda df, how, **more: written.append(materialise(df, how, **more)) or written[-1])
    rows = flac.query(spark, "/root/testdata/sf0.001")
    assert rows.count() == written[0].count() and written[0].columns == ["doc_id", "n_bytes", "media"]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = flac.query(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == wanted(texts[r.doc_id])
