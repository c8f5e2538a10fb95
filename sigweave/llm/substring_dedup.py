"""Substring dedup by difference-cover anchors.

A window of W words is removed if the same words start earlier somewhere. Anchors are runs of L = W - V + 1 words
at places (counted from the text's start) that are in a difference cover modulo V: two equal windows, wherever they
start, hold equal anchors at the same offset below V. Texts are written once, as slices (see slices), and:

1. every slice sends the distinct hashes of its anchors, a |cover| / V part of its places at most, to buckets by hash;
   a bucket tells each slice which of them occur more than once;
2. each repeated anchor is extended to the windows that hold it at an offset below V; a slice sends each such window
   once (64 to 96 bits of hash of all W words, so many that two windows of a corpus meet with a chance of one in a
   million) with its earliest start in the slice, and a bucket tells each slice which of its windows start nowhere earlier;
3. slices drop the words that all other windows cover.

No row stands for a document, a window or a pair of them: there are slices x buckets rows of packed numbers, and a
passage that all texts share is one number per slice. Buckets are sized by the corpus (ANCHORS_A_BUCKET).

Defined results: null text has no words; texts under W words lose nothing, texts of any length are taken whole (a text
over a slice's size is a slice of its own); earlier means a smaller id, then (for rows that share an id) a smaller row
number given once, then an earlier start; a null id is larger than all others; an empty table gives no rows; extra
columns are kept by `deduplicated` and play no part; for `strip`, a column of docs with the name of a new one gives way.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_strings, materialise, ngram_hashes, split_words, table
from .slices import bucket_edges, gathered, one_by_one, press, press_keys, rows_of, sliced, unpress, unpress_keys

WINDOW = 20
STAGE_WINDOW = 40
ANCHORS_A_BUCKET = 1_000_000
NO_ID = 2**63 - 1
SPARE_BITS = 14  # of a window's hash, beyond twice what it takes to number the corpus's bytes
SLICE = 4 << 20
NEW = ("n_words", "n_removed", "kept")

# Perfect difference sets, modulus -> cover.
COVERS = {1: (0,), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27), 57: (0, 1, 6, 15, 22, 26, 45, 55)}

SENT_ANCHORS = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("keys", pa.binary()), ("twice", pa.binary())])
SENT_WINDOWS = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), *((c, pa.binary()) for c in ("keys", "extra", "id", "row", "start"))])


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """(V, cover, L): the largest modulus that leaves anchors of a third of the window, and 8 words, at least."""
    v = max(v for v in COVERS if v == 1 or window - v + 1 >= max(8, window // 3))
    return v, COVERS[v], window - v + 1


class Places:
    """The words of a slice of texts: their hashes, and each text's bounds."""

    def __init__(self, texts: pa.Array):
        self.codes, self.bounds, self.words = split_words(texts, lower=False)
        self.h = hash_strings(self.words)[self.codes]
        self.size = np.diff(self.bounds)
        self.owner = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the anchors, in order."""
        v, cover, length = cover_for(window)
        rel = np.arange(len(self.h)) - self.bounds[:-1][self.owner]
        marked = np.zeros(v, bool)
        marked[list(cover)] = True
        size = self.size[self.owner]
        at = np.flatnonzero(marked[rel % v] & (size >= window) & (rel + length <= size))
        return at, ngram_hashes(self.h, length)[at] if len(at) else np.zeros(0, np.uint64)

    def windows(self, window: int, anchors: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of these anchors (places) at an offset below the cover's modulus."""
        n = len(self.h) - window + 1
        if n <= 0 or not len(anchors):
            return np.zeros(0, np.int64)
        flag = np.zeros(len(self.h) + 1, np.int32)
        flag[anchors] = 1
        run = np.concatenate([[0], np.cumsum(flag)])
        ends = np.minimum(np.arange(n) + cover_for(window)[0], len(flag))
        return np.flatnonzero((run[ends] > run[:n]) & (self.owner[:n] == self.owner[window - 1 :]))


class Windows:
    """The windows of a slice (row: data, and as `anchors` the answers to its anchors) that hold a repeated anchor: equal ones together, the earliest first."""

    def __init__(self, row: dict, window: int, buckets: int, hash_bits: int):
        self.docs = rows_of(row["data"].as_buffer())
        self.places = places = Places(self.docs.column("text"))
        at, h = places.anchors(window)
        keys, which = np.unique(h, return_inverse=True)
        many, found = np.zeros(len(keys), bool), {a["bucket"]: a["flags"] for a in row["anchors"].as_py() or ()}
        for b, a, z in bucket_edges(keys, buckets):
            if b in found:
                many[a:z] = flags_of(found[b], z - a)
        start = places.windows(window, at[many[which]])
        del at, h, which, many
        full = ngram_hashes(places.h, window)[start] if len(start) else np.zeros(0, np.uint64)
        extra = (ngram_hashes(~places.h, window)[start] >> np.uint64(32)).astype("<u4") if len(start) else np.zeros(0, "<u4")
        extra >>= np.uint32(min(31, 96 - hash_bits))
        places.h = None  # of no use from here on
        self.ident, own = np.asarray(self.docs.column("id")), places.owner[start]
        self.repeated_ids = len(np.unique(self.ident)) < len(self.ident)
        rank = np.empty(len(self.ident), np.int32)
        rank[np.argsort(self.ident, kind="stable")] = np.arange(len(rank), dtype=np.int32)
        order = np.lexsort((rank[own], extra, full))  # starts are in order, and stay so within a text
        self.start, self.own = start[order], own[order]
        del start, own
        self.full, self.extra = full[order], extra[order]
        del full, extra, order
        self.new = np.ones(len(self.full), bool)
        self.new[1:] = (self.full[1:] != self.full[:-1]) | (self.extra[1:] != self.extra[:-1])
        self.first = np.flatnonzero(self.new)
        self.edges = bucket_edges(self.full[self.first], 4 * buckets)  # every place of a text may start a window, a part of them holds anchors

    def later(self, answers: list[dict]) -> np.ndarray:
        """Places at which windows start that also start earlier."""
        found = {a["bucket"]: a["flags"] for a in answers}
        earliest = np.concatenate([flags_of(found[b], z - a) for b, a, z in self.edges]) if self.edges else np.zeros(0, bool)
        return self.start[~(self.new & earliest[np.cumsum(self.new) - 1])]


def repeated(hashes: list[np.ndarray], twice: list[np.ndarray]) -> list[np.ndarray]:
    """For each slice's distinct hashes, with flags of those that it holds more than once: which occur more than once anywhere."""
    every, at, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    many = (n > 1)[at] | (np.bincount(at, np.concatenate(twice), len(every)) > 0)[at]
    return np.split(many, np.cumsum([len(h) for h in hashes])[:-1])


def first_here(h, extra, ident, piece, row, start) -> np.ndarray:
    """For windows (hash, rest of the hash, id, slice, row, start): whether the window's earliest start is that one."""
    order = np.lexsort((start, row, piece, ident, extra, h))
    first = np.ones(len(h), bool)
    h, extra = h[order], extra[order]
    first[order[1:]] = (h[1:] != h[:-1]) | (extra[1:] != extra[:-1])
    return first


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags_of(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def earliest(slices: DataFrame, window: int) -> tuple[DataFrame, int, int]:
    """(slice, anchors, answers) of slices with anchors that occur more than once: which of its anchors do, and which of its windows start nowhere earlier. Also the buckets of the anchors, and the bits of a window's hash."""
    v, cover, _ = cover_for(window)
    size = slices.agg(F.sum("size")).first()[0] or 0
    buckets = max(12, math.ceil(size / 6 * len(cover) / v / ANCHORS_A_BUCKET))
    hash_bits = min(96, max(64, 2 * size.bit_length() + SPARE_BITS))

    def anchors_of(row):
        _, h = Places(rows_of(row["data"].as_buffer()).column("text")).anchors(window)
        keys, n = np.unique(h, return_counts=True)
        out = [(b, row["slice"].as_py(), press_keys(keys[a:z]), bits(n[a:z] > 1)) for b, a, z in bucket_edges(keys, buckets)]
        return pa.RecordBatch.from_pylist([dict(zip(("bucket", "slice", "keys", "twice"), o, strict=True)) for o in out], SENT_ANCHORS)

    def send_anchors(batches):
        for row in one_by_one(batches):
            yield anchors_of(row)

    def meet_anchors(group: pa.Table) -> pa.Table:
        hashes = [unpress_keys(x) for x in group["keys"].to_pylist()]
        twice = [flags_of(x, len(h)) for x, h in zip(group["twice"].to_pylist(), hashes, strict=True)]
        some = [(s, bits(m)) for s, m in zip(group["slice"].to_pylist(), repeated(hashes, twice), strict=True) if m.any()]
        return pa.table({"slice": pa.array([s for s, _ in some], pa.int64()), "bucket": pa.array([group["bucket"][0].as_py()] * len(some), pa.int32()), "flags": pa.array([m for _, m in some], pa.binary())})

    sent = slices.select("slice", "data").mapInArrow(send_anchors, "bucket int, slice long, keys binary, twice binary")
    found = sent.groupBy("bucket").applyInArrow(meet_anchors, "slice long, bucket int, flags binary")

    found = materialise(found, "none")

    def windows_of(row):
        w, number, out = Windows(row, window, buckets, hash_bits), row["slice"].as_py(), []
        for b, a, z in w.edges:
            f = w.first[a:z]
            out.append({"bucket": b, "slice": number, "keys": press_keys(w.full[f]), "extra": press(w.extra[f]), "id": press(w.ident[w.own[f]]), "row": press(w.own[f]) if w.repeated_ids else b"", "start": press((w.start[f] - w.places.bounds[w.own[f]]).astype("<u4"))})
        return pa.RecordBatch.from_pylist(out, SENT_WINDOWS)

    def send_windows(batches):
        for row in one_by_one(batches):
            yield windows_of(row)

    def meet_windows(group: pa.Table) -> pa.Table:
        def every(name, kind):
            return np.concatenate([unpress(x, kind) for x in group[name].to_pylist()])

        h = [unpress_keys(x) for x in group["keys"].to_pylist()]
        sizes = [len(x) for x in h]
        h = np.concatenate(h)
        piece = np.repeat(np.unique(np.asarray(group["slice"]), return_inverse=True)[1].astype(np.int32), sizes)
        row = np.concatenate([unpress(x, np.int32) if x else np.zeros(n, np.int32) for x, n in zip(group["row"].to_pylist(), sizes, strict=True)])
        first = first_here(h, every("extra", "<u4"), every("id", np.int64), piece, row, every("start", "<u4"))
        return pa.table({"slice": group["slice"], "bucket": group["bucket"], "flags": pa.array([bits(f) for f in np.split(first, np.cumsum(sizes)[:-1])], pa.binary())})

    held = slices.select("slice", "data").join(gathered(found, "flags"), "slice").withColumnRenamed("answers", "anchors")
    windows = held.mapInArrow(send_windows, "bucket int, slice long, keys binary, extra binary, id binary, row binary, start binary")
    firsts = windows.groupBy("bucket").applyInArrow(meet_windows, "slice long, bucket int, flags binary")
    both = gathered(found, "flags").withColumnRenamed("answers", "anchors").join(gathered(firsts, "flags"), "slice")
    return both, buckets, hash_bits


def strip(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, keep: list[str] | None = None, as_is: bool = False) -> DataFrame:
    """The columns `keep` (all of docs without the text, if None), with n_words, n_removed and kept: the words that stay, joined by one space (with as_is, the text as it is if it loses nothing)."""
    keep = [c for c in (docs.columns if keep is None else keep) if (c != text or keep is not None) and c.lower() not in NEW]
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(True))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).cast("string").alias("text"), kept.alias("keep"))
    slices = sliced(rows, "text", SLICE)
    answers, buckets, hash_bits = earliest(slices, window)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def stripped(row):
        if row["answers"].is_valid:
            w = Windows(row, window, buckets, hash_bits)
            own, codes, bounds, words = w.docs, w.places.codes, w.places.bounds, w.places.words
            start, n = w.later(row["answers"].as_py()), len(codes) + 1
            del w
            stays = np.cumsum(np.bincount(start, minlength=n) - np.bincount(start + window, minlength=n))[:-1] == 0
        else:
            own = rows_of(row["data"].as_buffer())
            codes, bounds, words = split_words(own.column("text"), lower=False)
            stays = np.ones(len(codes), bool)
        left = np.concatenate([[0], np.cumsum(stays)])[bounds]
        removed = np.diff(bounds) - np.diff(left)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.take(pa.array(codes[stays]))), " ")
        if as_is:
            texts = pc.if_else(pa.array(removed == 0), own.column("text"), texts)
        columns = own.column("keep").flatten()[: len(keep)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(bounds)), pa.array(removed), texts], names=[f.name for f in schema])

    def drop(batches):
        for row in one_by_one(batches):
            yield stripped(row)

    return slices.select("slice", "data").join(answers, "slice", "left").select("data", "anchors", "answers").mapInArrow(drop, schema)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: str = "n_chars", window: int = STAGE_WINDOW) -> DataFrame:
    """docs with later copies of passages taken out of their texts. Texts that lose nothing stay as they are; documents that lose everything go."""
    rest = F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("__doc")
    out = strip(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), rest), "__key", "__text", window, ["__doc"], as_is=True)
    out = out.where("n_removed < n_words OR n_words = 0")
    size = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema[chars].dataType)).otherwise(F.col(f"__doc.{chars}")) if chars in docs.columns else None
    return out.select(*[F.col("kept").alias(c) if c == text else size.alias(c) if c == chars else F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strip(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
later AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS i FROM later),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS kept, count(*) AS n FROM p LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.i = p.i WHERE gone.i IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
