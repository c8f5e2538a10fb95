"""Best-fit packing of tokenised documents into sequences.

Best-fit decreasing over all documents at once: it depends on the pieces' lengths only, of which there are no more
than the capacity. The driver gets one count per length, runs best-fit decreasing on whole groups of equal pieces
and equal bins (a segment tree over the remaining capacities finds the tightest open bin), and the plan says, for a
range of ranks among the pieces of one length, which bins they go to and at which offset. Pieces learn their rank
from counts per (hash partition, length) and a rank within those, so no task sees more than its share of a length
that a third of all pieces may have. The result equals best-fit decreasing one piece at a time.

Tokens: words are looked up by distinct space-led unit, and each distinct unit of a batch is encoded once. A unit
starts at a space next to at most one other white space, where the pattern of byte-level BPE never joins characters
to what stands before; texts with other spaces, or with a special token's string, go to the tokenizer whole. Units are
encoded from the same vocabulary's ranks, several times faster; tests hold the ids against the tokenizer's on whole tables.

Defined results: null text counts as empty (one end token); texts of any length are taken whole and cut into pieces;
pieces of one length are ranked by (id, piece, checksum), and rows that agree in these stand in any order; repeated rows
are packed each; a null id is an id like any other; an empty table gives no rows; other columns play no part, also those
with the names of new ones.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, partitions, string_bytes, table, text_slices

CAPACITY = 1024
END_ID = 2

# White space as byte-level BPE's pattern knows it.
_SPACE = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class Encoder:
    """Token ids of texts, as tokenizers.Tokenizer.from_file(json_path) gives them without special tokens added."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.json_path, self.whole = json_path, None
        self.fast = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)

    def encode_whole(self, text: str) -> np.ndarray:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.json_path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of texts without nulls."""
        odd = np.asarray(pc.or_(pc.match_substring_regex(texts, f"{_SPACE} (?:{_SPACE}|$)"), pc.match_substring(texts, "<|endoftext|>")))
        plain = texts.filter(pa.array(~odd)) if odd.any() else texts
        parts = pc.split_pattern(plain, " ")
        bounds = np.asarray(parts.offsets).astype(np.int64)
        bounds = bounds - bounds[0]
        coded = parts.flatten().dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        n = len(coded.dictionary)
        # units: 0 .. n - 1 with a space before; first parts of texts have none and get units of their own
        first = bounds[:-1]
        leads, lead_codes = np.unique(codes[first], return_inverse=True) if len(first) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        codes[first] = n + lead_codes
        flat, starts, sizes = self._units(coded.dictionary, leads)
        size = sizes[codes]
        total = int(size.sum())
        ends = np.cumsum(size)
        ids = flat[np.repeat(starts[codes] - (ends - size), size) + np.arange(total)]
        doc_bounds = np.concatenate([[0], ends])[bounds]
        if not odd.any():
            return ids, doc_bounds
        out, k = [], 0
        for i, whole in enumerate(odd):
            if whole:
                out.append(self.encode_whole(texts[i].as_py()))
            else:
                out.append(ids[doc_bounds[k] : doc_bounds[k + 1]])
                k += 1
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])

    def _units(self, words: pa.Array, leads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, sizes) of " " + each word, then of the words at leads as they are."""
        n = len(words)
        alone = np.asarray(pc.match_substring_regex(words, f"^(?:{_SPACE}|$)")) if n else np.zeros(0, bool)
        joined = words.filter(pa.array(~alone))
        text = " " + " ".join(joined.to_pylist()) if len(joined) else ""
        flat = np.array(self.fast.encode_ordinary(text), np.uint32)
        ends = np.cumsum(self.width[flat]) if len(flat) else np.zeros(0, np.int64)
        _, byte_bounds = string_bytes(joined)
        unit_ends = byte_bounds[1:] + np.arange(1, len(joined) + 1)
        upto = np.searchsorted(ends, unit_ends) + 1 if len(joined) else np.zeros(0, np.int64)
        starts, sizes = np.zeros(n + len(leads), np.int64), np.zeros(n + len(leads), np.int64)
        common = np.flatnonzero(~alone)
        starts[common] = np.concatenate([[0], upto[:-1]]) if len(upto) else 0
        sizes[common] = np.diff(np.concatenate([[0], upto]))
        more, at = [flat], len(flat)
        others = [(i, " " + words[int(i)].as_py()) for i in np.flatnonzero(alone)]
        others += [(n + j, words[int(i)].as_py()) for j, i in enumerate(leads)]
        for i, unit in others:
            got = self.fast.encode_ordinary(unit)
            starts[i], sizes[i] = at, len(got)
            at += len(got)
            more.append(np.array(got, np.uint32))
        return np.concatenate(more), starts, sizes


def vocabulary() -> dict:
    """Where the public tokenizer's files are, and its pattern."""
    import public_tokenizers as P

    return {"json_path": P.path("byte_bpe_50k.json"), "ranks_path": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, files: dict | None = None, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): a document's tokens, cut from its end if over the capacity."""
    schema = T.StructType(
        [T.StructField(key, docs.schema[key].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
        + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    )

    def cut(batches):
        encoder = Encoder(**(files or vocabulary()))  # where they are on this machine
        for whole in batches:
            for batch in text_slices(whole, text):
                ids, bounds = encoder.encode(pc.fill_null(batch.column(text), ""))
                rows, piece, start, length, crc, own = [], [], [], [], [], []
                ids = ids.astype("<u4")
                for i in range(batch.num_rows):
                    doc = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    n = len(doc)
                    edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for p in range(len(edges) - 1):
                        a, b = edges[p], edges[p + 1]
                        rows.append(i)
                        piece.append(p)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(doc[a:b].tobytes()))
                        if with_ids:
                            own.append(doc[a:b].astype(np.int32))
                out = [batch.column(key).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                out += [pa.array(own, pa.list_(pa.int32()))] * with_ids
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema])

    return docs.select(key, text).mapInArrow(cut, schema)


class CapacityTree:
    """A segment tree over remaining capacities 0 .. top: which of them have open bins."""

    def __init__(self, top: int):
        self.half = 1 << top.bit_length()
        self.some = [False] * (2 * self.half)

    def put(self, r: int, some: bool) -> None:
        i = r + self.half
        self.some[i] = some
        while i := i >> 1:
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest r >= least with an open bin."""
        i = least + self.half
        if self.some[i]:
            return least
        while i > 1:
            if not i & 1 and self.some[i + 1]:
                i += 1
                while i < self.half:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.half
            i >>= 1
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, bins from, pieces a bin, offset) of best-fit decreasing over counts[length] pieces.

    A piece with rank k among its length's goes, by the last row with first rank <= k, to bin
    from + (k - first) // a_bin at offset + ((k - first) % a_bin) * length.
    """
    tree, open_bins, new, plan = CapacityTree(capacity), defaultdict(deque), 0, []

    def add(r: int, first: int, n: int) -> None:
        if r and n:
            open_bins[r].append((first, n))
            tree.put(r, True)

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            r = tree.tightest(size)
            if r is None:
                r, n = capacity, -(-left // (capacity // size))
                first, new = new, new + n
            else:
                first, n = open_bins[r].popleft()
                if not open_bins[r]:
                    tree.put(r, False)
            each = r // size
            m = min(left, n * each)
            plan.append((size, rank, first, each, capacity - r))
            full, part = divmod(m, each)
            add(r - each * size, first, full)
            if part:
                add(r - part * size, first + full, 1)
                full += 1
            if full < n:
                open_bins[r].appendleft((first + full, n - full))
                tree.put(r, True)
            left -= m
            rank += m
    return np.array(plan, np.int64).reshape(-1, 5)


def pack(rows: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """rows (key, piece, length, ids_crc32, ...), materialised, with sequence_id and offset."""
    spark = rows.sparkSession
    n = partitions(spark)
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(n)).cast("int"))
    groups = materialise(rows.groupBy("__part", "length").agg(F.count("*").alias("__n")))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # one row per length, at most `capacity`
    plan = best_fit_plan(counts, capacity)
    lead = groups.withColumn("__lead", F.sum("__n").over(Window.partitionBy("length").orderBy("__part")) - F.col("__n")).drop("__n")
    rank = F.row_number().over(Window.partitionBy("__part", "length").orderBy(key, "piece", "ids_crc32")) - 1
    # rows are dealt and sorted for their ranks as the join wants them; the small side, which grows with the partitions, is never sent to all tasks
    ranked = rows.withColumn("__rank", rank).join(lead.hint("merge"), ["__part", "length"]).withColumn("__rank", F.col("__rank") + F.col("__lead")).drop("__part", "__lead")
    schema = T.StructType([*ranked.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    plan = plan[order]
    lengths = np.unique(plan[:, 0])

    def place(batches):
        for batch in batches:
            size, rank = np.asarray(batch.column("length")), np.asarray(batch.column("__rank"))
            at = np.zeros(len(size), np.int64)
            for s in np.unique(size):
                a, b = np.searchsorted(plan[:, 0], [s, s + 1])
                own = size == s
                at[own] = a + np.searchsorted(plan[a:b, 1], rank[own], side="right") - 1
            first, bins, each, offset = (plan[at, c] for c in (1, 2, 3, 4))
            k = rank - first
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins + k // each), pa.array(offset + k % each * size)], names=[f.name for f in schema])

    assert len(lengths) <= capacity
    return ranked.mapInArrow(place, schema).drop("__rank")


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, **how) -> DataFrame:
    """Every piece of every document, with its sequence and its place there."""
    return pack(materialise(pieces(docs, key, text, capacity, **how)), key, capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
