"""MinHash near-dedup with odd sketches.

Texts with the same word sequence are one class (a 128-bit hash of their words). A class has MinHash values of its
shingle set; bands of them find candidates, and an odd sketch (the values folded into a parity bitmap) estimates a candidate
pair's similarity from the popcount of their XOR: pairs estimated more than MARGIN below the limit go no further (a
link at the limit is estimated so low with a chance under 1e-6, others less). What the rest joins are candidate groups,
which are confirmed on full shingle sets. A link at similarity 0.8 shares no band with a chance of 5e-8; links above, less.

No group's pairs are ever listed; what comes back is stars: an edge from one class to each that passing pairs join
with it. Groups up to TILE classes meet in one task. Of a larger one, all classes meet PIVOTS of its classes, dealt to
salted tiles; those that pivots join, and pivots that members join, are its core, whose pairs need no further look. Only the
rest meets the whole group, tile by tile. So a group of n classes, m of them not in its core, sends n / TILE copies of its pivots and
2 n m / TILE rows, and no task holds more than two tiles.

Texts are written once, as slices (see slices); full sets are made again from them, for classes with candidates only.

Defined results: text that is null or without words has no shingles, is linked with nothing and is its own component;
texts of any length are taken whole; rows without an id count as one id that is larger than all others and is null in
results; repeated rows get a row each; rows that share an id are judged each by its own text; an empty table gives no
rows; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_strings, materialise, mix64, ngram_hashes, release, split_words, table, text_slices
from .slices import one_by_one, rows_of, sliced

SHINGLE = 5
SIMILAR = (80, 100)  # 100 * intersection >= 80 * union
BANDS, ROWS = 32, 4
VALUES = BANDS * ROWS
SKETCH_BITS = 1024
MARGIN = 0.2
TILE = 256
PIVOTS = 32  # of a group over TILE, about
BITS = 62  # pivots of a group at most, as many as a mask holds
MAX_BROADCAST = 100_000  # rows, one for each group over TILE
SLICE = 8 << 20
CHUNK = 2 << 20  # bytes of text or sets that a task works on at once
NO_ID = 2**63 - 1

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 2**32, VALUES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, VALUES, dtype=np.uint32)
_C = _rng.integers(0, 2**32, VALUES, dtype=np.uint32) | np.uint32(1)


def shingle_sets(texts: pa.Array, n: int):
    """For each text: (class as 16 bytes or None, sorted distinct shingle hashes)."""
    codes, bounds, words = split_words(texts, lower=True)
    h = hash_strings(words)[codes]
    grams = ngram_hashes(h, n)
    for i in range(len(bounds) - 1):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if a == b:
            yield None, np.zeros(0, np.uint64)
            continue
        own = np.unique(grams[a : b - n + 1]) if b - a >= n else ngram_hashes(h[a:b], b - a)
        yield xxhash.xxh3_128_digest(h[a:b].tobytes()), own


def min_values(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row of VALUES for each set; no set may be empty."""
    out = np.empty((len(sets), VALUES), np.uint32)
    at, part, size = 0, [], 0
    for i, s in enumerate(sets):
        part.append(s)
        size += len(s)
        if size >= 1 << 16 or i == len(sets) - 1:  # as much as stays in a core's cache
            x = (np.concatenate(part) >> np.uint64(32)).astype(np.uint32)
            starts = np.concatenate([[0], np.cumsum([len(p) for p in part])[:-1]])
            v = np.empty_like(x)
            for k in range(VALUES):
                np.multiply(x, _A[k], out=v)
                v += _B[k]
                v ^= v >> np.uint32(15)
                v *= _C[k]
                out[at : at + len(part), k] = np.minimum.reduceat(v, starts)
            at, part, size = i + 1, [], 0
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(values), 1))
    for r in range(ROWS):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + values[:, r::ROWS])
    return out.view(np.int64)


def odd_sketches(values: np.ndarray) -> np.ndarray:
    """One row of SKETCH_BITS / 64 words for each row of values: bit parities of the hashed (place, value) pairs."""
    bit = mix64(values.astype(np.uint64) * np.uint64(VALUES) + np.arange(VALUES, dtype=np.uint64)) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)
    at = bit.astype(np.int64) + np.arange(len(values))[:, None] * SKETCH_BITS
    odd = np.bincount(at.ravel(), minlength=len(values) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(values), SKETCH_BITS), axis=1).view(np.uint64)


def estimate(differing_bits: np.ndarray | int):
    """The Jaccard similarity that an odd sketch's XOR popcount stands for."""
    z = np.minimum(np.asarray(differing_bits, float), SKETCH_BITS / 2 - 1)
    return np.clip(1 + SKETCH_BITS / (4 * VALUES) * np.log(1 - 2 * z / SKETCH_BITS), 0, 1)


def most_bits(similar: tuple[int, int] = SIMILAR) -> int:
    """The largest XOR popcount whose estimate is no more than MARGIN below the limit."""
    fits = np.flatnonzero(estimate(np.arange(SKETCH_BITS // 2)) >= similar[0] / similar[1] - MARGIN)
    return int(fits.max())


def features(slices: DataFrame, n: int) -> DataFrame:
    """(slice, row, id, cls, n_shingles, bands, sketch) of slices of rows (id, text, ...); cls, bands and sketch are null without words."""

    def run(batches):
        for part in one_by_one(batches):
            first = 0
            for docs in text_slices(rows_of(part["data"].as_buffer()), limit=CHUNK):
                classes, sets = zip(*shingle_sets(docs.column("text"), n), strict=True)
                some = [i for i, c in enumerate(classes) if c is not None]
                bands, sketches = [None] * len(sets), [None] * len(sets)
                if some:
                    values = min_values([sets[i] for i in some])
                    for i, keys, bits in zip(some, band_keys(values), odd_sketches(values), strict=True):
                        bands[i], sketches[i] = keys, bits.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(sets), part["slice"].as_py())), pa.array(np.arange(first, first + len(sets), dtype=np.int32)), docs.column("id"), pa.array(classes, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    names=["slice", "row", "id", "cls", "n_shingles", "bands", "sketch"],
                )
                first += len(sets)

    return slices.select("slice", "data").mapInArrow(run, "slice long, row int, id long, cls binary, n_shingles long, bands array<long>, sketch binary")


# ---------------------------------------------------------------- comparing


class Sketches:
    """Odd sketches that pass if their estimate is not too low."""

    def __init__(self, values: list[bytes], similar: tuple[int, int]):
        self.bits = np.frombuffer(b"".join(values), np.uint64).reshape(len(values), SKETCH_BITS // 64)
        self.most = most_bits(similar)

    def each(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(1) <= self.most

    def matrix(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.zeros((len(x), len(y)), np.int32)
        for w in range(self.bits.shape[1]):
            z += np.bitwise_count(self.bits[x, w, None] ^ self.bits[None, y, w])
        return z <= self.most


class Sets:
    """Full shingle sets that pass if they are similar."""

    def __init__(self, values: list[bytes], similar: tuple[int, int]):
        self.sets, self.similar = [np.frombuffer(v, np.uint64) for v in values], similar
        self.size = np.array([len(s) for s in self.sets])

    def _linked(self, shared: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return self.similar[1] * shared >= self.similar[0] * (n + m - shared)

    def each(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        shared = np.array([len(np.intersect1d(self.sets[a], self.sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
        return self._linked(shared, self.size[i], self.size[j])

    def matrix(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        shared = intersections([self.sets[i] for i in x], [self.sets[i] for i in y]).astype(np.int64)
        return self._linked(shared, self.size[x][:, None], self.size[y][None])


def _groups(batches, keys: int):
    """Tables of whole groups (rows with equal first `keys` columns, which stand together) with the groups' first rows and ends, some CHUNK of bytes at a time."""
    held: list[pa.RecordBatch] = []

    def edges_of(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        for c in range(keys):
            k = rows.column(c).combine_chunks()
            k = np.asarray(k.dictionary_encode().indices if pa.types.is_binary(k.type) else k)
            new[1:] |= k[1:] != k[:-1]
        return np.concatenate([[0], np.flatnonzero(new), [rows.num_rows]])

    def parts(rows: pa.Table, edges: np.ndarray):
        size = rows.nbytes / max(1, rows.num_rows)
        a = 0
        while a < len(edges) - 1:
            z = max(a + 1, int(np.searchsorted(edges, edges[a] + CHUNK / size, side="right")) - 1)
            yield rows.slice(int(edges[a]), int(edges[z] - edges[a])), edges[a : z + 1] - edges[a]
            a = z

    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            held.append(batch.slice(start, 1024))
            rows = pa.Table.from_batches(held)
            edges = edges_of(rows)
            if len(edges) > 2:
                yield from parts(rows.slice(0, int(edges[-2])), edges[:-1])
                held = rows.slice(int(edges[-2])).to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield from parts(rows, edges_of(rows))


def _stars(i: np.ndarray, j: np.ndarray, names: list[bytes]) -> tuple[list[int], list[int]]:
    """For each component of the edges (i, j): an edge from its member of the smallest name to each other one."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            low, high = (x, y) if names[x] < names[y] else (y, x)
            up[high] = low
    members = [x for x in up if root(x) != x]
    return [root(x) for x in members], members


def intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets of x with sets of y."""
    out = np.zeros((len(x), len(y)))
    sides = [np.concatenate(s) for s in (x, y)]
    both = np.intersect1d(np.unique(sides[0]), np.unique(sides[1]), assume_unique=True)
    if not len(both):
        return out
    at = []
    for sets, flat in zip((x, y), sides, strict=True):
        column = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        hit = both[column] == flat
        order = np.argsort(column[hit], kind="stable")
        at.append((column[hit][order], row[hit][order]))
    width = 4096
    for c in range(0, len(both), width):
        part = []
        for (column, row), sets in zip(at, (x, y), strict=True):
            a, z = np.searchsorted(column, [c, c + width])
            m = np.zeros((len(sets), min(width, len(both) - c)), np.float32)
            m[row[a:z], column[a:z] - c] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out


def _edges(rows: pa.Table, i: list[np.ndarray], j: list[np.ndarray]) -> pa.RecordBatch:
    """The stars of pairs of rows."""
    i, j = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (i, j))
    a, b = _stars(i, j, rows["cls"].to_pylist())
    a, b = (rows["cls"].take(pa.array(v, pa.int64())).combine_chunks() for v in (a, b))
    return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])


def joined(rows: DataFrame, group: str, kind, similar: tuple[int, int], tile: int = TILE) -> DataFrame:
    """(a, b): stars that join the classes of rows (group, cls, v) that passing pairs of the same group join, through any number of them. v is what `kind` compares."""
    large = materialise(rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > tile))
    n = large.count()
    small = rows.join(_few(large, n), group, "left_anti") if n else rows
    met = small.select(group, "cls", "v").repartition(group).sortWithinPartitions(group)

    def meet(batches):
        for rows, edges in _groups(batches, 1):
            own, i, j = kind(rows["v"].to_pylist(), similar), [], []
            size = np.diff(edges)
            of = np.repeat(np.arange(len(size)), size)
            few = size[of] <= 8
            for d in range(1, 8):  # small groups all at once: rows d apart
                x = np.flatnonzero(few[:-d] & (of[:-d] == of[d:])) if len(of) > d else np.zeros(0, np.int64)
                x = x[own.each(x, x + d)]
                i.append(x)
                j.append(x + d)
            for g in np.flatnonzero(size > 8):
                all_ = np.arange(edges[g], edges[g + 1])
                x, y = np.nonzero(np.triu(own.matrix(all_, all_), 1))
                i.append(all_[x])
                j.append(all_[y])
            yield _edges(rows, i, j)

    out = met.mapInArrow(meet, "a binary, b binary")
    return out.unionByName(_by_pivots(rows.join(_few(large, n), group), n, group, kind, similar, tile)) if n else out


def _few(df: DataFrame, n: int) -> DataFrame:
    """df, which has a row for each of n large groups at most, sent to all tasks if it is small."""
    return F.broadcast(df) if n <= MAX_BROADCAST else df


def _by_pivots(rows: DataFrame, n: int, group: str, kind, similar: tuple[int, int], tile: int) -> DataFrame:
    """The stars of n large groups, from rows (group, cls, v, n: the group's classes); see joined."""
    drawn = F.pmod(F.xxhash64("cls", F.lit(16)), F.ceil(F.col("n") / PIVOTS)) == 0  # about PIVOTS of each group; without any, all is the rest
    number = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64("cls", F.lit(15)))) - 1
    pivots = rows.where(drawn).withColumn("pivot", number).where(F.col("pivot") < BITS)
    salts = F.ceil(F.col("n") / (0.75 * tile)).cast("int")
    dealt = lambda df, salt: df.select(group, salt.alias("salt"), "pivot", "cls", "v")
    members = dealt(rows.withColumn("pivot", F.lit(-1)), F.pmod(F.xxhash64("cls", F.lit(17)), salts).cast("int"))
    met = members.unionByName(dealt(pivots, F.explode(F.sequence(F.lit(0), salts - 1)))).repartition(group, "salt").sortWithinPartitions(group, "salt", "pivot")
    kinds = rows.schema[group].dataType.simpleString()

    def meet(batches):
        for rows, edges in _groups(batches, 2):
            own, names, pivot = kind(rows["v"].to_pylist(), similar), rows["cls"].to_pylist(), np.asarray(rows["pivot"])
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                x, p = np.arange(a, z)[pivot[a:z] < 0], np.arange(a, z)[pivot[a:z] >= 0]
                if not len(x):
                    continue
                to = own.matrix(x, p)
                mask = (to * (np.int64(1) << pivot[p].astype(np.int64))).sum(1)
                first = np.where(to.any(1), to.argmax(1), -1)
                u, v = np.nonzero(to)
                other = v != first[u]
                i, j = _stars(p[first[u[other]]], p[v[other]], names)  # pivots that members join
                at = pa.array(np.concatenate([x, np.array(j, np.int64)]))
                to_ = [names[p[f]] if f >= 0 else None for f in first] + [names[k] for k in i]
                columns = [rows[c].take(at).combine_chunks() for c in (group, "cls", "v")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([*mask.tolist(), *[None] * len(j)], pa.int64()), pa.array(to_, pa.binary())], names=[group, "cls", "v", "mask", "to"])

    status = materialise(met.mapInArrow(meet, f"{group} {kinds}, cls binary, v binary, mask long, to binary"))  # (class, the pivots that it is joined with, the first of them), and (pivot, null, another)
    stars = status.select(F.col("to").alias("a"), F.col("cls").alias("b")).where("a != b")
    status = status.where("mask IS NOT NULL")
    bits = status.select(group, "mask", F.explode(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit("mask", i) == 1)).alias("i"))
    joins = bits.groupBy(group, "i").agg(F.bit_or("mask").alias("m"), F.count("*").alias("k"))  # BITS rows of a group at most
    # the core: the pivot with the most members, and in a few passes the pivots that members join with it
    core, passes = F.col("core"), joins.groupBy(group).agg(F.collect_list(F.struct("i", "m")).alias("of"), F.max_by("m", F.struct("k", "i")).alias("core"))
    for _ in range(4):
        core = F.aggregate("of", core, lambda done, x: F.when(F.getbit(done, x["i"]) == 1, done.bitwiseOR(x["m"])).otherwise(done))
    cores = materialise(passes.select(group, core.alias("core")))
    rest = F.coalesce(F.col("mask").bitwiseAND(F.col("core")) == 0, F.lit(True))
    placed = status.select(group, "cls", "v", "mask").join(_few(cores, n), group, "left").withColumn("rest", rest)
    of = placed.groupBy(group).agg(F.count("*").alias("n"), F.count_if("rest").alias("m")).where("m > 0")
    placed = placed.join(_few(of, n), group)
    tiles = lambda size: F.ceil(F.col(size) / (0.75 * tile)).cast("int")
    at = lambda size, seed: F.pmod(F.xxhash64("cls", F.lit(seed)), tiles(size)).cast("int")
    every = lambda size: F.sequence(F.lit(0), tiles(size) - 1)
    left = F.when(F.col("rest"), F.transform(every("n"), lambda t: F.struct(at("m", 18).alias("low"), t.alias("high"), F.lit(True).alias("left"))))
    right = F.transform(every("m"), lambda t: F.struct(t.alias("low"), at("n", 19).alias("high"), F.lit(False).alias("left")))
    spread = placed.select(group, "cls", "v", F.explode(F.when(F.col("rest"), F.concat(left, right)).otherwise(right)).alias("t"))
    tiled = spread.select(group, "t.low", "t.high", "t.left", "cls", "v").repartitionByRange(group, "low", "high").sortWithinPartitions(group, "low", "high")  # by range: tiles spread evenly

    def meet_rest(batches):
        for rows, edges in _groups(batches, 3):
            own, left, i, j = kind(rows["v"].to_pylist(), similar), np.asarray(rows["left"]), [], []
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                x, y = np.arange(a, z)[left[a:z]], np.arange(a, z)[~left[a:z]]
                if len(x) and len(y):
                    u, v = np.nonzero(own.matrix(x, y))
                    i.append(x[u])
                    j.append(y[v])
            yield _edges(rows, i, j)

    return stars.unionByName(tiled.mapInArrow(meet_rest, "a binary, b binary")).where("a != b")


# ---------------------------------------------------------------- candidates, confirmed links, components


def candidates(classes: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Stars (a, b) of what pairs of classes with a band in common and near sketches join."""
    banded = classes.select("cls", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("w")).where("w > 1").select("band")
    sketches = classes.select("cls", F.col("sketch").alias("v"))
    held = materialise(banded.join(shared.hint("merge"), "band").join(sketches.hint("merge"), "cls"))
    return joined(held, "band", Sketches, similar)


def full_sets(slices: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(near, cls, v): the shingle sets of wanted classes (near, cls, slice, row)."""
    # tables of any size are joined in one way, by sorting
    asked = wanted.groupBy("slice").agg(F.collect_list(F.struct("row", "cls", "near")).alias("asked"))  # as many as the slice has rows at most

    def run(batches):
        for part in one_by_one(batches):
            asked = part["asked"].as_py()
            texts = rows_of(part["data"].as_buffer()).column("text").take(pa.array([a["row"] for a in asked], pa.int32()))
            yield pa.RecordBatch.from_arrays([*(pa.array([a[c] for a in asked], pa.binary()) for c in ("near", "cls")), pa.array([s.tobytes() for _, s in shingle_sets(texts, n)], pa.binary())], names=["near", "cls", "v"])

    return slices.select("slice", "data").join(asked.hint("merge"), "slice").mapInArrow(run, "near binary, cls binary, v binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of its component, for every node of the edges (a, b).

    Every node points to its smallest neighbour, pointers are followed to their roots, and edges shrink to those between
    different roots, until none is left.
    """
    edges = materialise(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    out = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
        while True:
            next_ = up.select(F.col("node").alias("label"), F.col("label").alias("up"))
            jumped = materialise(up.join(next_, "label").select("node", F.col("label").alias("was"), F.col("up").alias("label")))
            release(up)
            up = jumped
            if jumped.where("was != label").isEmpty():
                break
        up = up.select("node", "label")
        if out is None:
            out = up
        else:
            top = up.withColumnRenamed("label", "top").withColumnRenamed("node", "label")
            out = materialise(out.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label")))
        a, b = (up.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
        between = edges.join(a, "a").join(b, "b").where("la != lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
        fewer = materialise(between.distinct())
        release(edges)
        edges = fewer
        if edges.isEmpty():
            return out


# Tables that grow with the corpus are joined in one way at any size, by sorting: what small tables cost is what large ones will.


def grouped(slices: DataFrame, n: int, similar: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Of slices of rows (id, text, ...): (slice, row, id, cls, n_shingles) of each row, and (cls, label, top, k) of each class of rows: its
    component's smallest class, the component's first row (id, slice, row), and how many rows the class has."""
    made = materialise(features(slices, n))
    first = F.min(F.struct("id", "slice", "row"))
    classes = made.where("cls IS NOT NULL").groupBy("cls").agg(first.alias("at"), F.count("*").alias("k"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = materialise(classes)
    near = components(candidates(classes, similar)).select(F.col("node").alias("cls"), F.col("label").alias("near"))
    wanted = near.join(classes.select("cls", "at.slice", "at.row").hint("merge"), "cls")
    links = joined(materialise(full_sets(slices, wanted, n)), "near", Sets, similar)
    labels = components(links).withColumnRenamed("node", "cls")
    linked = classes.select("cls", "at", "k").join(labels.hint("merge"), "cls")
    heads = materialise(linked.groupBy("label").agg(F.min("at").alias("top")))
    alone = classes.join(labels.hint("merge"), "cls", "left_anti").select("cls", F.col("cls").alias("label"), F.col("at").alias("top"), "k")
    return made.select("slice", "row", "id", "cls", "n_shingles"), materialise(linked.join(heads, "label").select("cls", "label", "top", "k").unionByName(alone))


def _rows(docs: DataFrame, key: str, text: str, *more) -> DataFrame:
    return sliced(docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).cast("string").alias("text"), *more), "text", SLICE)


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(key, cls, n_shingles, component_id, kept, label) of each row; a component's label is its smallest class, null without words."""
    rows, classes = grouped(_rows(docs, key, text), shingle, similar)
    rows = rows.join(classes.select("cls", "label", F.col("top.id").alias("top")).hint("merge"), "cls", "left").withColumn("top", F.coalesce("top", "id"))
    given = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.select(given("id").alias(key), "cls", "n_shingles", given("top").alias("component_id"), (F.col("id") == F.col("top")).alias("kept"), "label")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """docs with one document of each component: the one with the smallest id, once; documents without words stay."""
    names = [c for c in docs.columns if c != text]
    slices = _rows(docs, key, text, F.struct(*[F.col(f"`{c}`") for c in names], F.lit(0)).alias("doc"))
    rows, classes = grouped(slices, shingle, similar)
    stay = classes.where("label = cls").select("top.slice", "top.row").unionByName(rows.where("cls IS NULL").select("slice", "row"))
    stay = stay.groupBy("slice").agg(F.sort_array(F.collect_list("row")).alias("stay"))  # as many as the slice has rows at most

    def run(batches):
        for part in one_by_one(batches):
            own = rows_of(part["data"].as_buffer()).take(pa.array(part["stay"].as_py(), pa.int32()))
            columns = dict(zip(names, own.column("doc").flatten(), strict=False)) | {text: own.column("text")}
            yield pa.RecordBatch.from_arrays([columns[c] for c in all_names], names=all_names)

    all_names = docs.columns
    return slices.select("slice", "data").join(stay.hint("merge"), "slice").mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id, min(other) = doc_id AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
