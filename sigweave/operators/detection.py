"""Detection of known libraries in applications: sketch filter, scan to a fixpoint, conflict resolution, round after round.

A record is a class: (artifact, cls, lib_super, app_super, interfaces, methods), a method (idx, name, blocks' units with
their references, k-gram hashes). Records are opened once, into their k-gram hashes and what votes need. Classes of a
library and an application meet in one task per pair, and only for pairs that the sketches suggest; the task iterates class
matching and weighted voting to its fixpoint, over class pairs that share a k-gram or a vote. Of an application it gets the
classes that can be matched with the library's: others keep their bits in the application's sketch, but leave it in no round.
Everything between scans is DataFrame code.
"""

from __future__ import annotations

import gc
import itertools
import json
import pickle
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.functions import arrays
from sigweave.sources.signatures import unit
from sigweave.sources.storage import release

from .assignment import solve
from .selection import DETECTION_THRESHOLD, SCAN_RANGE, SKETCH_THRESHOLD, detection_threshold, resolve, scan_window, sketch_filter
from .sketches import ARTIFACT_PRIME, FEW, bit

PARTS = 32  # rounds whose results are put together at once
RANGE = 18  # a row of bits has 2**RANGE of a sketch's
HELD = 1 << 22  # bits that a task gathers before it lets them go


@dataclass(frozen=True)
class Settings:
    """Tunable parameters of a detection."""

    k: int = 5
    class_similarity: float = 0.1
    sketch_similarity: float = 0.1
    mapping_threshold: float = 0.0
    call_importance: float = 0.99
    scan_range: float = SCAN_RANGE
    sketch_formula: str = SKETCH_THRESHOLD
    detection_formula: str = DETECTION_THRESHOLD
    additional_methods: bool = False


@dataclass
class Method:
    """A method's weight and k-gram hashes, and of its k-grams (lists of (instr, refs, invokes, callee class, callee idx)) those that votes look at."""

    idx: int
    name: str
    weight: int
    hashes: frozenset
    typed: dict[int, list]
    calls: dict[int, list]

    @property
    def constructor(self) -> bool:
        return self.name in ("<init>", "<clinit>")


def unique(grams: dict[int, list[list]], holds) -> dict[int, list]:
    """k-grams with such a unit, by hash, where all of a hash agree in their references."""
    out = {}
    for h, own in grams.items():
        some = [g for g in own if any(holds(u) for u in g)]
        if some and len({json.dumps([u[1] for u in g]) for g in some}) == 1:
            out[h] = some[0]
    return out


@dataclass
class Class:
    name: str
    lib_super: str | None
    app_super: str | None
    interfaces: list[str]
    methods: list[Method] = field(default_factory=list)

    def __post_init__(self):
        self.weight = sum(m.weight for m in self.methods)
        self.hashes = frozenset().union(*(m.hashes for m in self.methods))


def paths(blocks: list[list], follows: dict[int, list[int]], k: int):
    """All walks of k units from each unit, over block ends into following blocks; through blocks without units, but through none of them twice on end."""

    def onward(b: int, seen: tuple = ()):
        for n in follows.get(b, ()):
            if blocks[n]:
                yield n
            elif n not in seen:
                yield from onward(n, (*seen, n))

    def walk(b: int, i: int, done: list):
        done = done + [blocks[b][i]]
        if len(done) == k:
            yield done
        elif i + 1 < len(blocks[b]):
            yield from walk(b, i + 1, done)
        else:
            for n in onward(b):
                yield from walk(n, 0, done)

    for b, units in enumerate(blocks):
        for i in range(len(units) - k + 1):
            yield units[i : i + k]
        for i in range(max(0, len(units) - k + 1), len(units)):  # what leaves the block
            yield from walk(b, i, [])


@lru_cache(maxsize=1 << 18)
def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * 31 + ord(c)) % 2**32
    return h


def plain_hashes(blocks: list[list], k: int) -> frozenset:
    """Hashes of the k-grams of blocks that nothing follows, by one step a unit."""
    out, first, last = set(), 31**k, 31 ** (k - 1)
    for units in blocks:
        if len(units) >= k:
            h = [_hash(u[0]) for u in units]
            run = 0
            for x in h[:k]:
                run = run * 31 + x
            out.add((run + first) % 2**32)
            for old, new in zip(h, h[k:], strict=False):
                run = (run - old * last) * 31 + new
                out.add((run + first) % 2**32)
    return frozenset(out)


def load_class(record: dict, k: int) -> Class:
    """A Class from its lifted record (see sigweave.sources.signatures)."""
    methods = []
    for m in record["methods"]:
        if not any(m["blockSuccs"].values()) and not any(u[1] or u[2] for b in m["blocks"] for u in b):  # no walks, and nothing for votes
            methods.append(Method(m["idx"], m["name"], sum(map(len, m["blocks"])), plain_hashes(m["blocks"], k), {}, {}))
            continue
        grams: dict[int, list] = defaultdict(list)
        for g in paths(m["blocks"], {int(b): n for b, n in m["blockSuccs"].items()}, k):
            h = 1
            for u in g:
                h = (h * 31 + _hash(u[0])) % 2**32
            grams[h].append(g)
        methods.append(Method(m["idx"], m["name"], sum(map(len, m["blocks"])), frozenset(grams), unique(grams, lambda u: bool(u[1])), unique(grams, lambda u: u[2])))
    return Class(record["name"], record.get("super"), record.get("superType"), record.get("interfaces") or [], methods)


def dice(p: Method, q: Method) -> float:
    if (p.constructor or q.constructor) and p.name != q.name:
        return 0.0
    if not p.hashes and not q.hashes:
        return 1.0
    if not p.hashes or not q.hashes:
        return 0.0
    return 2 * len(p.hashes & q.hashes) / (len(p.hashes) + len(q.hashes))


class Polls:
    """Weighted votes: key -> value -> score, over the key's weights."""

    def __init__(self):
        self.score, self.weight = defaultdict(float), defaultdict(float)

    def add(self, key, value, score: float, weight: float) -> None:
        self.score[key, value] += score
        self.weight[key] += weight

    def get(self, key, value) -> float:
        w = self.weight.get(key, 0)
        return self.score.get((key, value), 0.0) / w if w else 0.0


def class_match(l: Class, a: Class, s: Settings) -> tuple[float, list[tuple[int, int, float]]]:  # noqa: E741
    """(similarity, method pairs with theirs) of a library's and an application's class."""
    if (l.lib_super is not None and l.lib_super != a.lib_super) or not l.methods or not a.methods or not l.weight or not a.weight:
        return 0.0, []
    m = np.array([[dice(p, q) for q in a.methods] for p in l.methods])
    pairs = [(i, j, float(m[i, j])) for i, j in solve(m)]
    sim = sum(x * l.methods[i].weight for i, _, x in pairs) / l.weight
    return (0.0 if sim < s.class_similarity else min(1.0, sim)), pairs


def scan(library: list[Class], app: list[Class], s: Settings, threshold: float) -> dict | None:
    """Match and cover of a library in an application and its matched classes, or None if the threshold is missed."""
    total = sum(c.weight for c in library)
    if not total:
        return None
    sims, initial = {}, np.zeros((len(library), len(app)))

    def similarity(i: int, j: int):
        if (i, j) not in sims:
            sims[i, j] = class_match(library[i], app[j], s)
        return sims[i, j]

    fits = lambda i, j: s.additional_methods or len(app[j].methods) <= len(library[i].methods)
    wanted, holders = set().union(*(c.hashes for c in library)), defaultdict(list)
    for j, a in enumerate(app):
        for h in a.hashes & wanted:
            holders[h].append(j)
    for i, l in enumerate(library):  # noqa: E741
        for j, n in Counter(j for h in l.hashes for j in holders[h]).items():
            if fits(i, j) and n / len(l.hashes) > s.sketch_similarity:
                initial[i, j] = similarity(i, j)[0]
    lib_at, app_at = defaultdict(list), defaultdict(list)
    for at, classes in ((lib_at, library), (app_at, app)):
        for i, c in enumerate(classes):
            at[c.name].append(i)
    matrix, seen, result = initial, set(), None
    while True:  # the matchings are finite, so that one repeats
        matching = solve(matrix)
        if tuple(matching) in seen:
            return result | {"classes": [(library[i].name, app[j].name, similarity(i, j)[0]) for i, j in matching]} if result else None
        seen.add(tuple(matching))
        by_name = {library[i].name: app[j].name for i, j in matching}
        calls, types = defaultdict(Polls), Polls()
        for i, j in matching:
            sim, pairs = similarity(i, j)
            for x, y, m in pairs:
                p, q = library[i].methods[x], app[j].methods[y]
                score = p.weight * m * sim
                if sim * m < s.mapping_threshold or score <= 0:
                    continue
                for h in p.calls.keys() & q.calls.keys():
                    for u, v in zip(p.calls[h], q.calls[h], strict=True):
                        if u[2] and v[2] and u[3] is not None and v[3] is not None and by_name.get(u[3]) == v[3]:
                            calls[u[3]].add(u[4], v[4], score, p.weight)
        weight_sum = sim_sum = 0.0
        for i, j in matching:
            l, a = library[i], app[j]  # noqa: E741
            sim, pairs = similarity(i, j)
            weight_sum += l.weight
            sim_sum += sim * l.weight
            if l.lib_super is None or l.lib_super == a.lib_super:
                m = np.array([[(1 - s.call_importance) * dice(p, q) + s.call_importance * calls[l.name].get(p.idx, q.idx) for q in a.methods] for p in l.methods]).reshape(len(l.methods), len(a.methods))
                pairs = [(x, y, float(m[x, y])) for x, y in solve(np.clip(m, 0, 1))]
            if l.app_super and a.app_super and sim >= s.mapping_threshold and l.weight * sim > 0:
                types.add(l.app_super, a.app_super, l.weight * sim, l.weight)
            for x in l.interfaces:
                for y in a.interfaces:
                    types.add(x, y, l.weight * sim / (len(l.interfaces) * len(a.interfaces)), l.weight)
            for x, y, m in pairs:
                p, q = l.methods[x], a.methods[y]
                score = p.weight * m * sim
                if sim * m < s.mapping_threshold or score <= 0:
                    continue
                for h in p.typed.keys() & q.typed.keys():
                    for u, v in zip(p.typed[h], q.typed[h], strict=True):
                        for t, w in zip(u[1], v[1], strict=False):
                            if t is not None and w is not None and not (q.constructor and w == a.name):
                                types.add(t, w, score, p.weight)
        if not weight_sum:
            return None
        match, cover = sim_sum / weight_sum, weight_sum / total
        if not match * cover >= threshold:
            return None
        result = {"match": match, "cover": cover}
        matrix = np.zeros_like(initial)
        for t, w in types.score:
            for i, j in itertools.product(lib_at.get(t, ()), app_at.get(w, ())):
                if fits(i, j):
                    matrix[i, j] = min(1.0, types.get(t, w))
        matrix = np.where(initial == 1, np.maximum(matrix, 1e-6), matrix)


def opened(classes: DataFrame, k: int, named: bool = False) -> DataFrame:
    """(artifact, cls, weight, hashes, body): class records (artifact, cls, record as JSON) with their distinct k-gram hashes, and all that a scan needs of them as bytes.
    With named, also the names that votes of the class may be for."""

    def names(record: dict) -> list[str]:
        refs = {t for m in record["methods"] for b in m["blocks"] for u in b for t in u[1]}
        return sorted({*refs, record.get("superType"), *(record.get("interfaces") or [])} - {None})

    def run(frames):
        for pdf in frames:
            records = [json.loads(r) for r in pdf["record"]]
            own = [load_class(r, k) for r in records]
            out = {"artifact": pdf["artifact"], "cls": pdf["cls"], "weight": [c.weight for c in own], "hashes": [sorted(c.hashes) for c in own], "body": [pickle.dumps(c) for c in own]}
            yield pd.DataFrame(out | ({"named": [names(r) for r in records]} if named else {}))

    return classes.select("artifact", "cls", "record").mapInPandas(run, "artifact string, cls string, weight long, hashes array<long>, body binary" + ", named array<string>" * named)


def packed_bits(places: np.ndarray) -> bytes:
    """Distinct places below 2**RANGE as bytes: numbers if they are few, else a bitmap."""
    if len(places) <= 1024:
        return b"n" + zlib.compress(places.astype(np.uint32).tobytes(), 1)
    out = np.zeros(1 << RANGE, bool)
    out[places] = True
    return b"b" + zlib.compress(np.packbits(out).tobytes(), 1)


def unpacked_bits(rows: list[bytes]) -> np.ndarray:
    """Which places any of the rows of packed_bits() has."""
    out = np.zeros(1 << RANGE, bool)
    for x in rows:
        raw = zlib.decompress(x[1:])
        if x[:1] == b"n":
            out[np.frombuffer(raw, np.uint32)] = True
        else:
            out |= np.unpackbits(np.frombuffer(raw, np.uint8)).view(bool)
    return out


def opened_lines(texts: DataFrame, k: int, wanted: np.ndarray) -> DataFrame:
    """Texts (artifact, cls, text) whose lines are classes `cls:number` of one method of one block, words its units: the lines with
    a hash of `wanted` as opened() has them, and of all others only the sketch, as rows (artifact, part, bits)."""
    schema = pa.schema([("artifact", pa.string()), ("cls", pa.string()), ("weight", pa.int64()), ("hashes", pa.list_(pa.int64())), ("body", pa.binary()), ("named", pa.list_(pa.string())), ("part", pa.int32()), ("bits", pa.binary())])
    wanted = np.unique(wanted).astype(np.uint64)
    mask = np.uint64((1 << 20) - 1)

    def sketch(names: list[str], gathered: list[np.ndarray]):
        if not gathered:
            return
        all_ = np.unique(np.concatenate(gathered))
        owner, place = np.divmod(all_, ARTIFACT_PRIME)
        key = (owner << 8) + (place >> RANGE)
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        rows = [{"artifact": names[owner[i]], "part": int(place[i] >> RANGE), "bits": packed_bits(place[i:j] & ((1 << RANGE) - 1))} for i, j in zip(starts, [*starts[1:], len(key)], strict=True)]
        yield pa.RecordBatch.from_pylist(rows, schema)

    def run(batches):
        known = np.zeros(1 << 20, bool)
        known[wanted & mask] = True
        numbers, gathered, n = {}, [], 0
        for whole in batches:
            for batch in arrays.text_slices(whole):
                of, names = batch.column("artifact").to_pylist(), batch.column("cls").to_pylist()
                words, sizes, where = [], [], []
                for row, text in enumerate(batch.column("text").to_pylist()):
                    for i, line in enumerate(text.split("\n") if text is not None else ()):
                        own = line.split()
                        if len(own) >= k:
                            words += own
                            sizes.append(len(own))
                            where.append((row, i))
                if not words:
                    continue
                coded = pa.array(words, pa.string()).dictionary_encode()
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                at = arrays.run_starts(bounds, k)
                h = arrays.sequences(arrays.polynomials(coded.dictionary)[np.asarray(coded.indices)], k)[at]
                line = np.searchsorted(bounds, at, side="right") - 1
                maybe = np.flatnonzero(known[h & mask])
                met = np.zeros(len(sizes), bool)
                met[line[maybe[np.isin(h[maybe], wanted)]]] = True
                rows = []
                for x in np.flatnonzero(met):
                    row, i = where[x]
                    method = {"name": "line", "idx": 0, "blocks": [[unit(w) for w in words[bounds[x] : bounds[x + 1]]]], "blockSuccs": {}}
                    c = load_class({"name": f"{names[row]}:{i}", "methods": [method]}, k)
                    rows.append({"artifact": str(of[row]), "cls": c.name, "weight": c.weight, "hashes": sorted(c.hashes), "body": pickle.dumps(c), "named": []})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                owner = np.array([numbers.setdefault(str(of[row]), len(numbers)) for row, _ in where], np.int64)
                rest = ~met[line]
                gathered.append(np.unique(owner[line[rest]] * ARTIFACT_PRIME + (h[rest] % np.uint64(ARTIFACT_PRIME)).astype(np.int64)))
                n += len(gathered[-1])
                if n >= HELD:
                    yield from sketch([*numbers], gathered)
                    numbers, gathered, n = {}, [], 0
        yield from sketch([*numbers], gathered)

    kinds = "artifact string, cls string, weight long, hashes array<long>, body binary, named array<string>, part int, bits binary"
    return texts.select("artifact", "cls", "text").mapInArrow(run, kinds)


def sketched(classes: DataFrame, bits: DataFrame) -> DataFrame:
    """(app, cls, bit, n): the bits of classes (app, cls, bit) that rows (artifact, part, bits) of their application don't have; and without cls and bit, how many those have, a part at a time."""
    schema = pa.schema([("app", pa.string()), ("cls", pa.string()), ("bit", pa.int32()), ("n", pa.int64())])

    def one(key, left: pa.Table, right: pa.Table) -> pa.Table:
        held = unpacked_bits(right.column("bits").to_pylist())
        own = left.filter(pa.array(~held[np.asarray(left.column("bit")) & ((1 << RANGE) - 1)])) if left.num_rows else left
        n = own.num_rows
        return pa.table([pa.array([key[0].as_py()] * (n + 1), pa.string()), pa.array([*own.column("cls").to_pylist(), None], pa.string()), pa.array([*own.column("bit").to_pylist(), None], pa.int32()), pa.array([None] * n + [int(held.sum())], pa.int64())], schema=schema)

    parts = classes.withColumn("part", F.shiftright("bit", RANGE)).groupBy("app", "part")
    return parts.cogroup(bits.select(F.col("artifact").alias("app"), "part", "bits").groupBy("app", "part")).applyInArrow(one, "app string, cls string, bit int, n long")


def class_hashes(classes: DataFrame, k: int) -> DataFrame:
    """(artifact, cls, h): distinct k-gram hashes of class records (artifact, cls, record)."""
    return opened(classes, k).select("artifact", "cls", F.explode("hashes").alias("h"))


def detect(libraries: DataFrame, apps: DataFrame, settings: Settings = Settings(), keep=lambda df: df, opened_libraries: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """(app, library, match, cover, accepted, round, classes) of all rounds; both inputs are class records (artifact, cls, record).

    `keep` fixes a round's rows (a table written or cached), so that later rounds don't compute them again. A round
    scans what the sketches suggest, accepts in order of (match, cover), takes accepted classes out of the applications,
    and drops library candidates whose scan failed; it ends when no candidate is left. Each round drops a candidate or takes
    classes away in each application that it scans. There can be as many rounds as copies of a library in an application, so
    that `keep` should cut the plan, too. The applications are written once: a round keeps only what it takes away, and what
    it doesn't need any more is released. opened_libraries: the libraries as opened() gives them, if they are kept somewhere.
    lines: texts (artifact, cls, text), if the classes of apps are just their lines; of those that share nothing with a
    library only the sketch is then written.
    """
    s = settings
    lib_rows = keep(opened(libraries, s.k)) if opened_libraries is None else opened_libraries
    lib_sets = keep(lib_rows.select(F.col("artifact").alias("library"), F.explode("hashes").alias("h")).distinct())
    sizes = lib_rows.groupBy(F.col("artifact").alias("library")).agg(F.sum("weight").alias("size"))
    thresholds = keep(sizes.select("library", detection_threshold(F.col("size"), s.detection_formula).alias("threshold")))
    keys = lib_sets.select("h").distinct()
    few = keys.limit(FEW + 1).count() <= FEW
    bits = None
    if lines is not None and few:
        written = keep(opened_lines(lines, s.k, np.array([r.h for r in keys.collect()], np.int64)))
        rows, bits = written.where("body IS NOT NULL"), written.where("bits IS NOT NULL")
    else:
        written = rows = keep(opened(apps, s.k, named=True))
    left = rows.select(F.col("artifact").alias("app"), "cls", "body")
    hashed = rows.select(F.col("artifact").alias("app"), "cls", F.explode("hashes").alias("h"))
    shared = keep(hashed.join(F.broadcast(keys) if few else keys, "h", "left_semi").select("app", "cls", "h"))
    votable = rows.select(F.col("artifact").alias("app"), F.explode("named").alias("cls")).distinct()
    named = keep(votable.join(left.select("app", "cls"), ["app", "cls"], "left_semi"))
    # only classes that share a hash with a library, or that a vote may be for, are ever matched; the others' bits stay
    placed = hashed.select("app", "cls", bit(F.col("h"), ARTIFACT_PRIME).alias("bit"))
    if bits is not None:
        both = keep(sketched(placed.distinct(), bits))
        own, stays = both.where("cls IS NOT NULL").select("app", "cls", "bit"), both.groupBy("app").agg(F.sum("n").alias("stays"))
    else:
        matchable = keep(shared.select("app", "cls").union(named).distinct())
        both = keep(placed.join(matchable, ["app", "cls"], "left_anti").select("app", "bit").distinct())
        own = keep(placed.join(matchable, ["app", "cls"], "left_semi").distinct().join(both, ["app", "bit"], "left_anti").select("app", "cls", "bit"))
        stays = both.groupBy("app").agg(F.count("*").alias("stays"))
        release(matchable)
    stays = keep(stays)
    of_libraries = keep(lib_sets.join(lib_sets.groupBy("library").agg(F.count("*").alias("size")), "library"))
    voted = not named.isEmpty()
    lib_classes = keep(lib_rows.select(F.col("artifact").alias("library"), F.col("cls").alias("l"), F.size("hashes").alias("of"), F.explode("hashes").alias("h")))
    gone, alive, parts = None, None, []
    now = lambda df: df if gone is None else df.join(gone, ["app", "cls"], "left_anti")
    for number in itertools.count(1):
        current = now(shared)
        moves = now(own).groupBy("app").agg(F.count_distinct("bit").alias("moves"))
        pops = stays.union(moves).groupBy("app").agg((F.sum("stays") / F.lit(float(ARTIFACT_PRIME))).alias("pop"))
        both_have = of_libraries.join(current.select("app", "h").distinct(), "h").groupBy("library", "app", "size").agg(F.count("*").alias("shared"))
        scores = both_have.withColumn("score", F.col("shared") / F.col("size")).join(pops, "app")
        if alive is not None:
            scores = scores.join(alive, ["app", "library"], "left_semi")
        passed = keep(sketch_filter(scores, F.col("pop"), formula=s.sketch_formula))  # what fails here once is out for good
        chosen = keep(scan_window(passed, within=["app"], width=s.scan_range).select("app", "library"))
        if chosen.isEmpty():
            break
        met = chosen.join(lib_classes, "library").join(current, ["app", "h"]).groupBy("app", "library", "l", "of", "cls").agg(F.count("*").alias("n"))
        asked = met.where(F.col("n") / F.col("of") > s.sketch_similarity).select("app", "library", "cls")
        if voted:
            asked = asked.union(chosen.join(now(named), "app").select("app", "library", "cls"))
        lib_side = chosen.join(lib_rows.select(F.col("artifact").alias("library"), "body"), "library").join(thresholds, "library").select("app", "library", F.lit("l").alias("side"), "threshold", "body")
        app_side = asked.distinct().join(left, ["app", "cls"]).select("app", "library", F.lit("a").alias("side"), F.lit(0.0).alias("threshold"), "body")

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            sides = {v: sorted((pickle.loads(b) for b in pdf.loc[pdf["side"] == v, "body"]), key=lambda c: c.name) for v in "la"}
            found = scan(sides["l"], sides["a"], s, float(pdf["threshold"].max()))
            row = [pdf["app"].iloc[0], pdf["library"].iloc[0], found and found["match"], found and found["cover"], [c[1] for c in found["classes"]] if found else []]
            return pd.DataFrame([row], columns=["app", "library", "match", "cover", "classes"])

        scanned = keep(lib_side.unionByName(app_side).groupBy("app", "library").applyInPandas(one, "app string, library string, match double, cover double, classes array<string>"))
        results = scanned.where("match IS NOT NULL")
        members = results.select("app", "library", F.explode("classes").alias("member"))
        resolved = keep(resolve(results, members, key="library", order=[F.desc("match"), F.desc("cover"), F.asc("library")], within=["app"]).withColumn("round", F.lit(number)))
        taken = resolved.where("accepted").select("app", F.explode("classes").alias("cls")).distinct()
        # a result without classes takes none away and would be scanned forever; one that lost a conflict is scanned again on what is left
        failed = scanned.where("match IS NULL OR size(classes) = 0").select("app", "library")
        before = gone, alive
        gone, alive = keep(taken if gone is None else gone.unionByName(taken)), keep(passed.select("app", "library").join(failed, ["app", "library"], "left_anti"))
        release(passed, chosen, scanned, *before)
        parts.append(resolved)
        if len(parts) == PARTS:
            whole = keep(reduce(DataFrame.unionByName, parts))
            release(*parts)
            parts = [whole]
        gc.collect()  # broadcasts and shuffle files of past rounds stay until the driver collects its garbage
        libraries.sparkSession._jvm.System.gc()
    release(written, lib_sets, thresholds, shared, named, both, own, stays, of_libraries, lib_classes, passed, chosen, gone, alive)
    if not parts:
        empty = "app string, library string, match double, cover double, classes array<string>, accepted boolean, round int"
        return libraries.sparkSession.createDataFrame([], empty)
    return reduce(DataFrame.unionByName, parts)
