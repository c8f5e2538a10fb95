"""The detection against a plain one: dictionaries, all assignments by enumeration, one step after the other as the definition has them."""

import itertools
import json
from collections import defaultdict
from math import log10

import numpy as np
import pytest

from sigweave.operators import detection
from sigweave.sources import signatures
from sigweave.sources.storage import materialise

K = 3


def grams(method):
    """k-grams of a method: tuples of units."""
    out = []

    def walk(b, i, done):
        done = (*done, tuple(map(str, method["blocks"][b][i]))), method["blocks"][b][i]
        done = done[0]
        if len(done) == K:
            out.append(done)
        elif i + 1 < len(method["blocks"][b]):
            walk(b, i + 1, done)
        else:
            for n in method["blockSuccs"].get(str(b), []):
                walk(n, 0, done)

    for b, units in enumerate(method["blocks"]):
        for i in range(len(units)):
            walk(b, i, ())
    return out


class Plain:
    def __init__(self, record):
        self.name, self.super, self.app_super, self.interfaces = record["name"], record.get("super"), record.get("superType"), record["interfaces"]
        self.methods = record["methods"]
        self.units = [{g: None for g in grams(m)} for m in self.methods]
        self.sets = [{tuple(u[0] for u in g) for g in own} for own in self.units]
        self.w = [sum(map(len, m["blocks"])) for m in self.methods]
        self.weight, self.all = sum(self.w), set().union(*self.sets)

    def with_units(self, i, holds):
        """Instruction texts -> k-gram, where a unit holds and the references never differ."""
        seen = defaultdict(set)
        for g in self.units[i]:
            if any(holds(u) for u in g):
                seen[tuple(u[0] for u in g)].add(g)
        return {t: next(iter(own)) for t, own in seen.items() if len({tuple(u[1] for u in g) for g in own}) == 1}


def best(m):
    """All pairs of a best matching, by trying every one."""
    rows, columns = len(m), len(m[0]) if len(m) else 0
    top, found = -1.0, []
    for choice in itertools.product([None, *range(columns)], repeat=rows):
        used = [c for c in choice if c is not None]
        if len(set(used)) == len(used) and all(m[i][c] > 0 for i, c in enumerate(choice) if c is not None):
            total = sum(1 + m[i][c] for i, c in enumerate(choice) if c is not None)
            if total > top + 1e-9:
                top, found = total, [(i, c) for i, c in enumerate(choice) if c is not None]
    return found


def dice(l, i, a, j):  # noqa: E741
    p, q = l.methods[i]["name"], a.methods[j]["name"]
    if {p, q} & {"<init>", "<clinit>"} and p != q:
        return 0.0
    x, y = l.sets[i], a.sets[j]
    return 1.0 if not x and not y else 2 * len(x & y) / (len(x) + len(y))


def class_sim(l, a):  # noqa: E741
    if (l.super is not None and l.super != a.super) or not l.weight or not a.weight:
        return 0.0, []
    m = [[dice(l, i, a, j) for j in range(len(a.methods))] for i in range(len(l.methods))]
    pairs = [(i, j, m[i][j]) for i, j in best(m)]
    sim = sum(x * l.w[i] for i, _, x in pairs) / l.weight
    return (0.0 if sim < 0.1 else sim), pairs


def refs(u):
    return [None if r == "None" else r for r in json.loads(u[1].replace("'", '"').replace("None", "null"))]


def plain_scan(lib, app):
    total = sum(c.weight for c in lib)
    sims = {(i, j): class_sim(l, a) for i, l in enumerate(lib) for j, a in enumerate(app)}
    fits = lambda i, j: len(app[j].methods) <= len(lib[i].methods)
    first = [[sims[i, j][0] if fits(i, j) and len(l.all & a.all) / len(l.all) > 0.1 else 0.0 for j, a in enumerate(app)] for i, l in enumerate(lib)]
    matrix, seen, result = first, [], None
    while True:
        matching = best(matrix)
        if matching in seen:
            return (*result, sorted(app[j].name for _, j in matching)) if result else None
        seen.append(matching)
        partner = {lib[i].name: app[j].name for i, j in matching}
        call_score, call_weight, score, weight = defaultdict(float), defaultdict(float), defaultdict(float), defaultdict(float)
        for i, j in matching:
            l, a = lib[i], app[j]  # noqa: E741
            for x, y, m in sims[i, j][1]:
                s = l.w[x] * m * sims[i, j][0]
                if s <= 0:
                    continue
                p, q = (c.with_units(n, lambda u: u[2] == "True") for c, n in ((l, x), (a, y)))
                for t in p.keys() & q.keys():
                    for u, v in zip(p[t], q[t], strict=True):
                        if u[2] == v[2] == "True" and u[3] != "None" and v[3] != "None" and partner.get(u[3]) == v[3]:
                            call_score[u[3], u[4], v[4]] += s
                            call_weight[u[3], u[4]] += l.w[x]
        sim_sum = weight_sum = 0.0
        for i, j in matching:
            l, a = lib[i], app[j]  # noqa: E741
            sim, pairs = sims[i, j]
            weight_sum += l.weight
            sim_sum += sim * l.weight
            if l.super is None or l.super == a.super:
                vote = lambda x, y: call_score[l.name, str(x), str(y)] / call_weight[l.name, str(x)] if call_weight[l.name, str(x)] else 0.0  # noqa: E731, B023
                m = [[0.01 * dice(l, x, a, y) + 0.99 * vote(x, y) for y in range(len(a.methods))] for x in range(len(l.methods))]
                pairs = [(x, y, m[x][y]) for x, y in best(m)]
            if l.app_super and a.app_super and l.weight * sim > 0:
                score[l.app_super, a.app_super] += l.weight * sim
                weight[l.app_super] += l.weight
            for x in l.interfaces:
                for y in a.interfaces:
                    score[x, y] += l.weight * sim / (len(l.interfaces) * len(a.interfaces))
                    weight[x] += l.weight
            for x, y, m in pairs:
                s = l.w[x] * m * sim
                if s <= 0:
                    continue
                p, q = (c.with_units(n, lambda u: u[1] != "[]") for c, n in ((l, x), (a, y)))
                for t in p.keys() & q.keys():
                    for u, v in zip(p[t], q[t], strict=True):
                        for r, o in zip(refs(u), refs(v), strict=False):
                            if r is not None and o is not None and not (a.methods[y]["name"] in ("<init>", "<clinit>") and o == a.name):
                                score[r, o] += s
                                weight[r] += l.w[x]
        if not weight_sum:
            return None
        match, cover = sim_sum / weight_sum, weight_sum / total
        if not match * cover >= max(0.1, 0.7 - 0.15 * log10(max(1, total))):
            return None
        result = (match, cover)
        votes = lambda i, j: min(1.0, score[lib[i].name, app[j].name] / weight[lib[i].name]) if fits(i, j) and weight[lib[i].name] else 0.0
        matrix = [[max(votes(i, j), 1e-6) if first[i][j] == 1 else votes(i, j) for j in range(len(app))] for i in range(len(lib))]


def plain_detect(libraries, app):
    """(library, match, cover, accepted, round, classes) of one application."""
    alive, left, out = set(libraries), sorted(app, key=lambda c: c.name), []
    for number in itertools.count(1):
        mine = set().union(*(c.all for c in left)) if left else set()
        pop, scores = len(mine) / detection.ARTIFACT_PRIME, {}
        for name in sorted(alive):
            own = set().union(*(c.all for c in libraries[name]))
            scores[name] = len(own & mine) / len(own)
            if not scores[name] or scores[name] < max(0.1 + pop, 0.9 - 0.2 * log10(max(1, len(own)))):
                alive.discard(name)
                del scores[name]
        if not scores:
            return out
        distinct = sorted(set(scores.values()), reverse=True)
        low = min(distinct[0] - 0.03, distinct[1] if len(distinct) > 1 else 0)
        found = []
        for name in [n for n, s in scores.items() if s > low]:
            got = plain_scan(sorted(libraries[name], key=lambda c: c.name), left)
            if got is None or not got[2]:
                alive.discard(name)
            if got is not None:
                found.append((-got[0], -got[1], name, got[2]))
        seen, gone = set(), set()
        for match, cover, name, classes in sorted(found):
            accepted = not seen & set(classes)
            seen |= set(classes)
            gone |= set(classes) if accepted else set()
            out.append((name, round(-match, 6), round(-cover, 6), accepted, number, classes))
        left = [c for c in left if c.name not in gone]


def made_up(seed):
    """Libraries, and an application with changed and renamed parts of them."""
    rng = np.random.default_rng(seed)
    word = lambda: f"op{rng.integers(500)}"
    libraries = {}
    for n in range(4):
        names = [f"l{n}.C{i}" for i in range(int(rng.integers(1, 4)))]
        classes = []
        for name in names:
            methods = []
            for idx in range(int(rng.integers(1, 4))):
                units = [word() for _ in range(int(rng.integers(6, 25)))]
                for _ in range(int(rng.integers(0, 3))):
                    other = names[int(rng.integers(len(names)))]
                    units[int(rng.integers(len(units)))] = ["call" + word(), [other], other, 0] if rng.random() < 0.6 else ["use" + word(), [other, None]]
                cut = int(rng.integers(1, len(units)))
                methods.append({"name": "<init>" if idx == 0 else f"m{idx}", "idx": idx, "fixTypes": [], "refs": [], "blocks": [[signatures.unit(u) for u in part] for part in (units[:cut], units[cut:])], "blockSuccs": {"0": [1]}})
            classes.append({"name": name, "interfaces": names[:1] if rng.random() < 0.3 else [], "methods": methods} | ({"super": "x.Y"} if rng.random() < 0.4 else {}) | ({"superType": names[0]} if rng.random() < 0.4 else {}))
        libraries[f"lib{n} 1"] = classes
    # a library that shares a class with another: they are in conflict
    libraries["lib9 1"] = [libraries["lib0 1"][0] | {"name": "l9.C0"}, *libraries["lib1 1"][:1]]
    app, renamed = [], {}
    for name, classes in libraries.items():
        if name == "lib3 1":
            continue
        for c in classes:
            renamed.setdefault(c["name"], f"a.{len(renamed):02}")
    change = lambda x: renamed.get(x, x)
    for name in ("lib0 1", "lib1 1", "lib2 1"):
        for c in libraries[name]:
            methods = []
            for m in c["methods"]:
                blocks = [[[u[0] if rng.random() > 0.03 else word(), [change(r) for r in u[1]], u[2], change(u[3]), u[4]] for u in b] for b in m["blocks"]]
                methods.append(m | {"name": m["name"] if m["name"] == "<init>" else "z" + m["name"], "blocks": blocks})
            app.append(c | {"name": change(c["name"]), "interfaces": [change(x) for x in c["interfaces"]], "methods": methods} | ({"superType": change(c["superType"])} if "superType" in c else {}))
    return libraries, app


@pytest.mark.parametrize("seed", range(4))
def test_detection_equals_a_plain_one(spark, seed):
    libraries, app = made_up(seed)
    rows = lambda name, classes: [(name, c["name"], json.dumps(c)) for c in classes]
    schema = "artifact string, cls string, record string"
    libs = spark.createDataFrame([r for n, c in libraries.items() for r in rows(n, c)], schema).coalesce(2)
    apps = spark.createDataFrame(rows("app", app), schema).coalesce(1)
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = detection.detect(libs, apps, detection.Settings(k=K), keep=materialise).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    got = sorted((r.library, round(r.match, 6), round(r.cover, 6), r.accepted, r["round"], sorted(r.classes)) for r in found)
    want = sorted(plain_detect({n: [Plain(c) for c in own] for n, own in libraries.items()}, [Plain(c) for c in app]))
    assert got == want and any(r[3] for r in want)
