import re

import duckdb
import numpy as np
import pytest

from sigweave.llm import near_dedup


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, n):
    """(doc_id, n_shingles, component_id) by comparing every pair that shares a shingle."""
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        shared = {}
        for g in s:
            for j in where.setdefault(g, []):
                shared[j] = shared.get(j, 0) + 1
            where[g].append(i)
        for j, k in shared.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def made_up(seed):
    """Chains of edits, copies in groups, short and empty texts."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(3000)}"
    texts = [None, "", " \t ", "a", "A", "a b c", "A B  C", "a b c d", "word " * 3000]
    for _ in range(12):
        base = [word() for _ in range(int(rng.integers(20, 200)))]
        for _ in range(int(rng.integers(1, 14))):
            texts.append(" ".join(base))
            texts.append(" ".join(base).upper())
            for _ in range(int(rng.integers(0, 4))):
                base[int(rng.integers(len(base)))] = word()
    order = rng.permutation(len(texts))
    return [(int(i), texts[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize("n", [4, 5])
def test_components_equal_brute_force(spark, n):
    rows = made_up(n)
    rows += [(3, rows[5][1]), (3, "something else entirely " * 9), (None, rows[6][1]), (None, "no id " * 20)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, cls string, id int")
    got = near_dedup.link(df, shingle=n).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, n)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(900):  # edits at random: many pairs are links, many are just not
        t = list(base)
        for j in rng.integers(0, 120, 3):
            t[j] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(t)))
    got = near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 4)


def roots(nodes, edges):
    """The smallest member of each node's component."""
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_pivots_and_tiles_join_what_all_pairs_join(spark, seed):
    """Groups over and under the tile, of one cluster, of several, of chains, and of strangers."""
    rng = np.random.default_rng(seed)
    sets, rows = {}, []
    for g, n in enumerate([1, 2, 8, 9, 30, 61, 120]):
        base = [rng.integers(0, 2**63, 40, dtype=np.uint64) for _ in range(3)]
        for i in range(n):
            if g % 2:  # a chain: each like the one before it
                base[0] = np.concatenate([base[0][2:], rng.integers(0, 2**63, 2, dtype=np.uint64)])
                own = base[0]
            else:
                own = base[int(rng.integers(3))].copy()
                own[rng.integers(0, 40, int(rng.integers(0, 8)))] = rng.integers(0, 2**63, dtype=np.uint64)
            cls = b"%d-%d" % (g, i)
            sets[cls] = np.unique(own)
            rows.append((g, cls, sets[cls].tobytes()))
    df = spark.createDataFrame(rows, "g int, cls binary, v binary")
    got = near_dedup.joined(df, "g", near_dedup.Sets, (80, 100), tile=8).collect()
    links = [(a, b) for g, a, _ in rows for h, b, _ in rows if g == h and a < b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    assert len(links) > 500
    assert roots(sets, [(bytes(r.a), bytes(r.b)) for r in got]) == roots(sets, links)


def test_long_texts_are_counted_exactly():
    x = [np.arange(70_000, dtype=np.uint64), np.arange(10, 69_000, dtype=np.uint64)]
    assert near_dedup.intersections(x, x).tolist() == [[70_000, 68_990], [68_990, 68_990]]


def test_representatives(spark):
    rows = [(4, "one two three four five six"), (2, "One two three four five six"), (7, None), (8, ""), (9, "other words that stand alone here")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in near_dedup.representatives(df).collect()) == [2, 7, 8, 9]
    twice = df.unionByName(df)
    assert sorted(r.doc_id for r in near_dedup.representatives(twice).collect()) == [2, 7, 7, 8, 8, 9]
    assert near_dedup.representatives(df.limit(0)).count() == 0


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(2)
    for j in (0.8, 0.9, 0.97):
        errors = []
        for _ in range(40):
            shared = rng.integers(0, 2**63, int(1000 * j), dtype=np.uint64)
            sets = [np.concatenate([shared, rng.integers(0, 2**63, int(1000 * (1 - j) / 2), dtype=np.uint64)]) for _ in range(2)]
            a, b = near_dedup.odd_sketches(near_dedup.min_values([np.unique(x << np.uint64(1)) for x in sets]))
            z = int(np.bitwise_count(a ^ b).sum())
            assert z <= near_dedup.most_bits()
            errors.append(float(near_dedup.estimate(z)) - j)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = near_dedup.query(spark, sf).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 4)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(con.sql(near_dedup.SQL).fetchall()) == sorted(map(tuple, got))
