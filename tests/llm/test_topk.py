import math

import numpy as np

from sigweave.llm import topk
from sigweave.llm.common import materialise as topk_materialise


def brute(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in good:
        if q is None or q % 50:
            continue
        found = [(-sum(a * b for a, b in zip(v, qv, strict=True)), math.inf if i is None else i) for i, v in good if i != q and len(v) == len(qv)]
        out += [(q, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def run(spark, rows, kind="float", **how):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, score int, __id int")
    return sorted((tuple(r) for r in topk.top_k(df, **how).collect()), key=str)


def test_ties_nulls_and_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (51, [1.0, 2.0]), (52, [1.0, 2.0]), (52, [1.0, 2.0]), (53, None), (54, [None, 1.0]), (55, [float("nan"), 1.0]), (56, [float("inf"), 1.0]), (57, [1.0]), (None, [3.0, 3.0]), (100, []), (150, [-0.001, 0.001]), (200, [7.0])]
    assert run(spark, [(*r, 1, 2) for r in rows]) == brute(rows)
    assert run(spark, [(*r, 1, 2) for r in rows], shard_rows=3, block_rows=2) == brute(rows)
    assert run(spark, [(1, [1.0], 1, 2)]) == []
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_rows_that_share_a_query_id_are_queries_each(spark):
    rng = np.random.default_rng(8)
    rows = [(i // 2 * 25, rng.normal(size=3).tolist()) for i in range(40)] + [(None, [9.0, 9.0, 9.0])] * 30
    want = brute(rows)
    assert sum(r[:2] == (50, 1) for r in want) == 2
    assert run(spark, [(*r, 1, 2) for r in rows], "double") == want
    assert run(spark, [(*r, 1, 2) for r in rows], "double", shard_rows=7, block_rows=3) == want


def test_each_shard_is_planted_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(topk, "materialise", lambda df: written.append(topk_materialise(df)) or written[-1])
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist(), 1, 2) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, __id int")
    assert topk.top_k(df, shard_rows=50, block_rows=2).count() == 12 * 5
    trees, _, *waves = written
    assert trees.count() == 12 and len(waves) == 3  # shard 0, the next 8, and the rest start from trees that are read


def test_stored_trees_answer_alike():
    rng = np.random.default_rng(2)
    for scale in (20, 3000, 1e12):
        x, q = (np.floor(rng.normal(size=(n, 5)) * scale) for n in (300, 4))
        tree = topk.BallTree(np.arange(300), x, leaf=16)
        again = topk.BallTree.read(5, tree.stored())
        assert (again.bounds(q) == tree.bounds(q)).all()
        assert all(again.search(i, q[i], again.bounds(q)[i], 5, None) == tree.search(i, q[i], tree.bounds(q)[i], 5, None) for i in range(4))


def test_many_shards_blocks_and_hot_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(700)] + [(i, [0.5] * 8) for i in range(700, 1100)]
    want = brute(rows)
    assert run(spark, [(*r, 1, 2) for r in rows], "double", shard_rows=150, block_rows=7) == want
    assert run(spark, [(*r, 1, 2) for r in rows], "double") == want


def test_huge_components_are_cut_to_64_bits(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 1.0]), (2, [3.0, 1e10])]
    got = run(spark, [(*r, 1, 2) for r in rows], "double")
    assert [r[2:] for r in got] == [(1, 2**63 - 1), (2, 2**63 - 1)]


def test_tree_search_equals_a_scan():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(500, 6)) * 20)
    tree = topk.BallTree(np.arange(500), x, leaf=16)
    q = np.floor(rng.normal(size=(9, 6)) * 20)
    bounds = tree.bounds(q)
    for i in range(9):
        want = sorted((-int(s), j) for j, s in enumerate(x @ q[i]) if j != i)[:5]
        assert tree.search(i, q[i], bounds[i], 5, None) == want
        assert tree.search(i, q[i], bounds[i], 5, -want[2][0]) == [p for p in want if p[0] <= want[2][0]]


def test_a_block_of_queries_equals_one_by_one():
    rng = np.random.default_rng(4)
    for scale in (3, 20, 1e12):  # with ties, without, and beyond what floats hold
        x = np.floor(rng.normal(size=(400, 5)) * scale)
        q = np.floor(rng.normal(size=(30, 5)) * scale)
        own, tree = rng.integers(0, 400, 30), topk.BallTree(np.arange(400), x, leaf=16)
        bounds, floors = tree.bounds(q), {}
        for _ in range(2):
            want = [(i, other, -minus) for i in range(30) for minus, other in tree.search(int(own[i]), q[i], bounds[i], 5, floors.get(i))]
            assert list(zip(*(c.tolist() for c in tree.search_all(own, q, 5, floors)), strict=True)) == want
            floors = {n: [s for i, _, s in want if i == n][2] for n in range(0, 30, 2)}
    few = topk.BallTree(np.arange(3), np.eye(3))
    assert few.search_all(np.array([1]), np.ones((1, 3)), 5, {})[1].tolist() == [0, 2]
