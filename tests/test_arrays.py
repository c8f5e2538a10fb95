import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigweave.functions import arrays
from sigweave.operators import kgrams, similarity, sketches
from sigweave.operators.detection import _hash

TEXTS = [None, "", " ", "a", "a b c d", "a  b\nc \n d e f", "x\ty z \x0b w v", "ü 日本 😀 a b c", "q " * 50, " lead and trail ", "same same same same same same"]


def units(text):
    return [w for w in re.split("[ \n]+", text or "") if w]


def fold(hashes):
    h = 1
    for x in hashes:
        h = (h * 31 + x) % 2**32
    return h


def test_units_and_hashes():
    codes, bounds, words = arrays.split_units(pa.array(TEXTS))
    words = words.to_pylist()
    assert [[words[c] for c in codes[a:z]] for a, z in zip(bounds, bounds[1:], strict=False)] == [units(t) for t in TEXTS]
    assert arrays.polynomials(pa.array(words)).tolist() == [_hash(w) for w in words]
    assert arrays.polynomials(pa.array(["", "x" * 300, ""])).tolist() == [0, _hash("x" * 300), 0]
    h = np.array([_hash(w) for w in "a b c d e f".split()], np.uint64)
    assert arrays.sequences(h, 5).tolist() == [fold(h[i : i + 5].tolist()) for i in range(2)]
    assert arrays.sequences(h[:3], 5).tolist() == []


@pytest.mark.parametrize("k", [1, 3, 5])
def test_grams_and_bits_of_texts(spark, k):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else f"s{i % 3}", t, i) for i, t in enumerate(TEXTS + TEXTS)], "i int, s string, text string, h int").repartition(3)
    of = lambda t: {tuple(units(t)[j : j + k]) for j in range(len(units(t)) - k + 1)}
    want = {(i, " ".join(g)) for i, t in enumerate(TEXTS + TEXTS) for g in of(t)}
    got = [(r.i, r.gram) for r in kgrams.text_kgrams(df.drop("h"), "text", k).collect()]
    assert set(got) == want and len(got) == len(want)
    hashed = [(r.i, r.h) for r in kgrams.text_kgrams(df.drop("h"), "text", k, hashed=True).collect()]
    assert len(set(hashed)) == len(hashed) == len(want) and len({h for _, h in hashed}) == len({g for _, g in want})
    bits = {(None if i % 4 == 0 else f"s{i % 3}", fold(_hash(w) for w in g) % 127) for i, t in enumerate(TEXTS + TEXTS) for g in of(t)}
    rows = [tuple(r) for r in sketches.text_bits(df.select("s", "text"), "text", k, 127).collect()]
    assert set(rows) == bits and len(rows) == len(bits)


def test_containment_with_and_without_a_broadcast_side(spark):
    rng = np.random.default_rng(0)
    a = spark.createDataFrame([(int(i), int(h)) for i, h in rng.integers(0, 12, (80, 2))], "l int, h long")
    b = spark.createDataFrame([(int(i), int(h)) for i, h in rng.integers(0, 15, (80, 2))], "r int, h long")
    got = [sorted(map(tuple, sketches.containment(a, b, "l", "r", few=few).collect())) for few in (10, 1000)]
    sets = lambda df, k: {x[k]: {r.h for r in df.collect() if r[k] == x[k]} for x in df.collect()}
    want = sorted((i, j, len(x & y), len(x), len(x & y) / len(x)) for i, x in sets(a, "l").items() for j, y in sets(b, "r").items() if x & y)
    assert got == [want, want]


def test_dice_of_equal_sets(spark):
    sets = {1: {1, 2, 3}, 2: {1, 2, 3}, 3: {2, 3, 4}, 4: {9}, 5: {9}, 6: {2, 3, 4}, 7: {50}}
    df = spark.createDataFrame([(k, h) for k, s in sets.items() for h in s] * 2, "k int, h long").select("k", F.col("h"))
    want = {(a, b, len(sets[a] & sets[b]), 2 * len(sets[a] & sets[b]) / (len(sets[a]) + len(sets[b]))) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    assert {tuple(r) for r in similarity.dice_self_join(df, "k").collect()} == want
    assert {tuple(r) for r in similarity.dice_self_join(df, "k", least=0.7).collect()} == {w for w in want if w[3] > 0.7}


@pytest.mark.parametrize("hot", [0, 3, 1000])
@pytest.mark.parametrize("least", [0.0, 0.1, 0.8])
def test_dice_with_frequent_elements(spark, hot, least):
    rng = np.random.default_rng(7)
    sets = {}
    for k in range(60):
        common = [int(x) for x in rng.permutation(12)[: int(rng.integers(0, 13))]]  # elements that most sets have
        sets[k] = {*common, *(int(x) for x in rng.integers(100, 160, int(rng.integers(0, 12))))}
    sets[60], sets[61], sets[62] = set(range(12)), set(range(11)), {5}
    df = spark.createDataFrame([(k, h) for k, s in sets.items() for h in s], "k int, h long")
    dice = lambda a, b: 2 * len(sets[a] & sets[b]) / max(1, len(sets[a]) + len(sets[b]))
    want = {(a, b, len(sets[a] & sets[b]), dice(a, b)) for a in sets for b in sets if a < b and sets[a] & sets[b] and dice(a, b) > least}
    got = [tuple(r) for r in similarity.dice_self_join(df, "k", least=least, hot=hot).collect()]
    assert set(got) == want and len(got) == len(want)
