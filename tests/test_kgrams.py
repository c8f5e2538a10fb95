from collections import Counter

import pytest
from pyspark.sql import functions as F

from sigweave.functions import hashing
from sigweave.operators import kgrams
from sigweave.operators.detection import _hash, paths
from sigweave.plans.bindings import FIXTURE_BLOCKS

# The expected 5-grams of the fixture, as a multiset.
EXPECTED = Counter("ABCDE ABCDH ABCCC ABCCD ABCDE ABDER BCDEF BCDHR BCCCC BCCCD BCCDE BCDER CDEFG DEFGH EFGHR CCCCC CCCCD CCCDE CCDER".split())


def test_control_flow_fixture_by_joins(spark):
    blocks = spark.createDataFrame([(0, i, u.split()) for i, (u, _) in enumerate(FIXTURE_BLOCKS)], "entity int, block int, units array<string>")
    edges = spark.createDataFrame([(0, i, d) for i, (_, s) in enumerate(FIXTURE_BLOCKS) for d in s], "entity int, src int, dst int")
    rows = kgrams.graph_kgrams(*kgrams.unit_successors(blocks, edges), 5).collect()
    assert {"".join(r.kgram): r.n for r in rows} == dict(EXPECTED)


def test_control_flow_fixture_in_a_worker():
    blocks = [u.split() for u, _ in FIXTURE_BLOCKS]
    assert Counter("".join(p) for p in paths(blocks, {i: list(s) for i, (_, s) in enumerate(FIXTURE_BLOCKS)}, 5)) == EXPECTED


@pytest.mark.parametrize("k", [1, 2, 5, 10])
def test_windows_of_short_and_long_arrays(spark, k):
    df = spark.createDataFrame([(list("abcdefgh"[:n]),) for n in range(9)], "u array<string>")
    for r in df.select("u", kgrams.windows_of(F.col("u"), k).alias("w")).collect():
        assert r.w == [r.u[i : i + k] for i in range(len(r.u) - k + 1)]


def test_ordered_kgrams(spark):
    df = spark.createDataFrame([(1, i, u) for i, u in enumerate("abcd")] + [(2, 0, "x")], "k int, i int, u string")
    assert {(r.k, "".join(r.kgram)) for r in kgrams.ordered_kgrams(df, "k", ["i"], "u", 3).collect()} == {(1, "abc"), (1, "bcd")}


def test_unique_kgrams_blacklist_changing_references(spark):
    df = spark.createDataFrame([(1, ["a", "call"], "T"), (1, ["a", "call"], "T"), (1, ["b", "call"], "T"), (1, ["b", "call"], "U"), (1, ["a", "b"], "T")], "m int, g array<string>, refs string")
    got = kgrams.unique_kgrams(df, "m", "g", "refs", lambda u: u == "call").collect()
    assert [r.g for r in got] == [["a", "call"]]


def test_hashes(spark):
    words = ["hello", "", "Ünï", None, "the quick brown fox"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", hashing.text_hash(F.col("w")).alias("h"))
    for r in df.collect():
        assert r.h == (None if r.w is None else _hash(r.w))
    assert _hash("hello") == 99162322
    (r,) = spark.range(1).select(hashing.sequence_hash(F.array(F.lit(5).cast("long"), F.lit(7).cast("long"))).alias("h"), hashing.content_hash(F.lit("abc")).alias("c")).collect()
    assert r.h == (31 + 5) * 31 + 7 and r.c.startswith("BA7816BF")
