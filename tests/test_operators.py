import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigweave.functions import normalise
from sigweave.functions.formula import compile_formula
from sigweave.operators import assignment, catalogue, rollup, selection, sequences, similarity, sketches, votes


@pytest.mark.parametrize("seed", range(30))
def test_assignment_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 6, 2)
    sim = np.where(rng.random((n, m)) < 0.4, 0, rng.random((n, m)).round(2))
    pairs = assignment.solve(sim)
    assert len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs}) and all(sim[p] > 0 for p in pairs)
    best = 0.0
    for choice in itertools.product(range(-1, m), repeat=int(n)):
        used = [j for j in choice if j >= 0]
        if len(set(used)) == len(used) and all(sim[i, j] > 0 for i, j in enumerate(choice) if j >= 0):
            best = max(best, sum(1 + sim[i, j] for i, j in enumerate(choice) if j >= 0))
    assert sum(1 + sim[p] for p in pairs) == pytest.approx(best)


def test_assignment_of_groups_and_bad_input(spark):
    df = spark.createDataFrame([("g", "a", "x", 0.9), ("g", "a", "y", 0.8), ("g", "b", "x", 0.7), ("h", "c", "z", 0.0)], "g string, l string, r string, sim double")
    assert {(r.l, r.r) for r in assignment.assign(df, "g", "l", "r").collect()} == {("a", "y"), ("b", "x")}
    with pytest.raises(ValueError):
        assignment.solve(np.array([[1.5]]))
    assert assignment.solve(np.zeros((0, 3))) == [] and assignment.solve(np.zeros((2, 2))) == []


def test_dice_and_empty_sets(spark):
    left = spark.createDataFrame([("l", 1), ("l", 2), ("l", 2), ("m", 3)], "l string, h int")
    right = spark.createDataFrame([("a", 2), ("a", 3), ("a", 4)], "a string, h int")
    pairs = similarity.dice_join(left, right, "l", "a")
    got = {(r.l, r.a): r.dice for r in pairs.collect()}
    assert got == {("l", "a"): pytest.approx(0.4), ("m", "a"): 0.5}
    candidates = spark.createDataFrame([("l", "a"), ("e", "f"), ("e", "a")], "l string, a string")
    sizes = [spark.createDataFrame([(k, n)], f"{c} string, n int") for c, k, n in (("l", "l", 2), ("a", "a", 3))]
    assert {(r.l, r.a): r.dice for r in similarity.with_empty(pairs, candidates, *sizes, "l", "a").collect()} == {("l", "a"): pytest.approx(0.4), ("e", "f"): 1.0, ("e", "a"): 0.0}


def test_votes(spark):
    df = spark.createDataFrame([("x", "p", 2.0, 4.0), ("x", "q", 1.0, 4.0), ("z", "p", 0.0, 0.0)], "k string, v string, score double, weight double")
    got = {(r.k, r.v): r.vote for r in votes.normalised(df).collect()}
    assert got == {("x", "p"): 0.25, ("x", "q"): 0.125, ("z", "p"): 0.0}
    assert {(r.k, r.v) for r in votes.best(votes.normalised(df)).collect()} == {("x", "p"), ("z", "p")}


@pytest.mark.parametrize("scores,want", [([0.9, 0.89, 0.8], [0.9, 0.89]), ([0.9, 0.8], [0.9]), ([0.9], [0.9]), ([0.02], [0.02]), ([0.5, 0.5, 0.48], [0.5, 0.5, 0.48])])
def test_scan_window(spark, scores, want):
    if scores == [0.5, 0.5, 0.48]:
        want = [0.5, 0.5, 0.48]  # 0.48 is over 0.5 - 0.03
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "lib int, score double")
    assert sorted((r.score for r in selection.scan_window(df).collect()), reverse=True) == want
    grouped = df.withColumn("g", F.lit(1))
    assert sorted((r.score for r in selection.scan_window(grouped, within=["g"]).collect()), reverse=True) == want


def test_conflicts_count_rejected_results_too(spark):
    results = spark.createDataFrame([("a", 0.9, 0.5), ("b", 0.8, 0.5), ("c", 0.7, 0.5), ("d", 0.7, 0.4)], "result string, match double, cover double")
    members = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 2), ("d", 3)], "result string, member int")
    assert {r.result: r.accepted for r in selection.resolve(results, members).collect()} == {"a": True, "b": False, "c": False, "d": True}


def test_thresholds_and_formulas(spark):
    (r,) = spark.range(1).select(selection.sketch_threshold(F.lit(100), F.lit(0.05)).alias("a"), selection.detection_threshold(F.lit(10)).alias("b"), compile_formula("2^3 + min(1, size) / 0", {"size": F.lit(4)}).alias("c"), compile_formula("-max(1, 2, size)", {"size": F.lit(4)}).alias("d")).collect()
    assert (r.a, r.b, r.c, r.d) == (pytest.approx(0.5), pytest.approx(0.55), None, -4.0)
    for bad in ("size.real", "__import__('os')", "other + 1", "1 +", "'a'", "min(1)", "True"):
        with pytest.raises(ValueError):
            compile_formula(bad, {"size": F.lit(1)})


def test_rollup_and_shares(spark):
    df = spark.createDataFrame([("a.b.C", 3), ("a.b.D", 1), ("a.E", 2), ("F", 4)], "name string, w int")
    nodes = rollup.rollup(df, "name", "w")
    assert {r.prefix: r.weight for r in nodes.collect()} == {"": 10, "a": 6, "a.b": 4}
    shares = {r.prefix: (r.own, r.children, r.own_share, r.total_share) for r in rollup.own_share(nodes).collect()}
    assert shares == {"": (4, 1, 0.4, 1.0), "a": (2, 1, 0.2, 0.6), "a.b": (4, 0, 0.4, 0.4)}
    assert {r.line for r in rollup.rendered(rollup.own_share(nodes)).collect()} == {"<default package> 40.00000% (100.00000%)", "  a 20.00000% (60.00000%)", "    a.b 40.00000%"}
    chain = rollup.own_share(rollup.rollup(spark.createDataFrame([("x.y.z.C", 1)], "name string, w int"), "name", "w"))
    assert {r.prefix for r in rollup.collapsed(chain).collect()} == {"", "x.y.z"}


def test_sketches(spark):
    rows = spark.createDataFrame([("n", "1", 5), ("n", "2", 5), ("n", "1", 6), ("m", "1", 5 + 127)], "name string, version string, h int")
    bits = rows.withColumn("bit", sketches.bit(F.col("h"), 127))
    assert {(r.name, r.bit) for r in sketches.common_bits(bits, "name", "version").collect()} == {("n", 5), ("m", 5)}
    assert {(r.freq, r.bits) for r in sketches.bit_frequency(bits, "name").collect()} == {(1, 2), (2, 1)}
    sizes = spark.createDataFrame([(n,) for n in (0, 13, 14, 37, 105, 299, 300)], "n int").select(sketches.prime_index(F.col("n")).alias("i")).collect()
    assert [r.i for r in sizes] == [0, 0, 1, 1, 2, 3, 4]


def test_catalogue_sorts_versions_as_text(spark):
    df = spark.createDataFrame([("l", "9", "d"), ("l", "10", "d"), ("l", "11", "e")], "library string, version string, digest string")
    got = {r.digest: (r.representative, r.label) for r in catalogue.content_index(df, "library", "version", "digest").collect()}
    assert got == {"d": ("10", "10, 9"), "e": ("11", "11")}
    assert {r.version for r in catalogue.representatives(df, "library", "version", "digest").collect()} == {"10", "11"}


def test_lcs(spark):
    assert [sequences.lcs(a, b) for a, b in (("ABCBDAB", "BDCABA"), ("", "A"), ("AAA", "AA"))] == [4, 0, 2]
    df = spark.createDataFrame([(list("abc"), list("ac")), ([], []), (None, ["a"])], "a array<string>, b array<string>")
    assert [r.s for r in df.select(sequences.lcs_similarity(F.col("a"), F.col("b")).alias("s")).collect()][:2] == [pytest.approx(0.8), 1.0]


def test_normalisation(spark):
    row = spark.createDataFrame([("com.app.A", ["int"], "run")], "c string, p array<string>, m string")
    (r,) = row.select(
        normalise.type_name(F.col("c"), F.lit(False)).alias("t"), normalise.method_signature(F.lit("java.io.File"), F.lit("void"), F.col("m"), F.col("p"), F.lit(True)).alias("s"), normalise.full_name(F.col("m"), F.col("p")).alias("f"),
        normalise.is_constructor(F.lit("<init>")).alias("i"), normalise.percent(F.lit(0.123456)).alias("q"), normalise.mask_identifiers(F.lit("a.b@c.de 12x3")).alias("x"),
        normalise.unit_text(F.lit("lookupswitch"), F.lit("v"), F.lit(None).cast("string"), F.array(F.lit("1"), F.lit("2"))).alias("u"), normalise.recorded_reference(F.col("c"), F.lit(False), F.lit(False), F.lit(True)).alias("r"),
    ).collect()
    assert tuple(r) == ("#", "<java.io.File: void run(int)>", "run(int)", True, "12.34560%", "# #x#", "lookupswitch (v) {1, 2}", [None])
    with pytest.raises(Exception, match="share"):
        row.select(normalise.percent(F.lit(1.5))).collect()


def test_raw_weights_and_what_stays_unmatched(spark):
    df = spark.createDataFrame([("g", "a", "x", -1.0), ("g", "a", "y", 5.0), ("g", "b", "y", 6.0), ("g", "b", "x", 4.5)], "g string, l string, r string, sim double")
    best = assignment.assign(df, "g", "l", "r", raw=True)
    assert {(r.l, r.r, r.sim) for r in best.collect()} == {("a", "y", 5.0), ("b", "x", 4.5)}
    nodes = spark.createDataFrame([("g", x) for x in "abc"], "g string, l string")
    assert [r.l for r in assignment.unmatched(nodes, best, ["g", "l"]).collect()] == ["c"]
    assert sorted(r.l for r in assignment.matched(nodes, best, ["g", "l"]).collect()) == ["a", "b"]


def test_common_subsequences():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = ([str(x) for x in rng.integers(0, 4, int(rng.integers(0, 12)))] for _ in range(2))
        got = sequences.common(a, b)
        assert len(got) == sequences.lcs(a, b)
        for own in (a, b):
            rest = iter(own)
            assert all(x in rest for x in got)


def test_progress_counts(spark):
    df = spark.createDataFrame([(1, True), (1, False), (2, True), (4, False)], "round int, accepted boolean")
    assert [tuple(r) for r in selection.progress(df).orderBy("round").collect()] == [(1, 2, 1), (2, 3, 2), (4, 4, 2)]
