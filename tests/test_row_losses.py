"""Rows that must not get lost: one test per case."""

import json
from collections import Counter

from sigweave.operators import catalogue, detection, kgrams, rollup, selection
from sigweave.sources import results, signatures
from sigweave.sources.storage import materialise, release
from sigweave.streaming import ingest


def test_results_of_another_application_are_added(spark, tmp_path):
    rows = lambda app, m: spark.createDataFrame([(app, "lib", m)], "app string, library string, match double")
    path = str(tmp_path / "out")
    results.write_json(rows("a b/c", 0.9), path)
    results.write_json(rows("two", 0.5).unionByName(rows("a b/c", 0.1)), path)
    assert {(r.app, r.match) for r in spark.read.json(path).collect()} == {("a b/c", 0.9), ("two", 0.5)}
    results.write_json(rows("two", 0.7), path, force=True)
    assert {(r.app, r.match) for r in spark.read.json(path).collect()} == {("a b/c", 0.9), ("two", 0.7)}


def test_index_of_another_library_stays(spark, tmp_path):
    rows = lambda lib, v: spark.createDataFrame([(lib, "AB", [v])], "library string, digest string, versions array<string>")
    path = str(tmp_path / "index")
    for lib, v in (("x", "1"), ("y", "1"), ("x", "2")):
        results.write_index(rows(lib, v), path)
    assert {(r.library, r.value) for r in spark.read.text(path).collect()} == {("x", '{"AB":["2"]}'), ("y", '{"AB":["1"]}')}


def test_arriving_words_are_those_of_the_batch_query(spark, tmp_path):
    spark.createDataFrame([(1, " a b c "), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = ingest.arriving_kgrams(ingest.arriving(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), "doc_id", "text", 3)
    ingest.append_to(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r.kgram for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a b c"]


def test_null_units_end_no_sequence(spark):
    df = spark.createDataFrame([(1, i, u) for i, u in enumerate(["a", None, "c", "d", None])], "k int, i int, u string")
    assert sorted(str(r.kgram) for r in kgrams.ordered_kgrams(df, "k", ["i"], "u", 2).collect()) == sorted(map(str, [["a", None], [None, "c"], ["c", "d"], ["d", None]]))


def test_walks_go_through_empty_blocks(spark):
    blocks, succs = [["a"], [], ["b"], [], ["c", "d"]], {0: [1, 2], 1: [2, 3], 3: [3, 4, 1], 2: [4]}
    want = Counter("".join(p) for p in detection.paths(blocks, succs, 3))
    assert want == Counter({"abc": 2, "bcd": 1, "acd": 1})
    b = spark.createDataFrame([(0, i, u) for i, u in enumerate(blocks)], "entity int, block int, units array<string>")
    e = spark.createDataFrame([(0, i, d) for i, s in succs.items() for d in s], "entity int, src int, dst int")
    assert {"".join(r.kgram): r.n for r in kgrams.graph_kgrams(*kgrams.unit_successors(b, e), 3).collect()} == dict(want)


def test_windows_with_one_score_or_none(spark):
    df = spark.createDataFrame([("x", 0.9, 1), ("x", 0.89, 2), ("x", 0.8, 3), ("y", 0.9, 4), ("y", 0.8, 5), ("z", 0.9, 6)], "g string, score double, i int")
    assert sorted(r.i for r in selection.scan_window(df, within=["g"]).collect()) == [1, 2, 4, 6]
    assert [r.i for r in selection.scan_window(df.where("g = 'x'")).collect()] == [1, 2]
    assert selection.scan_window(df.limit(0)).count() == 0


def test_representatives_in_lexicographic_order(spark):
    df = spark.createDataFrame([("l", "9", "d"), ("l", "10", "d"), ("l", "2", "e")], "library string, version string, digest string")
    assert sorted(r.version for r in catalogue.representatives(df, "library", "version", "digest").collect()) == ["10", "2"]


def test_collapsed_report(spark):
    rows = spark.createDataFrame([("a.b.c.X", 3), ("a.b.c.d.Y", 1), ("z.Z", 4)], "name string, w long")
    shares = rollup.own_share(rollup.rollup(rows, "name", "w"))
    got = [r.line for r in rollup.rendered(shares, collapse=True).orderBy("prefix").collect()]
    assert got == ["<default package> 0.00000% (100.00000%)", "  a.b.c 37.50000% (50.00000%)", "    a.b.c.d 12.50000%", "  z 50.00000%"]


def test_constructors_vote_not_for_their_own_class():
    """The guard is on the application's side: its constructor gives no vote for the class that it builds."""
    def cls(name, ctor, other):
        block = [signatures.unit(u) for u in (["x", [ctor]], "y", "z", "u", "v", "w")]
        return detection.load_class({"name": name, "interfaces": [], "methods": [{"name": "<init>", "idx": 0, "blocks": [block], "blockSuccs": {}}]}, 5)

    found = detection.scan([cls("L", "L", 0)], [cls("A", "A", 0)], detection.Settings(), 0.1)
    assert [c[:2] for c in found["classes"]] == [("L", "A")]  # kept by the equality at first, not by a vote


def test_released_tables_are_gone(spark):
    t = materialise(spark.range(5).selectExpr("id"))
    assert t.count() == 5
    release(t, None, spark.range(1))
    assert json.dumps(t.inputFiles()) and not __import__("os").path.exists(t._written_to.removeprefix("file:"))
