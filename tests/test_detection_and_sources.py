import io
import json
import zipfile

import pytest

from sigweave.operators import detection
from sigweave.operators.detection import Settings, load_class, scan
from sigweave.sources import archives, results, signatures


def method(idx, name, blocks, succs=None):
    return {"name": name, "idx": idx, "fixTypes": [], "blocks": [[signatures.unit(u) for u in b] for b in blocks], "blockSuccs": succs or {}, "refs": []}


def library(prefix, rename=lambda n: n):
    """Two classes whose names can be changed everywhere."""
    a, b, i = (rename(prefix + n) for n in ("A", "B", "I"))
    body = [f"op{j}" for j in range(12)]
    return [
        {"name": a, "super": "android.app.Activity", "superType": b, "interfaces": [i], "methods": [method(0, "<init>", [["x0", "x1", "x2", "x3", "x4", "x5"]]), method(1, rename("run"), [[*body, ["call", [b], b, 0], "r1", "r2", "r3", "r4"], ["e1", "e2"]], {"0": [1]})]},
        {"name": b, "interfaces": [], "methods": [method(0, rename("go"), [["y0", ["use", [a, None]], "y1", "y2", "y3", "y4", "y5"]]), method(1, "tiny", [["z"]])]},
    ]


def records(spark, artifact, classes):
    return [(artifact, c["name"], json.dumps(c)) for c in classes]


SCHEMA = "artifact string, cls string, record string"


def test_scan_of_itself_is_perfect():
    own = [load_class(c, 5) for c in library("lib.")]
    found = scan(own, own, Settings(), 0.1)
    assert found["match"] == pytest.approx(1) and found["cover"] == pytest.approx(1)
    assert {(x, y) for x, y, _ in found["classes"]} == {("lib.A", "lib.A"), ("lib.B", "lib.B")}


def test_detection_does_not_depend_on_names(spark):
    other = [{"name": f"app.X{i}", "interfaces": [], "methods": [method(0, "f", [[f"q{i}{j}" for j in range(9)]])]} for i in range(4)]
    renamed = library("lib.", lambda n: n if n.startswith("<") else "o" + str(sum(map(ord, n))))
    libs = spark.createDataFrame(records(spark, "lib 1", library("lib.")) + records(spark, "absent 1", [{"name": "z.Z", "interfaces": [], "methods": [method(0, "f", [[f"n{j}" for j in range(20)]])]}]), SCHEMA)
    for classes in (library("lib."), renamed):
        apps = spark.createDataFrame(records(spark, "app", classes + other), SCHEMA)
        (r,) = [r for r in detection.detect(libs, apps, keep=lambda df: df.persist()).collect() if r.accepted]
        assert (r.app, r.library) == ("app", "lib 1") and r.match == pytest.approx(1) and r.cover == pytest.approx(1)
        assert sorted(r.classes) == sorted(c["name"] for c in classes)
    none = spark.createDataFrame(records(spark, "app", other), SCHEMA)
    assert detection.detect(libs, none).count() == 0


def test_signatures_survive_a_round_trip(spark, tmp_path):
    classes = library("lib.") + [{"name": "abs", "interfaces": [], "methods": [method(0, "a", [])]}, {"name": "u", "interfaces": [], "methods": [method(0, "m", [["s", ["t", ["R"]], ["v", ["R", None], None], ["w", ["R"], "C", 3]]])]}]
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "1.0.json.zlib").write_bytes(signatures.encode(classes))
    got = signatures.read(spark, str(tmp_path))
    assert {r.artifact for r in got.collect()} == {"lib/1.0"}
    assert sorted((json.loads(r.record) for r in got.collect()), key=lambda c: c["name"]) == sorted(signatures.decode(signatures.encode(classes)), key=lambda c: c["name"])
    (content,) = [r.content for r in signatures.encoded(got).collect()]
    assert sorted(signatures.decode(bytes(content)), key=lambda c: c["name"]) == sorted(signatures.decode(signatures.encode(classes)), key=lambda c: c["name"])
    rows = signatures.units(got).where("cls = 'u'").orderBy("pos").collect()
    assert [(r.instr, r.ref_types, r.has_inv, r.ref_cls, r.ref_idx) for r in rows] == [("s", [], False, None, None), ("t", ["R"], False, None, None), ("v", ["R", None], True, None, None), ("w", ["R"], True, "C", 3)]
    with pytest.raises(ValueError):
        signatures.unit(["a", [], "c", 1, 2])


def test_catalogue_of_index_files(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "index.json").write_text(json.dumps({"AB": ["18.0.0", "13.0.0"], "CD": ["9"]}))
    got = {r.digest: (r.library, r.representative, r.name) for r in signatures.catalogue(spark, str(tmp_path)).collect()}
    assert got == {"AB": ("lib", "13.0.0", "lib 13.0.0, 18.0.0"), "CD": ("lib", "9", "lib 9")}


def test_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a/B.class", b"cafe")
        z.writestr("readme", b"x")
    for name, entry in (("one-1.0.aar", "classes.jar"), ("two-2.0.aar", "other")):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr(entry, inner.getvalue())
    (tmp_path / "skip.txt").write_text("x")
    found = archives.listing(spark, str(tmp_path), r".*/(\w+)-([\d.]+)\.aar", name_group=1, version_group=2)
    assert {(r.name, r.version) for r in found.collect()} == {("one", "1.0"), ("two", "2.0")}
    jars = archives.aar_classes(found)
    assert [(r.name, r.entry, bytes(r.content)) for r in archives.jar_entries(jars).collect()] == [("one", "a/B.class", b"cafe")]
    assert archives.excluded(found, "name", "one|x").count() == 1


def test_results_stay_unless_forced(spark, tmp_path):
    rows = lambda m: spark.createDataFrame([("app", "lib", m, 0.5, True, 1)], "app string, library string, match double, cover double, accepted boolean, round int")
    path = str(tmp_path / "out")
    results.write_json(rows(0.9), path)
    results.write_json(rows(0.1), path)
    assert spark.read.json(path).first().match == 0.9
    results.write_json(rows(0.1), path, force=True)
    assert spark.read.json(path).first().match == 0.1
    assert results.report(rows(0.25)).first().line == "app: lib match 25.00000%, coverage 50.00000%"


def test_arriving_texts_become_kgrams_once(spark, tmp_path):
    from sigweave.streaming import ingest

    spark.createDataFrame([(1, "a b c d"), (2, "x")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = ingest.arriving_kgrams(ingest.arriving(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), "doc_id", "text", 3)
    for _ in range(2):
        ingest.append_to(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.kgram for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a b c", "b c d"]
