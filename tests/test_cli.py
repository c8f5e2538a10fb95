import json
import shutil
import zipfile

import pytest
from test_detection_and_sources import library, method

from sigweave.__main__ import main, parser
from sigweave.sources import cache, recipes, signatures


def test_commands_end_to_end(spark, tmp_path, capsys):
    src, apps, libs = tmp_path / "src", tmp_path / "apps", str(tmp_path / "libs")
    for version in ("1.0", "1.1"):
        (src / "lib").mkdir(parents=True, exist_ok=True)
        (src / "lib" / f"{version}.json.zlib").write_bytes(signatures.encode(library("lib.")))
    (src / "lib" / "empty.json.zlib").write_bytes(signatures.encode([{"name": "e", "interfaces": [], "methods": [method(0, "f", [["x"]])]}]))
    (apps / "demo").mkdir(parents=True)
    (apps / "demo" / "app.json.zlib").write_bytes(signatures.encode(library("lib.")))
    assert main(["process", "-libs", libs, "-src", str(src)], spark) == 0
    assert {r.artifact for r in spark.read.parquet(f"{libs}/records").collect()} == {"lib/1.0"}
    index = spark.read.text(f"{libs}/index").first()
    assert '["1.0","1.1"]' in index.value
    main(["analyze", "-libs", libs, "-apk", str(apps), "-v", "7", "-out", str(tmp_path / "out"), "-bench"], spark)
    said = capsys.readouterr().out
    assert "demo/app: lib/1.0 match 100.00000%, coverage 100.00000%" in said and "<default package>" in said and "demo/app: lib/1.0\n" in said and "demo/app lib/1.0 lib.A" in said and "Duration" in said
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    main(["stats", "-libs", libs], spark)
    assert capsys.readouterr().out.startswith("1\t")


@pytest.mark.parametrize("bad", [["-mth", "1.5"], ["-k", "11"], ["-dtth", "size + other"], ["-bsth", "1 +"], ["-v", "8"]])
def test_options_are_checked(bad):
    with pytest.raises(SystemExit):
        parser().parse_args(["analyze", "-libs", "l", "-apk", "a", *bad])


@pytest.mark.parametrize("bad", [[], ["-m", "JAR"], ["-m", "JAR", "-ld", "x", "-p", "y", "-vcg", "1"], ["-m", "AAR", "-ld", "x", "-p", "y", "-vcg", "3", "-n", "a"], ["-m", "SOURCE", "-src", "x"]])
def test_process_wants_what_its_mode_needs(bad):
    with pytest.raises(SystemExit):
        main(["process", "-libs", "l", *bad])


def archive(path, entry, content):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(zipfile.ZipInfo(entry), content)


def test_archives_are_read_once_and_again_after_a_loss(spark, tmp_path):
    """Deleting what was read and reading again gives as many."""
    for folder in ("jar", "aar"):
        (tmp_path / folder).mkdir()
    for v in ("1.0", "1.1", "2.0"):
        archive(tmp_path / "jar" / f"one-{v}.jar", "a/B.class", b"same" if v != "2.0" else b"other")
        archive(tmp_path / "aar" / f"two-{v}.aar", "classes.jar", b"jar" + v.encode())
    archive(tmp_path / "aar" / "none-1.0.aar", "readme", b"x")
    libs = str(tmp_path / "libs")
    rows = lambda: sorted((r.library, r.version) for r in spark.read.parquet(f"{libs}/archives").collect())
    main(["process", "-libs", libs, "-m", "JAR", "-ld", str(tmp_path / "jar"), "-p", r".*/one-([0-9.]+)\.jar", "-vcg", "1", "-n", "one"], spark)
    assert rows() == [("one", "1.0"), ("one", "2.0")]
    main(["process", "-libs", libs, "-m", "AAR", "-ld", str(tmp_path / "aar"), "-p", r".*/([a-z]+)-([0-9.]+)\.aar", "-vcg", "2", "-ncg", "1"], spark)
    everything = [("one", "1.0"), ("one", "2.0"), ("two", "1.0"), ("two", "1.1"), ("two", "2.0")]
    assert rows() == everything
    main(["processAll", "-libs", libs, "-root", str(tmp_path)], spark)
    assert rows() == everything  # all known by content
    index = {r.library: json.loads(r.value) for r in spark.read.text(f"{libs}/archive_index").collect()}
    assert sorted(map(sorted, index["one"].values())) == [["1.0", "1.1"], ["2.0"]] and len(index["two"]) == 3
    shutil.rmtree(f"{libs}/archives")
    spark.catalog.clearCache()
    main(["processAll", "-libs", libs, "-root", str(tmp_path), "-x", "two 2.*"], spark)
    assert rows() == everything[:-1]


def test_opened_libraries_are_kept_for_each_k_and_content(spark, tmp_path):
    made = []

    def build(df, k):
        made.append(k)
        return df.selectExpr("artifact", f"{k} AS k")

    one, two = (spark.createDataFrame([("a", "c", r)], "artifact string, cls string, record string") for r in ("x", "y"))
    for df, k in ((one, 5), (one, 5), (one, 4), (two, 5), (one.unionByName(one), 5), (one, 4)):
        assert cache.cached(df, str(tmp_path / "kept"), k, build).first().k == k
    assert made == [5, 4, 5, 5]


def test_only_representatives_of_a_catalogue_are_read(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    for v in ("10", "9", "8"):
        (tmp_path / "lib" / f"{v}.json.zlib").write_bytes(signatures.encode([{"name": f"C{v}", "interfaces": [], "methods": []}]))
    (tmp_path / "lib" / "index.json").write_text(json.dumps({"AA": ["9", "10"]}))
    assert [(r.artifact, r.cls) for r in signatures.read_representatives(spark, str(tmp_path)).collect()] == [("lib 10, 9", "C10")]


def test_recipes(spark, tmp_path):
    (tmp_path / "x-1.2.jar").write_bytes(b"jar")
    (tmp_path / "r.json").write_text('[{"library": "x", "path": "%s", "mode": "jar", "pattern": ".*/x-([0-9.]+)\\\\.jar"}]' % tmp_path)
    assert [(r.name, r.version) for r in recipes.artifacts(spark, recipes.load(str(tmp_path / "r.json"))).collect()] == [("x", "1.2")]
