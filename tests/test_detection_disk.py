import numpy as np
import pytest

from sigweave.operators import detection
from sigweave.operators.sketches import ARTIFACT_PRIME
from sigweave.plans import bindings
from sigweave.sources.storage import materialise

SCHEMA = "artifact string, cls long, text string"


def corpus(seed=5):
    """Items, and texts with copies of their lines among words of their own: odd white space and characters, short lines, nulls."""
    rng = np.random.default_rng(seed)
    line = lambda n, p: " ".join(f"{p}{x}" for x in rng.integers(0, 4000, n))
    items = [("1", 1, "\n".join(line(30, "wörd") for _ in range(3))), ("2", 2, line(40, "𝕏")), ("3", 3, line(25, "z") + "\n" + line(3, "z"))]
    lines = [x for _, _, t in items for x in t.split("\n")]
    texts = []
    for i in range(60):
        own = [line(int(rng.integers(0, 300)), "own") for _ in range(4)]
        if i % 3 == 0:
            own[1] = lines[i // 3 % len(lines)].replace(" ", ["\t", "\x85", "  ", "\r", "　"][i % 5])
        texts.append((f"app{i % 2}" if i % 21 else None, i, "\n".join(own)))
    return items, [*texts, ("app0", 90, None), ("app0", 91, ""), ("app1", 92, " \n a b")]


@pytest.fixture(autouse=True)
def few_tasks(spark):
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", n)


@pytest.fixture()
def kept():
    """A keep() that writes, with what it wrote: (columns, rows) each time."""
    seen = []

    def keep(df):
        out = materialise(df)
        seen.append((out.columns, out.select([c for c in out.columns if c in ("artifact", "cls", "body")]).collect()))
        return out

    keep.seen = seen
    return keep


def test_rounds_do_not_write_applications_again(spark, kept):
    items, texts = corpus()
    # the same item several times: a round each
    texts = [("app", i, items[1][2]) for i in range(2)] + [(a and "app", i + 10, t) for a, i, t in texts]
    libs, apps = (bindings.text_records(spark.createDataFrame(x, SCHEMA), "artifact", "cls") for x in (items, texts))
    found = detection.detect(libs, apps, keep=kept).where("accepted").collect()
    assert max(r["round"] for r in found) >= 2
    bodies = [rows for columns, rows in kept.seen if "body" in columns]
    assert len(bodies) == 2  # the libraries and the applications


def test_lines_detect_as_records_do_and_only_those_that_share_a_hash_are_written(spark, kept):
    items, texts = corpus()
    libs, docs = spark.createDataFrame(items, SCHEMA), spark.createDataFrame(texts, SCHEMA).repartition(3)
    records = [bindings.text_records(x, "artifact", "cls") for x in (libs, docs)]
    plain = lambda df: sorted((r.app, r.library, r.match, r.cover, r.accepted, r["round"], sorted(r.classes)) for r in df.collect())
    want = plain(detection.detect(*records, keep=materialise))
    got = plain(detection.detect(*records, keep=kept, lines=docs))
    assert got == want and {r[0] for r in got} == {"app0", "app1", "None"}
    (written,) = [rows for columns, rows in kept.seen if "bits" in columns]
    wanted = {r.h for r in detection.class_hashes(records[0], 5).collect()}
    share = {(r.artifact, r.cls) for r in detection.class_hashes(records[1], 5).collect() if r.h in wanted}
    assert {(r.artifact, r.cls) for r in written if r.body is not None} == share


@pytest.mark.parametrize("held", [1 << 22, 500])
def test_sketches_of_lines_count_every_bit(spark, monkeypatch, held):
    items, texts = corpus()
    monkeypatch.setattr(detection, "HELD", held)
    libs, docs = spark.createDataFrame(items, SCHEMA), spark.createDataFrame(texts, SCHEMA).repartition(2)
    lib, app = (detection.class_hashes(bindings.text_records(x, "artifact", "cls"), 5).collect() for x in (libs, docs))
    wanted = {r.h for r in lib}
    rows = materialise(detection.opened_lines(docs, 5, np.array(sorted(wanted))))
    share = {(r.artifact, r.cls) for r in app if r.h in wanted}
    placed = spark.createDataFrame([(r.artifact, r.cls, r.h % ARTIFACT_PRIME) for r in app if (r.artifact, r.cls) in share], "app string, cls string, bit int").distinct()
    got = detection.sketched(placed, rows.where("bits IS NOT NULL")).collect()
    stays = {a: {r.h % ARTIFACT_PRIME for r in app if r.artifact == a and (a, r.cls) not in share} for a in ("app0", "app1", "None")}
    assert {a: sum(r.n for r in got if r.app == a and r.cls is None) for a in stays} == {a: len(b) for a, b in stays.items()}
    assert {(r.app, r.cls, r.bit) for r in got if r.cls} == {(r.app, r.cls, r.bit) for r in placed.collect() if r.bit not in stays[r.app]}


def test_bits_are_packed_without_loss():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1024, 1025, 90_000):
        places = np.sort(rng.choice(1 << detection.RANGE, n, replace=False))
        assert np.array_equal(np.flatnonzero(detection.unpacked_bits([detection.packed_bits(places)])), places)
