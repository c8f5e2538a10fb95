import datetime
import json

import numpy as np

from sigweave.operators import detection
from sigweave.plans import bindings
from sigweave.sources import signatures
from sigweave.sources.storage import materialise


def common(a, b):
    """Length of the longest common subsequence, by the whole table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_lcs_length_takes_whole_logs(spark, tmp_path):
    rng = np.random.default_rng(4)
    logs = {u: [f"e{x}" for x in rng.integers(0, 4, n)] for u, n in ((1, 75), (2, 140), (3, 31), (4, 3), (9, 50))}
    start = datetime.datetime(2024, 1, 1)
    rows = [(u * 1000 + i, u, start + datetime.timedelta(seconds=i // 2), e) for u, log in logs.items() for i, e in enumerate(log)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: (r.lcs, r.similarity) for r in bindings.queries()["lcs_length"](spark, str(tmp_path)).collect()}
    want = {u: common(logs[u], logs[u + 1]) for u in (1, 2, 3)}
    assert got == {u: (n, round(2 * n / (len(logs[u]) + len(logs[u + 1])), 6)) for u, n in want.items()}


def lines(spark, rows):
    """Class records of (artifact, class, prefix of its words, number of words)."""
    record = lambda c, p, n: json.dumps({"name": c, "methods": [{"name": "line", "idx": 0, "blocks": [[signatures.unit(f"{p}{i}") for i in range(n)]], "blockSuccs": {}}], "interfaces": []})
    return spark.createDataFrame([(a, c, record(c, p, n)) for a, c, p, n in rows], "artifact string, cls string, record string").coalesce(1)


def detected(spark, libraries, apps, settings):
    """Accepted (library, classes) by round."""
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = detection.detect(lines(spark, libraries), lines(spark, apps), settings, keep=materialise).where("accepted").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    return [(r.library, sorted(r.classes)) for r in sorted(found, key=lambda r: r["round"])]


def bounded():
    """Settings that ask for two rounds at most."""
    s = detection.Settings()
    object.__setattr__(s, "rounds", 2)
    return s


def test_detection_goes_on_until_no_candidate_is_left(spark):
    copies = [("app", f"c{i}", "x", 20) for i in range(3)]
    found = detected(spark, [("a", "x", "x", 20), ("b", "y", "y", 50), ("b", "z", "z", 20)], [*copies, ("app", "other", "y", 50)], bounded())
    assert sorted(c for library, classes in found[:-1] for c in classes if library == "a") == [c for _, c, _, _ in copies]
    assert found[-1] == ("b", ["other"])


def test_scan_goes_on_until_a_matching_repeats(monkeypatch):
    method = {"name": "line", "idx": 0, "blocks": [[signatures.unit(f"x{i}") for i in range(20)]], "blockSuccs": {}}
    classes = [detection.load_class({"name": f"c{i}", "methods": [method], "interfaces": []}, 5) for i in range(150)]
    solve, asked = detection.solve, []

    def other(m):
        """Another matching of the one class each time, up to the last class."""
        if m.shape != (1, 150):
            return solve(m)
        asked.append(m)
        return [(0, min(len(asked), 150) - 1)]

    monkeypatch.setattr(detection, "solve", other)
    found = detection.scan(classes[:1], classes, detection.Settings(), 0.1)
    assert found["classes"] == [("c0", "c149", 1.0)] and len(asked) == 151


def test_straight_methods_are_hashed_without_walks(monkeypatch):
    rng = np.random.default_rng(9)
    for k in (1, 3, 5):
        blocks = [[signatures.unit(f"wörd{x}") for x in rng.integers(0, 9, n)] for n in (0, 4, 5, 60)]
        method = {"name": "m", "idx": 0, "blocks": blocks, "blockSuccs": {}}
        want = set()
        for g in detection.paths(blocks, {}, k):
            h = 1
            for u in g:
                h = (h * 31 + detection._hash(u[0])) % 2**32
            want.add(h)
        with monkeypatch.context() as m:
            m.setattr(detection, "paths", None)
            own = detection.load_class({"name": "c", "methods": [method]}, k)
        assert own.hashes == want and own.weight == 69 and own.methods[0].typed == own.methods[0].calls == {}
