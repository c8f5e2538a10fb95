import duckdb
import pytest

from sigweave.llm import mixing

ROWS = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "d  e\tf\x0bg", None), (5, " h ", "é"), (5, " h ", "é"), (None, "i j", "z"), (7, "k " * 5000, "Z"), (8, "l", "Z")]


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    """Reshares what is over a cap until no source is above its own."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while True:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total >= repeats * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = repeats * sizes[s]
            left -= out[s]
        open_ -= over
        if not open_:
            return out


def check(rows):
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    for r in rows:
        assert r.source_size == sizes[r.source]
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], abs=1e-6)
        assert abs(taken[s] - want[s]) <= 2


def test_small_table(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").selectExpr("*", "1 AS taken", "2 AS __size")
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    assert {r.doc_id: r.size for r in rows} == {1: 3, 2: 0, 3: 0, 4: 4, 5: 1, None: 2, 7: 5000, 8: 1}
    check(rows)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_whole_table_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(mixing.mix(docs).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {r[0]: r for r in con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL})").fetchall()}
    for r in mixing.query(spark, sf).collect():
        assert tuple(r) == pytest.approx(want[r.doc_id])


def test_mixed_documents_hold_what_the_mix_takes(spark):
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, source string, n_chars long")
    want = {}
    for r in mixing.mix(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    got = dict.fromkeys(want, 0)
    for r in mixing.mixed_documents(docs).collect():
        got[r.doc_id] += len((r.text or "").split())
        assert r.n_chars == len(r.text or "")
    assert got == want
