import numpy as np
import pyarrow as pa
import pytest

from sigweave.llm import slices as sl


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_keys_and_numbers_survive_packing(n):
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    assert (sl.unpress_keys(sl.press_keys(keys)) == keys).all()
    for kind in ("<u4", "<i8", np.uint8, bool):
        x = rng.integers(0, 2, n).astype(kind)
        assert (sl.unpress(sl.press(x), kind) == x).all()


def test_bucket_edges_split_sorted_keys():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64))
    edges = sl.bucket_edges(keys, 7)
    assert [b for b, *_ in edges] == sorted({b for b, *_ in edges}) and edges[0][1] == 0 and edges[-1][2] == 500
    assert all(x[2] == y[1] for x, y in zip(edges, edges[1:], strict=False))
    assert sl.bucket_edges(keys[:0], 7) == []


def test_slices_hold_every_row_once(spark):
    rows = [(i if i % 9 else None, None if i % 5 == 0 else "x" * (i % 50), {"a": i}) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, text string, m map<string,int>").repartition(3)
    kept = sl.sliced(df, "text", 2000, lambda b: np.asarray([(i or 0) % 4 == 1 for i in b.column("id").to_pylist()]))
    got = kept.collect()
    assert len({r.slice for r in got}) == len(got) > 8
    back = [tuple(x.values()) for r in got for x in pa.Table.from_batches([sl.rows_of(r.data)]).to_pylist()]
    assert sorted(map(str, back)) == sorted(str((i, t, list(m.items()))) for i, t, m in rows)
    assert all(((x["id"] or 0) % 4 == 1) == r.apart for r in got for x in sl.rows_of(r.data).to_pylist())
    assert sl.sliced(df.limit(0), "text", 2000).count() == 0
