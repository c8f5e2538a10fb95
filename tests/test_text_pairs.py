import numpy as np
import pytest

from sigweave.operators import text_pairs
from sigweave.plans import bindings


def grams(text, k=5):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def texts(seed=3):
    rng = np.random.default_rng(seed)
    common = " ".join(f"c{i}" for i in range(15))  # a line that most texts have
    base = [[f"w{x}" for x in rng.integers(0, 500, int(rng.integers(5, 60)))] for _ in range(25)]
    out = []
    for i in range(70):
        own = list(base[i % 25])
        if i % 3 == 0:
            own[int(rng.integers(0, len(own)))] = f"x{i}"
        out.append(" ".join(own) + (f"\n{common}" if i % 4 else ""))
    return [*out, None, "", "too short"]


def table(spark, tmp_path, rows):
    spark.createDataFrame([(*r, len(r[3] or "")) for r in rows], "doc_id long, source string, lang string, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_packed_numbers_come_back():
    a, b = np.array([0, -1, 2**62, -(2**63)]), np.arange(4)
    assert (text_pairs.unpack(text_pairs.pack(a, b), 2) == [a, b]).all()


@pytest.mark.parametrize("tile", [3, 1024])
def test_dice_of_documents_sends_no_row_per_gram(spark, tmp_path, monkeypatch, tile):
    rows = [(i * 7 - 20, f"s{i % 5}", "en", t) for i, t in enumerate(texts())] + [(None, "s1", "en", texts()[0])]
    sf = table(spark, tmp_path, rows)
    monkeypatch.setattr(bindings, "document_grams", None)  # which has a row per gram
    pairs, small = text_pairs.pairs, text_pairs.SMALL
    monkeypatch.setattr(text_pairs, "pairs", lambda *a, **b: pairs(*a, **b, tile=tile))
    monkeypatch.setattr(text_pairs, "BUCKET_BYTES", 300)
    sets = {i: grams(t or "") for i, _, _, t in rows if i is not None}
    want = {(a, b, len(x & y), round(2 * len(x & y) / (len(x) + len(y)), 6)) for a, x in sets.items() for b, y in sets.items() if a < b and x & y and 2 * len(x & y) / (len(x) + len(y)) > 0.1}
    got = [tuple(r) for r in bindings.queries()["dice_documents"](spark, sf).select("a", "b", "shared", "dice").collect()]
    assert set(got) == want and len(got) == len(want) > 500 and small == text_pairs.SMALL


@pytest.mark.parametrize("tile", [3, 1024])
def test_candidates_of_documents_send_no_row_per_gram(spark, tmp_path, monkeypatch, tile):
    rows = [(i * 7 - 20, f"s{i % 5}" if i % 6 else None, (None, "en", "de")[i % 3], t) for i, t in enumerate(texts())]
    sf = table(spark, tmp_path, rows)
    monkeypatch.setattr(bindings, "document_grams", None)
    pairs = text_pairs.pairs
    monkeypatch.setattr(text_pairs, "pairs", lambda *a, **b: pairs(*a, **b, tile=tile))
    docs = [(d, s, lang, grams(t or ""), len([x for x in (t or "").split("\n") if x]), len(t or "")) for d, s, lang, t in rows]
    want = {
        (l, a): round(len(lg & ag) / len(lg), 6)
        for l, ls, ll, lg, lm, lw in docs for a, as_, al, ag, am, aw in docs
        if ls != as_ and lg and len(lg & ag) / len(lg) > 0.1 and lm and am and lw and aw and am <= lm and (ll is None or ll == al)
    }
    got = bindings.queries()["class_candidates_whole"](spark, sf).collect()
    assert len(got) == len(want) > 300 and {(r.l, r.a): r.score for r in got} == want


def test_ids_that_repeat_take_the_exact_path_by_rows(spark, tmp_path):
    rows = [(i % 60, "s", "en", t) for i, t in enumerate(texts())]
    sf, sets = table(spark, tmp_path, rows), {}
    for i, _, _, t in rows:
        sets[i] = sets.get(i, set()) | grams(t or "")
    want = {(a, b, len(x & y)) for a, x in sets.items() for b, y in sets.items() if a < b and x & y and 2 * len(x & y) / (len(x) + len(y)) > 0.1}
    assert {tuple(r) for r in bindings.queries()["dice_documents"](spark, sf).select("a", "b", "shared").collect()} == want
