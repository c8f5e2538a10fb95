from sigweave.plans import bindings


def brute(rows):
    """{(l, a): score} of all documents of different sources, pair by pair."""
    def grams(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    docs = [(d, s, lang, grams(t), len([x for x in t.split("\n") if x]), len(t)) for d, s, lang, t in rows]
    out = {}
    for l, ls, ll, lg, lm, lw in docs:
        for a, as_, al, ag, am, aw in docs:
            fits = lm and am and lw and aw and am <= lm and (ll is None or ll == al)
            if ls != as_ and lg and len(lg & ag) / len(lg) > 0.1 and fits:
                out[l, a] = round(len(lg & ag) / len(lg), 6)
    return out


def test_candidates_of_all_sources(spark, tmp_path):
    x, y = (" ".join(f"{p}{i}" for i in range(30)) for p in "xy")
    rows = [(1, "src1", "en", x), (2, "src2", "en", f"{x}\n{y}"), (3, None, "en", f"{y}\n{x}"), (4, "src0", "de", y), (5, "src1", None, y), (6, "src2", "en", x), (7, None, "en", x), (8, "src9", "en", "")]
    spark.createDataFrame([(*r, len(r[3])) for r in rows], "doc_id long, source string, lang string, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows)
    got = bindings.queries()["class_candidates_whole"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.l, r.a): r.score for r in got} == want
    assert {(1, 6), (6, 1), (2, 1), (3, 1), (5, 4)} <= want.keys()
