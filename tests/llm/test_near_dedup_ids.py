from sigweave.llm import near_dedup


def test_unrelated_texts_that_share_an_id_or_have_none_stay(spark):
    text = lambda p: " ".join(f"{p}{i}" for i in range(60))
    near = text("a").replace("a59", "other")
    rows = [(3, text("a")), (3, text("b")), (None, text("c")), (None, text("d")), (None, text("d")), (5, near), (None, text("b").upper()), (None, None), (8, text("e"))]
    got = near_dedup.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(3, text("a")), (3, text("b")), (None, text("c")), (None, text("d")), (None, None), (8, text("e"))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
