import numpy as np
import pyarrow as pa

from sigweave.llm import language_id, toxicity

ODD = [None, "", "  ", "123 +++ 45", "é", "the " * 30000, "\x0b\x0c x"]


def test_language_of_small_and_odd_tables(spark):
    en, fr = "the house and the garden with that thing", "le jardin et la maison avec cette chose"
    rows = [(i, en if i % 2 else fr, "en" if i % 2 else "fr") for i in range(20)] + [(None, en, None), (21, None, "en"), (22, en, "en")] + [(30 + i, t, None) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    out = language_id.predict(docs.drop("lang"), language_id.fit(docs)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1
        if r.text in (en, fr):
            assert r.lang_pred == ("en" if r.text == en else "fr")
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert r.lang_pred in ("en", "fr")
    nothing = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs.select("doc_id", "text"), nothing).collect()} == {"und"}
    assert language_id.predict(docs.select("doc_id", "text").limit(0), nothing).count() == 0


def test_bit_sliced_filters_hold_every_gram_of_70_languages():
    rng = np.random.default_rng(0)
    grams = [rng.integers(0, 2**63, 50, dtype=np.uint64) for _ in range(70)]
    filters = language_id.LanguageFilters([f"l{i:02}" for i in range(70)], grams)
    for i, own in enumerate(grams):
        hits = filters.hits(np.zeros(50, np.int64), own, 1)[0]
        assert hits[i] == 50 and hits.sum() < 60


def test_language_accuracy_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in language_id.query(spark, sf).collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def plain_grams(text, sizes=language_id.SIZES):
    """All n-grams of a text with repeats, letter runs between marks, one by one."""
    out = []
    for run in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        marked = f" {run} "
        out += [marked[i : i + n] for n in sizes for i in range(len(marked) - n + 1)]
    return out


def test_prediction_equals_popcounts_of_plain_sets(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    filters = language_id.fit(docs.where("doc_id % 3 != 0"))
    sets = {x: set() for x in filters.languages}
    for r in rows:
        if r.lang is not None and r.doc_id % 3:
            sets[r.lang] |= set(plain_grams(r.text))
    for r in language_id.predict(docs.select("doc_id", "text"), filters).collect():
        found = sorted(((-sum(g in own for g in plain_grams(r.text)), x) for x, own in sets.items()))
        if not plain_grams(r.text):
            continue
        top, second = -found[0][0], -found[1][0]
        assert abs(r.score - top / (top + second)) < 0.01
        if top - second > 0.01 * top:  # false positives of the filters may settle what is closer
            assert r.lang_pred == found[0][1]


def test_letters_without_grams_still_get_a_language(spark):
    docs = spark.createDataFrame([(1, "ab cd", "en"), (2, "x", None), (3, "7", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert got[2] == ("en", 0) and got[3] == ("und", 0)


def plain_features(text, lexicon):
    """The features of one text, word by word."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    rows = []
    for word in words:
        w = toxicity.plain(word)
        odds = max([lexicon.get("=" + w, 0.0), *(lexicon.get(w[:n], 0.0) for n in (4, 5) if len(w) > n)])
        core = word.strip(toxicity.EDGES)
        letters = [c.isalpha() for c in core]
        odd = not word.isalpha() and not core.isalpha() and any(letters) and not all(letters)
        rows.append((max(odds, 0), odds > 1.5, w in toxicity.INSULTS, w in toxicity.SECOND, len(word) > 1 and word.isupper(), 0 if word.isalpha() else len(word) - len(core), odd, len(w) > 3 and bool(re.search(r"(.)\1\1", w, re.S)), len(word)))
    n = max(1, len(words))
    total = [sum(r[i] for r in rows) for i in range(9)]
    near = sum(1 for i, r in enumerate(rows) if (r[1] or r[2]) and any(x[3] for x in rows[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]))
    return [total[0] / n, max((r[0] for r in rows), default=0), total[1], total[1] / n, total[2], total[2] / n, near, *(t / n for t in total[3:9]), np.log1p(len(words)), sum(r[0] > 0 for r in rows), total[0]]


def plain_score(model, text):
    """A text's score from the fitted model, tree by tree and point by point."""
    x = np.asarray(plain_features(text, model.lexicon), np.float32)
    raw = model.trees.base
    for features, cuts, leaf in model.trees.trees:
        node = 0
        for feature, cut in zip(features, cuts, strict=True):
            f = feature[node]
            node = 2 * node + (int((model.trees.edges[f] < x[f]).sum()) > cut[node])
        raw += leaf[node]
    points, values = model.points, model.values
    if raw <= points[0] or raw >= points[-1]:
        return values[0] if raw <= points[0] else values[-1]
    i = int((points <= raw).sum()) - 1
    return values[i] + (values[i + 1] - values[i]) * (raw - points[i]) / (points[i + 1] - points[i])


def test_scores_equal_the_model_followed_by_hand(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert model.lexicon and model.trees
    some = [(r.doc_id, r.text) for r in docs.collect()] + [(-1 - i, t) for i, t in enumerate(ODD)]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(some, "doc_id long, text string"), model).collect()}
    for i, t in some:
        assert abs(got[i] - min(1, max(0, plain_score(model, t)))) < 1e-6, (i, (t or "")[:60])


def test_every_unit_that_passes_is_in_the_lexicon(spark):
    rows = [(i, f"bad{i % 6000}word neutral") for i in range(30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "1 AS toxic").unionByName(spark.range(100_000, 130_000).selectExpr("id AS doc_id", "0 AS toxic"))
    docs = docs.unionByName(spark.range(100_000, 130_000).selectExpr("id AS doc_id", "'neutral' AS text"))
    model = toxicity.fit(docs, labels, max_train=60_000)
    assert sum(u.startswith("=bad") for u in model.lexicon) == 6000  # more than any fixed number


def test_isotonic_pools_to_a_monotone_fit():
    points, values = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 0]))
    assert points.tolist() == [1, 2, 3, 4] and values.tolist() == [0, 0.5, 0.5, 0.5]


def test_second_person_proximity_stays_within_a_text():
    x = toxicity.text_features(pa.array(["you are an idiot", "a b c d e f g idiot . . . . . . you", "idiot", "you", None]), {})
    assert x[:, 6].tolist() == [1, 0, 0, 0, 0] and x[:, 4].tolist() == [1, 1, 1, 0, 0]


def test_toxicity_of_small_and_odd_tables(spark):
    rows = [(i, ("what a lovely day " if i % 3 else "you zargle, zargle off ") * 3) for i in range(90)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "again")]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, score string, Predicted int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(0, 0), (None, 1), (61, None), (999, 1)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.text and "zargle" in r.text:
            assert r.predicted == 1
        if r.text and "lovely" in r.text:
            assert r.predicted == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(labels[r.doc_id], r.predicted) for r in toxicity.query(spark, sf).collect() if r.held_out and r.doc_id in labels]
    # some texts of repeated words or punctuation are labelled toxic without any toxic word
    assert np.mean([p for t, p in held if t]) > 0.9
    assert np.mean([p for t, p in held if not t]) < 0.01
