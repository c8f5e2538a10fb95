import corpus_pipeline
import pytest
from test_near_dedup import brute as near_brute
from test_substring_dedup import brute as substring_brute

from sigweave.llm import mixing, toxicity
from sigweave.llm.common import fold

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """The input of each stage, and the last one's result."""
    out = [spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for _, stage in corpus_pipeline.STAGES:
        schema = spark.read.parquet(f"{SF}/documents.parquet").schema
        out.append(stage(spark, spark.createDataFrame(out[-1], schema), SF).collect())
    return out


def test_stages_keep_the_columns(tables):
    for rows in tables[:-1]:
        assert rows and list(rows[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity_drops_what_the_operator_rejects(spark, tables):
    docs = spark.createDataFrame(tables[0])
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(fold("doc_id", 5) != 0)
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels)).collect()
    assert {r.doc_id for r in scored if not r.predicted} == {r.doc_id for r in tables[1]}


def test_near_dedup_keeps_one_of_each_group(tables):
    want = {d for d, _, component in near_brute([(r.doc_id, r.text) for r in tables[1]], 5) if d == component}
    assert {r.doc_id for r in tables[2]} == want and len(tables[2]) == len(want)


def test_substring_dedup_takes_out_later_copies(tables):
    want = {d: (n, gone, kept) for d, n, gone, kept in substring_brute([(r.doc_id, r.text) for r in tables[2]], 40)}
    before = {r.doc_id: r.text for r in tables[2]}
    got = {r.doc_id: r.text for r in tables[3]}
    assert set(got) == {d for d, (n, gone, _) in want.items() if gone < n or not n}
    for d, text in got.items():
        assert text == (want[d][2] if want[d][1] else before[d])


def test_mixing_takes_what_the_operator_says(spark, tables):
    want = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(tables[3])).collect()}
    got = dict.fromkeys(want, 0)
    for r in tables[4]:
        got[r.doc_id] += len((r.text or "").split())
    assert got == want


def test_packing_holds_every_row(tables):
    assert sum(r.piece == 0 for r in tables[5]) == len(tables[4])
    bins = {}
    for r in tables[5]:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_and_clashing_columns(spark, tables):
    assert corpus_pipeline.run(spark, SF).count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    more = docs.selectExpr("*", "1 AS score", "2 AS predicted", "3 AS kept", "4 AS n_words", "5 AS target", "6 AS cls", "7 AS id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        more = spark.createDataFrame(stage(spark, more, SF).collect(), more.schema)
        assert more.count() > 0


def test_null_ids_repeated_rows_and_empty_tables(spark):
    """Toxic texts go whatever their id, of equal texts one row stays whatever the ids, clean and wordless rows stay, and an empty table gives an empty one."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    clean = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text and 40 < len(r.text.split()) < 300][:30]
    odd = [(None, None, None, None, None), (None, "", "en", "src1", 0), (7, None, "en", None, 0), (7, " \t ", None, "src1", 3), (None, "two different words", "en", "src2", 19), (None, "short rows of other words", None, None, 25)]
    odd += [(None, "two different words", "en", "src2", 19)] * 3 + [(7, "short rows of other words", "fr", "src1", 25)]
    docs = spark.createDataFrame([tuple(r) for r in clean] + odd, schema)
    toxicity_filter, near, substring, mix, pack = (stage for _, stage in corpus_pipeline.STAGES)
    rows = sorted(map(str, toxicity_filter(spark, docs, SF).collect()))
    assert len(rows) >= len(odd) and set(rows) <= set(map(str, docs.collect()))
    kept = near(spark, docs, SF).collect()
    assert sum(r.text is None for r in kept) == 2 and sum(r.text is not None and not r.text.split() for r in kept) == 2  # wordless rows stay
    assert [(r.doc_id, r.text) for r in kept if r.text and "rows of other" in r.text] == [(7, "short rows of other words")]  # the id that is one comes first
    assert sum(r.text == "two different words" for r in kept) == 1
    assert sorted((str(tuple(r)) for r in substring(spark, docs.where("length(text) < 40 OR text IS NULL"), SF).collect())) == sorted(map(str, odd))
    mixed = mix(spark, docs, SF).collect()
    assert {r.source for r in mixed} <= {r.source for r in docs.collect()} and None in {r.source for r in mixed}
    packed = pack(spark, docs, SF).collect()
    assert sum(r.piece == 0 for r in packed) == len(clean) + len(odd)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
