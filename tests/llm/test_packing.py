import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sigweave.llm import packing

TEXTS = [None, "", " ", "  ", "a b", "a  b", "a   b  ", "x\n y", "x\n \ny", "x \n\n y", "\n\n ", "tab\t here \x0b z", "don't we'll  I'm", "<|endoftext|> a <|endoftext|>", "a  b", "a 　 b c ", "héé ñandú 12 345 6789", "日本語 テキスト", "😀 x", "word " * 3000, "x" * 5000, "don't don't don't", "a b", " lead", "trail "]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_ids_equal_the_public_tokenizer(whole):
    texts = [t or "" for t in TEXTS]
    ids, bounds = packing.Encoder(**packing.vocabulary()).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def same_ids(whole, texts):
    ids, bounds = packing.Encoder(**packing.vocabulary()).encode(pa.array(texts, pa.string()))
    for i, e in enumerate(whole.encode_batch(texts, add_special_tokens=False)):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == e.ids, repr(texts[i][:200])


def test_ids_equal_the_public_tokenizer_on_whole_tables(spark, whole):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL")
    same_ids(whole, [r.text for r in docs.select("text").collect()])


@pytest.mark.parametrize("seed", range(4))
def test_ids_equal_the_public_tokenizer_on_random_strings(whole, seed):
    rng = np.random.default_rng(seed)
    spaces = [*" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0", "\u1680", "\u2000", "\u2009", "\u200a", "\u200b", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\ufeff", "  ", " \n", "\n ", "   "]
    words = ["a", "I'm", "we'll", "'s", "'", "don't", "x1", "42", "3.14", "--", "...", "!?", "é", "e\u0301", "日本", "ß", "Ω", "\u0660", "²", "½", "😀", "👩\u200d💻", "<|", "|>", "<|endoftext|>", "_", "A_b", "\u00ad", "\u0600", "\U0001d7d8"]
    chars = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x11000)]]
    texts = []
    for i in range(700):
        n = int(rng.integers(1, 25))
        pool = words if i % 3 else chars
        some = [pool[int(j)] for j in rng.integers(0, len(pool), n)]
        gaps = [spaces[int(j)] if rng.random() < 0.4 else " " if rng.random() < 0.7 else "" for j in rng.integers(0, len(spaces), n + 1)]
        texts.append("".join(g + w for g, w in zip(gaps, [*some, ""], strict=True)))
    same_ids(whole, texts)


def one_by_one(sizes, capacity):
    """Best-fit decreasing by looking at every bin."""
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in bins if r >= s]
        if fit:
            bins[bins.index(min(fit))] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 60))
    sizes = rng.integers(1, capacity + 1, int(rng.integers(1, 300))).tolist()
    counts = {int(s): sizes.count(s) for s in set(sizes)}
    plan = packing.best_fit_plan(counts, capacity)
    bins = defaultdict(list)
    for s, n in counts.items():
        own = plan[plan[:, 0] == s]
        for k in range(n):
            _, first, bin0, each, offset = own[own[:, 1] <= k][-1]
            bins[bin0 + (k - first) // each].append((offset + (k - first) % each * s, s))
    for content in bins.values():
        at = 0
        for offset, s in sorted(content):
            assert offset == at
            at += s
        assert at <= capacity
    assert sorted(capacity - sum(s for _, s in b) for b in bins.values()) == one_by_one(sizes, capacity)


def check(rows, texts, whole):
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    for doc, text in texts.items():
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by_doc.pop(doc), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 1024)))
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert len(ids) <= 1024 or r.piece == 0 or r.length == 1024
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for own in by_bin.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return sorted(1024 - sum(r.length for r in b) for b in by_bin.values())


def test_query_on_small_and_odd_texts(spark, whole):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, offset long")
    rows = packing.packed(docs).collect()
    got = check(rows, dict(enumerate(TEXTS)), whole)
    assert got == one_by_one([r.length for r in rows], 1024)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    rows = packing.packed(docs).collect()
    assert len(rows) == 4 and sum(r.length for r in rows) == 3 + 3 + 2 + 1
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4
    assert packing.packed(docs.limit(0)).count() == 0


def test_whole_table(spark, whole):
    rows = packing.query(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert check(rows, {d.doc_id: d.text for d in docs}, whole) == one_by_one([r.length for r in rows], 1024)
