import hashlib
import re

import duckdb
import numpy as np
import pytest

from sigweave.llm import substring_dedup as sd


def brute(rows, w):
    """(doc_id, n_words, n_removed, kept) with a dictionary of all windows."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = set(), []
    for i in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", rows[i][1] or "")
        gone = [False] * len(words)
        for s in range(len(words) - w + 1):
            g = tuple(words[s : s + w])
            if g in seen:
                gone[s : s + w] = [True] * w
            seen.add(g)
        kept = " ".join(x for x, y in zip(words, gone, strict=True) if not y)
        out.append((rows[i][0], len(words), sum(gone), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("v", sd.COVERS)
def test_covers_hold_every_difference(v):
    cover = sd.COVERS[v]
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def made_up(seed, w):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(400)}"
    passages = [[word() for _ in range(int(rng.integers(w - 3, 3 * w)))] for _ in range(8)]
    texts = [None, "", " \t", "a " * (3 * w), " ".join(passages[0][:w]), "x\x0by"]
    for _ in range(60):
        t = [word() for _ in range(int(rng.integers(0, 40)))]
        for _ in range(int(rng.integers(0, 4))):
            p = passages[int(rng.integers(8))]
            a = int(rng.integers(0, 4))
            t += p[a : len(p) - int(rng.integers(0, 4))] + [word() for _ in range(int(rng.integers(0, 15)))]
        texts.append("  ".join(t))
    texts += texts[-3:]
    return [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]


@pytest.mark.parametrize("w", [5, 20, 40])
def test_equals_brute_force(spark, w):
    rows = made_up(w, w)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, bucket int, kept string")
    got = sd.strip(df, window=w, keep=["doc_id"]).collect()
    want = brute(rows, w)
    assert sorted(map(tuple, got), key=str) == want
    assert sum(r[2] for r in want) > 100


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(f"u{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "short")], "doc_id long, text string")
    got = sorted((tuple(r)[:3] for r in sd.strip(df).collect()), key=str)
    assert got == sorted([(1, 30, 0), (1, 30, 30), (None, 30, 30), (None, 1, 0)], key=str)
    assert sd.strip(df.limit(0)).count() == 0


def test_deduplicated_documents(spark):
    text = " ".join(f"u{i}" for i in range(60))
    rows = [(1, "a\n b  " + text, "s", 9), (2, text, "s", 9), (3, "own  words " + text + "\nmore", None, 9), (4, None, "s", 0), (5, "clean  text\n", "s", 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    got = {r.doc_id: r for r in sd.deduplicated(df).collect()}
    assert sorted(got) == [1, 3, 4, 5]
    assert got[1].text == rows[0][1] and got[5].text == rows[4][1] and got[4].text is None
    assert got[3].text == "own words more" and got[3].n_chars == 14


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows, 20)]
    assert sorted(map(tuple, sd.query(spark, sf).collect()), key=str) == sorted(want, key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(con.sql(sd.SQL).fetchall()) == sorted(want)
