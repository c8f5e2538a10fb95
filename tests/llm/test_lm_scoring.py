import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from sigweave.llm import lm_scoring as lm


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def folded(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode())


def brute(rows):
    """What the contract defines, by dictionaries: (doc_id, held_out, n_tokens, n_known, N, base_score)."""
    count = Counter(t for d, text in rows if folded(d) % 7 != 2 for t in tokens_of(text))
    n, v, out = sum(count.values()), len(count), []
    for d, text in rows:
        own = tokens_of(text)
        out.append((d, folded(d) % 7 == 2, len(own), sum(count[t] > 0 for t in own), n, sum(log10((count[t] + 1) / (n + v + 1)) for t in own)))
    return out


def plain_em(tokens, order):
    """Weights by bucket from single held-out tokens (bucket, estimates): expectation-maximisation on all of them first, then in
    each bucket, where the common weights count as one more token."""
    even = [1 / (order + 1)] * (order + 1)
    if not tokens:
        return dict.fromkeys(range(order * lm.TOP), even)

    def rounds(own, w, prior):
        for _ in range(lm.ROUNDS):
            total = list(prior)
            for f in own:
                mix = sum(a * b for a, b in zip(w, f, strict=True))
                for k in range(order + 1):
                    total[k] += w[k] * f[k] / mix
            w = [t / sum(total) for t in total]
        return w

    common = [0.999 * x + 0.001 / (order + 1) for x in rounds([f for _, f in tokens], even, [0.0] * (order + 1))]
    return {b: rounds([f for c, f in tokens if c == b], common, common) for b in range(order * lm.TOP)}


def brute_model(rows, order):
    """The interpolated model by dictionaries, with EM over single held-out tokens."""
    def grams(text, n):
        s = ["<"] * (order - 1) + tokens_of(text)
        return [(tuple(s[i - n + 1 : i]), s[i]) for i in range(order - 1, len(s))]

    def counted(docs):
        gram = [Counter(g for _, t in docs for g in grams(t, n)) for n in range(1, order + 1)]
        context = [Counter(c for c, _ in (g for _, t in docs for g in grams(t, n))) for n in range(1, order + 1)]
        return gram, context

    def estimate(text, gram, context):
        n1, words = sum(gram[0].values()), len(gram[0])
        for i in range(len(tokens_of(text))):
            f, bucket = [1 / (words + 1)], 0
            for n in range(1, order + 1):
                c, w = grams(text, n)[i]
                k = context[n - 1][c] if n > 1 else n1
                f.append(gram[n - 1][c, w] / k if k else 0)
                if n > 1 and k:
                    bucket = (n - 1) * lm.TOP + min(lm.TOP - 1, k.bit_length() - 1)
            yield bucket, f

    train = [r for r in rows if folded(r[0]) % 7 != 2]
    deleted = [r for r in train if folded(r[0]) // 7 % lm.DELETED == 0]
    rest = counted([r for r in train if folded(r[0]) // 7 % lm.DELETED])
    weights = plain_em([x for _, t in deleted for x in estimate(t, *rest)], order)
    full = counted(train)
    return [sum(log10(float(np.dot(weights[b], f))) for b, f in estimate(t, *full)) for _, t in rows]


def made_up():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(vocabulary[min(59, int(x))] for x in rng.exponential(12, int(rng.integers(0, 60))))) for i in range(150)]
    return rows + [(200, None), (201, ""), (202, " \t\x0b "), (203, "A a À à new-word"), (204, "w1 " * 4000), (7, "again w1"), (7, "again w1"), (None, "no id")]


@pytest.mark.parametrize("order,block", [(2, 500), (2, 10**6), (3, 700)])
def test_equals_brute_force(spark, order, block):
    rows = made_up()
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, block string, score double").repartition(3)
    got = sorted(map(tuple, lm.score(df, order=order, block_tokens=block).collect()), key=str)
    want = sorted([(*a, b) for a, b in zip(brute(rows), brute_model(rows, order), strict=True)], key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])
    # EM sees estimates gathered in half octaves
    assert [g[6] for g in got] == pytest.approx([w[6] for w in want], rel=0.02, abs=0.05)


def test_no_training_documents_and_empty_table(spark):
    held = next(i for i in range(100) if folded(i) % 7 == 2)
    df = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    (r,) = lm.score(df).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0)
    assert np.isfinite(r.score)
    assert lm.score(df.limit(0)).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, lm.query(spark, sf).collect()))
    want = sorted(brute(rows))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)  # the mixture predicts held-out texts better than the base
