"""Language-model scores by deleted interpolation.

P(w | context) mixes the maximum-likelihood estimates of all orders up to ORDER and a uniform one, with weights that
depend on how often the context occurs (one set per power of two, and per longest context seen). The weights come from
expectation-maximisation over held-out counts: a part of the training documents is deleted from the counts, and
their tokens are predicted from what is left. The final model counts all training documents.

No table of counts is sent to every task. Texts are written once, as slices of about BLOCK_TOKENS words (see slices). A slice
sends each distinct n-gram hash once, with its count in the slice, to buckets by hash; a bucket adds up what the
slices sent and returns to each slice the totals of its own n-grams. So a frequent n-gram costs one number per slice,
buckets are even whatever the words' frequencies, and all counts cover the whole corpus. For EM the held-out tokens
become a histogram of (context bucket, estimates in octaves, with each cell's mean estimates), whose size is
bounded by its grid, not by the corpus. A task holds one slice at a time and, of it, one order's n-grams.

Words are told apart by 64 bits of hash, longer n-grams by KEY_SPARE bits more than it takes to number the corpus's
bytes, so that one in some millions shares its counts with another.

Defined results: null text is an empty one (one end token); texts of any length are scored whole; without training
documents every token has the uniform estimate of an empty vocabulary; a null id folds as an empty text and is null in
results; repeated rows are counted and scored each; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_strings, materialise, mix64, split_words, table
from .slices import bucket_edges, gathered, one_by_one, press, press_keys, rows_of, sliced, unpress, unpress_keys

ORDER = 3
DELETED = 8  # one of so many parts of the training documents is held out for EM
BLOCK_TOKENS = 1_000_000
CHUNK = 100_000  # tokens whose estimates are held at once
NGRAMS_A_BUCKET = 1_500_000
KEY_SPARE = 20
ROUNDS = 40
TOP = 24  # context buckets per order
LEVELS = 32  # octaves of estimates in the histogram; what is below the last counts there
_BEGIN, _END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)
_MUL = np.uint64(0x9E3779B97F4A7C15)


class Block:
    """Tokens of some documents, as padded sequences: order - 1 begin marks, the words, an end mark."""

    def __init__(self, texts: pa.Array, order: int, key_bits: int = 64):
        codes, bounds, words = split_words(texts, lower=True)
        size = np.diff(bounds)
        self.order, self.key_bits, pad = order, key_bits, order - 1
        self.tokens = size + 1
        full = self.tokens + pad
        starts = np.cumsum(full) - full
        self.h = np.full(int(full.sum()), _BEGIN, np.uint64)
        # word i of text d stands pad begin marks and d * (pad + 1) marks of the texts before later
        self.h[np.arange(len(codes)) + np.repeat(np.arange(len(size)) * (pad + 1) + pad, size)] = hash_strings(words)[codes]
        self.h[starts + full - 1] = _END
        real = np.ones(len(self.h), bool)
        for p in range(pad):
            real[starts + p] = False
        self.at = np.flatnonzero(real)
        self.first = np.cumsum(self.tokens) - self.tokens  # each text's first token

    def keys(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(distinct hashes in order, number of each token's n-gram among them); an n-gram ends at its token."""
        g = self.h[self.at - (n - 1)]
        for i in range(n - 2, -1, -1):
            g *= _MUL
            g += self.h[self.at - i]
        g = mix64(g + np.uint64(n))
        if n > 1 and self.key_bits < 64:
            g &= ~np.uint64((1 << 64 - self.key_bits) - 1)
        return np.unique(g, return_inverse=True)

    def counts(self, totals, documents: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For n = 1 .. order: each token's n-gram count, and its context's (for n = 1: 0). totals(n) are the counts of keys(n)."""
        gram, context = [], [np.zeros(len(self.at), np.int64)]
        for n in range(1, self.order + 1):
            gram.append(totals(n)[self.keys(n)[1]])
        for n in range(2, self.order + 1):
            before = np.concatenate([[0], gram[n - 2][:-1]])
            before[self.first] = documents  # at a text's first token the context is begin marks only, which stand once in each document
            context.append(before)
        return gram, context


def estimates(gram: list[np.ndarray], context: list[np.ndarray], tokens: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(context bucket, maximum-likelihood estimates) of each token; estimates of order n in column n, uniform in column 0."""
    f = np.zeros((len(gram[0]), len(gram) + 1))
    f[:, 0] = 1 / (words + 1)
    f[:, 1] = gram[0] / max(1, tokens)
    bucket = np.zeros(len(gram[0]), np.int64)
    for n in range(2, len(gram) + 1):
        c = context[n - 1]
        f[:, n] = np.minimum(1, gram[n - 1] / np.maximum(1, c))
        bucket = np.where(c > 0, (n - 1) * TOP + np.minimum(TOP - 1, np.frexp(c.astype(float))[1] - 1), bucket)
    return bucket, f


def learn(cells: list[tuple[int, float, list[float]]], order: int, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights of each context bucket by EM over cells (bucket, tokens, mean estimates)."""
    weights = np.full((order * TOP, order + 1), 1 / (order + 1))
    if not cells:
        return weights
    bucket, n, f = np.array([c[0] for c in cells]), np.array([c[1] for c in cells]), np.array([c[2] for c in cells])

    def em(start: np.ndarray, group: np.ndarray, groups: int, prior: np.ndarray | None) -> np.ndarray:
        w = start
        for _ in range(rounds):
            share = w[group] * f
            share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
            total = np.stack([np.bincount(group, share[:, k], groups) for k in range(f.shape[1])], 1)
            if prior is not None:
                total = total + prior
            w = total / np.maximum(total.sum(1), 1e-300)[:, None]
        return w

    pooled = em(weights[:1], np.zeros(len(n), np.int64), 1, None)
    pooled = 0.999 * pooled + 0.001 / (order + 1)
    return em(np.repeat(pooled, len(weights), 0), bucket, len(weights), pooled)  # one token's worth of the pooled weights


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7, held: int = 2, order: int = ORDER, block_tokens: int = BLOCK_TOKENS, crc: Column | None = None) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document. crc32(key) mod modulus = held keeps a document from training."""
    crc = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) if crc is None else crc
    docs = docs.select(F.col(key).cast("long").alias("id"), crc.alias("crc"), F.col(text).cast("string").alias("text"))

    def roles(crcs):
        """(in training, deleted for EM) of each document."""
        train = crcs % modulus != held
        return train, train & (crcs % (modulus * DELETED) < modulus)

    slices = sliced(docs, "text", 6 * block_tokens, lambda batch: roles(np.asarray(batch.column("crc")))[1])
    size = slices.agg(F.sum("size")).first()[0] or 0
    buckets, key_bits = max(12, math.ceil(size / 6 / NGRAMS_A_BUCKET)), min(64, KEY_SPARE + size.bit_length())

    def send(batches):
        for row in one_by_one(batches):
            own = rows_of(row["data"].as_buffer())
            block = Block(own.column("text"), order, key_bits)
            train = np.repeat(roles(np.asarray(own.column("crc")))[0], block.tokens)
            for n in range(1, order + 1):
                keys, at = block.keys(n)
                seen = np.bincount(at[train], minlength=len(keys)).astype("<u4")
                rows = [{"slice": row["slice"].as_py(), "apart": row["apart"].as_py(), "n": n, "bucket": b, "keys": press_keys(_short(keys[a:z], n, key_bits)), "counts": press(seen[a:z])} for b, a, z in bucket_edges(keys, buckets)]
                del keys, at, seen
                yield pa.RecordBatch.from_pylist(rows, SENT)

    def add_up(group: pa.Table) -> pa.Table:
        keys = [unpress_keys(x) for x in group["keys"].to_pylist()]  # as they were shortened, which leaves their order
        counts = [unpress(x, "<u4") for x in group["counts"].to_pylist()]
        apart = group["apart"].to_pylist()
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts), len(every)).astype("<i8")
        held_out = np.bincount(at, np.concatenate([c if a else np.zeros_like(c) for c, a in zip(counts, apart, strict=True)]), len(every)).astype("<i8")
        back, end = [], 0
        for k, a in zip(keys, apart, strict=True):
            own, end = at[end : end + len(k)], end + len(k)
            back.append((press(total[own]), press(held_out[own]) if a else None))
        sums = np.zeros((len(keys), 4), np.int64)  # in the group's first row: words and tokens of the training documents, and of those that stay for EM
        if group["n"][0].as_py() == 1:
            sums[0] = (total > 0).sum(), (total > held_out).sum(), total.sum(), (total - held_out).sum()
        return pa.table({"slice": group["slice"], "apart": group["apart"], "n": group["n"], "bucket": group["bucket"], "totals": [b[0] for b in back], "deleted": pa.array([b[1] for b in back], pa.binary()), **{c: sums[:, i] for i, c in enumerate(SUMS)}})

    sent = slices.select("slice", "apart", "data").mapInArrow(send, "slice long, apart boolean, n int, bucket int, keys binary, counts binary")
    answers = materialise(sent.groupBy("n", "bucket").applyInArrow(add_up, f"slice long, apart boolean, n int, bucket int, totals binary, deleted binary, {', '.join(f'{c} long' for c in SUMS)}"), "none")
    vocab = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in SUMS]).first()
    train, deleted = roles(F.col("crc"))
    texts = docs.agg(F.count_if(train), F.count_if(deleted)).first()
    words, tokens, documents = (vocab[0], vocab[1]), (vocab[2], vocab[3]), (texts[0], texts[0] - texts[1])

    def tokens_of(row: dict, rest: bool):
        """(slice, block, chunks of (context bucket, estimates) of its tokens, 1-gram counts); rest leaves out the deleted documents."""
        own = rows_of(row["data"].as_buffer())
        block = Block(own.column("text"), order, key_bits)
        entries = row["answers"].as_py()

        def totals(n: int) -> np.ndarray:
            parts = sorted((a["bucket"], a) for a in entries if a["n"] == n)
            return np.concatenate([unpress(a["totals"], "<i8") - (unpress(a["deleted"], "<i8") if rest else 0) for _, a in parts])

        gram, context = block.counts(totals, documents[rest])
        chunks = (estimates([g[c : c + CHUNK] for g in gram], [x[c : c + CHUNK] for x in context], tokens[rest], words[rest]) for c in range(0, len(block.at), CHUNK))
        return own, block, chunks, gram[0]

    def histogram(batches):
        for row in one_by_one(batches):
            for bucket, f in tokens_of(row, True)[2]:
                cell = bucket
                for n in range(1, order + 1):
                    level = np.where(f[:, n] > 0, np.maximum(1, LEVELS + np.rint(np.log2(np.maximum(f[:, n], 1e-30)))), 0).astype(np.int64)
                    cell = cell * (LEVELS + 1) + level
                cells, at = np.unique(cell, return_inverse=True)
                means = [np.bincount(at, f[:, k], len(cells)) for k in range(order + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.bincount(at, minlength=len(cells))), *map(pa.array, means)], names=["cell", "n", *(f"f{k}" for k in range(order + 1))])

    fields = [f"f{k}" for k in range(order + 1)]
    asked = slices.where("apart").select("slice", "data").join(gathered(answers.where("apart"), "n", "totals", "deleted"), "slice")
    cells = asked.mapInArrow(histogram, f"cell long, n long, {', '.join(f'{c} double' for c in fields)}").groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", *fields)]).collect()  # as many as the grid has cells at most
    weights = learn([(r["cell"] // (LEVELS + 1) ** order, r["n"], [r[c] / r["n"] for c in fields]) for r in sorted(cells)], order)

    def finish(batches):
        for row in one_by_one(batches):
            own, block, chunks, known = tokens_of(row, False)
            model = np.concatenate([np.log10((weights[bucket] * f).sum(1)) for bucket, f in chunks])
            base = np.log10((known + 1) / (tokens[0] + words[0] + 1))
            per = [np.add.reduceat(v, block.first) for v in ((known > 0).astype(np.int64), base, model)]
            held_out = ~roles(np.asarray(own.column("crc")))[0]
            yield pa.RecordBatch.from_arrays(
                [own.column("id"), pa.array(held_out), pa.array(block.tokens), pa.array(per[0]), pa.array(np.full(own.num_rows, tokens[0])), pa.array(per[1]), pa.array(per[2])],
                names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    asked = slices.select("slice", "data").join(gathered(answers, "n", "totals"), "slice").select("data", "answers")
    return asked.mapInArrow(finish, f"`{key}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


SUMS = ("words", "kept_words", "tokens", "kept_tokens")
SENT = pa.schema([("slice", pa.int64()), ("apart", pa.bool_()), ("n", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _short(keys: np.ndarray, n: int, key_bits: int) -> np.ndarray:
    return keys >> np.uint64(64 - key_bits) if n > 1 else keys


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
