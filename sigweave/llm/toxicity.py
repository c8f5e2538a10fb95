"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Features: densities of two lexicons (the words below, and one learned from the labels: whole words and word beginnings
with their log odds), lexicon words close to a second-person word, rates of capitals, punctuation, obfuscated and
stretched words, and the text's length. They are computed per distinct word of a batch and summed per text.

Fitted on a sample of labelled rows of about MAX_TRAIN rows by a hash of the id (documented bound; all if there are
fewer). Texts stay on the executors: the driver gets the learned lexicon (words of the sample that toxic texts prefer) and one
row of features per sampled document. Rows get features from a lexicon that other thirds of the sample taught, trees are
calibrated on thirds that they haven't seen.

Defined results: null text counts as empty and is scored; texts of any length are read whole; labels that are null or belong to no document teach nothing;
a document with several labels is toxic if one says so; without toxic labels every score is the share of toxic
labels, 0 if there are none; repeated rows are scored each; an empty table gives no rows; a null id folds as an empty
text and has no label; other columns play no part; a column of docs with the name of a new one gives way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, materialise, split_words, table, text_slices

MAX_TRAIN = 20_000
LEAST_TOXIC, LEAST_ODDS, LEAST_GAIN = 3, 1.0, 6.0  # toxic documents, log odds and their product that make a unit part of the lexicon
FOLDS = 3
NEAR = 5  # words

# Words of insult, and words for the second person.
INSULTS = frozenset("arrogant bastard bitch brainless clown coward cretin damn disgusting dumb failure filthy fool freak garbage hate idiot ignorant imbecile jerk kill liar loser lunatic moron pathetic pig psycho rat retard rubbish scum shameful shit shut sick stupid sucker trash ugly useless vermin vile weak worthless wretch".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta vous votre tú usted ustedes vosotros ti".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, "_": None, "-": None, ".": None})
EDGES = ".,;:!?\"'()[]{}<>|&%#/\\…“”«»"
FEATURES = 16


def plain(word: str) -> str:
    """Lower case, without punctuation around, and with letters for the signs that stand for them."""
    w = word.strip(EDGES).lower()
    return w if w.isalpha() else w.translate(LEET)


def units(word: str) -> list[str]:
    """What the learned lexicon knows of a plain word: the word, and its beginnings of 4 and 5 letters."""
    return ["=" + word] + [word[:n] for n in (4, 5) if len(word) > n]


def word_features(words: list[str], lexicon: dict[str, float]) -> np.ndarray:
    """For each distinct word: learned odds, strong hit, known insult, second person, capitals, punctuation, obfuscated, stretched, letters."""
    out = np.zeros((len(words), 9), np.float32)
    for i, word in enumerate(words):
        w = plain(word)
        odds = lexicon.get("=" + w, 0.0)
        if len(w) > 4:
            odds = max(odds, lexicon.get(w[:4], 0.0))
            if len(w) > 5:
                odds = max(odds, lexicon.get(w[:5], 0.0))
        row = out[i]
        if odds > 0:
            row[0], row[1] = odds, odds > 1.5
        if w in INSULTS:
            row[2] = 1
        if w in SECOND:
            row[3] = 1
        if len(word) > 1 and word.isupper():
            row[4] = 1
        if not word.isalpha():
            core = word.strip(EDGES)
            row[5] = len(word) - len(core)
            if not core.isalpha() and any(c.isalpha() for c in core) and any(not c.isalpha() for c in core):
                row[6] = 1
        if len(w) > 3 and any(a == b == c for a, b, c in zip(w, w[1:], w[2:], strict=False)):
            row[7] = 1
        row[8] = len(word)
    return out


def text_features(texts: pa.Array, lexicon: dict[str, float]) -> np.ndarray:
    """FEATURES numbers for each text."""
    codes, bounds, words = split_words(texts, lower=False)
    each = word_features(words.to_pylist(), lexicon)
    n = np.diff(bounds)
    out = np.zeros((len(n), FEATURES), np.float32)

    def total(values: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return run[bounds[1:]] - run[bounds[:-1]]

    def of(k: int) -> np.ndarray:
        """Feature k of every word; one feature's numbers at a time."""
        return each[:, k][codes]

    some, words_n = n > 0, np.maximum(n, 1)
    odds = of(0)
    out[:, 15] = total(odds)
    out[:, 0] = out[:, 15] / words_n
    if some.any():
        out[some, 1] = np.maximum.reduceat(odds, bounds[:-1][some])
    out[:, 14] = total((odds > 0).astype(np.float32))
    del odds
    strong, insult, you = of(1), of(2), of(3)
    out[:, 2] = total(strong)
    out[:, 3] = out[:, 2] / words_n
    out[:, 4] = total(insult)
    out[:, 5] = out[:, 4] / words_n
    # lexicon words with a second-person word of the same text within NEAR words
    hit, second = np.flatnonzero((strong > 0) | (insult > 0)), np.flatnonzero(you > 0)
    out[:, 7] = total(you) / words_n
    del strong, insult, you
    if len(hit) and len(second):
        near = np.zeros(len(codes), np.float32)
        owner = np.searchsorted(bounds, hit, side="right") - 1
        low, high = np.maximum(hit - NEAR, bounds[owner]), np.minimum(hit + NEAR + 1, bounds[owner + 1])
        near[hit] = np.searchsorted(second, high) > np.searchsorted(second, low)
        out[:, 6] = total(near)
    for column, k in ((8, 4), (9, 5), (10, 6), (11, 7), (12, 8)):
        out[:, column] = total(of(k)) / words_n
    out[:, 13] = np.log1p(n)
    return out


class Trees:
    """Boosted regression trees for log odds, on up to 32 quantile bins a feature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, ridge: float = 1.0):
        self.depth = depth
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])) for f in range(x.shape[1])]
        share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.base = float(np.log(share / (1 - share)))
        binned = self.bins(x)
        raw, self.trees, width = np.full(len(x), self.base), [], 33
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(len(x), np.int64)
            features, cuts = [], []
            for level in range(depth):
                n = 1 << level
                best, feature, cut = np.full(n, 1e-9), np.zeros(n, np.int64), np.full(n, width)
                for f in range(x.shape[1]):
                    at = node * width + binned[:, f]
                    g = np.bincount(at, grad, n * width).reshape(n, width).cumsum(1)
                    h = np.bincount(at, hess, n * width).reshape(n, width).cumsum(1)
                    gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                    k = gain.argmax(1)
                    top = gain[np.arange(n), k]
                    better = top > best + 1e-12
                    best, feature, cut = np.where(better, top, best), np.where(better, f, feature), np.where(better, k, cut)
                features.append(feature)
                cuts.append(cut)
                node = node * 2 + (binned[np.arange(len(x)), feature[node]] > cut[node])
            n = 1 << depth
            leaf = rate * np.bincount(node, grad, n) / (np.bincount(node, hess, n) + ridge)
            self.trees.append((features, cuts, leaf))
            raw = raw + leaf[node]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, out, row = self.bins(x), np.full(len(x), self.base), np.arange(len(x))
        for features, cuts, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in zip(features, cuts, strict=True):
                node = node * 2 + (binned[row, feature[node]] > cut[node])
            out += leaf[node]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points, values): the non-decreasing values with least squares to y in order of raw, pooled."""
    points, at = np.unique(raw, return_inverse=True)
    weight, total = np.bincount(at).astype(float), np.bincount(at, y)
    blocks: list[list[float]] = []  # weight, sum, points
    for w, s in zip(weight, total, strict=True):
        blocks.append([w, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, s2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + s2, blocks[-1][2] + n2]
    return points, np.repeat([s / w for w, s, _ in blocks], [int(n) for *_, n in blocks])


class Model:
    """Lexicon, trees and calibration; score() gives numbers of 0 to 1."""

    def __init__(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray, third: np.ndarray):
        self.lexicon, self.trees, self.share = lexicon, None, float(y.mean()) if len(y) else 0.0
        if not 0 < self.share < 1:
            return
        self.trees = Trees(x, y)
        seen, raw = np.zeros(len(y), bool), np.zeros(len(y))
        for f in range(FOLDS):
            own, rest = third == f, third != f
            if own.any() and 0 < y[rest].mean() < 1:
                raw[own], seen[own] = Trees(x[rest], y[rest]).raw(x[own]), True
        if not seen.any():
            raw, seen = self.trees.raw(x), ~seen
        self.points, self.values = isotonic(raw[seen], y[seen])

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        return np.clip(np.interp(self.trees.raw(text_features(texts, self.lexicon)), self.points, self.values), 0, 1)


def _lexicon(counts: list, skip: int | None) -> dict[str, float]:
    """unit -> log odds, from rows (unit, third, toxic, clean), without the rows of one third."""
    total, docs = {}, np.zeros(2)
    for unit, third, toxic, clean in counts:
        if third != skip:
            t = docs if unit == "" else total.setdefault(unit, np.zeros(2))
            t += (toxic, clean)
    out = {}
    for unit, (toxic, clean) in total.items():
        if toxic >= LEAST_TOXIC:
            odds = np.log((toxic + 0.5) / (docs[0] + 1)) - np.log((clean + 0.5) / (docs[1] + 1))
            if odds > LEAST_ODDS and toxic * odds > LEAST_GAIN:
                out[unit] = float(odds)
    return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """The model from documents and their labels; leave out of labels what it must not see."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max((F.col(label) > 0).cast("int")).alias("__y"))
    n = known.count()
    share = min(1.0, max_train / max(1, n))
    # about max_train rows of two numbers
    known = known.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < share * 1_000_000).select(F.col(key).alias("__id"), "__y")
    sample = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(known), "__id")
    sample = materialise(sample.withColumn("__third", F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(FOLDS)).cast("int")))

    def count(batches):
        for batch in batches:
            total: dict[tuple[str, int], list[int]] = {}
            for part in text_slices(batch, "__text"):
                ys, thirds = part.column("__y").to_pylist(), part.column("__third").to_pylist()
                codes, bounds, words = split_words(part.column("__text"), lower=False)
                known_units = [units(plain(w)) for w in words.to_pylist()]
                for i, (y, third) in enumerate(zip(ys, thirds, strict=True)):
                    own = {u for c in np.unique(codes[bounds[i] : bounds[i + 1]]) for u in known_units[c]}
                    for u in (*own, ""):
                        total.setdefault((u, third), [0, 0])[1 - y] += 1
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total]), pa.array([k[1] for k in total], pa.int32()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.int64())], names=["unit", "third", "toxic", "clean"])

    counted = sample.mapInArrow(count, "unit string, third int, toxic long, clean long").groupBy("unit", "third").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    thirds = {r["third"]: (r["toxic"], r["clean"]) for r in counted.where("unit = ''").collect()}  # FOLDS rows
    part = lambda name, f: F.sum(F.when(F.col("third") == f, F.col(name)).otherwise(0))
    by_unit = counted.where("unit != ''").groupBy("unit").agg(*[part(name, f).alias(f"{name}{f}") for name in ("toxic", "clean") for f in range(FOLDS)])
    kept = F.lit(False)
    for skip in (None, *range(FOLDS)):
        own = [f for f in range(FOLDS) if f != skip]
        docs_of = [sum(thirds.get(f, (0, 0))[i] for f in own) for i in (0, 1)]
        t, c = (sum((F.col(f"{name}{f}") for f in own[1:]), F.col(f"{name}{own[0]}")) for name in ("toxic", "clean"))
        odds = F.log((t + 0.5) / (docs_of[0] + 1)) - F.log((c + 0.5) / (docs_of[1] + 1))
        kept = kept | ((t >= LEAST_TOXIC) & (odds > LEAST_ODDS) & (t * odds > LEAST_GAIN))
    found = by_unit.where(kept).collect()  # what some third's lexicon holds: words of the sample
    counts = [("", f, *n) for f, n in sorted(thirds.items())] + [(r["unit"], f, r[f"toxic{f}"], r[f"clean{f}"]) for r in sorted(found) for f in range(FOLDS)]
    parts = [_lexicon(counts, f) for f in range(FOLDS)]

    def features(batches):
        for batch in batches:
            for part in text_slices(batch, "__text"):
                third = np.asarray(part.column("__third"))
                x = np.zeros((part.num_rows, FEATURES), np.float32)
                for f in np.unique(third):
                    own = np.flatnonzero(third == f)
                    x[own] = text_features(part.column("__text").take(pa.array(own)), parts[f])
                yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("__y"), part.column("__third"), pa.array(x.tolist(), pa.list_(pa.float32()))], names=["id", "y", "third", "x"])

    kind = docs.schema[key].dataType.simpleString()
    rows = sample.mapInArrow(features, f"id {kind}, y int, third int, x array<float>").orderBy("id", "third").toArrow()
    x = np.array(rows["x"].to_pylist(), np.float64).reshape(-1, FEATURES)
    return Model(_lexicon(counts, None), x, np.asarray(rows["y"]).astype(float), np.asarray(rows["third"]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score and predicted."""
    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, text):
                s = model.score(batch.column(text))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs.select("doc_id", "text"), labels.where(fold("doc_id", 5) != 0).select("doc_id", "toxic"))
    out = score(docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", "predicted")
