"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the keys define the order in which documents are taken; token
counts are summed by key range, the ranges' prefix sums find the one range that holds the source's cut, and only
that range is sorted to find the cut itself. A document is then taken by comparing its key with its source's cut.
Budgets over a source's size repeat it: whole epochs first, then the part up to the cut.

Data moved: one small row per (source, key range), one range per source, and the cuts (one row per source), which
are broadcast only up to MAX_BROADCAST sources. What depends on all sources at once (their order, and the level at
which targets stop) sorts one row per source in one task, which spills; documents never pass through it.

Defined results: null text has size 0; texts of any length are counted whole; a null source is a source of its own, last in order; a source of size 0 has
target 0; equal rows (same key, id and size) at a cut share what is left evenly, rounded down; an empty table gives
no rows; other columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, table

MAX_BROADCAST = 10_000  # rows of the cut table
ROWS_A_RANGE = 1024  # aimed at, of a key range
KEY_BITS = 60


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(key: str, seed: int) -> Column:
    """60 bits of md5("seed:id")."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, repeats: float) -> DataFrame:
    """(__s, source_size, target) of each source, from rows (__s, __size).

    Sources in order of their code points, null last, weigh weights[0], weights[1], ... repeating. The target is
    min(repeats * size, level * weight) at the one level at which the targets sum to share * all sizes. For sources
    in order of repeats * size / weight, what is left after the sources before, over the weights from here on, is
    largest at that level.
    """
    by = sizes.groupBy("__s").agg(F.sum("__size").alias("source_size"))
    # one row per source from here on
    order = Window.orderBy(F.substring("__s", 1, 1).desc(), "__s")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("__w", weight).withColumn("__cap", repeats * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("__cap") / F.col("__w"), "__s").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum(F.col("source_size")).over(everything) * share - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / (F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    by = by.withColumn("__level", level).withColumn("__level", F.max("__level").over(everything))
    return by.select("__s", "source_size", F.least("__cap", F.col("__w") * F.col("__level")).alias("target"))


def cuts(docs: DataFrame, key: str, weights: tuple[float, ...], share: float, repeats: float) -> tuple[DataFrame, int]:
    """One row per source: its target, whole epochs, and the (key, id, size) at which its last epoch is cut, with the
    words that each document there gives. docs: rows (key, __s, __size, __key)."""
    n = docs.count()
    bits = min(24, max(6, math.ceil(math.log2(max(1, n) / ROWS_A_RANGE))))
    plan = targets(docs, weights, share, repeats)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    some = F.greatest(F.col("source_size"), F.lit(1))
    plan = materialise(plan.withColumn("__epochs", F.floor(budget / some).cast("long")).withColumn("__rest", budget - F.col("__epochs") * F.col("source_size")))
    sources = plan.count()
    small = F.broadcast(plan) if sources <= MAX_BROADCAST else plan
    ranged = docs.withColumn("__range", F.shiftright("__key", KEY_BITS - bits))
    sums = ranged.groupBy("__s", "__range").agg(F.sum("__size").alias("__sum"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.partitionBy("__s").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    holding = sums.join(small, "__s").where("__before <= __rest and __rest < __before + __sum").select("__s", "__range", "__before", "__rest")
    holding = F.broadcast(holding) if sources <= MAX_BROADCAST else holding
    inside = ranged.join(holding, ["__s", "__range"]).groupBy("__s", "__rest", "__before", "__key", key, "__size").agg(F.count("*").alias("__same"))
    inside = inside.withColumn("__sum", F.col("__same") * F.col("__size"))
    inside = inside.withColumn("__at", F.col("__before") + F.coalesce(F.sum("__sum").over(Window.partitionBy("__s").orderBy("__key", key, "__size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = inside.where("__at <= __rest and __rest < __at + __sum").select(
        "__s", F.col("__key").alias("__cut_key"), F.col(key).alias("__cut_id"), F.col("__size").alias("__cut_size"), F.floor((F.col("__rest") - F.col("__at")) / F.col("__same")).cast("long").alias("__part")
    )
    return plan.join(cut, "__s", "left"), sources


def keyed(docs: DataFrame, key: str, text: str, source: str, seed: int, keep: list[Column]) -> DataFrame:
    named = F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    return docs.select(*keep, named.alias("__s"), word_count(text).alias("__size"), random_key(key, seed).alias("__key"))


def taken(key: str) -> Column:
    """Words taken of a row joined with its source's cut."""
    k, c = F.struct("__key", key, "__size"), F.struct(F.col("__cut_key"), F.col("__cut_id"), F.col("__cut_size"))
    part = F.when(F.col("__cut_key").isNull(), 0).when(k < c, F.col("__size")).when(k == c, F.col("__part")).otherwise(0)
    return (F.col("__epochs") * F.col("__size") + part).cast("long")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: float = 2.0, seed: int = 0) -> DataFrame:
    """(key, source, size, source_size, target, taken) of each document."""
    rows = materialise(keyed(docs, key, text, source, seed, [F.col(key), F.col(source)]))
    cut, sources = cuts(rows, key, weights, share, repeats)
    joined = rows.join(F.broadcast(cut) if sources <= MAX_BROADCAST else cut, "__s")
    return joined.select(key, source, F.col("__size").alias("size"), "source_size", "target", taken(key).alias("taken"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", chars: str = "n_chars", **how) -> DataFrame:
    """The mix itself, with the columns of docs: a document once for each time that it is taken whole, and a document
    at its source's cut also with its first words, as many as the budget has left."""
    params = {"weights": (3, 1, 2), "share": 1.5, "repeats": 2.0, "seed": 0} | how
    seed = params.pop("seed")
    rows = materialise(keyed(docs, key, text, source, seed, [F.col(key), F.col(source)]))
    cut, sources = cuts(rows, key, **params)
    cut = cut.drop("source_size", "target")
    whole = keyed(docs, key, text, source, seed, [F.col(c) for c in docs.columns]).join(F.broadcast(cut) if sources <= MAX_BROADCAST else cut, "__s").withColumn("__taken", taken(key))
    size = F.greatest(F.col("__size"), F.lit(1))
    copies = F.floor(F.col("__taken") / size).cast("int")
    rest = (F.col("__taken") - copies * F.col("__size")).cast("int")
    times = F.concat(F.array_repeat(F.lit(-1), copies), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    out = whole.withColumn("__times", F.explode(times))
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    cutoff = F.col("__times") >= 0
    out = out.withColumn(text, F.when(cutoff, F.array_join(F.slice(words, 1, F.greatest(F.col("__times"), F.lit(0))), " ")).otherwise(F.col(text)))
    if chars in docs.columns:
        out = out.withColumn(chars, F.when(cutoff, F.length(text).cast("long")).otherwise(F.col(chars)))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS s,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k
  FROM documents),
o AS (SELECT s, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY s[1] DESC, s) - 1 AS i FROM d GROUP BY s),
w AS (SELECT s, source_size, CASE i % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w, (2 * source_size)::DOUBLE AS cap FROM o),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS t
      FROM w WINDOW p AS (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT s, source_size, least(cap, w * max(t) OVER ()) AS target FROM l),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget, greatest(source_size, 1) AS n FROM g),
x AS (SELECT d.*, b.source_size, b.target, budget // n AS epochs, budget - (budget // n) * source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY d.s ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
      FROM d JOIN b ON d.s = b.s)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - a)))::BIGINT AS taken FROM x
"""
