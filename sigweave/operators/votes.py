"""Weighted votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalised(votes: DataFrame, key: str = "k", value: str = "v", score: str = "score", weight: str = "weight") -> DataFrame:
    """(key, value, vote): the value's scores over all weights of the key; 0 for a key without weight."""
    sums = votes.groupBy(key, value).agg(F.sum(score).alias("__s"), F.sum(weight).alias("__w"))
    total = F.sum("__w").over(Window.partitionBy(key))
    return sums.select(key, value, F.when(total == 0, 0.0).otherwise(F.try_divide(F.col("__s"), total)).alias("vote"))


def best(votes: DataFrame, key: str = "k", value: str = "v", vote: str = "vote") -> DataFrame:
    """(key, value, vote): the value with the largest vote, the smaller value if votes are equal."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(vote), value))
    return votes.withColumn("__r", rank).where("__r = 1").select(key, value, vote)


def set_votes(pairs: DataFrame, left_sets: DataFrame, right_sets: DataFrame, left: str = "l", right: str = "a", item: str = "item") -> DataFrame:
    """(k, v, score, weight) from every pair of items of matched sets: pairs (left, right, sim, w) vote w * sim / (n * m) with weight w each."""
    n = left_sets.groupBy(left).agg(F.count("*").alias("__n"))
    m = right_sets.groupBy(right).agg(F.count("*").alias("__m"))
    rows = pairs.join(left_sets.withColumnRenamed(item, "k"), left).join(right_sets.withColumnRenamed(item, "v"), right).join(n, left).join(m, right)
    return rows.select("k", "v", (F.col("w") * F.col("sim") / (F.col("__n") * F.col("__m"))).alias("score"), F.col("w").alias("weight"))


def blended(content: Column, vote: Column, importance: float = 0.99) -> Column:
    """Similarity for rematching: the content's, and with `importance` the votes'."""
    return (1 - importance) * content + importance * F.coalesce(vote, F.lit(0.0))


def next_similarity(vote: Column, initial: Column, left_methods: Column, right_methods: Column) -> Column:
    """The next round's similarity of a pair: its vote, 0 if the right one has more methods; pairs that were equal at first keep 1e-6."""
    v = F.when(right_methods > left_methods, 0.0).otherwise(F.coalesce(vote, F.lit(0.0)))
    return F.when(initial == 1, F.greatest(v, F.lit(1e-6))).otherwise(v)


def shared_kgrams(pairs: DataFrame, left_units: DataFrame, right_units: DataFrame, left: str = "l", right: str = "a") -> DataFrame:
    """pairs with (h, pos) and both sides' unit, for every unit of every k-gram that a pair's methods share.

    Units: (left or right, h, pos, unit), the units of the k-grams that count, a struct at each place. A unit that lies in several shared k-grams comes once for each.
    """
    l = left_units.withColumnRenamed("unit", "left_unit")  # noqa: E741
    return pairs.join(l, left).join(right_units.withColumnRenamed("unit", "right_unit"), [right, "h", "pos"])


def code_votes(shared: DataFrame, least: float = 0.0) -> DataFrame:
    """(k, v, score, weight): types at the same place of shared k-grams vote for each other. shared: shared_kgrams() of pairs with (sim, class_sim, w, l_class, a_class,
    constructor: whether the application's method is one); a unit has an array `refs`. A vote counts w * sim * class_sim, if that is over 0 and sim * class_sim reaches
    `least`; constructors don't vote for their own class, and null is no type."""
    score = F.col("w") * F.col("sim") * F.col("class_sim")
    places = F.arrays_zip(F.col("left_unit.refs").alias("k"), F.col("right_unit.refs").alias("v"))
    cast = shared.where((score > 0) & (F.col("sim") * F.col("class_sim") >= least)).select("a_class", "constructor", score.alias("score"), F.col("w").alias("weight"), F.explode(places).alias("place"))
    own = F.col("constructor") & (F.col("place.v") == F.col("a_class"))
    return cast.where(F.col("place.k").isNotNull() & F.col("place.v").isNotNull() & ~own).select("place.k", "place.v", "score", "weight")


def call_votes(shared: DataFrame, matching: DataFrame, least: float = 0.0) -> DataFrame:
    """(cls, k, v, score, weight): callees at the same place of shared k-grams vote for each other, by their place in their classes, where these are matched. shared as for
    code_votes; a unit has (invokes, ref_cls, ref_idx). matching: (l_class, a_class)."""
    score = F.col("w") * F.col("sim") * F.col("class_sim")
    both = F.col("left_unit.invokes") & F.col("right_unit.invokes")
    cast = shared.where(both & (score > 0) & (F.col("sim") * F.col("class_sim") >= least))
    cast = cast.select(F.col("left_unit.ref_cls").alias("cls"), F.col("right_unit.ref_cls").alias("other"), F.col("left_unit.ref_idx").alias("k"), F.col("right_unit.ref_idx").alias("v"), score.alias("score"), F.col("w").alias("weight"))
    return cast.join(matching.select(F.col("l_class").alias("cls"), F.col("a_class").alias("other")), ["cls", "other"]).drop("other")


def superclass_votes(pairs: DataFrame, least: float = 0.0) -> DataFrame:
    """(k, v, score, weight): superclasses of matched classes (l_super, a_super, sim, w) vote for each other, if sim reaches `least` and counts at all."""
    counts = F.col("l_super").isNotNull() & F.col("a_super").isNotNull() & (F.col("sim") >= least) & (F.col("w") * F.col("sim") > 0)
    return pairs.where(counts).select(F.col("l_super").alias("k"), F.col("a_super").alias("v"), (F.col("w") * F.col("sim")).alias("score"), F.col("w").alias("weight"))


def class_similarity(pairs: DataFrame, weights: DataFrame, keys: list[str], least: float = 0.1) -> DataFrame:
    """(keys, sim): of matched classes by their matched methods (keys, sim, w): the similarities' mean by weight over the library class's weight (keys, weight), 0 if it is
    under `least`; classes without matched methods have 0."""
    sums = pairs.groupBy(*keys).agg(F.sum(F.col("sim") * F.col("w")).alias("__s"))
    sim = F.least(F.coalesce(F.try_divide("__s", "weight"), F.lit(0.0)), F.lit(1.0))
    return weights.join(sums, keys, "left").select(*keys, F.when(sim < least, 0.0).otherwise(sim).alias("sim"))


def match_and_cover(pairs: DataFrame, totals: DataFrame, keys: list[str], threshold: Column) -> DataFrame:
    """(keys, match, cover, found): of a library's matched classes (keys, sim, w), the similarity by weight, and the part of the library's weight (keys, size) that they have;
    found is whether their product reaches the threshold, a column of size. Nothing matched is not found."""
    sums = pairs.groupBy(*keys).agg(F.sum(F.col("sim") * F.col("w")).alias("__s"), F.sum("w").alias("__w"))
    rows = totals.join(sums, keys, "left").select(*keys, "size", F.try_divide("__s", "__w").alias("match"), F.try_divide("__w", "size").alias("cover"))
    return rows.select(*keys, "match", "cover", F.coalesce(F.col("match") * F.col("cover") >= threshold, F.lit(False)).alias("found"))
