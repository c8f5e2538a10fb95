"""Thresholds, candidate windows and conflict resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigweave.functions.formula import compile_formula

# The default formulas and the candidate window's width.
SKETCH_THRESHOLD = "max(0.1 + pop, 0.9 - 0.2 * log10(max(1, size)))"
DETECTION_THRESHOLD = "max(0.1, 0.7 - 0.15 * log10(max(1, size)))"
SCAN_RANGE = 0.03


def sketch_threshold(size: Column, pop: Column, formula: str = SKETCH_THRESHOLD) -> Column:
    return compile_formula(formula, {"size": size, "pop": pop})


def detection_threshold(size: Column, formula: str = DETECTION_THRESHOLD) -> Column:
    return compile_formula(formula, {"size": size})


def sketch_filter(scores: DataFrame, pop: Column, score: str = "score", size: str = "size", formula: str = SKETCH_THRESHOLD) -> DataFrame:
    """Rows whose score reaches the threshold for their size; scores that aren't numbers go."""
    return scores.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.col(score) >= sketch_threshold(F.col(size), pop, formula)))


def scan_window(scores: DataFrame, score: str = "score", within: list[str] | None = None, width: float = SCAN_RANGE) -> DataFrame:
    """Rows with a score over min(best - width, second best distinct score, 0 if there is none)."""
    within = within or []
    best = scores.groupBy(*within).agg(F.max(score).alias("__best"))
    both = scores.join(best, within) if within else scores.crossJoin(F.broadcast(best))  # one row
    second = F.max(F.when(F.col(score) < F.col("__best"), F.col(score)))  # of distinct scores
    tops = both.groupBy(*within).agg(F.least(F.max("__best") - width, F.coalesce(second, F.lit(0.0))).alias("__over"))
    joined = scores.join(tops, within) if within else scores.crossJoin(F.broadcast(tops))  # one row
    return joined.where(F.col(score) > F.col("__over")).drop("__over")


def resolve(results: DataFrame, members: DataFrame, key: str = "result", member: str = "member", order: list[Column] | None = None, within: list[str] | None = None) -> DataFrame:
    """results with `accepted`: no result that stands before it in order holds a member of it. Members with several results
    decide by their first: a result is accepted if it is the first of all its members."""
    within = within or []
    order = order or [F.desc("match"), F.desc("cover"), F.asc(key)]
    ranked = results.withColumn("__rank", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
    held = members.join(ranked.select(*within, key, "__rank"), [*within, key])
    first = held.groupBy(*within, member).agg(F.min("__rank").alias("__first"))
    lost = held.join(first, [*within, member]).where("__rank > __first").select(*within, key).distinct().withColumn("__lost", F.lit(True))
    return ranked.join(lost, [*within, key], "left").withColumn("accepted", F.col("__lost").isNull()).drop("__rank", "__lost")


def progress(results: DataFrame) -> DataFrame:
    """(round, scanned, accepted) of detection results: the results of each round so far, and those accepted."""
    rounds = results.groupBy("round").agg(F.count("*").alias("found"), F.count_if("accepted").alias("taken"))  # one row per round from here on
    so_far = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return rounds.select("round", F.sum("found").over(so_far).alias("scanned"), F.sum("taken").over(so_far).alias("accepted"))


def error_counts(matches: DataFrame, truth: DataFrame, key: str, found: str) -> DataFrame:
    """(correct, wrong_assignment, wrong_detection, unmatched): of (key, found) against the names `truth` holds.

    A key that truth has should be found as itself: found as another it is a wrong assignment, not found at all
    unmatched; a key that truth lacks but that was found is a wrong detection.
    """
    known = truth.select(F.col(key).alias("__t")).distinct().withColumn("__known", F.lit(True))
    both = matches.join(known, matches[key] == known["__t"], "left")
    has, same = F.col("__known").isNotNull(), F.col(found).eqNullSafe(F.col(key))
    return both.agg(
        F.count_if(has & same).alias("correct"), F.count_if(has & ~same & F.col(found).isNotNull()).alias("wrong_assignment"),
        F.count_if(~has & F.col(found).isNotNull()).alias("wrong_detection"), F.count_if(has & F.col(found).isNull()).alias("unmatched"),
    )
