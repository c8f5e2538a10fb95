"""Weights rolled up along dotted names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROOT = ""
DEFAULT = "<default package>"


def prefixes(name: Column, separator: str = ".") -> Column:
    """The root and every proper prefix of a name's parts."""
    parts = F.split(name, "\\" + separator if separator in ".|$^*+?()[]{}\\" else separator)
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), separator))


def rollup(rows: DataFrame, name: str, weight: str, separator: str = ".") -> DataFrame:
    """(prefix, depth, weight): every package's weight with all below it. Weights of equal names are summed before they spread to prefixes."""
    named = rows.groupBy(name).agg(F.sum(weight).alias("__w"))
    spread = named.select(F.posexplode(prefixes(F.col(name), separator)).alias("depth", "prefix"), "__w")
    return spread.groupBy("prefix", "depth").agg(F.sum("__w").alias("weight"))


def own_share(nodes: DataFrame, separator: str = ".") -> DataFrame:
    """nodes (prefix, depth, weight) with own (what no child package has), children, and both as shares of the root."""
    cut = F.length("prefix") - F.length(F.substring_index("prefix", separator, -1)) - len(separator)
    parent = F.when(F.col("depth") > 1, F.expr("prefix").substr(F.lit(1), cut)).otherwise(F.lit(ROOT))
    below = nodes.where("depth > 0").groupBy(parent.alias("prefix")).agg(F.sum("weight").alias("__below"), F.count("*").alias("children"))
    all_ = nodes.join(below, "prefix", "left").withColumn("children", F.coalesce("children", F.lit(0))).withColumn("own", F.col("weight") - F.coalesce("__below", F.lit(0)))
    root = nodes.where("depth = 0").select(F.col("weight").alias("__total"))
    return all_.crossJoin(F.broadcast(root)).select("prefix", "depth", "weight", "own", "children", F.try_divide("own", "__total").alias("own_share"), F.try_divide("weight", "__total").alias("total_share"))


def collapsed(shares: DataFrame) -> DataFrame:
    """Without packages that have a single child and nothing of their own, which their child's longer name stands for; the root stays."""
    return shares.where("depth = 0 OR own != 0 OR children != 1")


def rendered(shares: DataFrame, collapse: bool = False) -> DataFrame:
    """(prefix, line): a report line for each package, in order of the tree; with collapse, without those that their only child stands for, and indented by what is left above."""
    if collapse:
        left = collapsed(shares)
        above = left.select(F.col("prefix").alias("__above"))
        up = left.select("prefix", F.explode(F.array_distinct(prefixes(F.col("prefix")))).alias("__above")).join(above, "__above").where("__above != prefix")
        shares = left.drop("depth").join(up.groupBy("prefix").agg(F.count("*").alias("depth")), "prefix", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    label = F.when(F.col("prefix") == ROOT, DEFAULT).otherwise(F.col("prefix"))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), label, F.format_string(" %.5f%%", F.col("own_share") * 100), F.when(F.col("children") > 0, F.format_string(" (%.5f%%)", F.col("total_share") * 100)).otherwise(""))
    return shares.select("prefix", line.alias("line"))
