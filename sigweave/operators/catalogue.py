"""Catalogues of artifact versions by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_index(artifacts: DataFrame, library: str, version: str, digest: str) -> DataFrame:
    """(library, digest, versions, representative, label): versions of equal content, in lexicographic order; the first stands for all."""
    grouped = artifacts.groupBy(library, digest).agg(F.sort_array(F.collect_set(F.col(version).cast("string"))).alias("versions"))
    return grouped.select(library, digest, "versions", F.element_at("versions", 1).alias("representative"), F.array_join("versions", ", ").alias("label"))


def representatives(artifacts: DataFrame, library: str, version: str, digest: str) -> DataFrame:
    """artifacts that stand for their content."""
    first = artifacts.groupBy(library, digest).agg(F.min(F.col(version).cast("string")).alias(version))
    return artifacts.join(first.select(library, version), [library, version], "left_semi")


def remaining(classes: DataFrame, accepted: DataFrame, keys: list[str]) -> DataFrame:
    """classes that no accepted result has taken."""
    return classes.join(accepted, keys, "left_anti")
