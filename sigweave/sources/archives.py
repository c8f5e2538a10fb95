"""Archive sources: files found by a pattern on their path, with name and version from its groups."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.functions import hashing


def listing(spark: SparkSession, path: str, pattern: str, name_group: int | None = None, version_group: int = 1, name: str = "") -> DataFrame:
    """(path, name, version, content) of all files under path whose whole path matches the pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    full = f"^(?:{pattern})$"
    found = files.where(F.col("path").rlike(full))
    called = F.regexp_extract("path", full, name_group) if name_group else F.lit(name)
    return found.select("path", called.alias("name"), F.regexp_extract("path", full, version_group).alias("version"), "content")


def aar_classes(archives: DataFrame, entry: str = "classes.jar") -> DataFrame:
    """archives with the content of an entry of each; archives without it, or that are no archives, are skipped."""

    def run(frames):
        for pdf in frames:
            keep, inner = [], []
            for content in pdf["content"]:
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        inner.append(z.read(entry))
                    keep.append(True)
                except (KeyError, zipfile.BadZipFile):
                    keep.append(False)
            out = pdf[keep].copy()
            out["content"] = inner
            yield out

    return archives.mapInPandas(run, archives.schema)


def jar_entries(archives: DataFrame, suffix: str = ".class") -> DataFrame:
    """(path, name, version, entry, content) of all entries of each archive with a suffix."""

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                with zipfile.ZipFile(io.BytesIO(r.content)) as z:
                    rows += [(r.path, r.name, r.version, e, z.read(e)) for e in z.namelist() if e.endswith(suffix)]
            yield pd.DataFrame(rows, columns=["path", "name", "version", "entry", "content"])

    return archives.mapInPandas(run, "path string, name string, version string, entry string, content binary")


def catalogued(archives: DataFrame, excluded_pattern: str = "^$") -> DataFrame:
    """(library, version, digest, path, content): archives (path, name, version, content) with their content's hash, without those whose `name version` the pattern matches as a whole; an archive without a version or entries is left out."""
    named = archives.withColumn("__n", F.concat_ws(" ", "name", "version")).where("name != '' AND version != '' AND length(content) > 0")
    return excluded(named, "__n", excluded_pattern).select(F.col("name").alias("library"), "version", hashing.content_hash(F.col("content")).alias("digest"), "path", "content")


def excluded(names: DataFrame, column: str, pattern: str = "^$") -> DataFrame:
    """Rows whose name the exclusion pattern doesn't match as a whole."""
    return names.where(~F.col(column).rlike(f"^(?:{pattern})$"))
