"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _held(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key) of the partitions key=... that exist under path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    return spark.createDataFrame([(unescape(n.split("=", 1)[1]),) for n in names if n.startswith(f"{key}=")], f"`{key}` string")


def _write(df: DataFrame, path: str, key: str, form: str, force: bool) -> None:
    """df into folders key=... of path: those that exist stay, or with force, those that df has are replaced; no other one changes."""
    if force:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).format(form).save(path)
    else:
        df.join(_held(df.sparkSession, path, key), key, "left_anti").write.mode("append").partitionBy(key).format(form).save(path)


def write_json(results: DataFrame, path: str, force: bool = False) -> None:
    """One folder of JSON per application under path. An application that has one keeps it unless forced; others' results stay in either case."""
    _write(results, path, "app", "json", force)


def write_index(index: DataFrame, path: str, force: bool = True) -> None:
    """A catalogue index, {digest: [versions]} per library. Only the libraries of `index` are written."""
    maps = index.groupBy("library").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("digest", "versions")))).alias("versions"))
    _write(maps.select("library", F.to_json("versions").alias("value")), path, "library", "text", force)


def report(results: DataFrame) -> DataFrame:
    """A line per detection, best first."""
    line = F.format_string("%s: %s match %.5f%%, coverage %.5f%%%s", "app", "library", F.col("match") * 100, F.col("cover") * 100, F.when(F.col("accepted"), "").otherwise(" (alternative)"))
    return results.orderBy("app", "round", F.desc("match"), F.desc("cover")).select("app", line.alias("line"))
