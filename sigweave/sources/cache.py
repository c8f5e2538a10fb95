"""Derived tables kept beside a corpus: one for each k-gram length and content, made when first asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_key(records: DataFrame) -> str:
    """What tells two contents of a table of records (artifact, cls, record) apart, whatever the order of their rows."""
    hashes = [F.bit_xor(F.xxhash64("artifact", "cls", "record", F.lit(i))) for i in (1, 2)]
    n, a, b = records.agg(F.count("*"), *hashes).first()
    return f"{n:x}-{(a or 0) & (2**64 - 1):016x}{(b or 0) & (2**64 - 1):016x}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to the end there."""
    done = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def cached(records: DataFrame, path: str, k: int, build) -> DataFrame:
    """build(records, k), from path/k=.../content=... if it was written there before for the same records, else written there."""
    spark = records.sparkSession
    at = f"{path}/k={k}/content={content_key(records)}"
    if not exists(spark, at):
        build(records, k).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
