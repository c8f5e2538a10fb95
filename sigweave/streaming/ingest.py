"""A corpus that grows: new text files or tables in a landing folder become k-grams as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.operators.kgrams import windows_of


def arriving(spark: SparkSession, path: str, schema: T.StructType, files_a_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that land under path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def arriving_kgrams(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(key, kgram) of each arriving text's words; no state is kept."""
    words = F.filter(F.split(F.col(text), "[ \n]+"), lambda w: w != "")
    return docs.select(key, F.explode(windows_of(words, k)).alias("kgram")).select(key, F.array_join("kgram", " ").alias("kgram"))


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Writes a stream once for all that has arrived, exactly once per row over restarts."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
