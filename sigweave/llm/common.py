"""What the training-data operators share: their tables, folds and words.

Words are `[^\\x20\\x09-\\x0D]+`; only A-Z is ever lower-cased.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.functions.arrays import hash_strings, listed, mix64, ngram_hashes, string_bytes, text_slices  # noqa: F401
from sigweave.sources.storage import materialise, release, shared_dir  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"

# ---------------------------------------------------------------- tables


def partitions(spark: SparkSession) -> int:
    """As many partitions as the session sets for shuffles, 8 at least."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, modulus: int) -> Column:
    """crc32(key as text) mod modulus; a null key counts as an empty text."""
    col = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


# ---------------------------------------------------------------- words


def split_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, bounds, vocabulary): text i holds the words vocabulary[codes[bounds[i]:bounds[i + 1]]]."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    return listed(pc.ascii_split_whitespace(texts))
