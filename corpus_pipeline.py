"""A training corpus from raw documents: toxic ones out, one of each near-duplicate group, repeated passages once, sources mixed to target weights, and the mix packed into sequences.

Each stage is a function of (spark, docs, sf_dir). What it returns is written and read again as the next one's docs.
All but the last return the columns of documents.

Defined results, beyond those that each operator states: rows may share an id or have none, and are judged each by their own text;
null and empty texts are never toxic, no near duplicates, have nothing to take out, add no words to the mix and pack as one end
token; null sources are a source; labels of documents that aren't there teach nothing; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.llm import mixing, near_dedup, packing, substring_dedup, toxicity
from sigweave.llm.common import fold, materialise, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (9) doesn't find toxic. It learns from labelled documents of this table, without those whose fold is held out."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0).select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__doc")
    scored = toxicity.score(docs.select(rest, F.col("text").alias("__text")), model, "__text").where("predicted = 0")
    return scored.select(*[F.col("__text").alias(c) if c == "text" else F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5): five-word shingles, similarity 0.8 or more."""
    return near_dedup.representatives(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of passages of 40 words or more (6)."""
    return substring_dedup.deduplicated(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights (2): documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as sequences of at most 1024 tokens (7)."""
    return packing.packed(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup_stage),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Trees, MinHash and tokenizers have no SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
