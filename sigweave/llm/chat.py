"""Multi-party perspective rotation: each participant's view of a dialogue, as chat segments with loss masks.

For each participant of a conversation (a role other than `system`) the dialogue is rendered with that participant as
the assistant, every other speaker as a named user, and system turns as they are. A view is one row per turn, with
the place of its text in the rendered view; a view's text is its segments put together in order of `position`. The
mask covers what the assistant is to learn: its content and the end mark, and no header; it is empty, at the segment's
end, for all others.

Only DataFrame functions. No conversation is gathered in one row, joined or sorted in one task: distinct turns are sorted by
range, so that a long conversation lies in many ranges (its spans); prefix sums over the spans place each span, a window
inside the span places each turn, and equal turns count as one until the end.

Defined results: turns stand in order of (turn, role, text), nulls first; null text is empty; a null role is a user
named `unknown` and no participant; conversations without participants give no rows; repeated turns stay; a null
conv_id is one conversation; texts of any length are taken whole; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, table

SYSTEM = "system"
UNKNOWN = "unknown"
END = "<|end|>\n"


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", spans: int | None = None) -> DataFrame:
    """(conv, perspective, position, turn, speaker, chat_role, name, segment, char_start, char_end, mask_start, mask_end, masked). spans: ranges that all turns are sorted into, as the session's shuffles if None."""
    rows = turns.select(
        F.col(conv).alias("__conv"), F.col(turn).cast("long").alias("__turn"), F.col(role).cast("string").alias("__role"), F.coalesce(F.col(text), F.lit("")).alias("__text"),
        F.coalesce(F.concat(F.lit("c"), F.col(conv).cast("string")), F.lit("n")).alias("__c"),
    )
    alike = rows.groupBy("__c", "__conv", "__turn", "__role", "__text").agg(F.count("*").alias("__times"))
    order = ["__turn", "__role", "__text"]
    ranged = alike.repartitionByRange(spans or partitions(turns.sparkSession), "__c", *order)
    held = materialise(ranged.withColumn("__span", F.spark_partition_id()))  # the spans are fixed by being written
    parts = held.where(F.col("__role") != SYSTEM).select("__c", F.col("__role").alias("__self")).distinct()
    views = held.join(held.select("__c", "__span").distinct().join(parts, "__c"), ["__c", "__span"])
    own = F.col("__role").eqNullSafe(F.col("__self"))
    system = F.coalesce(F.col("__role") == SYSTEM, F.lit(False))
    chat_role = F.when(own, "assistant").when(system, "system").otherwise("user")
    name = F.when(~own & ~system, F.coalesce("__role", F.lit(UNKNOWN)))
    views = views.withColumn("__chat", chat_role).withColumn("__name", name)
    head = F.concat(F.lit("<|"), F.col("__chat"), F.coalesce(F.concat(F.lit(" name="), F.col("__name")), F.lit("")), F.lit("|>\n"))
    views = views.withColumn("__head", F.length(head)).withColumn("__len", (F.length(head) + F.length("__text") + len(END)).cast("long"))
    key = ["__c", "__self", "__span"]
    sums = views.groupBy(*key).agg(F.sum(F.col("__len") * F.col("__times")).alias("__chars"), F.sum("__times").alias("__turns"))
    before = Window.partitionBy("__c", "__self").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)  # one row per span
    sums = sums.select(*key, F.coalesce(F.sum("__chars").over(before), F.lit(0)).alias("__at"), F.coalesce(F.sum("__turns").over(before), F.lit(0)).alias("__nth"))
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = views.withColumn("__in", F.coalesce(F.sum(F.col("__len") * F.col("__times")).over(inside), F.lit(0))).withColumn("__k", F.coalesce(F.sum("__times").over(inside), F.lit(0)))
    placed = placed.join(sums, key).withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1)))
    start = F.col("__at") + F.col("__in") + F.col("__copy") * F.col("__len")
    learns = F.col("__chat") == "assistant"
    return placed.select(
        F.col("__conv").alias(conv), F.col("__self").alias("perspective"), (F.col("__nth") + F.col("__k") + F.col("__copy")).alias("position"), F.col("__turn").alias(turn), F.col("__role").alias("speaker"),
        F.col("__chat").alias("chat_role"), F.col("__name").alias("name"), F.concat(head, F.col("__text"), F.lit(END)).alias("segment"), start.alias("char_start"), (start + F.col("__len")).alias("char_end"),
        (start + F.when(learns, F.col("__head")).otherwise(F.col("__len"))).alias("mask_start"), (start + F.col("__len")).alias("mask_end"), F.when(learns, F.col("__len") - F.col("__head")).otherwise(0).alias("masked"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


SQL = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS self FROM t WHERE role <> 'system'),
v AS (
  SELECT t.*, p.self AS perspective,
         CASE WHEN role IS NOT DISTINCT FROM self THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user' END AS chat_role,
         CASE WHEN role IS DISTINCT FROM self AND coalesce(role <> 'system', true) THEN coalesce(role, 'unknown') END AS name
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|' || chat_role || coalesce(' name=' || name, '') || '|>' || chr(10) AS head FROM v),
s AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM h),
o AS (
  SELECT *, row_number() OVER w - 1 AS position, length(segment) AS n,
         coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text))
SELECT conv_id, perspective, position, turn, role AS speaker, chat_role, name, segment, a AS char_start, a + n AS char_end,
       a + CASE WHEN chat_role = 'assistant' THEN length(head) ELSE n END AS mask_start, a + n AS mask_end,
       CASE WHEN chat_role = 'assistant' THEN n - length(head) ELSE 0 END AS masked
FROM o
"""
