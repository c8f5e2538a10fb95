"""The queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from . import chat, flac, language_id, lm_scoring, mixing, near_dedup, packing, substring_dedup, topk, toxicity

OPERATORS = {
    "op1_deleted_interpolation": lm_scoring,
    "op2_source_mixing": mixing,
    "op3_ball_tree_top_k": topk,
    "op4_flac_media": flac,
    "op5_minhash_near_dedup": near_dedup,
    "op6_substring_dedup": substring_dedup,
    "op7_best_fit_packing": packing,
    "op8_language_id": language_id,
    "op9_toxicity": toxicity,
    "op10_perspective_rotation": chat,
}


def queries() -> dict:
    import corpus_pipeline

    return {name: module.query for name, module in OPERATORS.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in OPERATORS.items() if getattr(module, "SQL", None)}
