"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradeloom.llm import ann, chosen_path, exact_dedup, hard_negatives, mixing, neural_lm, phrases, pii, quality, sentence_piece, sharding, token_file, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_quality": quality.op2_quality,
        "op3_ann": ann.op3_ann,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_sentence_piece": sentence_piece.op5_sentence_piece,
        "op6_near_duplicates": chosen_path.op6_near_duplicates,
        "op7_token_file": token_file.op7_token_file,
        "op8_pii": pii.op8_pii,
        "op9_sharding": sharding.op9_sharding,
        "op10_mixing": mixing.op10_mixing,
        "op11_phrases": phrases.op11_phrases,
        "op12_lm_score": neural_lm.op12_lm_score,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": exact_dedup.ORACLE_SQL,
        "op10_mixing": mixing.ORACLE_SQL,
        "op11_phrases": phrases.op11_phrases,
        "op11_phrases": phrases.ORACLE_SQL,
        "op13_hard_negatives": hard_negatives.ORACLE_SQL,
    }
