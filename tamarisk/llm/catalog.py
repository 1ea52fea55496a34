"""The registered corpus queries, and their SQL checks where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamarisk.llm import chat, decontaminate, line_dedup, lm_score, merkle, mixing, private_data, quality, secrets, simhash, token_files, vector_codes, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_token_files": token_files.op2_token_files,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_source_mixing": mixing.op4_source_mixing,
        "op5_decontamination": decontaminate.op5_decontamination,
        "op6_simhash_dedup": simhash.op6_simhash_dedup,
        "op7_private_data": private_data.op7_private_data,
        "op8_lm_score": lm_score.op8_lm_score,
        "op9_chat_formatting": chat.op9_chat_formatting,
        "op10_quality_rules": quality.op10_quality_rules,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_warc_captures": warc.op13_warc_captures,
    }


def oracles() -> dict[str, str]:
    return {
        "op1_secret_scan": secrets.OP1_SQL,
        "op3_line_dedup": line_dedup.OP3_SQL,
        "op4_source_mixing": mixing.OP4_SQL,
        "op9_chat_formatting": chat.OP9_SQL,
        "op10_quality_rules": quality.OP10_SQL,
        "op11_vector_codes": vector_codes.OP11_SQL,
        "op12_merkle_manifest": merkle.OP12_SQL,
        "op13_warc_captures": warc.OP13_SQL,
    }
