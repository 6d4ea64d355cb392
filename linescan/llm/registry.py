"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat_template, decontaminate, mixing, ngram_join, pii, quality, substring_dedup, tokens, warc_zip


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op4_chat_template": chat_template.op4_chat_template,
        "op5_learned_partitions": ann.op5_learned_partitions,
        "op6_pii_crf": pii.op6_pii_crf,
        "op1_warc_zip": warc_zip.op1_warc_zip,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op10_decontamination": decontaminate.op10_decontamination,
        "op3_ngram_jaccard_join": ngram_join.op3_ngram_jaccard_join,
        "op7_mixing": mixing.op7_mixing,
        "op9_token_blocks": tokens.op9_token_blocks,
        "op8_quality_classifier": quality.op8_quality_classifier,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_zip": warc_zip.SQL, "op4_chat_template": chat_template.SQL, "op2_substring_dedup": substring_dedup.SQL, "op3_ngram_jaccard_join": ngram_join.SQL, "op10_decontamination": decontaminate.SQL}
