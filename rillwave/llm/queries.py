"""The registered queries of the subpackage: thin callers of its operators over whole tables."""

from __future__ import annotations

import corpus_pipeline

from rillwave.llm import bpe, chat, exact_dedup, html_text, language, mixing, near_dedup, pii, quality, toxicity
from rillwave.llm.common import table


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_html_text(spark, sf_dir):
    return html_text.query(spark, sf_dir)


def op3_bpe(spark, sf_dir):
    return bpe.query(spark, sf_dir)


def op4_pii(spark, sf_dir):
    return pii.query(spark, sf_dir)


def op5_chat(spark, sf_dir):
    return chat.query(spark, sf_dir)


def op6_mixing(spark, sf_dir):
    return mixing.query(spark, sf_dir)


def op7_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op8_toxicity(spark, sf_dir):
    return toxicity.query(spark, sf_dir)


def op9_language(spark, sf_dir):
    return language.query(spark, sf_dir)


def op10_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"))


def queries():
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_html_text": op2_html_text,
        "op3_bpe": op3_bpe,
        "op4_pii": op4_pii,
        "op5_chat": op5_chat,
        "op6_mixing": op6_mixing,
        "op7_near_dedup": op7_near_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_language": op9_language,
        "op10_quality": op10_quality,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op1_exact_dedup": exact_dedup.ORACLE,
        "op5_chat": chat.ORACLE,
        "op6_mixing": mixing.ORACLE,
        "op7_near_dedup": near_dedup.ORACLE,
        "op10_quality": quality.ORACLE,
    }
