"""The queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from strandlog.llm import chat, decontaminate, mixing
from strandlog.llm.context_tree import language_model_table
from strandlog.llm.language import language_table
from strandlog.llm.ngram_join import similar_components
from strandlog.llm.quality import quality_table
from strandlog.llm.repeats import repeats_table
from strandlog.llm.sharding import shard_table
from strandlog.llm.toxicity import toxicity_table


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def op1_suffix_dedup(spark, sf_dir):
    return repeats_table(documents(spark, sf_dir))


def op2_decontamination(spark, sf_dir):
    return decontaminate.found_items(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark, sf_dir):
    return toxicity_table(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark, sf_dir):
    return quality_table(documents(spark, sf_dir))


def op5_chat_formatting(spark, sf_dir):
    return chat.pair_table(table(spark, sf_dir, "conversations"))


def op6_sharding(spark, sf_dir):
    return shard_table(documents(spark, sf_dir))


def op7_mixing(spark, sf_dir):
    return mixing.mix_table(documents(spark, sf_dir))


def op8_lm_scoring(spark, sf_dir):
    return language_model_table(documents(spark, sf_dir))


def op9_language_id(spark, sf_dir):
    return language_table(documents(spark, sf_dir))


def op10_ngram_jaccard_join(spark, sf_dir):
    return similar_components(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_decontamination, op3_toxicity, op4_quality_rules, op5_chat_formatting, op6_sharding, op7_mixing, op8_lm_scoring, op9_language_id, op10_ngram_jaccard_join)}

ORACLE: dict[str, str] = {"op2_decontamination": decontaminate.ORACLE, "op5_chat_formatting": chat.ORACLE, "op7_mixing": mixing.oracle()}
