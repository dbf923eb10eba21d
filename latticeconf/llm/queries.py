"""Registered queries of the training-data operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fim_split, hyperlang, license_scan, pii, poisson_mix, simhash_gph, size_tiered, template_decontam, text_density, token_align, token_pack, token_rollup, weak_quality
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.rollup_of(table(spark, sf_dir, "documents"))


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_gph.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix.mix(table(spark, sf_dir, "documents"), poisson_mix.TARGETS, absent="spread")


def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = weak_quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op7_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return size_tiered.assignment(size_tiered.shard(docs), docs.schema, ["doc_id"])


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_density.main_text(table(spark, sf_dir, "pages"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperlang.identify(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_split.fim_digest(fim_split.fill_in_middle(table(spark, sf_dir, "documents")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(table(spark, sf_dir, "documents")).drop("groups")


def op13_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_pack.pack(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_token_counts, op3_simhash_groups, op4_poisson_mix, op5_weak_quality, op6_pii, op7_size_tiered_shards, op8_main_text, op9_language, op10_decontaminate, op11_fill_in_middle, op12_token_alignment, op13_pack_sequences, pipeline)}

ORACLE_SQL = {"op4_poisson_mix": poisson_mix.ORACLE, "op5_weak_quality": weak_quality.oracle(), "op10_decontaminate": template_decontam.ORACLE, "op11_fill_in_middle": fim_split.ORACLE}
