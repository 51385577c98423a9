"""Queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, jaccard, lines, merkle, mixing, packing, quality, resampling, secrets, shards, suffixes, tokens, urls


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The tokenizer's file: ``LODESTONE_TOKENIZER``, or the installed public one."""
    if path := os.environ.get("LODESTONE_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_overlaps(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_near(_read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.find_repeats(_read(spark, sf_dir, "documents"), digest=True)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.dedup_lines(_read(spark, sf_dir, "documents")))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judge(_read(spark, sf_dir, "documents")))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_read(spark, sf_dir, "documents")))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.by_source(_read(spark, sf_dir, "documents")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return urls.judge_urls(pages, urls.listed_pages(pages), key=urls.page_key())


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(_read(spark, sf_dir, "documents"), tokenizer=tokenizer_file())


def op10_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.digest(shards.assign(_read(spark, sf_dir, "documents")))


def op11_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(_read(spark, sf_dir, "documents"), tokenizer=tokenizer_file("byte_bpe_50k.json")))


def op12_merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.prove(_read(spark, sf_dir, "documents"), digest=True).drop("source")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.digest(resampling.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_ngram_jaccard,
        op3_suffix_dedup,
        op4_line_dedup,
        op5_line_quality,
        op6_secret_scan,
        op7_mix_sources,
        op8_url_filter,
        op9_token_files,
        op10_ring_shards,
        op11_pack_windows,
        op12_merkle_proofs,
        op13_resample,
    )
}

ORACLE_SQL = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op4_line_dedup": lines.ORACLE,
    "op5_line_quality": quality.ORACLE,
    "op7_mix_sources": mixing.ORACLE,
    "op8_url_filter": urls.ORACLE,
    "op12_merkle_proofs": merkle.ORACLE,
    "op13_resample": resampling.ORACLE,
}
