"""The registered queries of this subpackage: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, cube_mix, decontam, html_crf, jaccard_rtree, quality, sharding, sql, substring_lsm, suffix_bwt, token_alignment, token_store, toxicity, warc, whitening
from .common import table


def tokenizer(name: str) -> str:
    """Place of a vocabulary file of the installed package, the same on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = common.Scratch(spark, "archives").path("warc")
    manifest = warc.write_archives(spark, table(spark, sf_dir, "pages"), base)
    return warc.read_archives(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.place(docs, fallback="text").select("doc_id", "shard")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_rtree.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_bwt.remove_repeats(spark, table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_lsm.remove_repeats(spark, table(spark, sf_dir, "documents"))


def op10_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(spark, table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))


def op13_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = common.Scratch(spark, "ids").path("files")
    manifest = token_store.write_tokens(spark, table(spark, sf_dir, "documents"), base, tokenizer("word_bpe_49k.json"))
    return token_store.read_tokens(spark, manifest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
