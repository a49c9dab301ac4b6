"""The queries of this subpackage's operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import centroids, chat_format, curve_packing, day_layout, decision_lists, decontaminate, importance, link_trust, lm_scoring, matroska, pipeline, simhash_dedup, token_store, warc_archive
from .tokens import tokenizer_path

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.digests(chat_format.format_chats(turns))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash_dedup.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return importance.resample(documents(spark, sf_dir), labels)


def op4_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = curve_packing.pack(documents(spark, sf_dir), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_store.round_trip(spark, documents(spark, sf_dir), tokenizer_path())
    return read.select("doc_id", "start", F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judge(pages(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short=True)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc_archive.round_trip(pages(spark, sf_dir))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir))


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.features(matroska.encode(documents(spark, sf_dir)))


def op11_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decision_lists.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op12_block_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_day_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_layout.overwritten(spark.read.parquet(f"{sf_dir}/sales.parquet"))


OPERATORS = (
    op1_chat_format,
    op2_simhash_dedup,
    op3_importance_resampling,
    op4_curve_packing,
    op5_plane_files,
    op6_link_trust,
    op7_decontamination,
    op8_warc_revisits,
    op9_suffix_tree,
    op10_matroska,
    op11_decision_lists,
    op12_block_norms,
    op13_day_overwrite,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in OPERATORS} | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat_format.sql(), "op6_link_trust": link_trust.judge_sql(), "op8_warc_revisits": warc_archive.SQL, "op12_block_norms": centroids.cluster_sql()}
