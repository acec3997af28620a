"""The registered queries of the training-data operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomstone.llm import conversations, decontam, fm_quality, html_blocks, itq_near, packing, periodic_runs, quality_rules, suffix_repeats, tgm_join, token_counts, training_order, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(_read(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op2_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tgm_join.jaccard_components(_read(spark, sf_dir, "documents"), size=3, numerator=90, denominator=100)


def op3_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    machine = fm_quality.train(docs, _read(spark, sf_dir, "labels"))
    scored = fm_quality.score(docs, machine, keep=["doc_id"])
    return scored.select("doc_id", fm_quality.held_out().alias("held_out"), "score", "predicted")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), keep=["doc_id"])


def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.digest(_read(spark, sf_dir, "documents"))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.round_trip(spark, _read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality_rules(docs).drop("text")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(spark, _read(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    return decontam.digest(decontam.matches(docs, benchmark, keep=["doc_id"]))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.collapsed(_read(spark, sf_dir, "documents"), loops=True, keep=["doc_id"]))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(conversations.damage(_read(spark, sf_dir, "conversations")))


def op13_itq_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_near.near_duplicates(_read(spark, sf_dir, "embeddings"), threshold=0.95)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_blocks": op1_html_blocks,
        "op2_token_group_join": op2_token_group_join,
        "op3_fm_quality": op3_fm_quality,
        "op4_token_counts": op4_token_counts,
        "op5_suffix_repeats": op5_suffix_repeats,
        "op6_training_order": op6_training_order,
        "op7_quality_rules": op7_quality_rules,
        "op8_packing": op8_packing,
        "op9_warc": op9_warc,
        "op10_decontamination": op10_decontamination,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_itq_near": op13_itq_near,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_quality_rules": quality_rules.oracle(),
        "op9_warc": warc.oracle(),
        "op10_decontamination": decontam.oracle(),
        "op12_conversation_repair": conversations.oracle(),
        "op13_itq_near": itq_near.oracle(),
    }
