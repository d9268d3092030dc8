"""Queries ``opN_<name>``: each applies its operator with production parameters to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, licences, mixing, quality, secrets, shards, simhash, tokens, toxicity
from .common import held_out, table


def op1_sentence_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(table(spark, sf_dir, "documents"))


def op2_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op3_shuffled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.shuffled(table(spark, sf_dir, "documents"), 40)
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    return rows.select("doc_id", shards.record_bytes().alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")


def op4_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.learn(docs), "doc_id")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.round("fit", 3).alias("chars_per_phrase"))


def op6_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "n_matched", "exact_slots")


def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(table(spark, sf_dir, "documents"))
    first = F.round(F.get("passes", F.lit(0))["position"], 9)
    return rows.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position")).orderBy("first_position", "doc_id")


def op8_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"))


def op9_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "evidence")


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


QUERIES = (op1_sentence_licences, op2_simhash_groups, op3_shuffled_shards, op4_cross_parsing, op5_token_counts, op6_template_leaks, op7_curriculum_mix, op8_linked_secrets, op9_nearest_toxicity, op10_line_quality)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op10_line_quality": quality.judged_sql(), "op1_sentence_licences": licences.scan_sql(), "op7_curriculum_mix": mixing.mix_sql()}
