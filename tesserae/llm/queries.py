"""The queries of this subpackage, by the name they are registered under."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def op1_shard_minimax(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.assign(common.table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan

    return secret_scan.digest(secret_scan.scan(common.table(spark, sf_dir, "documents")))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import token_files

    return token_files.encoded(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.near_groups(common.table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), any_case=True)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules

    return quality_rules.judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op7_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import importance

    return importance.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.measure(common.table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(common.table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.round_trip(common.table(spark, sf_dir, "pages"))


# What SQL can say of operators whose whole rows it cannot


def part1_shard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, bytes and texts over all shards; whether equal texts share a shard, and slots are without gaps."""
    rows = op1_shard_minimax(spark, sf_dir).join(common.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("mark")), "doc_id")
    rows = common.materialize(rows, "shard-totals")
    texts = rows.groupBy("mark").agg(F.countDistinct("shard").alias("n")).agg(F.count("*").alias("n_texts"), (F.max("n") == 1).alias("whole"))
    shards = rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots"))
    every = shards.agg(F.sum("n").alias("n_rows"), F.sum("bytes").alias("bytes"), F.min((F.col("n") == F.col("slots")) & (F.col("last") == F.col("n") - 1) & (F.col("shard") < 24)).alias("gapless"))
    return every.crossJoin(texts)  # one row each


def part2_secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def part6_base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def part9_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and target of every source, and whether what is taken of it ends within a document of the target."""
    rows = op9_mix_sources(spark, sf_dir)
    each = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max("size").alias("longest"))
    return each.select("source", "source_size", F.round("target", 2).alias("target"), (F.abs(F.col("taken") - F.col("target")) <= F.col("longest")).alias("near"))


def queries() -> dict:
    every = (op1_shard_minimax, op2_secret_scan, op3_token_files, op4_simhash, op5_decontaminate, op6_quality_rules, op7_importance, op8_suffix_dedup, op9_mix_sources, op10_warc)
    return {f.__name__: f for f in (*every, part1_shard_totals, part2_secret_counts, part6_base_rules, part9_targets)}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
