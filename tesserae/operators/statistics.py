"""Keyed counters over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counters(rows: DataFrame, contributions: list[tuple[Column, Column]]) -> DataFrame:
    """Every row adds each (key, number); key and sum come back. Null keys add nothing."""
    each = F.array(*[F.struct(k.cast("string").alias("key"), n.cast("long").alias("value")) for k, n in contributions])
    return rows.select(F.explode(each).alias("c")).select("c.*").filter("key is not null").groupBy("key").agg(F.sum("value").alias("value"))


def file_statistics(sources: DataFrame) -> DataFrame:
    """files/total, files/<mime>, fileSize/total and fileSize/<mime>."""
    sums = sources.rollup("mime").agg(F.grouping("mime").alias("all"), F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    name = F.when(F.col("all") == 1, "total").otherwise(F.col("mime"))
    both = F.array(F.struct(F.concat(F.lit("files/"), name).alias("key"), F.col("files").alias("value")), F.struct(F.concat(F.lit("fileSize/"), name).alias("key"), F.col("bytes").alias("value")))
    return sums.select(F.explode(both).alias("c")).select("c.*").filter("key is not null")


def element_statistics(features: DataFrame) -> DataFrame:
    """Counts of classes, fields and methods; what is no class and no field is a method."""
    kind = F.when(F.col("kind").isin("CLASS", "INTERFACE", "ENUM", "ANNOTATION_TYPE"), "java-classes").when(F.col("kind").isin("FIELD", "ENUM_CONSTANT"), "java-fields").otherwise("java-methods")
    return features.groupBy(kind.alias("key")).agg(F.count("*").alias("value"))
