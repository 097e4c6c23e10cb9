"""Keeping tables up to date: upserts, snapshot differences, versioned publishing."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_change(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last change of each key."""
    return changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in changes.columns if c != key]), order).alias("last")).select(key, "last.*")


def upsert(old: DataFrame, changes: DataFrame, key: str, order: str, op: str) -> DataFrame:
    """old with the last change of each key: rows of deleted keys go, also in a batch that only deletes."""
    last = last_change(changes, key, order)
    new = last.filter(F.col(op) != "delete").select(*old.columns)
    return old.join(last.select(key), key, "left_anti").unionByName(new)


def difference(before: DataFrame, after: DataFrame, key: str, stamp: str) -> DataFrame:
    """key and change (added, changed or removed) between two snapshots."""
    a, b = before.select(key, F.col(stamp).alias("was")), after.select(key, F.col(stamp).alias("now"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select(key, change.alias("change")).filter("change is not null")


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(df: DataFrame, root: str, partition: str | None = None, files: int | None = None) -> str:
    """Write a new version below root and point to it. Readers see the old or the new one, and never none.

    Pointers are numbered files that are written aside and renamed into place; the one with the greatest number counts,
    so there is always one. Older ones go after that.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    out = df.coalesce(files) if files else df
    writer = out.write
    (writer.partitionBy(partition) if partition else writer).parquet(f"{root}/versions/{version}")
    return _point(spark, root, version)


def _pointers(spark: SparkSession, root: str) -> dict[int, str]:
    where, store = _fs(spark, f"{root}/current")
    if not store.exists(where):
        return {}
    return {int(s.getPath().getName()): s.getPath().toString() for s in store.listStatus(where) if s.getPath().getName().isdigit()}


def _point(spark: SparkSession, root: str, version: str) -> str:
    while True:
        known = _pointers(spark, root)
        n = max(known, default=0) + 1
        spark.createDataFrame([(json.dumps({"version": version}),)], "value string").coalesce(1).write.text(f"{root}/.next-{version}")
        aside, store = _fs(spark, f"{root}/.next-{version}")
        to, _ = _fs(spark, f"{root}/current/{n}")
        store.mkdirs(to.getParent())
        if not store.exists(to) and store.rename(aside, to):
            break
        store.delete(aside, True)  # somebody else was first with this number
    for k, old in known.items():
        if k < n - 1:  # the one before stays for readers that have just looked
            store.delete(_fs(spark, old)[0], True)
    return version


def published(spark: SparkSession, root: str) -> DataFrame:
    """The version that root points to."""
    return spark.read.parquet(f"{root}/versions/{current(spark, root)}")


def current(spark: SparkSession, root: str) -> str:
    """The name of the version that root points to."""
    known = _pointers(spark, root)
    if not known:
        raise FileNotFoundError(f"nothing is published below {root}")
    return json.loads(spark.read.text(known[max(known)]).first()[0])["version"]


def append_only(old: DataFrame, new: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Documents of a kind that knows no deletion; asking for one is an error."""
    if removed is not None and not removed.isEmpty():
        raise ValueError("documents of this kind are not removed")
    return old.unionByName(new)
