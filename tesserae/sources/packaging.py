"""Indexes as packages: written out, measured, handed on, cached by build, and told to be read anew."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import maintenance
from tesserae.sources import corpus

HOUR = 3600.0  #: seconds for which a cached index is believed without asking


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def pack(spark: SparkSession, tables: dict[str, DataFrame], root: str, base: str, info: dict | None = None, paths: tuple[str, ...] = ("path", "file", "relative_path"), files: int | None = None) -> dict:
    """Write the tables of an index, paths made relative to base, and a manifest with their sizes, names and info.

    Parts of a table are compacted to ``files`` files if that is given. The manifest comes last: a package without one is not complete.
    """
    for name, df in tables.items():
        for c in paths:
            if c in df.columns:
                df = df.withColumn(c, corpus.rebase(F.col(c), base.rstrip("/") + "/", "rel:/"))
        (df.coalesce(files) if files else df).write.mode("overwrite").parquet(f"{root}/{name}")
    sizes = {name: _size(spark, f"{root}/{name}") for name in tables}
    manifest = {"tables": sorted(tables), "sizes": sizes, "indexSize": sum(sizes.values()), **(info or {})}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/_manifest")
    return manifest


def manifest(spark: SparkSession, root: str) -> dict:
    """What a package says of itself; FileNotFoundError if there is none."""
    where, store = _fs(spark, f"{root}/_manifest")
    if not store.exists(where):
        raise FileNotFoundError(root)
    return json.loads(spark.read.text(f"{root}/_manifest").first()[0])


def unpack(spark: SparkSession, root: str, base: str, paths: tuple[str, ...] = ("path", "file", "relative_path")) -> dict[str, DataFrame]:
    """The tables of a package, with paths below base."""
    out = {}
    for name in manifest(spark, root)["tables"]:
        df = spark.read.parquet(f"{root}/{name}")
        for c in paths:
            if c in df.columns:
                df = df.withColumn(c, corpus.rebase(F.col(c), "rel:/", base.rstrip("/") + "/"))
        out[name] = df
    return out


def _size(spark: SparkSession, path: str) -> int:
    where, store = _fs(spark, path)
    return int(store.getContentSummary(where).getLength())


def download(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """The files of a package (path below it, length and content) and their total length, which goes ahead of them."""
    manifest(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_extract("path", "/" + root.rstrip("/").rpartition("/")[2] + "/(.*)$", 1)
    return files.select(below.alias("path"), "length", "content"), _size(spark, root)


def invalidate(spark: SparkSession, *tables: str) -> None:
    """An index has been updated: forget what is cached of it, or of all."""
    if not tables:
        spark.catalog.clearCache()
    for t in tables:
        spark.catalog.refreshByPath(t)


class ResultCache:
    """Result tables by index, segment and key, valid for one build of the index.

    The build is asked for again after ``ttl`` seconds; another build empties the cache of that index and segment.
    """

    def __init__(self, spark: SparkSession, root: str, ttl: float = HOUR, now: Callable[[], float] = time.time):
        self.spark, self.root, self.ttl, self.now = spark, root.rstrip("/"), ttl, now
        self.checked: dict[str, tuple[float, str]] = {}

    def _place(self, index: str, segment: str) -> str:
        return f"{self.root}/{index}/{segment}"

    def build(self, index: str, segment: str, ask: Callable[[], str]) -> str:
        place = self._place(index, segment)
        at, known = self.checked.get(place, (float("-inf"), ""))
        if self.now() - at <= self.ttl:
            return known
        current = ask()
        mark, store = _fs(self.spark, f"{place}/_build")
        kept = self.spark.read.text(f"{place}/_build").first()[0] if store.exists(mark) else None
        if kept != current:
            store.delete(_fs(self.spark, place)[0], True)
            self.spark.createDataFrame([(current,)], "value string").coalesce(1).write.mode("overwrite").text(f"{place}/_build")
        self.checked[place] = (self.now(), current)
        return current

    def get(self, index: str, segment: str, key: str, ask: Callable[[], str], compute: Callable[[], DataFrame]) -> DataFrame:
        """The result for a key, computed and written if the current build has none yet."""
        self.build(index, segment, ask)
        place = f"{self._place(index, segment)}/{key}"
        done, store = _fs(self.spark, f"{place}/_SUCCESS")
        if not store.exists(done):
            compute().write.mode("overwrite").parquet(place)
        return self.spark.read.parquet(place)


def store_counts(counts: DataFrame, root: str) -> str | None:
    """Publish access counts (key, n) unless they are what is published already; the new version, or None."""
    spark = counts.sparkSession
    try:
        old = maintenance.published(spark, root)
    except FileNotFoundError:
        old = None
    if old is not None and counts.exceptAll(old).isEmpty() and old.exceptAll(counts).isEmpty():
        return None
    return maintenance.publish(counts, root, files=1)
