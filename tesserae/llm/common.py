"""Things the operators of this subpackage share: tables, the shared folder, word rules."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources.shipping import ship

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_serial = itertools.count()
_kept: dict[str, SparkSession] = {}
_tables: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``, or else the context's checkpoint
    folder. Where neither is set and all runs in one process (tests) a temporary
    folder is made once and set for the session; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; removed when the driver ends."""
    path = f"{shared_dir(spark)}/tesserae-{spark.sparkContext.applicationId}/{name}-{next(_serial)}-{uuid.uuid4().hex[:8]}"
    if not _kept:
        atexit.register(_remove_all)
    _kept[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Drop a table written by :func:`materialize` or :func:`bucketed`."""
    if path in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _kept.pop(path, None)


def _remove_all() -> None:
    for path, spark in list(_kept.items()):
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone by now
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: a cut lineage that outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tesserae_path = path
    return back


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """Write a table to the shared folder in buckets of a column, as many as shuffles have partitions, and read it back.

    Joins on the column read the buckets in place of a shuffle.
    """
    spark, table = df.sparkSession, f"tesserae_{uuid.uuid4().hex}"
    path = fresh_path(spark, name)
    n = conf_int(spark, "spark.sql.shuffle.partitions", 200)
    df.write.bucketBy(n, column).option("path", path).saveAsTable(table)
    _tables[path] = table
    back = spark.table(table)
    back._tesserae_path = path
    return back


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow, with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def drop(df: DataFrame) -> None:
    """Remove what :func:`materialize` wrote, once nothing reads it any more."""
    remove(df.sparkSession, df._tesserae_path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each with underscores added until no column of df has it in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text with null as the empty string."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once. Inside a lambda an outer expression is worked out for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))
