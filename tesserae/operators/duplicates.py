"""Duplicate text: runs of lines that stand together wherever they stand.

The weight of a line is its number of tokens; a hash is the first eight hex digits of
the MD5 with the weight behind a colon. A run goes on while the next line is the same
at every place, and stands nowhere else, so a clone of any length is one run and no
run lies in another. Nothing is collected by hash: sets of files are compared by their
size and two sums over their members, so a very common line costs no more than its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIN_WEIGHT = 10
BROADCAST_ROWS = 100_000  #: hashes or categories that are sent to all tasks; more are shuffled


def weight(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def fragment_hash(text: Column, value: Column) -> Column:
    return F.concat(F.upper(F.substring(F.md5(text.cast("binary")), 1, 8)), F.lit(":"), value.cast("string"))


def hash_weight(hash_: Column) -> Column:
    """The number behind the last colon."""
    return F.substring_index(hash_, ":", -1).cast("long")


def lines_of(content: Column) -> Column:
    return F.split(F.replace(content, F.lit("\r\n"), F.lit("\n")), "\n", -1)


def numbered(sources: DataFrame, path: str, content: str) -> DataFrame:
    """path, line number and text of every line: no shuffle."""
    return sources.select(F.col(path).alias("path"), F.posexplode(lines_of(F.col(content))).alias("line", "text"))


def lines(sources: DataFrame, path: str, content: str) -> DataFrame:
    """path, line number, text, start and end offsets. Offsets come from a running sum inside each file."""
    run = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("text") + 1).over(run) - 1
    return numbered(sources, path, content).withColumn("end_off", end.cast("long")).withColumn("start_off", F.col("end_off") - F.length("text"))


def single(sources: DataFrame, path: str, content: str, min_weight: int = MIN_WEIGHT) -> DataFrame:
    """Lines that weigh enough, by hash, without offsets: no shuffle."""
    each = sources.select(F.col(path).alias("path"), F.explode(F.split(F.col(content), "\n", -1)).alias("text")).withColumn("value", weight(F.col("text"))).filter(F.col("value") >= min_weight)
    return each.select("path", "value", fragment_hash(F.col("text"), F.col("value")).alias("hash"))


def duplicated(fragments: DataFrame, min_files: int = 2, min_spans: int = 2) -> DataFrame:
    """hash, value, n_files and n_spans of hashes found often enough."""
    by_file = fragments.groupBy("hash", "value", "path").agg(F.count("*").alias("n"))
    return by_file.groupBy("hash", "value").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_spans")).filter((F.col("n_files") >= min_files) & (F.col("n_spans") >= min_spans))


def file_set(path: str) -> list[Column]:
    """Two sums by which equal sets of files are known."""
    return [F.sum(F.xxhash64(path, F.lit(1)).cast("decimal(38,0)")).alias("files_sum"), F.bit_xor(F.xxhash64(path, F.lit(2))).alias("files_xor")]


def runs(sources: DataFrame, path: str, content: str, min_files: int = 2, min_weight: int = MIN_WEIGHT) -> DataFrame:
    """Maximal runs of lines that files share: hash (of the hashes of its lines), value, n_lines, n_files, n_spans, path, line (its first place).

    Blank lines do not count. Each line knows the hash of the next one from its own row, so one aggregate by hash is all that sees every line.
    """
    full = F.filter(F.transform(lines_of(F.col(content)), lambda t, i: F.struct(i.alias("line"), F.upper(F.substring(F.md5(t.cast("binary")), 1, 16)).alias("mark"), weight(t).alias("value"))), lambda s: s["value"] > 0)
    rows = sources.select(F.col(path).alias("path"), full.alias("full"))
    each = rows.select("path", F.posexplode(F.arrays_zip(F.col("full").alias("one"), F.slice("full", F.lit(2), F.greatest(F.size("full"), F.lit(1))).alias("two"))).alias("nth", "p"))
    each = each.select("path", "nth", F.col("p.one.line").alias("line"), F.col("p.one.mark").alias("mark"), F.col("p.one.value").alias("value"), F.coalesce(F.col("p.two.mark"), F.lit("")).alias("next"))
    first = F.min(F.struct("path", "nth", "line"))
    by_file = each.groupBy("mark", "value", "path").agg(F.count("*").alias("n"), F.min("next").alias("lo"), F.max("next").alias("hi"), first.alias("first"))
    all_ = by_file.groupBy("mark", "value").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_spans"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first")).filter(F.col("n_files") >= min_files)
    # a line goes on with the next if that is the same everywhere and as frequent, for then they stand at the same places
    into = all_.filter("lo = hi and lo <> ''").select(F.col("lo").alias("mark"), F.col("n_spans").alias("of"), F.lit(True).alias("goes_on"))
    linked = all_.join(into, (all_["mark"] == into["mark"]) & (all_["n_spans"] == into["of"]), "left").select(all_["*"], F.coalesce("goes_on", F.lit(False)).alias("goes_on"))
    linked = linked.dropDuplicates(["mark", "value"])
    # the first places of a run's lines follow each other, so runs are stretches of these
    order = Window.partitionBy("first.path").orderBy("first.nth")
    new = ~F.col("goes_on") | (F.lag("first.nth").over(order) != F.col("first.nth") - 1) | F.lag("first.nth").over(order).isNull()
    island = F.sum(new.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = linked.withColumn("island", island)
    out = parts.groupBy(F.col("first.path").alias("path"), "island").agg(F.sort_array(F.collect_list(F.struct(F.col("first.nth").alias("nth"), F.col("first.line").alias("line"), "mark", "value"))).alias("s"), F.min("n_files").alias("n_files"), F.min("n_spans").alias("n_spans"))
    value = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["value"])
    marks = F.array_join(F.transform("s", lambda x: x["mark"]), "")
    done = out.select("path", value.alias("value"), F.size("s").cast("long").alias("n_lines"), "n_files", "n_spans", F.col("s")[0]["line"].cast("long").alias("line"), F.element_at("s", -1)["line"].cast("long").alias("last_line"), fragment_hash(marks, value).alias("hash"))
    return done.filter(F.col("value") >= min_weight).select("hash", "value", "n_lines", "n_files", "n_spans", "path", "line", "last_line")


def offsets(found: DataFrame, sources: DataFrame, path: str, content: str) -> DataFrame:
    """Found runs with start_off and end_off in their first file, from that file's text alone."""
    text = sources.select(F.col(path).alias("path"), F.replace(F.col(content), F.lit("\r\n"), F.lit("\n")).alias("text"))
    met = found.join(text, "path")
    upto = lambda n: F.length(F.expr(f"substring_index(text, '\\n', int({n}))"))
    start = F.when(F.col("line") == 0, F.lit(0)).otherwise(upto("line") + 1)
    return met.withColumn("start_off", start.cast("long")).withColumn("end_off", upto("last_line + 1").cast("long")).drop("text")


def ranked(groups: DataFrame, page: int, size: int = 100) -> DataFrame:
    """One page of groups, heaviest first, then by hash."""
    return groups.orderBy(F.desc("value"), "hash").offset(page * size).limit(size)


def by_category(hashes: DataFrame, categories: DataFrame, fragments: DataFrame) -> DataFrame:
    """hash, segment and the sorted files for each asked hash and category; none found gives no files.

    There are as many categories as indexes, whose names the driver holds; each asked hash unfolds over them.
    """
    found = fragments.join(hashes.select("hash").distinct(), "hash", "left_semi").select("hash", "segment", "path").distinct().groupBy("hash", "segment").agg(F.sort_array(F.collect_list("path")).alias("files"))
    names = [r[0] for r in categories.select("segment").filter("segment is not null").distinct().limit(BROADCAST_ROWS + 1).collect()]
    if len(names) > BROADCAST_ROWS:
        raise ValueError("more categories than indexes can be open at once")
    asked = hashes.select("hash").distinct().withColumn("segment", F.explode(F.array(*map(F.lit, names)).cast("array<string>")))
    return asked.join(found, ["hash", "segment"], "left").select("hash", "segment", F.coalesce("files", F.array().cast(found.schema["files"].dataType)).alias("files"))
