"""Lookups that join: source roots, usages, overriders, class paths, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ancestors(path: Column) -> Column:
    """All prefixes of a path that end in a slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))


def by_root(rows: DataFrame, file: str, roots: DataFrame) -> DataFrame:
    """Every row with every root (column ``root``) that its file lies below.

    A file's ancestors are listed and equi-joined, so no nested loop compares each file to each root.
    """
    return rows.withColumn("root", F.explode(F.array_distinct(ancestors(F.col(file))))).join(roots.select("root", "ordinal"), "root")


def first_root(rows: DataFrame, file: str, roots: DataFrame, key: str) -> DataFrame:
    """Every row with the longest of its roots, the first of equals."""
    best = by_root(rows, file, roots).withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.length("root")), "ordinal")))
    return best.filter("nth = 1").drop("nth")


def root_of(rows: DataFrame, file: str, roots: DataFrame) -> DataFrame:
    """Every row with the first of its roots in their order; a row without one is an error when it is read."""
    best = by_root(rows.select(file).distinct(), file, roots).groupBy(file).agg(F.min_by("root", "ordinal").alias("root"))
    met = rows.join(best, file, "left")
    return met.withColumn("root", F.coalesce("root", F.raise_error(F.concat(F.lit("no source root for "), F.col(file)))))


def lists_by_root(rows: DataFrame, file: str, roots: DataFrame) -> DataFrame:
    """root and the sorted files of each root that has any."""
    return by_root(rows.select(file).distinct(), file, roots).groupBy("root").agg(F.sort_array(F.collect_list(file)).alias("files"))


def usages_of(wanted: DataFrame, usages: DataFrame, resources: DataFrame | None) -> DataFrame:
    """wanted: signature, legacy. usages: file, signature. Files that use the signature, its older form if it has none, and resources always.

    Which signatures have direct uses is known from their distinct names alone; then each has one form, and one join finds them all.
    signature, file, found and n (uses) come back.
    """
    direct = wanted.select("signature").distinct().join(usages.select("signature").distinct(), "signature", "left_semi").select("signature", F.lit("direct").alias("found"), F.col("signature").alias("form"))
    legacy = wanted.join(usages.select("signature").distinct(), "signature", "left_anti").select("signature", F.lit("legacy").alias("found"), F.col("legacy").alias("form")).distinct()
    met = usages.select(F.col("signature").alias("form"), "file").join(direct.unionByName(legacy), "form")
    kept = met.groupBy("signature", "found", "file").agg(F.count("*").alias("n")).select("signature", "file", "found", "n")
    if resources is not None:
        hits = wanted.select("signature", "reference").distinct().join(resources.select(F.col("signature").alias("reference"), "file"), "reference")
        kept = kept.unionByName(hits.groupBy("signature", "file").agg(F.count("*").alias("n")).select("signature", "file", F.lit("resource").alias("found"), "n"))
    return kept


def unused(declarations: DataFrame, usages: DataFrame, key: str, overriding: DataFrame | None = None) -> DataFrame:
    """Declarations that nothing uses, in any index. Those in ``overriding`` are never reported, as calls may reach them by another name."""
    out = declarations.join(usages.select(key).distinct(), key, "left_anti")
    return out if overriding is None else out.join(overriding.select(key).distinct(), key, "left_anti")


def resolve(wanted: DataFrame, classpath: DataFrame, files: DataFrame) -> DataFrame:
    """name and the first class path entry (by ordinal) that has a file for it. Archives are skipped."""
    entries = classpath.filter(~F.col("entry").endswith(".jar"))
    return wanted.join(files, "name").join(entries, "entry").groupBy("name").agg(F.min_by("entry", "ordinal").alias("entry"), F.min("ordinal").alias("ordinal"))


def narrowest(points: DataFrame, intervals: DataFrame, key: str, point: str) -> DataFrame:
    """For each point the shortest interval (start_off, end_off) of its key that holds it; of equals the first.

    Points and intervals are sorted together within a key: a point meets the last intervals that begin before it, and
    among nested or adjoining intervals the shortest that holds it is one of the latest beginnings at each length class.
    """
    width = F.col("end_off") - F.col("start_off")
    level = F.floor(F.log2(F.greatest(width, F.lit(1)))).cast("int")
    i = intervals.select(key, "start_off", "end_off", level.alias("level"))
    levels = i.select(key, "level").distinct()
    p = points.select(key, point).distinct().join(levels, key)
    # in a class of lengths [2^k, 2^(k+1)), cells of 2^(k+1) places: an interval that holds a point begins in its cell or the one before
    cell = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("level") + 1))
    near = p.withColumn("cell", F.explode(F.array(cell(F.col(point)), cell(F.col(point)) - 1)))
    held = near.join(i.withColumn("cell", cell(F.col("start_off"))), [key, "level", "cell"]).filter((F.col("start_off") <= F.col(point)) & (F.col(point) <= F.col("end_off")))
    best = F.min(F.struct((F.col("end_off") - F.col("start_off")).alias("width"), "start_off", "end_off"))
    return held.groupBy(key, point).agg(best.alias("b")).select(key, point, "b.start_off", "b.end_off")


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """child, ancestor and least depth over any number of steps, by joins that double what is reached until nothing is new.

    Pairs as far apart as was reached go on with all that are known, so a round gives each new pair about once, and rounds are
    as many as the logarithm of the deepest chain; cycles end by themselves. A caller may say how deep chains go at most; one that
    goes deeper is an error. What is joined can be large however little its size is taken to be, so it is never sent whole to all tasks.
    """
    from tesserae.operators.rounds import checkpointed

    found = checkpointed(edges.select("child", F.col("parent").alias("ancestor")).filter("child != ancestor").distinct().withColumn("depth", F.lit(1)))
    reach = 1
    while True:
        far = found.filter(F.col("depth") == reach).select(F.col("child").alias("low"), F.col("ancestor").alias("child"))
        if far.isEmpty():
            return found
        new = far.join(found.hint("merge"), "child").filter("low != ancestor").select(F.col("low").alias("child"), "ancestor", (F.col("depth") + reach).alias("depth"))
        found = checkpointed(found.unionByName(new).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")))
        reach *= 2
        if max_depth is not None and reach > max_depth and not found.filter(F.col("depth") > max(max_depth, 1)).isEmpty():
            raise ValueError(f"a chain is longer than {max_depth}")


def below(edges: DataFrame, top: DataFrame) -> DataFrame:
    """ancestor and child for the given ancestors alone, and all that is below them at any depth; as :func:`closure`, from above. top: ancestor."""
    from tesserae.operators.rounds import checkpointed

    step = edges.select(F.col("child").alias("next"), F.col("parent").alias("child")).hint("merge")
    front = checkpointed(top.select("ancestor", F.col("ancestor").alias("child")).distinct())
    found = front.limit(0)
    while not front.isEmpty():
        new = front.join(step, "child").select("ancestor", F.col("next").alias("child")).filter("child != ancestor").distinct()
        front = checkpointed(new.join(found.hint("merge"), ["ancestor", "child"], "left_anti"))
        found = checkpointed(found.unionByName(front))
    return found
