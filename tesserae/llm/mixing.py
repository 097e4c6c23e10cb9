"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every source gets a target number of words: its weight's share of all words, held
to a multiple of its own size, with the excess shared again by weight. That is
the level at which ``sum(least(limit * size, level * weight))`` equals the total;
it is found with running sums over sources sorted by where they fill up.

A source whose target is q times its size takes floor(q) complete epochs of all
its documents first. The rest of its target is filled from one more sample
without replacement: documents come in the order of their exponential keys,
-ln(u) / weight, weight being a document's quality, until the running sum of
their words reaches the budget; the document that crosses it is taken if this
ends nearer to the budget.

No task sorts a whole source: keys are first counted in a coarse and then in a
fine histogram, and only documents in the one fine bin that the budget falls
into are ordered one by one.

Defined results: null texts have size 0; null sources are one source, last;
null doc_ids are drawn by their text; documents with one key are ordered by doc_id and size, and repeated rows
one after the other; words of a text of any length are all counted; other columns are not looked at, and kept as they
are by :func:`mixed`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common


def quality(text: Column, size: Column) -> Column:
    """A document's weight: 1 for prose, down to 0.1 as marks and digits replace letters."""
    marks = F.length(text) - F.length(F.translate(text, "0123456789#*$%&|<>{}[]=@_~^\\/+", ""))
    return F.greatest(F.lit(0.1), F.lit(1.0) - marks / F.greatest(F.length(text), F.lit(1)))


def targets(sources: DataFrame, weights: Sequence[float], limit: float) -> DataFrame:
    """sources (source, source_size) with their target. One row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    known = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(limit))
    # sources fill up in the order of cap / weight; before the i-th does, all earlier ones are full
    fills = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    ahead = known.select(
        "*",
        F.coalesce(F.sum("cap").over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("full"),
        F.sum("weight").over(fills.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open"),
        F.sum("source_size").over(every).alias("total"),
    )
    level = ahead.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    # the level is the first at which the source itself does not fill up; later ones are lower
    holds = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    final = level.withColumn("at", F.max(holds).over(every))
    target = F.least(F.col("cap"), F.coalesce(F.col("at"), F.lit(float("inf"))) * F.col("weight"))
    return final.select("source", "source_size", "weight", target.alias("target"))


def drawn(docs: DataFrame, seed: int, weight: Column | None = None, *more: Column) -> DataFrame:
    """doc_id, source, size and the place of the exponential key in [0, 1) for every row.

    u is a hash of the document, so reruns agree. 1 - u ** (1 / weight) has the order of -ln(u) / weight.
    """
    text = common.text_of(docs)
    size = F.regexp_count(text, F.lit(common.WORD)).cast("long")
    u = (F.shiftrightunsigned(F.xxhash64(docs["doc_id"], text, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        size.alias("size"),
        (F.lit(1.0) - F.pow(u, F.lit(1.0) / (quality(text, size) if weight is None else weight))).alias("place"),
        *more,
    )


def _crossed(bins: DataFrame, keys: list[str], budget: DataFrame) -> DataFrame:
    """By source, the bin that its budget falls into and what the bins before it hold."""
    run = Window.partitionBy("source").orderBy("bin")
    upto = bins.withColumn("upto", F.sum("size").over(run)).withColumn("before", F.col("upto") - F.col("size"))
    met = upto.join(budget, upto["source"].eqNullSafe(budget["b_source"])).filter((F.col("before") <= F.col("budget")) & (F.col("upto") > F.col("budget")))
    return met.select("b_source", F.col("bin").alias(keys[0]), F.col("before").alias(keys[1]))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), limit: int = 3, seed: int = 7, bins: int = 256, weight: Column | None = None) -> DataFrame:
    """Every row with its size, its source's size and target, and the words the mix takes of it."""
    return apply_mix(common.materialize(drawn(docs, seed, weight), "mix-rows"), weights, limit, bins)


def apply_mix(rows: DataFrame, weights: Sequence[float], limit: int, bins: int) -> DataFrame:
    """rows: doc_id, source, size, place and any more columns."""
    stats = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(stats, weights, limit)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("epochs", whole).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = common.materialize(goal.withColumnRenamed("source", "b_source"), "mix-goal")
    budget = goal.select("b_source", "budget")
    coarse = F.least(F.floor(F.col("place") * bins), F.lit(bins - 1)).cast("int")
    fine = F.least(F.floor(F.col("place") * (bins * bins)), F.lit(bins * bins - 1)).cast("int")
    first = _crossed(rows.groupBy("source", coarse.alias("bin")).agg(F.sum("size").alias("size")), ["c_bin", "c_before"], budget)
    goal1 = goal.join(first.withColumnRenamed("b_source", "s1"), F.col("b_source").eqNullSafe(F.col("s1")), "left").drop("s1")
    goal1 = common.materialize(goal1, "mix-coarse")
    tight = goal1.select("b_source", "c_bin", (F.col("budget") - F.col("c_before")).alias("budget")).filter("c_bin is not null")
    near = rows.join(tight, rows["source"].eqNullSafe(tight["b_source"]) & (coarse == tight["c_bin"])).select("source", fine.alias("bin"), "size")
    second = _crossed(near.groupBy("source", "bin").agg(F.sum("size").alias("size")), ["f_bin", "f_before"], tight.select("b_source", "budget"))
    goal2 = goal1.join(second.withColumnRenamed("b_source", "s2"), F.col("b_source").eqNullSafe(F.col("s2")), "left").drop("s2")
    goal2 = common.materialize(goal2, "mix-fine")
    extra = [c for c in rows.columns if c not in ("doc_id", "source", "size", "place")]
    known = rows.withColumn("fine", fine).join(goal2, F.col("source").eqNullSafe(F.col("b_source")))
    # bins before the one that the budget falls into are taken whole; a budget beyond the last bin takes all
    sure = F.col("c_bin").isNull() | (F.col("fine") < F.coalesce(F.col("f_bin"), (F.col("c_bin") + 1) * bins))
    at_edge = F.col("c_bin").isNotNull() & F.coalesce(F.col("fine") == F.col("f_bin"), F.lit(False))
    edge = known.filter(at_edge)
    run = Window.partitionBy("source").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("size").over(run)
    left = F.col("budget") - F.col("c_before") - F.col("f_before")
    edge = edge.withColumn("chosen", upto - F.col("size") / 2 <= left)
    rest = known.filter(~at_edge).withColumn("chosen", sure & (F.col("budget") > 0))
    both = rest.unionByName(edge)
    taken = (F.col("epochs") + F.col("chosen").cast("long")) * F.col("size")
    return both.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", *extra)


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), limit: int = 3, seed: int = 7, bins: int = 256) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it.

    A row is found again by its doc_id, source and the MD5 of its text. Rows without words are not taken.
    """
    mark = F.md5(common.text_of(docs).cast("binary"))
    rows = common.materialize(drawn(docs, seed, None, mark.alias("mark")), "mix-rows")
    got = apply_mix(rows, weights, limit, bins).filter("size > 0 and taken > 0")
    # rows that agree in all of this are as one, taken as often as all of them together
    own, nth, all_, n = common.unused(docs, "mark", "nth", "taken_all", "taken_rows")
    often = got.groupBy(F.col("doc_id").alias("t_id"), F.col("source").alias("t_source"), F.col("mark").alias("t_mark")).agg(F.sum(F.expr("taken div size")).alias(all_), F.count("*").alias(n))
    often = common.materialize(often, "mix-taken")
    keyed = docs.withColumn(own, mark)
    same = (keyed[own] == often["t_mark"]) & keyed["doc_id"].cast("long").eqNullSafe(often["t_id"]) & keyed["source"].cast("string").eqNullSafe(often["t_source"])
    met = keyed.join(often, same).select(*[keyed[c] for c in keyed.columns], all_, n)
    one = met.filter(F.col(n) == 1).unionByName(met.filter(F.col(n) > 1).dropDuplicates([own, "doc_id", "source"]))
    return one.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(all_).cast("int")))).select(*docs.columns)
