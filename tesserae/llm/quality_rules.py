"""Quality rules in DataFrame operations only: base rules, and a likelihood ratio.

The ratio compares two multinomials over hashed n-grams, one of trusted documents
and one of the whole raw corpus. A document's score is the mean log-likelihood
ratio of its n-grams, so its length does not matter; a document is kept if its
base rules hold and its score is at least a threshold. The threshold is the score
that all but ``miss`` of a held-out part of the trusted documents reach: it depends
on the input alone, and every document is held against it.

Counts come from all documents, and all trusted labels make up the trusted side,
but for the fifth of them that is held out for the threshold. The model is a table of a fixed number of
buckets, which is broadcast. Trusted ids are as many as labels: if they are small
Spark sends them to all tasks, else documents' n-grams are shuffled to meet them.

Repeated windows are found inside each row: hashes of all five-word windows, and
only where two are equal a sort of them, whose neighbours are then compared as
words.

Defined results: a null or empty text has no words and fails the base rules;
repeated rows are judged alike; a score of just the threshold is kept; without trusted labels the threshold is
minus infinity; a text of any length is measured whole; columns other than doc_id and text are not looked at; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 20
SMOOTH = 5.0  #: added to each bucket's counts, both on the scale of the trusted side
PRIOR = 20  #: n-grams of ratio one that every document has besides its own
WINDOW = 5


def bucket(gram: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(size)).cast("int")


def grams(words: Column, order: int) -> Column:
    """The n-grams of a word array."""
    if order == 1:
        return words
    n = F.size(words) - (order - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(words, i, order), " "))).otherwise(F.array().cast("array<string>"))


def _equal_neighbours(items: Column, same) -> Column:
    """Elements of a sorted array that equal the one before or after."""

    def of(a: Column) -> Column:
        return F.filter(a, lambda x, i: ((i > 0) & same(F.get(a, i - 1), x)) | ((i < F.size(a) - 1) & same(F.get(a, i + 1), x)))

    return common.let(items, of)


def repeated_words(words: Column, hashes: Column) -> Column:
    """How many words lie in a window that the text has twice or more. hashes: of its windows, in order."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    maybe = _equal_neighbours(ordered, lambda a, b: a["h"] == b["h"])
    spelled = F.array_sort(F.transform(maybe, lambda m: F.struct(F.array_join(F.slice(words, m["i"] + 1, WINDOW), " ").alias("w"), m["i"].alias("i"))))
    sure = F.array_sort(F.transform(_equal_neighbours(spelled, lambda a, b: a["w"] == b["w"]), lambda m: m["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(sure, start, lambda a, i: F.struct((a["n"] + F.lit(WINDOW) - F.greatest(F.lit(0), a["end"] - i)).alias("n"), (i + F.lit(WINDOW)).alias("end")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered)


def trusted(labels: DataFrame, max_labels: int | None = None) -> DataFrame:
    """t_id and fold (0: held out) of all trusted documents, or of max_labels of them, those with the smallest hash."""
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("t_id")).distinct()
    marked = good.withColumn("h", F.xxhash64("t_id"))
    some = marked if max_labels is None else marked.orderBy("h", "t_id").limit(max_labels)
    return some.select("t_id", F.pmod("h", F.lit(5)).alias("fold"))


def weights(docs: DataFrame, known: DataFrame, order: int, size: int) -> DataFrame:
    """w_bucket and its log ratio; at most ``size`` rows."""
    words = common.words_of(common.text_of(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), grams(words, order).alias("grams"))
    marked = rows.join(known.filter("fold != 0"), F.col("doc_id") == F.col("t_id"), "left").select(F.explode("grams").alias("gram"), F.col("t_id").isNotNull().cast("long").alias("hit"))
    counts = marked.groupBy(bucket(F.col("gram"), size).alias("w_bucket")).agg(F.count("*").alias("raw"), F.sum("hit").alias("hits"))
    counts = common.materialize(counts, "gram-counts")
    share = counts.agg(F.sum("hits") / F.sum("raw")).scalar()
    return counts.select("w_bucket", F.log((F.col("hits") + F.lit(SMOOTH)) / (F.col("raw") * share + F.lit(SMOOTH))).alias("ratio"))


def measured(docs: DataFrame, ratio: DataFrame, order: int, size: int) -> DataFrame:
    """The counts of the base rules and the score of every row. ratio: log ratios by bucket."""
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of(docs).alias("text")).withColumn("words", common.words_of(F.col("text")))
    n = F.size("words")
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    two = one.select(
        "doc_id",
        "words",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        hashes.alias("hashes"),
    )
    counted = two.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), F.col("hashes")).cast("long").alias("n_repeat_words"),
        grams(F.col("words"), order).alias("grams"),
    )
    # a row is its own group; all of its n-grams are in one task, which sums them before any shuffle
    marked = counted.withColumn("row", F.monotonically_increasing_id())
    small = [c for c in counted.columns if c != "grams"]
    spread = marked.select("row", *small, F.explode_outer("grams").alias("gram"))
    table = F.broadcast(ratio)  # at most `size` rows, whatever the input
    joined = spread.join(table, bucket(F.col("gram"), size) == F.col("w_bucket"), "left")
    total = joined.groupBy("row").agg(*[F.first(c).alias(c) for c in small], (F.coalesce(F.sum("ratio"), F.lit(0.0)) / (F.count("gram") + F.lit(PRIOR))).alias("score"))
    return total.drop("row")


def judge(docs: DataFrame, labels: DataFrame, miss: float = 0.015, max_labels: int | None = None, order: int = 1, size: int = BUCKETS) -> DataFrame:
    """Counts, score and verdict of every row. max_labels: if given, no more trusted documents than that are used."""
    known = common.materialize(trusted(labels, max_labels), "trusted")
    ratio = common.materialize(weights(docs, known, order, size), "ratios")
    rows = common.materialize(measured(docs, ratio, order, size), "quality")
    held = rows.join(known.filter("fold = 0"), F.col("doc_id") == F.col("t_id")).filter("n_words > 0")
    least = held.agg(F.percentile("score", F.lit(miss)).alias("least")).scalar()
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    passed = F.col("score") >= F.coalesce(least, F.lit(float("-inf")))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & passed)
