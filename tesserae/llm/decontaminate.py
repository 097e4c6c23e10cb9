"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Texts become templates: numbers, units and names (capitalised words) are replaced
by typed placeholders, other words are lower-cased, marks are dropped. A benchmark
item is looked for by its windows of five template words:

1. Windows of all documents meet the items' windows in a hash join. A document is
   a candidate for an item if it has at least ``share`` of the item's windows.
2. For candidates only, the words behind the placeholders are compared along each
   alignment of document and item (difference of their positions): every value of
   the item must stand for one value of the document, the commonest (of equals the
   value itself). Windows with another value are left out unless they equal the
   item's word for word, and the share is taken again.

So a copy is caught, and a copy with other numbers, units and names as well, but
not a text that only has the same outline.

With ``any_case`` (op5 and the pipeline) both steps are also taken over case-folded
words, where names stay words, and the larger share counts: a copy in capitals is
one run of names to the templates.

The items' windows are broadcast up to a checked number of rows, and shuffled
beyond it. A window of fewer than two plain words says little and is not used. Items of
fewer than five words, or without a window left, have no share: with ``any_case``
they are looked for as one sequence of case-folded words, numbers and units, so
that exact copies are caught; an item without any word or number is not looked for.

Defined results: null texts hold nothing; each row of a contaminated text is
reported, repeated ones too; null item ids are left out; a share of just ``share`` is enough; of values that
are equally common the item's own is the partner, else the greatest; a text of any length is looked through
whole; other columns are not looked at, and kept as they are by :func:`clean`; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 5
SHARE = 0.8
BROADCAST_ROWS = 500_000  #: windows of items, at some 40 bytes each

NUM, NAME, UNIT = "\x01", "\x02", "\x03"
#: with names as placeholders, or as case-folded words
VIEWS = (0, 1)
FOLDED = 1
_NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
#: fixed values
UNITS = ("%", "kg", "g", "mg", "lb", "lbs", "oz", "km", "m", "cm", "mm", "mi", "ft", "in", "l", "ml", "s", "ms", "min", "h", "hour", "hours", "minute", "minutes", "second", "seconds", "day", "days", "week", "weeks", "month", "months", "year", "years", "mph", "kmh", "dollars", "cents", "euros", "USD", "EUR", "GB", "MB", "KB", "Hz", "kHz", "MHz", "GHz", "W", "kW", "V", "A", "J", "N", "Pa")
_LETTER = r"\p{L}\p{M}"


def marked(text: Column, keep: bool, folded: bool = False) -> Column:
    """The text with placeholders, each followed by what it stands for if keep. If folded, case is folded first and names stay words."""
    unit = "|".join(dict.fromkeys(u.lower() for u in UNITS) if folded else UNITS)
    one, two = ("$1", "$2") if keep else ("", "")
    raw = F.upper(text) if folded else text
    # most texts hold no placeholder and no digit: a look for one spares them the replacements
    held = raw.contains(NUM) | raw.contains(NAME) | raw.contains(UNIT)
    t = F.when(held, F.regexp_replace(raw, f"[{NUM}{NAME}{UNIT}]", " ")).otherwise(raw)
    if folded:  # by way of capitals, as ß and SS; Spark would leave out upper() right inside lower()
        t = F.lower(t)
    # lookaheads stand first: a lookbehind at every place of the text is what takes time
    n = F.regexp_replace(t, rf"([$€£¥])\s?({_NUMBER})", f" {UNIT}{one} {NUM}{two} ")
    n = F.regexp_replace(n, rf"(?=[0-9])(?<!{NUM})({_NUMBER})\s?({unit})(?![{_LETTER}])", f" {NUM}{one} {UNIT}{two} ")
    n = F.regexp_replace(n, rf"(?=[0-9])(?<![{NUM}0-9.,])({_NUMBER})", f" {NUM}{one} ")
    t = F.when(text.rlike("[0-9]"), n).otherwise(t)
    if folded:
        return t
    t = F.regexp_replace(t, rf"(?=\p{{Lu}})(?<![{_LETTER}{UNIT}])(\p{{Lu}}[{_LETTER}]*)", f" {NAME}{one} ")
    return F.lower(t)


def template(text: Column, folded: bool = False) -> Column:
    """The template words of a text."""
    return F.array_remove(F.split(marked(text, False, folded), f"[^{_LETTER}{NUM}{NAME}{UNIT}]+"), "")


def filled(text: Column, folded: bool = False) -> Column:
    """The template words in the same order, placeholders with their values."""
    return F.regexp_extract_all(marked(text, True, folded), F.lit(f"{NUM}[0-9.,]+|{UNIT}[^ ]+|{NAME}[{_LETTER}]+|[{_LETTER}]+"), F.lit(0))


def _outline(words: Column) -> Column:
    return F.transform(words, lambda w: F.when(F.substring(w, 1, 1).isin(NUM, NAME, UNIT), F.substring(w, 1, 1)).otherwise(w))


def _windows(words: Column, make) -> Column:
    """make(i) for the start of every window, none if there are too few words."""
    n = F.size(words)
    return F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), make))


def _hashes(words: Column) -> Column:
    """Hashes of all windows of an array of words."""
    return common.let(words, lambda w: _windows(w, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])))


def _texts(docs: DataFrame) -> DataFrame:
    text = common.text_of(docs)
    return docs.select(F.unhex(F.md5(text.cast("binary"))).alias("tid"), text.alias("text"))


def _positions(rows: DataFrame, *keys: str, views: tuple = VIEWS[:1]) -> DataFrame:
    """keys, view, position, outline of the window (a string) and its filled words. For few texts."""
    each = lambda w, o: _windows(w, lambda i: F.struct(F.array_join(F.slice(o, i + 1, WINDOW), " ").alias("window"), F.slice(w, i + 1, WINDOW).alias("values")))
    both = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("view"), filled(F.col("text"), v == FOLDED).alias("words")) for v in views])).alias("v")).select(*keys, "v.view", "v.words")
    at = F.posexplode(common.let(F.col("words"), lambda w: common.let(_outline(w), lambda o: each(w, o))))
    return both.select(*keys, "view", at.alias("pos", "w")).select(*keys, "view", "pos", "w.window", "w.values")


def item_windows(benchmark: DataFrame, views: tuple = VIEWS[:1]) -> DataFrame:
    """item_id, view, pos, window, values, hash and n_windows of the windows that are looked for."""
    text = benchmark.select(F.col("item_id").cast("long").alias("item_id"), common.text_of(benchmark).alias("text")).filter("item_id is not null")
    at = _positions(text, "item_id", views=views)
    plain = F.size(F.filter("values", lambda w: ~F.substring(w, 1, 1).isin(NUM, NAME, UNIT)))
    words = F.split("window", " ")
    used = at.filter(plain >= 2).withColumn("hash", F.xxhash64(*[F.get(words, k) for k in range(WINDOW)]))
    sizes = used.groupBy(F.col("item_id").alias("s_item"), F.col("view").alias("s_view")).agg(F.countDistinct("window").cast("long").alias("n_windows"))
    return used.join(sizes, (F.col("item_id") == F.col("s_item")) & (F.col("view") == F.col("s_view"))).drop("s_item", "s_view")


def _met(hits: DataFrame, share: float) -> DataFrame:
    """tid, item_id, view and share of windows met, where that is enough. hits: tid, item_id, view, window or hash, n_windows."""
    each = hits.distinct().groupBy("tid", "item_id", "view").agg(F.count("*").alias("met"), F.first("n_windows").alias("n_windows"))
    return each.withColumn("share", F.col("met") / F.col("n_windows")).filter(F.col("share") >= F.lit(share)).select("tid", "item_id", "view", "share")


def matches(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, broadcast_rows: int = BROADCAST_ROWS, any_case: bool = False) -> DataFrame:
    """tid (MD5 of a text), item_id, share and n_other (values that differ from the item's) of contaminated texts.

    If any_case, windows of case-folded words are looked for too, and the larger share counts; items without a window are looked for in full.
    """
    views = VIEWS if any_case else VIEWS[:1]
    items = common.materialize(item_windows(benchmark, views), "item-windows")
    hint = lambda df, rows: F.broadcast(df) if rows <= broadcast_rows else df
    n_windows = items.count()
    texts = _texts(docs)
    # a window without a name hashes alike in both views: hits may only be too many here, the words decide
    # windows that a text repeats may come again; what hits is made distinct where it is counted
    hashes = F.concat(*[F.coalesce(_hashes(F.col(f"words{v}")), F.array().cast("array<bigint>")) for v in views])
    wide = texts.select("tid", *[template(F.col("text"), v == FOLDED).alias(f"words{v}") for v in views]).select("tid", F.explode(hashes).alias("d_hash"))
    looked = items.select("item_id", "view", "hash", "n_windows").distinct()
    hits = wide.join(hint(looked, n_windows), wide["d_hash"] == looked["hash"]).select("tid", "item_id", "view", "hash", "n_windows")
    found = common.materialize(_met(hits, share).select("tid", "item_id", "view"), "candidates")
    # the words of candidates, in full
    of = found.select(F.col("tid").alias("c_tid"), F.col("item_id").alias("c_item"), F.col("view").alias("c_view"))
    few = texts.join(hint(of.select("c_tid").distinct(), found.count()), F.col("tid") == F.col("c_tid"), "left_semi").dropDuplicates(["tid"])
    at = _positions(few, "tid", views=views).select("tid", F.col("view").alias("d_view"), F.col("pos").alias("d_pos"), F.col("window").alias("d_window"), F.col("values").alias("d_values"))
    pairs = at.join(hint(items, n_windows), (F.col("d_window") == F.col("window")) & (F.col("d_view") == F.col("view"))).join(of, (F.col("tid") == F.col("c_tid")) & (F.col("item_id") == F.col("c_item")) & (F.col("view") == F.col("c_view")), "left_semi")
    lined = common.materialize(pairs.select("tid", "item_id", "view", "n_windows", "window", "pos", (F.col("d_pos") - F.col("pos")).alias("line"), F.arrays_zip(F.col("values").alias("i"), F.col("d_values").alias("d")).alias("slots")), "alignments")
    line = ["tid", "item_id", "view", "line"]
    slots = lined.select(*line, "pos", F.posexplode("slots").alias("k", "s")).select(*line, (F.col("pos") + F.col("k")).alias("at"), "s.i", "s.d").filter(F.substring("i", 1, 1).isin(NUM, NAME, UNIT)).distinct()
    # each value's partner: the commonest, of equals the value itself
    partner = F.max(F.struct("n", (F.col("i") == F.col("d")).alias("same"), "d"))["d"]
    kept = slots.groupBy(*line, "i", "d").agg(F.count("*").alias("n")).groupBy(*line, "i").agg(partner.alias("d"), F.count("*").alias("n"), F.max((F.col("i") != F.col("d")).cast("long")).alias("other"))
    kept = common.materialize(kept.groupBy(*line).agg(F.max("n").alias("most"), F.sum("other").alias("other"), F.map_from_entries(F.collect_list(F.struct("i", "d"))).alias("partners")), "partners")
    broken = kept.filter("most > 1").select(*[F.col(c).alias("b_" + c) for c in line], "partners")
    verbatim = F.forall("slots", lambda s: s["i"] == s["d"])
    regular = F.forall("slots", lambda s: ~F.substring(s["i"], 1, 1).isin(NUM, NAME, UNIT) | (F.col("partners")[s["i"]] == s["d"]))
    lines = [F.col(c) == F.col("b_" + c) for c in line]
    sound = common.materialize(lined.join(broken, lines, "left").filter(F.col("partners").isNull() | verbatim | regular).select(*line, "window", "n_windows"), "sound")
    whole = _met(sound.select("tid", "item_id", "view", "window", "n_windows"), share)
    other = kept.join(sound.select(*line).distinct(), line, "left_semi").groupBy("tid", "item_id", "view").agg(F.min("other").alias("n_other"))
    each = whole.join(other, ["tid", "item_id", "view"], "left").select("tid", "item_id", "view", "share", F.coalesce("n_other", F.lit(0)).cast("long").alias("n_other"))
    found = each.groupBy("tid", "item_id").agg(F.max("share").alias("share"), F.min_by("n_other", "view").alias("n_other"))  # names count if both views match
    return found.unionByName(whole_copies(docs, benchmark, items, broadcast_rows)) if any_case else found


def whole_copies(docs: DataFrame, benchmark: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """tid, item_id, share (1) and n_other (0) of texts that hold an item without a window in full, values included, in any case.

    items: what item_windows() gave in all views. A hash join on the first words of an item names candidates.
    """
    text = benchmark.select(F.col("item_id").cast("long").alias("item_id"), filled(common.text_of(benchmark), True).alias("words")).filter(F.col("item_id").isNotNull() & (F.size("words") > 0))
    head = text.join(items.select("item_id").distinct(), "item_id", "left_anti").withColumn("n", F.least(F.size("words"), F.lit(WINDOW)))
    head = common.materialize(head.select("item_id", "n", F.xxhash64(F.slice("words", F.lit(1), F.col("n"))).alias("hash"), _sequence("words").alias("sequence")).distinct(), "whole-items")
    lengths = sorted(r.n for r in head.select("n").distinct().collect())  # at most five
    hint = (lambda df, rows: F.broadcast(df) if rows <= broadcast_rows else df)
    texts = _texts(docs)
    if not lengths:
        return texts.limit(0).select("tid", F.lit(0).cast("long").alias("item_id"), F.lit(1.0).alias("share"), F.lit(0).cast("long").alias("n_other"))
    starts = lambda w, k: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, k))))
    hashes = common.let(filled(F.col("text"), True), lambda w: F.array_distinct(F.concat(*[F.coalesce(starts(w, k), F.array().cast("array<bigint>")) for k in lengths])))
    n_heads = head.count()
    hits = texts.select("tid", F.explode(hashes).alias("d_hash")).join(hint(head.select("item_id", "hash"), n_heads), F.col("d_hash") == F.col("hash"))
    of = common.materialize(hits.select(F.col("tid").alias("c_tid"), F.col("item_id").alias("c_item")).distinct(), "whole-candidates")
    few = texts.join(hint(of.select("c_tid").distinct(), of.count()), F.col("tid") == F.col("c_tid"), "left_semi").dropDuplicates(["tid"]).select("tid", _sequence(filled(F.col("text"), True)).alias("d_sequence"))
    pairs = few.join(of, F.col("tid") == F.col("c_tid")).join(hint(head.select("item_id", "sequence"), n_heads), F.col("c_item") == F.col("item_id"))
    return pairs.filter(F.contains("d_sequence", "sequence")).select("tid", "item_id", F.lit(1.0).alias("share"), F.lit(0).cast("long").alias("n_other")).distinct()


def _sequence(words) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, any_case: bool = False) -> DataFrame:
    """A row for each document that holds benchmark items: doc_id, n_items, item_ids, share of the fullest, n_other of the closest."""
    got = matches(docs, benchmark, share, any_case=any_case).groupBy("tid").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("share"), F.min("n_other").alias("n_other"))
    got = common.materialize(got.withColumnRenamed("tid", "m_tid"), "contaminated")
    text = common.text_of(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("tid"))
    return rows.join(got, F.col("tid") == F.col("m_tid")).select("doc_id", "n_items", "item_ids", "share", "n_other")


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, any_case: bool = False) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns."""
    (tid,) = common.unused(docs, "tid")
    got = common.materialize(matches(docs, benchmark, share, any_case=any_case).select(F.col("tid").alias("m_" + tid)).distinct(), "contaminated")
    keyed = docs.withColumn(tid, F.unhex(F.md5(common.text_of(docs).cast("binary"))))
    return keyed.join(got, keyed[tid] == got["m_" + tid], "left_anti").drop(tid)
