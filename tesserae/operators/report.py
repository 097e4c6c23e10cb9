"""Reports: diagnostics, snippets, run lengths, status of groups, generated rules, diffs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

#: From least to most; a group has the greatest of its members.
STATUS = ("NOTHING_TO_DO", "NO_HINTS_FOUND", "SUCCESS", "FAILURE")
#: What a compiler is told for each severity; anything else is a note.
SEVERITY = {"error": "ERROR", "verifier": "WARNING", "warning": "WARNING", "hint": "NOTE"}


def compiler_severity(severity: Column) -> Column:
    """ERROR, WARNING or NOTE."""
    out = None
    for k, v in SEVERITY.items():
        out = F.when(F.lower(severity) == k, v) if out is None else out.when(F.lower(severity) == k, v)
    return out.otherwise("NOTE")


def diagnostics(lines: DataFrame, needle: str, severity: Column, label: str) -> DataFrame:
    """Every hit of a string in each line, hits that do not overlap: path, line, column (both from 1), severity, message.

    The message has a place line, the source line and a line with a caret that keeps the tabs before it.
    """
    # the pieces between hits say where these are
    pieces = F.split("text", "\\Q" + needle + "\\E", -1)
    start = F.struct(F.lit(1).cast("long").alias("next"), F.array().cast("array<bigint>").alias("found"))
    found = F.aggregate(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), start, lambda a, p: F.struct((a["next"] + F.length(p) + F.lit(len(needle))).alias("next"), F.concat(a["found"], F.array((a["next"] + F.length(p)).cast("long"))).alias("found")), lambda a: a["found"])
    hit = lines.filter(F.col("text").contains(needle)).withColumn("column", F.explode(found)).withColumn("severity", severity)
    id_ = F.regexp_replace(F.lit(label), "[^A-Za-z0-9]+", "_")
    place = F.concat_ws("", F.col("path").cast("string"), F.lit(":"), (F.col("line") + 1).cast("string"), F.lit(": "), "severity", F.lit(": ["), id_, F.lit("] "), F.lit(label))
    caret = F.concat(F.regexp_replace(F.expr("substring(text, 1, int(column) - 1)"), r"[^\t]", " "), F.lit("^"))
    return hit.select("path", (F.col("line") + 1).cast("long").alias("line"), "column", "severity", F.concat_ws("\n", place, "text", caret).alias("message"))


def totals(found: DataFrame) -> DataFrame:
    """Errors and warnings, and the exit code that they give."""
    e, w = F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warning")
    return found.agg(e.alias("errors"), w.alias("warnings"), (e > 0).cast("int").alias("exit_code"))


def status(members: DataFrame) -> DataFrame:
    """The greatest status of each group."""
    rank = F.array_position(F.array(*map(F.lit, STATUS)), F.col("status"))
    return members.groupBy("group").agg(F.max(rank).alias("rank")).select("group", F.element_at(F.array(*map(F.lit, STATUS)), F.col("rank").cast("int")).alias("status"))


def run_lengths(spans: DataFrame, key: str, order: list[str], length: str) -> DataFrame:
    """Absolute start and end of spans that lie behind each other."""
    run = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(length).over(run)
    return spans.withColumn("end_off", end).withColumn("start_off", F.col("end_off") - F.col(length))


def snippets(lines: DataFrame, column: str, expression: str, around: int) -> DataFrame:
    """Lines that an expression hits, with as many lines before and after that are not blank, and what lies between.

    path, line, first and last line of the snippet.
    """
    full = F.when(F.length(F.trim(column)) > 0, F.col("line"))
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    # the number of full lines before and after a line names the lines that bound its snippet
    n = F.count(full).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = lines.withColumn("full", full).withColumn("n", n).withColumn("upto", F.coalesce(F.count("full").over(before), F.lit(0)))
    hit = marked.filter(F.col(column).rlike(expression)).select("path", "line", F.explode(F.sequence(F.col("upto") - around + 1, F.col("n") + around)).alias("n"))
    numbered = marked.filter("full is not null").select("path", F.col("line").alias("at"), "n")
    low = hit.join(numbered, ["path", "n"], "left")
    return low.groupBy("path", "line").agg(F.least(F.min("at"), F.col("line")).alias("first_line"), F.greatest(F.max("at"), F.col("line")).alias("last_line")).select("path", "line", "first_line", "last_line")


def snippet(code: str, start: int, end: int, around: int = 2) -> tuple[str, str, str]:
    """What stands before, in and behind a place, with as many lines around it that are not blank, escaped for a page."""
    lines, at, whole = code.split("\n"), 0, []
    for x in lines:
        whole.append((at, at + len(x), bool(x.strip())))
        at += len(x) + 1
    first = next(i for i, w in enumerate(whole) if start <= w[1])
    last = next(i for i, w in enumerate(whole) if max(start, end) <= w[1])
    a, b, n = first, last, 0
    while a > 0 and n < around:
        a -= 1
        n += whole[a][2]
    n = 0
    while b < len(whole) - 1 and n < around:
        b += 1
        n += whole[b][2]
    escape = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\n", "<br>").replace('"', "&quot;")
    return escape(code[whole[a][0] : start]), escape(code[start:end]), escape(code[end : whole[b][1]])


def use_pattern(kind: Column, modifiers: Column, owner: Column, name: Column) -> Column:
    """The rule that finds uses of a declaration."""
    static = F.array_contains(modifiers, "STATIC")
    call = F.when(kind == "METHOD", "()").otherwise("")
    return F.when(kind.isin("CLASS", "INTERFACE"), F.concat(owner, F.lit(";;"))).when(kind == "CONSTRUCTOR", F.concat(F.lit("new "), owner, F.lit("();;"))).when(static, F.concat(owner, F.lit("."), name, call, F.lit(";;"))).otherwise(F.concat(F.lit("$this."), name, call, F.lit(" :: $this instanceof "), owner, F.lit(";;")))


def unified(path: str, before: str, after: str, context: int = 3) -> str:
    """A unified diff; empty for equal texts."""
    a, b = before.splitlines(keepends=True), after.splitlines(keepends=True)
    return "".join(difflib.unified_diff(a, b, "a/" + path, "b/" + path, n=context))


@F.pandas_udf(StringType())
def diff(path: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else unified(p, x, y) for p, x, y in zip(path, before, after)])
