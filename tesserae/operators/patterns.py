"""Pattern search: token phrases as a cheap filter, frequencies, exact validation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = "\x01"


@dataclass(frozen=True)
class Pattern:
    """A name, phrases that must all occur, types that the document must have, and an exact expression."""

    name: str
    phrases: tuple[tuple[str, ...], ...]
    types: tuple[str, ...] = ()
    exact: str | None = None


def joined(text: Column) -> Column:
    """Tokens of a text, each between separators that no token holds."""
    return F.concat(F.lit(SEP), F.regexp_replace(F.trim(text), r"[\s\x01]+", SEP + SEP), F.lit(SEP))


def _spelled(phrase: tuple[str, ...]) -> str:
    return SEP + (SEP + SEP).join(phrase) + SEP


def has_phrase(tokens: Column, phrase: tuple[str, ...]) -> Column:
    return tokens.contains(F.lit(_spelled(phrase)))


def count_phrase(tokens: Column, phrase: tuple[str, ...]) -> Column:
    """Occurrences that do not overlap."""
    p = _spelled(phrase)
    return ((F.length(tokens) - F.length(F.replace(tokens, F.lit(p), F.lit("")))) / F.lit(len(p))).cast("long")


def holds(pattern: Pattern, tokens: Column, types: Column, attributed: Column) -> Column:
    """All phrases, and all types unless the document was indexed without types."""
    some = [has_phrase(tokens, p) for p in pattern.phrases if p]
    if not some:
        raise ValueError("a pattern needs a phrase")
    typed = reduce(lambda a, b: a & b, [F.array_contains(types, t) for t in pattern.types], F.lit(True))
    return reduce(lambda a, b: a & b, some) & (~attributed | typed)


def search(docs: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """path, pattern and freq. docs: path, tokens, types, attributed. All patterns in one pass."""
    each = F.array(*[F.when(holds(p, F.col("tokens"), F.col("types"), F.col("attributed")), F.struct(F.lit(p.name).alias("pattern"), count_phrase(F.col("tokens"), p.phrases[0]).alias("freq"))) for p in patterns])
    return docs.select("path", F.explode(F.filter(each, lambda h: h.isNotNull())).alias("h")).select("path", "h.pattern", "h.freq")


def validated(docs: DataFrame, pattern: Pattern, content: str) -> DataFrame:
    """path and n_exact of candidates in which the exact expression holds: phrases first, then the expression on survivors."""
    few = docs.filter(holds(pattern, F.col("tokens"), F.col("types"), F.col("attributed")))
    return few.select("path", F.regexp_count(F.col(content), F.lit(pattern.exact)).cast("long").alias("n_exact")).filter("n_exact > 0")


def references(rows: DataFrame, file: str, content: str) -> DataFrame:
    """file and every dotted or dashed name in its content, with all prefixes of two parts and more, once each."""
    found = F.explode(F.regexp_extract_all(F.col(content), F.lit(r"[A-Za-z_][A-Za-z0-9_]*(?:[.-][A-Za-z_][A-Za-z0-9_]*)+"), F.lit(0)))
    parts = F.split("name", "[.-]")
    prefixes = F.transform(F.sequence(F.lit(2), F.size("parts")), lambda n: F.array_join(F.slice("parts", 1, n), "."))
    return rows.select(F.col(file).alias("file"), found.alias("name")).withColumn("parts", parts).select("file", F.explode(prefixes).alias("reference")).distinct()
