"""Name search: the kind of a query is inferred from its text, and gives a predicate."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.rounds import shared_folder

EXACT, PREFIX, CI_PREFIX, REGEXP, CI_REGEXP, CAMEL = "EXACT", "PREFIX", "CASE_INSENSITIVE_PREFIX", "REGEXP", "CASE_INSENSITIVE_REGEXP", "CAMEL_CASE"
KINDS = (EXACT, PREFIX, CI_PREFIX, REGEXP, CI_REGEXP, CAMEL)


@dataclass(frozen=True)
class Query:
    kind: str
    text: str


def infer(text: str, case_sensitive: bool = False, kind: str | None = None) -> Query | None:
    """The query that a text stands for; None for a blank one. An unknown kind is as none."""
    if not text.strip():
        return None
    if kind in KINDS:
        return Query(kind, text.strip())
    if text.endswith(" "):
        return Query(EXACT, text.strip())
    text = text.strip()
    if (len(text) > 1 and text.isupper() and text.isalpha()) or re.fullmatch(r"[A-Z][a-z0-9]*(?:[A-Z][a-z0-9]*)+", text):
        return Query(CAMEL, text)
    if "*" in text or "?" in text:
        return Query(REGEXP if case_sensitive else CI_REGEXP, text)
    return Query(PREFIX if case_sensitive else CI_PREFIX, text)


def wildcard(text: str) -> str:
    """A regular expression for * and ?."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in text) + "$"


def humps(text: str) -> str:
    """A regular expression for names whose humps begin with those of the text."""
    parts = re.findall(r"[A-Z][a-z0-9]*|[^A-Z]+", text)
    return "^" + r"[a-z0-9_$]*".join(re.escape(p) for p in parts) + ".*$"


def matches(query: Query | None, name: Column, lower: Column) -> Column:
    """Whether a name is hit. lower: the name in lower case. Over a table that :func:`indexed` wrote, names and prefixes reach the scan."""
    if query is None:
        return F.lit(False)
    if query.kind == EXACT:
        return name == query.text
    if query.kind == PREFIX:
        return name.startswith(query.text)
    if query.kind == CI_PREFIX:
        return lower.startswith(query.text.lower())
    if query.kind == REGEXP:
        return name.rlike(wildcard(query.text))
    if query.kind == CI_REGEXP:
        return lower.rlike(wildcard(query.text.lower()))
    return name.rlike(humps(query.text)) | lower.startswith(query.text.lower())


_indexes: dict[tuple[str, str], str] = {}


def indexed(features: DataFrame, key: str) -> DataFrame:
    """The features as a table in the order of their lower-case names, written once for an application and key.

    Statistics of its row groups then leave out what a prefix cannot hit, and searches read little more than their hits.
    """
    spark = features.sparkSession
    name = (spark.sparkContext.applicationId, key)
    if name not in _indexes:
        where = f"{shared_folder(spark)}/names-{uuid.uuid4().hex}"
        ordered = features.repartitionByRange("simple_name_lower").sortWithinPartitions("simple_name_lower", "simple_name")
        ordered.write.option("parquet.block.size", str(4 << 20)).parquet(where)
        _indexes[name] = where
    return spark.read.schema(features.schema).parquet(_indexes[name])


def simple_of(fqn: Column) -> Column:
    """After the last $, else after the last dot."""
    return F.regexp_extract(fqn, r"([^.$]*)$", 1)


def outer_of(fqn: Column) -> Column:
    """Between the last dot and the last $, with $ as a dot; empty for a top-level name."""
    return F.translate(F.regexp_extract(fqn, r"([^.]*)\$[^.$]*$", 1), "$", ".")


def package_of(fqn: Column) -> Column:
    return F.regexp_extract(fqn, r"^(.*)\.[^.]*$", 1)


def file_of(fqn: Column, root: Column) -> Column:
    """The source file of a class below a root."""
    return F.concat(root, F.translate(F.substring_index(fqn, "$", 1), ".", "/"), F.lit(".java"))
