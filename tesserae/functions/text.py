"""Scalar functions on names, identifiers, spans and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of kinds, pictures and escapes in this module are fixed values of the formats that they belong to.

FIELDS = ("FIELD", "ENUM_CONSTANT")


def signature(kind: Column, owner: Column, name: Column, descriptor: Column) -> Column:
    """kind:owner:name[:descriptor]; fields carry no type, classes neither name nor descriptor."""
    return F.when(kind.isin("CLASS", "INTERFACE"), F.concat_ws(":", kind, owner)).when(kind.isin(*FIELDS), F.concat_ws(":", kind, owner, name)).otherwise(F.concat_ws(":", kind, owner, name, descriptor))


def normalized(sig: Column) -> Column:
    """Older field signatures have a type as fourth part, which is dropped."""
    parts = F.split(sig, ":")
    old = F.get(parts, F.lit(0)).isin(*FIELDS) & (F.size(parts) == 4)
    return F.when(old, F.array_join(F.slice(parts, 1, 3), ":")).otherwise(sig)


def top_level(sig: Column) -> Column:
    """The outermost class of a signature."""
    return F.substring_index(F.get(F.split(sig, ":"), F.lit(1)), "$", 1)


def icon(kind: Column, modifiers: Column) -> Column:
    """Name of the picture for a declaration: kind, static, visibility."""
    base = F.when(kind.isin("FIELD"), "variable").when(kind == "METHOD", "method").when(kind == "CONSTRUCTOR", "constructor").when(kind == "ENUM_CONSTANT", "constant").when(kind == "INTERFACE", "interface").otherwise("class")
    static = F.when(kind.isin("FIELD", "METHOD") & F.array_contains(modifiers, "STATIC"), "Static").otherwise("")
    seen = F.when(F.array_contains(modifiers, "PUBLIC"), "Public").when(F.array_contains(modifiers, "PRIVATE"), "Private").when(F.array_contains(modifiers, "PROTECTED"), "Protected").otherwise("Package")
    return F.when(kind.isin("FIELD", "METHOD", "CONSTRUCTOR"), F.concat(base, static, seen)).otherwise(base)


def category_label(id_: Column, names: Column | None = None) -> Column:
    """[identifier] of a rule's display name. names: a map from ids to display names; an id that it lacks is unknown."""
    x = F.regexp_replace(id_, "^text/x-java:", "")
    if names is not None:
        x = F.coalesce(F.try_element_at(names, x), F.lit("unknown"))
    x = F.replace(F.replace(x, F.lit("=="), F.lit("equals")), F.lit("!="), F.lit("not_equals"))
    x = F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9]", "_"), "_+", "_")
    return F.concat(F.lit("["), x, F.lit("] "))


def escape_key(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("__"), F.lit("___")), F.lit("$"), F.lit("__d"))


def unescape_key(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("__d"), F.lit("$")), F.lit("___"), F.lit("__"))


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br>"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def pack_spans(spans: Column) -> Column:
    """begin:end:begin:end of an array of (start, end)."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ":")


def unpack_spans(text: Column) -> Column:
    n = F.split(text, ":")
    return F.when(F.length(text) == 0, F.array().cast("array<struct<start:long,end:long>>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(n) - 2, F.lit(2)), lambda i: F.struct(F.get(n, i).cast("long").alias("start"), F.get(n, i + 1).cast("long").alias("end"))))


def pack_positions(spans: Column) -> Column:
    """start:length;start:length of an array of (start, end)."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), (s["end"] - s["start"]).cast("string"))), ";")


def common_prefix(least: Column, greatest: Column) -> Column:
    """Longest common prefix of a set of strings, from its least and its greatest."""
    n = F.least(F.length(least), F.length(greatest))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(least, F.lit(1), i) == F.substring(greatest, F.lit(1), i))
    return F.substring(least, F.lit(1), F.array_max(same))


def split_arguments(text: str) -> list[str]:
    """Words of a line; a backslash keeps the next character."""
    out, word, started, quoted = [], "", False, False
    for c in text:
        if quoted:
            word, quoted = word + c, False
        elif c == "\\":
            started = quoted = True
        elif c == " ":
            if started:
                out.append(word)
            word, started = "", False
        else:
            word, started = word + c, True
    return [*out, word] if started else out
