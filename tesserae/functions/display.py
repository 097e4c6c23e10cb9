"""What readers are shown: names of elements, rules as text, colours of tokens and of what is found in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions import signatures

#: Categories of tokens that are shown under another name (fixed values).
CATEGORIES = {"literal": "keyword", "keyword-directive": "keyword", "xml-attribute": "markup-attribute", "xml-comment": "comment", "xml-error": "error", "xml-operator": "operator", "xml-ref": "entity-reference", "xml-tag": "markup-element", "xml-value": "markup-attribute-value"}


def element_name(signature: Column) -> Column:
    """name(parameters) in owner; the name alone of a type."""
    parts = F.split(signature, ":")
    part = lambda i: F.get(parts, F.lit(i))
    params = F.when(part(0) == "METHOD", signatures.parameters(F.coalesce(part(3), F.lit("()V")))).otherwise("")
    return F.when(F.size(parts) == 2, part(1)).otherwise(F.concat(part(2), params, F.lit(" in "), part(1)))


def client_signature(kind: Column, owner: Column, name: Column, descriptor: Column, fqn: Column) -> Column:
    """The signature that a client makes of a row: only methods carry a descriptor."""
    return F.when(kind == "METHOD", F.concat_ws(":", kind, owner, name, descriptor)).when(kind.isin("CLASS", "INTERFACE", "ENUM", "ANNOTATION_TYPE"), F.concat_ws(":", kind, fqn)).otherwise(F.concat_ws(":", kind, owner, name))


def strip(text: Column, *prefixes: str) -> Column:
    """The text without the first of the prefixes that it has."""
    out = None
    for p in prefixes:
        rest = F.substring(text, F.lit(len(p) + 1), F.length(text))
        out = F.when(text.startswith(p), rest) if out is None else out.when(text.startswith(p), rest)
    return text if out is None else out.otherwise(text)


def rule_names(rules: DataFrame) -> DataFrame:
    """id and display name of each rule, the first name of an id; without a name the id is shown."""
    return rules.groupBy("id").agg(F.min("display_name").alias("name")).select("id", F.coalesce("name", "id").alias("display_name"))


def rule_text(pattern: Column, constraints: Column, n_imports: Column) -> Column:
    """The text of a rule, from its pattern and its constraints (array of variable and type); null if it has imports."""
    where = F.array_join(F.transform(constraints, lambda c: F.concat(c["variable"], F.lit(" instanceof "), c["type"])), " && ")
    return F.when(n_imports == 0, F.concat(pattern, F.when(F.size(constraints) > 0, F.concat(F.lit(" :: "), where)).otherwise(""), F.lit(";;\n")))


def query_escaped(text: Column) -> Column:
    """A text as part of a query of an address: what an address may hold stays, also : and /, but not &."""
    escaped = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, plain in (("%2F", "/"), ("%3A", ":"), ("%28", "("), ("%29", ")"), ("%3B", ";"), ("%24", "$"), ("%2C", ","), ("%3F", "?"), ("%40", "@"), ("%3D", "="), ("%2B", "+"), ("%21", "!"), ("%27", "'"), ("%7E", "~")):
        escaped = F.replace(escaped, F.lit(code), F.lit(plain))
    return escaped


def coloured(tokens: DataFrame) -> DataFrame:
    """Lengths and categories of a file's tokens, in order. tokens: path, offset, length, category, colours (array).

    A length runs from the end of the token before, so gaps go to the token behind them.
    """
    order = Window.partitionBy("path").orderBy("offset")
    end = F.col("offset") + F.col("length")
    shown = F.col("category")
    for a, b in CATEGORIES.items():
        shown = F.when(F.col("category") == a, b).otherwise(shown)
    more = F.array_join(F.transform(F.coalesce("colours", F.array().cast("array<string>")), F.lower), " ")
    return tokens.select("path", "offset", (end - F.coalesce(F.lag(end).over(order), F.lit(0))).alias("span"), F.trim(F.concat_ws(" ", shown, more)).alias("category"))


def highlighted(spans: DataFrame, highlights: DataFrame) -> DataFrame:
    """Spans of tokens cut where highlights begin and end. spans: path, start, text, category. highlights: path, h_start, h_end.

    A token gives up to three pieces for a highlight that meets it: before, within and behind. Places are cut once,
    however many highlights meet there; a piece is highlighted if one covers it. Highlights and tokens meet by the blocks of
    places that they reach into, not by comparing all of a file.
    """
    block = 256
    reach = lambda a, b: F.explode(F.sequence(F.floor(a / block), F.floor(F.greatest(b - 1, a) / block)))
    s = spans.withColumn("end", F.col("start") + F.length("text"))
    by = s.withColumn("block", reach(F.col("start"), F.col("end"))).select("path", "start", "end", "block")
    hs = highlights.withColumn("block", reach(F.col("h_start"), F.col("h_end")))
    met = by.join(hs, ["path", "block"]).filter((F.col("h_start") < F.col("end")) & (F.col("h_end") > F.col("start"))).groupBy("path", "start").agg(F.collect_set(F.struct("h_start", "h_end")).alias("hits"))
    both = s.join(met, ["path", "start"], "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<h_start:long,h_end:long>>")))
    inner = F.flatten(F.transform("hits", lambda h: F.array(F.greatest(h["h_start"], F.col("start")), F.least(h["h_end"], F.col("end")))))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.col("start").cast("long"), F.col("end").cast("long")), inner)))
    pieces = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda i: F.struct(F.get("cuts", i).alias("a"), F.get("cuts", i + 1).alias("b")))
    each = both.withColumn("cuts", cuts).filter(F.size("cuts") > 1).select("path", "start", "text", "category", "hits", F.explode(pieces).alias("p"))
    lit = F.exists("hits", lambda h: (h["h_start"] <= F.col("p.a")) & (h["h_end"] >= F.col("p.b")))
    return each.select("path", F.col("p.a").alias("start"), F.substring("text", (F.col("p.a") - F.col("start") + 1).cast("int"), (F.col("p.b") - F.col("p.a")).cast("int")).alias("text"), F.when(lit, F.concat("category", F.lit(" highlight"))).otherwise(F.col("category")).alias("category"))


def numbered(rows: DataFrame, project: str, file: str) -> DataFrame:
    """Rows with their place in their project, projects and files in the order in which they are listed; without a project come last.

    Projects are numbered among themselves and files within them, so no task sorts all files.
    """
    own = Window.partitionBy(project).orderBy(file)
    return rows.withColumn("place", F.row_number().over(own).cast("long"))


def listed(rows: DataFrame, project: str, file: str) -> DataFrame:
    """Rows by the project's name in any case, then by file."""
    return rows.orderBy(F.lower(project).asc_nulls_last(), file)
