"""Readers of the corpus tables, and adapters that give them the engine's schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kind of declaration that a row of the part table stands for.
KINDS = {"ECONOMY": "METHOD", "MEDIUM": "CONSTRUCTOR", "PROMO": "FIELD", "STANDARD": "ENUM_CONSTANT", "LARGE": "CLASS", "SMALL": "INTERFACE"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_tree(spark: SparkSession, root: str, glob: str = "*", encodings: dict[str, str] | None = None) -> DataFrame:
    """All files below a folder as sources: relative_path, content, mime (the suffix), size_bytes.

    encodings: by suffix, for files that are not UTF-8; a byte order mark decides before that.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    base = "/" + root.removeprefix("file://").strip("/") + "/"
    mime = F.regexp_extract("path", r"\.([^./]+)$", 1)
    return files.filter(below(path, base)).select(relativize(path, base).alias("relative_path"), decoded(F.col("content"), mime, encodings).alias("content"), mime.alias("mime"), F.col("length").alias("size_bytes"))


def decoded(content: Column, mime: Column, encodings: dict[str, str] | None = None) -> Column:
    """The text of a file by its byte order mark, or its suffix's encoding, or UTF-8. What is no text in it becomes a replacement character."""
    head = F.hex(F.substring(content, 1, 3))
    out = F.when(head == "EFBBBF", _utf8(F.substring(content, F.lit(4), F.length(content))))
    out = out.when(head.startswith("FEFF") | head.startswith("FFFE"), F.decode(content, "UTF-16"))
    for suffix, charset in (encodings or {}).items():
        out = out.when(mime == suffix, F.decode(content, charset))
    return out.otherwise(_utf8(content))


def _utf8(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def below(path: Column, root: str) -> Column:
    """Whether a file lies below the folder of its category."""
    return path.startswith(root.rstrip("/") + "/")


def source_roots(segments: DataFrame) -> DataFrame:
    """code and relative path of the roots that a segments file names (lines ``code=rel:/path/``); other lines are no roots."""
    at = F.instr("value", "=")
    code, path = F.trim(F.expr("substring(value, 1, instr(value, '=') - 1)")), F.trim(F.expr("substring(value, instr(value, '=') + 1)"))
    rooted = segments.filter(~F.col("value").startswith("#") & (at > 0)).select(code.alias("code"), F.regexp_replace(path, r"\\\\(.)", "$1").alias("path"))
    return rooted.filter(F.col("path").startswith("rel:")).select("code", F.regexp_replace("path", "^rel:/?", "").alias("relative_path"))


def projects(paths: DataFrame, markers: list[str], ignores: list[str] = (), per_project: str | None = None) -> DataFrame:
    """The projects among files: group 1 of the first marker that a path fits, each once, by the least path in name order.

    A path any part of whose names an ignore pattern fits in full is left out, and so is a project that per_project fits.
    """
    part = F.col("path")
    kept = paths
    if ignores:
        pruned = "^(?:" + "|".join(f"(?:{g})" for g in ignores) + ")$"
        kept = kept.filter(~F.exists(F.split(part, "/"), lambda c: c.rlike(pruned)))
    hit = F.coalesce(*[F.when(part.rlike(f"^(?:{m})$"), F.regexp_extract(part, f"^(?:{m})$", 1)) for m in markers])
    found = kept.select(hit.alias("project"), F.split(part, "/").alias("names")).filter("project is not null")
    if per_project:
        found = found.filter(~F.col("project").rlike(f"^(?:{per_project})$"))
    return found.groupBy("project").agg(F.min("names").alias("first")).select("project", "first")


def java_root(path: Column, content: Column, option: str | None = None, owner: Column | None = None) -> Column:
    """The root of a Java source: as an option says, or its owner, or its folder without the parts of its package."""
    if option is not None:
        return F.lit(option)
    package = F.regexp_extract(content, r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    tail = F.concat(F.lit("/"), F.translate(package, ".", "/"))
    walked = F.when((package != "") & F.endswith(folder, tail), F.substring(folder, F.lit(1), F.length(folder) - F.length(tail))).otherwise(folder)
    return walked if owner is None else F.coalesce(owner, walked)


def fetched(addresses: DataFrame, timeout: float = 10.0) -> DataFrame:
    """address, text and lines of what each address answers; a failure gives no text and no lines."""

    def run(batches):
        import urllib.request

        import pandas as pd

        for batch in batches:
            rows = []
            for a in batch["address"]:
                try:
                    with urllib.request.urlopen(a, timeout=timeout) as answer:
                        text = answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
                    rows.append((a, text, text.splitlines()))
                except (OSError, ValueError):
                    rows.append((a, None, []))
            yield pd.DataFrame(rows, columns=["address", "text", "lines"])

    return addresses.select("address").mapInPandas(run, "address string, text string, lines array<string>")


def rule_files(sources: DataFrame) -> DataFrame:
    """Rules of all rule files among sources (relative_path, content): path, label, pattern, enabled, n_replacements, and problems of those that cannot be read."""
    from tesserae.sources.shipping import ship

    ship(sources.sparkSession)
    return sources.filter(F.col("relative_path").rlike(r"(^|/)META-INF/upgrade/[^/]*\.hint$|\.hint$")).select("relative_path", "content").mapInPandas(_rules, "path string, label string, pattern string, enabled boolean, n_replacements int, problem string")


def _rules(batches):
    import pandas as pd

    from tesserae.operators import rules

    for batch in batches:
        rows = []
        for path, text in zip(batch["relative_path"], batch["content"]):
            found, wrong = rules.read(text or "")
            rows += [(path, r.label, r.pattern, r.enabled, len(r.replacements), None) for r in found] + [(path, None, None, None, None, w) for w in wrong]
        out = pd.DataFrame(rows, columns=["path", "label", "pattern", "enabled", "n_replacements", "problem"])
        out["n_replacements"], out["enabled"] = out["n_replacements"].astype("Int32"), out["enabled"].astype("boolean")
        yield out


def relativize(path: Column, root: str) -> Column:
    """The path below a root; the full path where it is not below it."""
    return F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)


def rebase(path: Column, old: str, new: str) -> Column:
    """Another prefix in front of what is below the old one; other paths stay."""
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(path)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment, relative_path, content, mime, size_bytes of the documents."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("segment"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("relative_path"), F.col("text").alias("content"), F.col("lang").alias("mime"), F.col("n_chars").alias("size_bytes"))


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relative_path and content of the pages."""
    return table(spark, sf_dir, "pages").select(F.col("url").alias("relative_path"), F.col("html").alias("content"))


def kind_of(p_type: Column) -> Column:
    out = None
    for k, v in KINDS.items():
        out = F.when(p_type == k, v) if out is None else out.when(p_type == k, v)
    return out


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations: decl_pos, class_fqn, simple_name and its lower case, kind, modifiers."""
    p = table(spark, sf_dir, "part")
    name = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    modifiers = F.filter(F.array(F.when(F.col("p_size") % 2 == 0, "STATIC"), F.when(F.col("p_size") % 3 == 0, "PUBLIC").when(F.col("p_size") % 3 == 1, "PRIVATE")), lambda m: m.isNotNull())
    return p.select(
        F.col("p_partkey").alias("decl_pos"),
        F.concat(F.lit("shop."), F.lower("p_type"), F.lit("."), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("class_fqn"),
        name.alias("simple_name"),
        F.lower(name).alias("simple_name_lower"),
        kind_of(F.col("p_type")).alias("kind"),
        modifiers.alias("modifiers"),
    )


def usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file and the position of the declaration used there."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("decl_pos"), F.col("l_linenumber").alias("line"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key and ts of every access."""
    return table(spark, sf_dir, "events").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), "ts")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """child and parent over customers, nations and regions."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("child"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("parent"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent"))
    return c.unionByName(n)


def java_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment, path and content of a small Java source for each part; sources hang on each other by type and by call.

    The class of part k extends that of k div 4 and calls that of k div 2 + 1; what it declares depends on k.
    """
    k = F.col("p_partkey")
    text = lambda x: x.cast("string")
    up, other = text(F.expr("p_partkey div 4")), text(F.expr("p_partkey div 2 + 1"))
    derived, even, fifth = k >= 4, k % 2 == 0, k % 5 == 0
    part = lambda c, *x: F.when(c, F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])).otherwise("")
    lines = [
        F.lit("package shop.p;\nimport java.util.List;\n/* items.isEmpty() in a comment */\npublic class P"),
        text(k),
        part(derived, " extends P", up),
        part(fifth, " implements java.io.Serializable"),
        F.lit(" {\n private int count"),
        text(k % 3),
        F.lit(";\n private List<String> items;\n public void m"),
        text(k % 3),
        F.lit("(int a, String b) {\n  if (!items.isEmpty() && a > 0) { count"),
        text(k % 3),
        F.lit(" = items.size() + a; }\n  String s = \"x.isEmpty()\";\n }\n"),
        part(even, " <T extends Comparable<T>> T pick(List<? extends T> l, T[] d) { return l.isEmpty() ? d[0] : l.get(0); }\n"),
        F.lit(" void call(P"),
        other,
        F.lit(" o) { o.m"),
        text(F.expr("(p_partkey div 2 + 1) % 3")),
        F.lit("(1, \"x\"); o.next().next(); }\n"),
        part(derived, " P", up, " next() { return null; }\n"),
        part(fifth, " static class In { String s; boolean e() { return s.isEmpty(); } }\n"),
        F.lit("}\n"),
    ]
    # keys are dealt out before sources are made of them: reading these is what takes time
    keys = table(spark, sf_dir, "part").select("p_partkey").repartition(spark.sparkContext.defaultParallelism)
    return keys.select(F.concat(F.lit("s"), text(k % 3)).alias("segment"), text(k).alias("path"), F.concat(*lines).alias("content"))
