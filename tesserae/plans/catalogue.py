"""The catalogue of queries, by name, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import display, signatures, text
from tesserae.operators import batch, clones, duplicates, extractors, java, locate, lookup, maintenance, names, patterns, report, rounds, rules, statistics
from tesserae.plans.oracles import ORACLES
from tesserae.sources import corpus
from tesserae.sources.shipping import ship
from tesserae.streaming import counters


def q01_file_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.file_statistics(corpus.sources(spark, sf))


def q02_keyed_counters(spark, sf):
    s = corpus.sources(spark, sf)
    one = F.lit(1)
    return statistics.counters(s, [(F.concat(F.lit("segment/"), "segment"), one), (F.concat(F.lit("mime/"), "mime"), one), (F.concat(F.lit("size/"), "mime"), F.col("size_bytes")), (F.lit("total"), one)])


def q03_element_statistics(spark, sf):
    return statistics.element_statistics(corpus.features(spark, sf))


def _signed(spark, sf):
    f = corpus.features(spark, sf)
    return f.withColumn("signature", text.signature(F.col("kind"), F.col("class_fqn"), F.col("simple_name"), F.lit("()V")))


def q04_signatures(spark, sf):
    parts = F.split("signature", ":")
    return _signed(spark, sf).select("decl_pos", "signature", F.size(parts).cast("long").alias("n_parts"), F.get(parts, F.lit(1)).alias("owner"), F.get(parts, F.lit(2)).alias("name"), text.top_level(F.col("signature")).alias("top_level"))


def _used(spark, sf):
    return corpus.usages(spark, sf).join(_signed(spark, sf).select("decl_pos", "signature"), "decl_pos").select("file", "signature", "line")


def q05_distinct_usages(spark, sf):
    return _used(spark, sf).select("file", "signature").distinct().groupBy("file").agg(F.count("*").alias("n_signatures"))


def q06_references(spark, sf):
    docs = corpus.sources(spark, sf).select(F.col("relative_path").alias("file"), "content")
    pages = corpus.resources(spark, sf).select(F.col("relative_path").alias("file"), "content")
    return patterns.references(docs.unionByName(pages), "file", "content")


def q07_categories(spark, sf):
    return corpus.sources(spark, sf).groupBy("segment").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("index_size"), F.countDistinct("mime").alias("n_mimes")).withColumn("display_name", F.concat(F.upper(F.substring("segment", 1, 1)), F.expr("substring(segment, 2)")))


MARKERS = [r"(.*)/en/[0-9]+.*", r"(.*)/de/[0-9]+.*"]


def q08_projects(spark, sf):
    path = F.regexp_replace("relative_path", "^https?://", "")
    return corpus.projects(corpus.resources(spark, sf).select(path.alias("path")), MARKERS, [r"m\..*"]).select("project")


def _named(spark, sf, query):
    f = names.indexed(corpus.features(spark, sf), sf)
    return f.filter(names.matches(query, F.col("simple_name"), F.col("simple_name_lower")))


def q09_prefix_search(spark, sf):
    exact, loose = names.infer("Sm", case_sensitive=True), names.infer("sm")
    a = _named(spark, sf, exact).select(F.lit("prefix").alias("search"), "decl_pos", "simple_name")
    return a.unionByName(_named(spark, sf, loose).select(F.lit("any case").alias("search"), "decl_pos", "simple_name"))


def q10_wildcard_search(spark, sf):
    return _named(spark, sf, names.infer("r*g?t")).select("decl_pos", "simple_name")


def q11_camel_search(spark, sf):
    hits = _named(spark, sf, names.infer("RW"))
    kind = F.when(F.col("kind").isin("CLASS", "INTERFACE"), "CLASS").otherwise(F.col("kind"))
    return hits.select("decl_pos", "simple_name", kind.alias("kind"), F.col("class_fqn").alias("enclosing"))


def q12_binary_names(spark, sf):
    fqn = F.concat("class_fqn", F.lit("$"), "simple_name")
    f = corpus.features(spark, sf).select("decl_pos", fqn.alias("fqn"))
    return f.select("decl_pos", names.simple_of(F.col("fqn")).alias("simple"), names.outer_of(F.col("fqn")).alias("outer_name"), names.package_of(F.col("fqn")).alias("package"), names.file_of(F.col("fqn"), F.lit("src/")).alias("file"))


PATTERNS = [
    patterns.Pattern("of the", (("of", "the"),), exact=r"\bof the\b"),
    patterns.Pattern("de la", (("de", "la"),), types=("es",), exact=r"\bde la\b"),
    patterns.Pattern("the and of", (("the",), ("and",), ("of",)), types=("en",), exact="the"),
]


def _pattern_docs(spark, sf):
    d = corpus.table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("path"), patterns.joined(F.col("text")).alias("tokens"), F.array("lang", "source").alias("types"), (F.col("doc_id") % 10 != 0).alias("attributed"), "text")


def q13_phrase_search(spark, sf):
    return _pattern_docs(spark, sf).filter(patterns.has_phrase(F.col("tokens"), ("of", "the"))).select("path")


def q14_pattern_frequencies(spark, sf):
    return patterns.search(_pattern_docs(spark, sf), PATTERNS)


def q15_validated_patterns(spark, sf):
    return patterns.validated(_pattern_docs(spark, sf), PATTERNS[0], "text")


def q16_kind_groups(spark, sf):
    group = F.when(F.col("kind").isin("CLASS", "INTERFACE"), "types").when(F.col("kind").isin("FIELD", "ENUM_CONSTANT"), "fields").when(F.col("kind").isin("METHOD"), "methods").otherwise("others")
    return corpus.features(spark, sf).groupBy(group.alias("kind_group"), "class_fqn").agg(F.count("*").alias("n"))


def _roots(spark, sf):
    s = corpus.sources(spark, sf)
    each = s.select(F.explode(F.array(F.concat("segment", F.lit("/")), F.concat("segment", F.lit("/"), "mime", F.lit("/")))).alias("root")).distinct()
    return each.withColumn("ordinal", F.length("root"))


def q17_source_roots(spark, sf):
    s, roots = corpus.sources(spark, sf), _roots(spark, sf)
    every = lookup.by_root(s, "relative_path", roots).groupBy("root").agg(F.count("*").alias("n_all"))
    best = lookup.first_root(s.select("relative_path"), "relative_path", roots, "relative_path").groupBy("root").agg(F.count("*").alias("n_longest"))
    return every.join(best, "root", "left").select("root", "n_all", F.coalesce("n_longest", F.lit(0)).alias("n_longest"))


def q18_usages(spark, sf):
    """Uses of every signature, under its older form if it has none, and in resources: declarations that name it."""
    signed, used = _signed(spark, sf), _used(spark, sf)
    old = F.when(F.col("kind").isin("FIELD", "ENUM_CONSTANT"), F.concat("signature", F.lit(":I"))).otherwise(F.col("signature"))
    wanted = signed.select(text.normalized(old).alias("signature"), F.concat_ws(".", "class_fqn", "simple_name").alias("reference"), F.concat(F.lit("old:"), "signature").alias("legacy")).distinct()
    docs = signed.select(F.concat_ws(".", "class_fqn", "simple_name").alias("signature"), F.col("decl_pos").alias("file"))
    # signatures of static declarations are known in their older form only
    older = signed.select("signature", F.array_contains("modifiers", "STATIC").alias("static")).groupBy("signature").agg(F.max("static").alias("static"))
    seen = used.join(older, "signature").select(F.when(F.col("static"), F.concat(F.lit("old:"), "signature")).otherwise(F.col("signature")).alias("signature"), "file")
    found = lookup.usages_of(wanted, seen, docs)
    return found.groupBy("signature", "found").agg(F.sum("n").alias("n"), F.count("*").alias("n_files"))


def q19_unused(spark, sf):
    """Declarations that no line uses; static ones are never reported. Every second key is used by nobody, as keys are doubled."""
    used = corpus.usages(spark, sf)
    few = corpus.features(spark, sf).select((F.col("decl_pos") * 2).alias("decl_pos"), "class_fqn", "simple_name", "modifiers")
    return lookup.unused(few, used, "decl_pos", few.filter(F.array_contains("modifiers", "STATIC"))).select("decl_pos", "class_fqn", "simple_name")


def q20_duplicate_hashes(spark, sf):
    found = duplicates.single(corpus.table(spark, sf, "documents"), "doc_id", "text")
    return duplicates.duplicated(found)


def q21_duplicate_groups(spark, sf):
    docs = corpus.table(spark, sf, "documents")
    page = rounds.checkpointed(duplicates.ranked(duplicates.runs(docs, "doc_id", "text"), 0))
    return duplicates.offsets(page, docs, "doc_id", "text").select("value", "n_lines", "n_files", "n_spans", "path", "start_off", "end_off")


def q22_hashes_by_category(spark, sf):
    d = corpus.table(spark, sf, "documents")
    found = duplicates.single(d.select(F.struct("doc_id", "source").alias("k"), "text"), "k", "text").select("hash", "value", F.col("path.doc_id").alias("path"), F.col("path.source").alias("segment"))
    asked = duplicates.duplicated(found).select("hash")
    asked = rounds.checkpointed(asked.unionByName(spark.createDataFrame([("00000000:0",)], "hash string")))
    files = F.array_join(F.transform("files", lambda x: x.cast("string")), ",")
    return duplicates.by_category(asked, d.select(F.col("source").alias("segment")), found).select("hash", "segment", F.size("files").cast("long").alias("n_files"), files.alias("files"))


def q23_usage_and_subtypes(spark, sf):
    """By order: lines of parts that are public, and the others as subtypes."""
    f = corpus.features(spark, sf).select("decl_pos", F.array_contains("modifiers", "PUBLIC").alias("public"))
    each = corpus.usages(spark, sf).join(f, "decl_pos")
    used = each.filter("public").groupBy("file").agg(F.count("*").alias("n_usages"))
    sub = each.filter("not public").groupBy("file").agg(F.sort_array(F.collect_set("decl_pos")).alias("subs"))
    return used.join(sub, "file", "full_outer").select("file", F.col("n_usages").isNotNull().alias("usage"), F.coalesce("n_usages", F.lit(0)).alias("n_usages"), F.coalesce(F.array_join(F.transform("subs", lambda x: x.cast("string")), ","), F.lit("")).alias("subtypes"))


def q24_classpath(spark, sf):
    f = corpus.features(spark, sf)
    wanted = f.select(F.col("simple_name").alias("name")).distinct()
    files = f.select(F.col("simple_name").alias("name"), F.col("class_fqn").alias("entry")).distinct()
    order = f.select("class_fqn").distinct().select(F.explode(F.array(F.col("class_fqn"), F.concat("class_fqn", F.lit(".jar")))).alias("entry")).withColumn("ordinal", F.conv(F.substring(F.md5("entry"), 1, 8), 16, 10).cast("long"))
    return lookup.resolve(wanted, order, files)


def q25_random_files(spark, sf):
    s = corpus.sources(spark, sf)
    return s.select("relative_path", F.md5(F.concat("relative_path", F.lit(":42"))).alias("mark")).orderBy("mark", "relative_path").limit(30)


def q26_decoded_signatures(spark, sf):
    ship(spark)
    f = corpus.features(spark, sf)
    kinds = {"METHOD": "<T:Ljava/lang/String;>(Ljava/util/Map<Ljava/util/List<Ljava/lang/String;>;TT;>;Z)V;", "CONSTRUCTOR": "(Ljava/util/List<+Ljava/lang/String;>;[[I)V;", "FIELD": "()Lshop/Box$Lid<**>;", "ENUM_CONSTANT": "(J-D)V"}
    encoded = F.lit("()V")
    for k, v in kinds.items():
        encoded = F.when(F.col("kind") == k, v).otherwise(encoded)
    return f.select("decl_pos", encoded.alias("encoded")).withColumn("decoded", signatures.parameters("encoded"))


def q27_icons(spark, sf):
    return corpus.features(spark, sf).select("decl_pos", text.icon(F.col("kind"), F.col("modifiers")).alias("icon"))


def q28_category_labels(spark, sf):
    p = corpus.table(spark, sf, "part")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("text/x-java:"), "p_name", F.lit(" == "), "p_brand")).otherwise(F.concat("p_name", F.lit(" != "), "p_brand", F.lit("!!")))
    return p.select("p_partkey", text.category_label(raw).alias("label"))


def q29_escaping(spark, sf):
    p = corpus.table(spark, sf, "part")
    key = F.concat(F.replace("p_name", F.lit(" "), F.lit("__")), F.when(F.col("p_partkey") % 2 == 0, "$").otherwise("_"), "p_type")
    e = text.escape_key(key)
    return p.select("p_partkey", e.alias("escaped"), text.unescape_key(e).alias("unescaped"), text.escape_html(F.concat(F.lit('<a href="'), "p_name", F.lit('">&\n'))).alias("html"))


def q30_use_types(spark, sf):
    u = corpus.usages(spark, sf).withColumn("use", F.element_at(F.array(F.lit("READ"), F.lit("WRITE"), F.lit("EXECUTE")), (F.col("line") % 3 + 1).cast("int")))
    by = u.groupBy("decl_pos").agg(F.array_join(F.sort_array(F.collect_set("use")), "|").alias("uses"), F.count("*").alias("n_uses"))
    f = corpus.features(spark, sf).select("decl_pos", F.array_contains("modifiers", "PRIVATE").alias("private"))
    return f.join(by, "decl_pos", "left").select("decl_pos", F.coalesce("uses", F.lit("")).alias("uses"), F.coalesce("n_uses", F.lit(0)).alias("n_uses"), (F.col("private") & ~F.coalesce(F.col("uses").contains("READ"), F.lit(False))).alias("unused"))


def q31_offsets(spark, sf):
    spans = corpus.usages(spark, sf).select("file", "decl_pos", "line", (F.col("decl_pos") % 17 + 1).alias("span"))
    return report.run_lengths(spans, "file", ["line", "decl_pos"], "span")


def q32_narrowest(spark, sf):
    lines = duplicates.lines(corpus.table(spark, sf, "documents"), "doc_id", "text")
    halves = lines.withColumn("mid", F.expr("start_off + (end_off - start_off) div 2"))
    intervals = halves.select("path", F.explode(F.array(F.struct("start_off", "end_off"), F.struct("start_off", F.col("mid").alias("end_off")))).alias("i")).select("path", "i.*")
    points = corpus.table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.explode(F.array(F.expr("n_chars div 3"), F.expr("n_chars div 2 + 1"))).alias("point"))
    return lookup.narrowest(points.distinct(), intervals, "path", "point").select("path", "point", "start_off", "end_off")


def _diagnosed(spark, sf):
    labels = corpus.table(spark, sf, "labels").filter("doc_id is not null").select(F.col("doc_id").alias("l_doc"), "quality", "toxic")
    docs = corpus.table(spark, sf, "documents").select("doc_id", "text")
    known = docs.join(labels, docs["doc_id"] == labels["l_doc"], "left").select(F.struct("doc_id", "quality", "toxic").alias("k"), "text")
    lines = duplicates.numbered(known, "k", "text").select(F.col("path.doc_id").alias("path"), F.col("path.quality").alias("quality"), F.col("path.toxic").alias("toxic"), "line", "text")
    return report.diagnostics(lines, "the ", F.when(F.col("quality") == 0, "error").when(F.col("toxic") == 1, "warning").otherwise("note"), "Usage of the")


def q33_diagnostics(spark, sf):
    return _diagnosed(spark, sf).select("path", "line", "column", "severity", "message")


def q34_status(spark, sf):
    d = corpus.table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("source").alias("group"))
    labels = corpus.table(spark, sf, "labels").select(F.col("doc_id").alias("path"), "quality")
    return report.status(d.join(labels, "path", "left").select("group", F.when(F.col("quality").isNull(), "NOTHING_TO_DO").when(F.col("quality") == 0, "FAILURE").when(F.col("path") % 2 == 0, "SUCCESS").otherwise("NO_HINTS_FOUND").alias("status")))


def q35_access_counts(spark, sf):
    return counters.counts(corpus.access_log(spark, sf))


def q36_hourly_counts(spark, sf):
    return counters.windowed(corpus.access_log(spark, sf))


def q37_streamed_counts(spark, sf):
    import uuid

    log = corpus.table(spark, sf, "events")
    where = rounds.shared_folder(spark)
    files = spark.readStream.schema(log.schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf)
    keys = files.select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"))
    return counters.run_to_end(counters.counts(keys), f"{where}/stream-{uuid.uuid4().hex}")


def _changes(spark, sf):
    o = corpus.table(spark, sf, "orders")
    op = F.when(F.col("o_orderstatus") == "F", "delete").otherwise("put")
    return o.select((F.col("o_orderkey") % 3000).alias("p_partkey"), F.col("o_orderkey").alias("seq"), op.alias("op"), F.lit("changed").alias("p_name"), F.col("o_totalprice").alias("p_retailprice"))


def q38_upsert(spark, sf):
    old = corpus.table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    return maintenance.upsert(old, _changes(spark, sf), "p_partkey", "seq", "op")


def q39_snapshot_difference(spark, sf):
    old = corpus.table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.col("p_retailprice").alias("stamp"))
    new = q38_upsert(spark, sf).select(F.col("p_partkey").alias("path"), F.col("p_retailprice").alias("stamp"))
    return maintenance.difference(old, new, "path", "stamp")


def q40_closure(spark, sf):
    return lookup.closure(corpus.edges(spark, sf)).groupBy("ancestor", "depth").agg(F.count("*").alias("n"))


def q41_snippets(spark, sf):
    return report.snippets(duplicates.numbered(corpus.table(spark, sf, "documents"), "doc_id", "text"), "text", r"(?i)\bcopyright\b|licen[sc]e", 2)


def q42_common_prefix(spark, sf):
    s = corpus.sources(spark, sf)
    by = s.groupBy("segment").agg(F.min("relative_path").alias("a"), F.max("relative_path").alias("b"))
    return by.select("segment", text.common_prefix(F.col("a"), F.col("b")).alias("common"))


def q43_span_codec(spark, sf):
    spans = corpus.usages(spark, sf).groupBy("file").agg(F.sort_array(F.collect_set(F.struct(F.col("decl_pos").alias("start"), (F.col("decl_pos") + F.col("line")).alias("end")))).alias("found"))
    packed = text.pack_spans(F.col("found"))
    return spans.select("file", packed.alias("spans"), text.pack_positions(F.col("found")).alias("positions"), text.pack_spans(text.unpack_spans(packed)).alias("again"))


def q44_use_patterns(spark, sf):
    return corpus.features(spark, sf).select("decl_pos", report.use_pattern(F.col("kind"), F.col("modifiers"), F.col("class_fqn"), F.col("simple_name")).alias("rule"))


def q45_java_declarations(spark, sf):
    return java.extract(corpus.java_files(spark, sf)).select(F.col("path").cast("long").alias("path"), "kind", "simple_name", "descriptor", "signature", "element")


RULES = rules.parse("""'Usage of isEmpty': $var.isEmpty() => $var.size() == 0;;
'typed': $1.isEmpty() :: $1 instanceof java.util.Collection => $1.none();;
'text': $1.isEmpty() :: $1 instanceof java.lang.CharSequence => $1.length() == 0 => $1.equals("");;
'choice': $a.isEmpty() ? $b[0] : $c;;
'guard': if ($c && $a > 0) { $s$; } => if ($a > 0) { $s$; };;""")


def q46_rule_occurrences(spark, sf):
    found = rules.occurrences(corpus.java_files(spark, sf), RULES)
    return found.select(F.col("path").cast("long").alias("path"), "label", "start_off", "end_off", "line", "column")


def q47_rule_rewrites(spark, sf):
    """Rules one after the other: texts by their length, lists by their size, the guard without its condition."""
    some = [RULES[2], RULES[0], RULES[4]]
    return rules.applied(corpus.java_files(spark, sf), some).select(F.col("path").cast("long").alias("path"), "content", F.regexp_count("diff", F.lit("(?m)^[-+] ")).cast("long").alias("n_changed_lines"))


def _declared(spark, sf):
    return java.extract(corpus.java_files(spark, sf))


def q48_subtypes(spark, sf):
    return java.subtypes(java.extract(corpus.java_files(spark, sf), java.KINDS)).select("type", F.col("path").cast("long").alias("path"), "class")


def q49_overrides(spark, sf):
    return java.overrides(_declared(spark, sf)).select(F.col("path").cast("long").alias("path"), "element", "overridden")


def q50_java_usages(spark, sf):
    found = java.usages(corpus.java_files(spark, sf))
    return found.filter("element like 'METHOD:%'").groupBy(F.col("path").cast("long").alias("path"), "element", "is_override").agg(F.count("*").alias("n"))


def q51_used_types(spark, sf):
    """Packages, types and fields that sources use."""
    found = java.usages(corpus.java_files(spark, sf))
    return found.filter("element not like 'METHOD:%'").groupBy("element").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_files"))


def q52_clones(spark, sf):
    """Accepted groups of generalised trees, by weight, files and places."""
    found = rounds.checkpointed(clones.fragments(corpus.java_files(spark, sf)))
    return clones.accepted(found).groupBy("value", "n_files", "n_spans").agg(F.count("*").alias("n_groups"))


def q53_file_flags(spark, sf):
    """Files that use the class of part 2, or are subtypes of it, and those that override a method of it."""
    files = corpus.java_files(spark, sf)
    declared, raw = java.analysed(files)
    used = java.usages(files, declared, raw)
    one = locate.file_flags(used, declared, "CLASS:shop.p.P2").withColumn("of", F.lit("P2"))
    two = locate.file_flags(used, declared, "METHOD:shop.p.P2:m2:(ILjava/lang/String;)V").withColumn("of", F.lit("m2"))
    return one.unionByName(two).select("of", F.col("path").cast("long").alias("path"), "usage", F.array_join("subtypes", ",").alias("subtypes"), F.array_join("overriders", ",").alias("overriders"))


def q54_typed_search(spark, sf):
    """Calls of isEmpty in files where something is serializable, and in files with a list of anything."""
    files, rule = corpus.java_files(spark, sf), RULES[:1]
    read = rounds.checkpointed(rules.typed(files, rule))
    a = rules.typed_search(files, rule, ["java.io.Serializable"], read=read).withColumn("required", F.lit("Serializable"))
    b = rules.typed_search(files, rule, ["java.util.Collection", "java.lang.CharSequence"], read=read).withColumn("required", F.lit("Collection, CharSequence"))
    return a.unionByName(b).select(F.col("path").cast("long").alias("path"), "pattern", "required", "freq")


def q55_rule_spans(spark, sf):
    return rules.spans(corpus.java_files(spark, sf), RULES[0]).select(F.col("path").cast("long").alias("path"), "spans")


def q56_carets(spark, sf):
    """What stands at the name of the class, at its first call of size, and in the head of the package."""
    files = corpus.java_files(spark, sf)
    places = files.select("path", F.explode(F.array(F.instr("content", "class P") + 5, F.instr("content", ".size()"), F.lit(9)).cast("array<long>")).alias("position"))
    return locate.carets(files, places).select(F.col("path").cast("long").alias("path"), "position", "element", "kind", "declaration", "target")


def q57_declaration_spans(spark, sf):
    d = _declared(spark, sf)
    wanted = d.filter("kind = 'METHOD'").select("element")
    return locate.declaration_spans(d, wanted).select(F.col("path").cast("long").alias("path"), "element", F.array_join(F.transform("name_span", lambda x: x.cast("string")), ":").alias("name_span"))


def q58_sources_of_types(spark, sf):
    files = corpus.java_files(spark, sf)
    d = java.extract(files).join(files.select("path", "segment"), "path")
    return locate.sources_of(d, d.filter("kind = 'CLASS'").select("name")).select("segment", "name", F.array_join("paths", ",").alias("paths"))


def q59_element_names(spark, sf):
    ship(spark)
    f = _signed(spark, sf)
    client = display.client_signature(F.col("kind"), F.col("class_fqn"), F.col("simple_name"), F.lit("(I[J)V"), F.col("class_fqn"))
    named = f.select("decl_pos", client.alias("client"))
    return named.select("decl_pos", "client", display.element_name(F.col("client")).alias("shown"), display.strip(F.col("client"), "CLASS:", "INTERFACE:", "METHOD:").alias("stripped"))


def q60_rule_texts(spark, sf):
    f = corpus.features(spark, sf)
    pattern = F.concat(F.lit("$1."), "simple_name", F.lit("($a$)"))
    where = F.filter(F.array(F.when(F.array_contains("modifiers", "PUBLIC"), F.struct(F.lit("$1").alias("variable"), F.col("class_fqn").alias("type"))), F.when(F.array_contains("modifiers", "STATIC"), F.struct(F.lit("$a").alias("variable"), F.lit("int").alias("type")))), lambda c: c.isNotNull())
    made = display.rule_text(pattern, where, F.when(F.array_contains("modifiers", "PRIVATE"), 1).otherwise(0))
    return f.select("decl_pos", made.alias("rule"), display.query_escaped(F.concat("simple_name", F.lit("&a b/c?d=e:"), "class_fqn")).alias("escaped"))


def _tokens(spark, sf):
    """Lines of an order as tokens that stand behind each other, with gaps."""
    li = corpus.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), "l_linenumber", "l_partkey")
    one = li.groupBy("path", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    category = F.element_at(F.array(F.lit("literal"), F.lit("xml-tag"), F.lit("identifier"), F.lit("")), (F.col("part") % 4 + 1).cast("int"))
    colours = F.when(F.col("part") % 3 == 0, F.array(F.lit("STATIC"), F.lit("PUBLIC"))).otherwise(F.array().cast("array<string>"))
    return one.select("path", (F.col("l_linenumber") * 12).cast("long").alias("offset"), (F.col("part") % 12 + 1).alias("length"), category.alias("category"), colours.alias("colours"))


def q61_token_colours(spark, sf):
    return display.coloured(_tokens(spark, sf)).select("path", "offset", "span", "category")


def q62_highlights(spark, sf):
    """Every token of twelve places cut by one highlight of an order, from place 18 on."""
    t = _tokens(spark, sf).select("path", F.col("offset").alias("start"), F.lit("abcdefghijkl").alias("text"), F.lit("plain").alias("category"))
    h = corpus.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg((F.min("l_partkey") % 20 + 20).alias("h_end")).select("path", F.lit(18).cast("long").alias("h_start"), "h_end")
    return display.highlighted(t, h).select("path", "start", "text", "category")


def q63_resource_expressions(spark, sf):
    ship(spark)
    return _signed(spark, sf).select("decl_pos", locate.resource_expressions("signature").alias("expression"))


def q64_paths_and_owners(spark, sf):
    """Remote paths with local files or without, and the folders that local files lie below."""
    s = corpus.sources(spark, sf).select(F.col("relative_path").alias("path"), "size_bytes")
    local = s.filter("size_bytes > 1000").select("path", F.concat(F.lit("/home/"), "path").alias("file"))
    mapped, lost = locate.local_paths(s.select("path"), local)
    folders = corpus.sources(spark, sf).select(F.concat_ws("/", "segment", "mime").alias("folder")).distinct().withColumn("root", F.concat(F.lit("root:"), "folder"))
    owned = locate.owners(mapped.select("path", "local_file"), folders).select("path", "local_file", "root")
    return owned.unionByName(lost.select("path", F.lit(None).cast("string").alias("local_file"), F.lit(None).cast("string").alias("root")))


def q65_given_hashes(spark, sf):
    """Of lines that documents share, those that stand in document 3 or a later copy, and what a cache learns of them."""
    d = corpus.table(spark, sf, "documents")
    found = duplicates.single(d, "doc_id", "text").select("hash", "path")
    asked = rounds.checkpointed(found.groupBy("hash").agg(F.min("path").alias("p")).select("hash"))
    cache = found.filter("path < 100").distinct()
    answers, fuller = clones.cached(asked, cache, found.filter("path >= 100").distinct())
    return fuller.groupBy("hash").agg(F.count("path").alias("n_paths")).join(answers.groupBy("hash").agg(F.min("path").alias("first")), "hash", "left")


def q66_compiler_severity(spark, sf):
    return _diagnosed(spark, sf).groupBy(report.compiler_severity(F.col("severity")).alias("severity")).agg(F.count("*").alias("n"))


def q67_batch(spark, sf):
    """The rules over all segments: status by segment, and what they report in all."""
    files = corpus.java_files(spark, sf).withColumnRenamed("segment", "group")
    options = batch.options("--group", "s0", "--group", "s2", "--no-apply")
    return batch.run(files, RULES, options).status


def q68_relative_paths(spark, sf):
    """Paths below a root made relative, others as they are, and moved below another."""
    p = corpus.sources(spark, sf).select(F.concat(F.when(F.col("size_bytes") % 2 == 0, "/w/src/").otherwise("/x/"), "relative_path").alias("path"))
    moved = corpus.rebase(F.col("path"), "/w/src/", "rel:/")
    return p.select("path", corpus.below(F.col("path"), "/w/src").alias("below"), corpus.relativize(F.col("path"), "/w/src/").alias("relative"), moved.alias("moved"), corpus.rebase(moved, "rel:/", "/w/src/").alias("back"))


def q69_symbol_rows(spark, sf):
    """Methods by name, as rows that leave out what they lack."""
    d = _declared(spark, sf).filter(names.matches(names.infer("ne"), F.col("simple_name"), F.lower("simple_name")) | (F.col("kind") == "FIELD"))
    return d.select(F.col("path").cast("long").alias("path"), F.to_json(F.struct(F.col("path").alias("file"), F.col("owner").alias("enclosingFQN"), F.col("simple_name").alias("simpleName"), F.when(F.col("kind") == "METHOD", F.col("descriptor")).alias("vmsignature"), "kind", "modifiers")).alias("row"))


def q70_listed(spark, sf):
    """Files of a project in the order in which they are shown: by the project's name in any case, then by file."""
    s = corpus.sources(spark, sf).select(F.col("segment").alias("project"), F.col("relative_path").alias("file"))
    return display.numbered(s, "project", "file").select("project", "file", "place")


def q71_extractors(spark, sf):
    found = extractors.extract(corpus.java_files(spark, sf), "imports", "sizes")
    return found.select("extractor", F.col("path").cast("long").alias("path"), "key", "value")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "q" and k[1:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
