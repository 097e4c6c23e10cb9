import pytest
from pyspark.sql import functions as F

from tesserae.functions import display, text
from tesserae.operators import batch, java, locate, report, rules
from tesserae.sources import corpus, packaging

CODE = "package test; public class Test { private Test() { System.err.println(1); } int f; void m(int p) { f = p; other(); } }"


def at(piece, plus=0):
    return locate.element_at(CODE, CODE.index(piece) + plus)


def test_carets():
    assert at("err")["element"] == "FIELD:java.lang.System:err" and at("println")["element"] == "METHOD:java.io.PrintStream:println:(I)V"
    assert at("System")["element"] == "CLASS:java.lang.System" and at("System")["target"] == locate.NOWHERE
    assert at("Test {", 2) == {"element": "CLASS:test.Test", "kind": "CLASS", "declaration": True, "target": CODE.index("public")}
    assert at("Test()")["element"] == "CONSTRUCTOR:test.Test:<init>:()V" and at("Test()")["declaration"]
    assert at("f = p")["element"] == "FIELD:test.Test:f" and at("f = p")["target"] == CODE.index("int f")
    assert at("p; other")["kind"] == "PARAMETER" and at("p; other")["target"] == CODE.index("int p")
    assert at("m(int")["declaration"] and at("package") is None and at("test;")["element"] == "PACKAGE:test"


# Fixed places: where a use is noted.
@pytest.mark.parametrize(("caret", "mark"), [("Sy|stem.err.println(1)", "^System.err.println(1)"), ("System.e|rr.println(1)", "System.^err.println(1)"), ("System.err.p|rintln(1)", "System.err.^println(1)")])
def test_tree_positions(caret, mark):
    head = "package test; public class Test { private Test() { "
    code, pos = head + caret.replace("|", "") + "; } }", len(head) + caret.index("|")
    a = java.Attribution(code)
    under = [n for n in a.unit.tree.walk() if n.kind in ("IDENTIFIER", "MEMBER_SELECT") and n.at <= pos <= n.at + len(n.name)]
    assert locate.tree_position(under[0]) == len(head) + mark.index("^")


def test_name_spans(spark):
    files = spark.createDataFrame([("T", CODE)], "path string, content string")
    d = java.with_library(java.extract(files))
    got = {r.element: r.name_span for r in locate.declaration_spans(d, d.filter("path is not null or name = '<init>'").select("element")).collect() if "test.Test" in r.element}
    b, e = got["METHOD:test.Test:m:(I)V"][2:]
    assert CODE[b:e] == "m" and CODE[slice(*got["CONSTRUCTOR:test.Test:<init>:()V"][2:])] == "Test" and CODE[slice(*got["CLASS:test.Test"][2:])] == "Test"
    none = java.with_library(java.extract(spark.createDataFrame([("U", "class U { }")], "path string, content string")))
    (r,) = locate.declaration_spans(none, spark.createDataFrame([("CONSTRUCTOR:U:<init>:()V",)], "element string")).collect()
    assert r.name_span == [-1, -1, -1, -1]


def test_lines_and_resources(spark):
    code = "ab\ncd\n\nefg"
    df = spark.range(len(code)).select(F.col("id").cast("int").alias("o"), F.lit(code).alias("c"))
    got = {r.o: (r.a, r.b) for r in df.select("o", locate.line_start(F.col("c"), F.col("o")).alias("a"), locate.line_end(F.col("c"), F.col("o")).alias("b")).collect()}
    for o in range(len(code)):
        a = b = o
        while a > 0 and code[a] != "\n":
            a -= 1
        while b < len(code) - 1 and code[b] != "\n":
            b += 1
        assert got[o] == (a, b)
    assert locate.resource_expression("METHOD:a.b.C:m:()V") == "a[.-]b[.-]C[.-]m" and locate.resource_expression("CLASS:a.B") == "a[.-]B"
    assert locate.resource_hits("x\r\na-b.C-m a.b.C", "METHOD:a.b.C:m:()V") == [(2, 9)]


def test_snippets():
    code = "one\n\ntwo\nthree <x>\nfour\n \nfive\nsix"
    at = code.index("<x>")
    assert report.snippet(code, at, at + 3) == ("one<br><br>two<br>three ", "&lt;x&gt;", "<br>four<br> <br>five")
    assert report.snippet("a", 0, 1) == ("", "a", "")


def test_highlights_and_colours(spark):
    spans = spark.createDataFrame([("f", 0, "package", "K"), ("f", 8, "test", "E"), ("f", 600, "far", "E")], "path string, start long, text string, category string")
    hits = spark.createDataFrame([("f", 1, 3), ("f", 2, 9), ("f", 600, 603), ("g", 0, 5)], "path string, h_start long, h_end long")
    got = sorted((r.start, r.text, r.category) for r in display.highlighted(spans, hits).collect())
    assert got == [(0, "p", "K"), (1, "a", "K highlight"), (2, "c", "K highlight"), (3, "kage", "K highlight"), (8, "t", "E highlight"), (9, "est", "E"), (600, "far", "E highlight")]
    tokens = spark.createDataFrame([("f", 0, 7, "keyword", None), ("f", 7, 1, "xml-ref", ["STATIC"]), ("f", 10, 4, "", ["PUBLIC", "UNUSED"])], "path string, offset int, length int, category string, colours array<string>")
    assert [(r.span, r.category) for r in display.coloured(tokens).orderBy("offset").collect()] == [(7, "keyword"), (1, "entity-reference static"), (6, "public unused")]


def test_names_and_rule_texts(spark):
    df = spark.createDataFrame([("METHOD:a.B:m:(I)V",), ("CLASS:a.B",), ("FIELD:a.B:f",)], "s string")
    assert [r[0] for r in df.select(display.element_name(F.col("s"))).collect()] == ["m(int) in a.B", "a.B", "f in a.B"]
    known = batch.display_names(spark, rules.parse("'Long name': $1.a();;"))
    assert [tuple(r) for r in known.collect()] == [("text/x-java:Long-name", "Long name")]
    named = spark.createDataFrame([("x", None), ("y", "Y"), ("y", "Z")], "id string, display_name string")
    assert sorted(map(tuple, display.rule_names(named).collect())) == [("x", "x"), ("y", "Y")]
    names = F.create_map(F.lit("a"), F.lit("A == B"))
    got = spark.createDataFrame([("text/x-java:a",), ("text/x-java:z",)], "i string").select(text.category_label(F.col("i"), names)).collect()
    assert [r[0] for r in got] == ["[A_equals_B] ", "[unknown] "]


def test_paths_and_segments(spark):
    lines = spark.createDataFrame([("#x",), ("s1=rel:/prj1/src/",), ("s2=file:/other",), ("s3=rel:/a",)], "value string")
    assert sorted(map(tuple, corpus.source_roots(lines).collect())) == [("s1", "prj1/src/"), ("s3", "a")]
    paths = spark.createDataFrame([("b/pom.xml",), ("a/x/pom.xml",), ("a/.git/pom.xml",), ("a/build.xml",), ("a/x/build.xml",)], "path string")
    got = corpus.projects(paths, ["(.*)/pom.xml", "(.*)/build.xml"], [r"\..*"], "b")
    assert sorted((r.project, "/".join(r["first"])) for r in got.collect()) == [("a", "a/build.xml"), ("a/x", "a/x/build.xml")]
    df = spark.createDataFrame([("/r/src/p/q/A.java", "package p.q;\nclass A{}"), ("/r/x/B.java", "class B{}"), ("/r/z/C.java", " package other;")], "p string, c string")
    assert [r[0] for r in df.select(corpus.java_root(F.col("p"), F.col("c"))).collect()] == ["/r/src", "/r/x", "/r/z"]
    assert df.select(corpus.java_root(F.col("p"), F.col("c"), "/o")).first()[0] == "/o"
    remote = spark.createDataFrame([("a",), ("b",)], "path string")
    mapped, lost = locate.local_paths(remote, spark.createDataFrame([("a", "/l/a")], "path string, file string"))
    assert mapped.count() == 1 and [r.path for r in lost.collect()] == ["b"]
    assert locate.not_open(spark.createDataFrame([("r1",), ("r2",)], "root string"), spark.createDataFrame([("r1",)], "root string")).count() == 1
    assert locate.narrowed(remote, "a", "ab", F.col("path") == "a").count() == 1 and locate.narrowed(remote, "b", "ab", F.lit(True)) is None
    texts = spark.createDataFrame([("s2", "a", "two"), ("s1", "a", None)], "segment string, relative_path string, content string")
    assert [r.content for r in locate.contents(texts, "a").collect()] == [""]


def test_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.properties").write_bytes("é".encode("latin-1"))
    (tmp_path / "c.txt").write_bytes("﻿é".encode())
    (tmp_path / "d.txt").write_bytes("é".encode("utf-16"))
    (tmp_path / "e.txt").write_bytes(b"x\xff")
    got = {r.relative_path: r.content for r in corpus.read_tree(spark, str(tmp_path), encodings={"properties": "ISO-8859-1"}).collect()}
    assert got == {"a.txt": "é", "b.properties": "é", "c.txt": "é", "d.txt": "é", "e.txt": "x�"}


def test_fetching(spark, tmp_path):
    (tmp_path / "x").write_text("one\ntwo\n")
    df = spark.createDataFrame([(f"file://{tmp_path}/x",), (f"file://{tmp_path}/none",), ("no address",)], "address string")
    got = {r.address.rpartition("/")[2]: (r.text, r.lines) for r in corpus.fetched(df).collect()}
    assert got == {"x": ("one\ntwo\n", ["one", "two"]), "none": (None, []), "no address": (None, [])}


def test_rule_files(spark):
    df = spark.createDataFrame([("src/META-INF/upgrade/a.hint", "'x': $1.a() => $1.b();; $1.c(;;"), ("src/A.java", "$1.a();;")], "relative_path string, content string")
    assert sorted((r.label or "", r.n_replacements, bool(r.problem)) for r in corpus.rule_files(df).collect()) == [("", None, True), ("x", 1, False)]


def test_packages(spark, tmp_path):
    root = f"file://{tmp_path}/pkg"
    files = spark.createDataFrame([("/w/src/A.java", 1), ("/other/B", 2)], "path string, n int")
    with pytest.raises(FileNotFoundError):
        packaging.manifest(spark, root)
    made = packaging.pack(spark, {"files": files}, root, "/w/src", {"displayName": "x"}, files=1)
    assert made == packaging.manifest(spark, root) and made["indexSize"] > 0 and made["displayName"] == "x"
    assert sorted(r.path for r in spark.read.parquet(root + "/files").collect()) == ["/other/B", "rel:/A.java"]
    assert sorted(r.path for r in packaging.unpack(spark, root, "/new")["files"].collect()) == ["/new/A.java", "/other/B"]
    parts, total = packaging.download(spark, root)
    assert total >= parts.agg(F.sum("length")).first()[0] > 0 and parts.filter("path like 'files/%'").count() >= 1
    packaging.invalidate(spark)
    packaging.invalidate(spark, root)


def test_result_cache(spark, tmp_path):
    clock, asked, made, build = [0.0], [], [], ["b1"]
    cache = packaging.ResultCache(spark, f"file://{tmp_path}/cache", ttl=10, now=lambda: clock[0])
    ask = lambda: asked.append(1) or build[0]
    get = lambda seg="s": cache.get("i", seg, "k", ask, lambda: made.append(1) or spark.range(len(made))).count()
    assert (get(), get(), len(asked), len(made)) == (1, 1, 1, 1)
    clock[0], build[0] = 9.0, "b2"
    assert get() == 1 and len(asked) == 1
    clock[0] = 11.0
    assert get() == 2 and len(asked) == 2
    assert get("t") == 3 and get() == 2  # segments do not share


def test_stored_counts(spark, tmp_path):
    root = f"file://{tmp_path}/counts"
    a = spark.createDataFrame([("k", 1)], "key string, n long")
    assert packaging.store_counts(a, root) and packaging.store_counts(a, root) is None
    assert packaging.store_counts(spark.createDataFrame([("k", 2)], "key string, n long"), root)


@pytest.mark.parametrize("args", [("--config-file", "x", "--hint", "h"), ("--config-file", "x", "--hint-file", "h"), ("--config", "a=b"), ("--hint", "h", "--config", "ab"), ("--hint", "a", "--hint-file", "b"), ("--source", "x"), ("--nonsense",), ("--out",)])
def test_options_that_exclude_each_other(args):
    with pytest.raises(batch.UsageError):
        batch.options(*args)
    assert batch.main(list(args)) == 1


def test_options():
    o = batch.options("--hint", "h", "--config", "a=b", "--source", "1.6", "--apply", "src", "--group=x")
    assert o.one("hint") == "h" and o.values["group"] == ["x"] and o.roots == ["src"] and "apply" in o.flags
    assert batch.group_options(r"--classpath a\ b root").one("classpath") == "a b"
    assert batch.arguments({"apply": True, "group": ["a", "b"], "debug": False, "roots": ["r"]}) == ["--apply", "--group", "a", "--group", "b", "r"]
    assert batch.listed(rules.parse("'b': $1.b();; 'a': $1.a();; 'b': $1.c();;")) == ["a", "b"]


RULE = "'u': $var.isEmpty() => $var.size() == 0;;"


def test_batch(spark, tmp_path):
    files = spark.createDataFrame([("g", "A.java", "class A { boolean b = c.isEmpty(); }"), ("h", "B.java", "class B { }")], "group string, path string, content string")
    known = rules.parse(RULE)
    r = batch.run(files, known, batch.options("--apply", "--fail-on-warnings"))
    assert sorted(map(tuple, r.status.collect())) == [("g", "SUCCESS"), ("h", "NOTHING_TO_DO")] and r.overall() == "SUCCESS" and r.exit_code() == 1
    assert [x.content for x in r.changed.collect()] == ["class A { boolean b = c.size() == 0; }"]
    assert [x.message.split("\n")[0] for x in batch.diagnostics(r, files).collect()] == ["A.java:1: warning: [u] u"]
    batch.upgrade(r, f"file://{tmp_path}/classes")
    assert "+class A { boolean b = c.size() == 0; }" in spark.read.text(f"file://{tmp_path}/classes/{batch.UPGRADE}", wholetext=True).first()[0]
    none = batch.run(files, known, batch.options("--apply", "--no-apply", "--group", "h"))
    assert none.changed is None and none.exit_code() == 0 and none.status.count() == 1
    assert batch.run(files, known, batch.options(), config={"u": False}).overall() == "NO_HINTS_FOUND"
    assert batch.compute(spark, {"A": "class A { boolean b = c.isEmpty(); }"}, known) == {"A": [("u", 22, 33)]}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "A.java").write_text("class A {\n boolean b = c.isEmpty();\n}\n")
    (tmp_path / "r.hint").write_text(RULE + "\n%%TestCase t\nx.isEmpty()\n%%=>\nx.size() == 0\n")
    assert batch.main(["--hint-file", str(tmp_path / "r.hint"), "--list"]) == 0 and capsys.readouterr().out == "u\n"
    assert batch.main(["--hint-file", str(tmp_path / "r.hint"), "--run-tests", "--apply", "--out", str(tmp_path / "o"), str(tmp_path / "src")]) == 0
    assert "A.java:2: warning: [u] u\n boolean b = c.isEmpty();\n             ^" in capsys.readouterr().out
    assert batch.main(["--hint-file", str(tmp_path / "r.hint")]) == 0


def test_unused_imports():
    code = "package a;\nimport java.util.List;\nimport java.util.Map;\nimport static a.B.c;\nimport x.*;\n/** {@link Map} */\nclass A { List l = c; }\n"
    assert batch.unused_imports(code) == code
    assert batch.unused_imports(code.replace("{@link Map}", "")) == code.replace("import java.util.Map;\n", "").replace("{@link Map}", "")


def test_occurrence_check(spark):
    files = spark.createDataFrame([("A", "package p; class A { void m() { } }"), ("B", "package p; class B extends A { void m() { } }"), ("C", "package p; class C { void c(A a) { a.m(); } }"), ("D", "package p; class D { }")], "path string, content string")
    d = java.extract(files)
    used = java.usages(files, d)
    targets = spark.createDataFrame([(x, e) for x in "ABCD" for e in ("METHOD:p.A:m:()V", "CLASS:p.A")], "path string, element string")
    got = {(r.path, r.element[:5]): (r.by_usage, r.by_override, r.by_subtype) for r in locate.occurrence_check(used, d, targets).collect()}
    assert got == {("B", "METHO"): (False, True, False), ("C", "METHO"): (True, False, False), ("B", "CLASS"): (True, False, True), ("C", "CLASS"): (True, False, False)}
    flags = {r.path: (r.usage, r.subtypes, r.overriders) for r in locate.file_flags(used, d, "METHOD:p.A:m:()V").collect()}
    assert flags == {"B": (False, [], ["p.B"]), "C": (True, [], [])}
    assert locate.super_methods(spark.createDataFrame([("METHOD:p.B:m:()V",)], "element string"), java.overrides(d)).first().super_methods == ["METHOD:p.A:m:()V"]
    assert sorted(r.path for r in locate.local_usages(used, spark.createDataFrame([("METHOD:p.A:m:()V",)], "element string")).collect()) == ["C"]


def test_documents(spark):
    files = spark.createDataFrame([("A", "package p; class A extends B { int[][] x; void m(String[] s) { s[0].length(); } }"), ("B", "package p; class B implements java.io.Serializable { }")], "path string, content string")
    got = {r.path: (r.tokens, r.types) for r in rules.documents(files).collect()}
    assert {"java.io.Serializable", "p.B", "p.A", "java.lang.CharSequence", "java.lang.Object"} <= set(got["A"][1]) and "CLASS" in got["A"][0] and "length" in got["A"][0]
    assert [r.path for r in rules.typed_search(files, rules.parse("$1.length();;"), ["java.io.Serializable"]).collect()] == ["A"]


def test_extractors(spark):
    from tesserae.operators import extractors

    files = spark.createDataFrame([("A", "import static a.B.c;\nimport x.*;\nclass A {}")], "path string, content string")
    got = sorted(map(tuple, extractors.extract(files, "imports", "sizes").collect()))
    assert got == [("imports", "A", "import", "x.*"), ("imports", "A", "static", "a.B.c"), ("sizes", "A", "characters", "43"), ("sizes", "A", "lines", "2")]
    with pytest.raises(KeyError):
        extractors.extract(files, "none")
    assert {"imports", "sizes"} <= set(extractors.known())


def test_remote_exactness():
    known = rules.parse("$1.a();;")
    assert batch.exact_remote({"attributed", "spans"}, known) and not batch.exact_remote({"spans"}, known) and not batch.exact_remote({"attributed", "spans"}, known, imports=1)


def test_listing(spark):
    rows = spark.createDataFrame([("b", "2"), ("A", "3"), ("b", "1"), (None, "0")], "project string, file string")
    assert [tuple(r) for r in display.listed(rows, "project", "file").collect()] == [("A", "3"), ("b", "1"), ("b", "2"), (None, "0")]
