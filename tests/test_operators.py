import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions import signatures, text
from tesserae.operators import clones, duplicates, lookup, maintenance, names, patterns, report
from tesserae.sources import corpus


def test_query_kinds():
    kind = lambda *a, **b: names.infer(*a, **b).kind
    assert kind("Name ") == names.EXACT
    assert kind("RW") == names.CAMEL and kind("ReWi") == names.CAMEL
    assert kind("a*b") == names.CI_REGEXP and kind("a?b", case_sensitive=True) == names.REGEXP
    assert kind("abc") == names.CI_PREFIX and kind("abc", case_sensitive=True) == names.PREFIX
    assert kind("abc", kind="EXACT") == names.EXACT and kind("abc", kind="NONSENSE") == names.CI_PREFIX
    assert names.infer("  ") is None


@pytest.mark.parametrize(
    ("encoded", "decoded"),
    [("()V", "()"), ("<T:Ljava/lang/String;>(Ljava/util/Map<Ljava/util/List<Ljava/lang/String;>;TT;>;Z)V;", "(Map<List<String>, T>, boolean)"), ("(Ljava/util/List<+Ljava/lang/String;>;)V;", "(List<? extends String>)"), ("([[IJ)V", "(int[][], long)"), ("<P:TT;>(TP;)V;", "(P)")],
)
def test_decoded_parameters(encoded, decoded):
    assert signatures.decode_parameters(encoded) == decoded


def test_decoded_type():
    assert signatures.decode_type("Lorg/x/Analyzer$CustomizerProvider<**>;") == "CustomizerProvider<?, ?>"


def test_arguments():
    assert text.split_arguments(r"a\ b  a\\b") == ["a b", "a\\b"]
    assert text.split_arguments("") == []


FILES = [("Test1", "x f . isDirectory ( ) y f . isDirectory ( )"), ("Test2", "f . isDirectory ( ) new ImageIcon ( null )"), ("Test3", "new ImageIcon ( a ) new ImageIcon ( b )")]


def _docs(spark, rows, types=()):
    return spark.createDataFrame([(p, c) for p, c in rows], "path string, text string").select("path", patterns.joined(F.col("text")).alias("tokens"), F.array(*[F.lit(t) for t in types]).cast("array<string>").alias("types"), F.lit(bool(types)).alias("attributed"), "text")


def test_pattern_frequencies(spark):
    some = [patterns.Pattern("isDirectory", ((".", "isDirectory", "("),)), patterns.Pattern("ImageIcon", (("new", "ImageIcon"),))]
    got = sorted(map(tuple, patterns.search(_docs(spark, FILES), some).collect()))
    assert got == [("Test1", "isDirectory", 2), ("Test2", "ImageIcon", 1), ("Test2", "isDirectory", 1), ("Test3", "ImageIcon", 2)]


def test_type_constraint(spark):
    p = patterns.Pattern("p", ((".", "isDirectory"),), types=("java.io.File",))
    assert patterns.search(_docs(spark, FILES, ("java.io.File",)), [p]).count() == 2
    assert patterns.search(_docs(spark, FILES, ("other",)), [p]).count() == 0
    assert patterns.search(_docs(spark, FILES), [p]).count() == 2  # without types nothing is ruled out


def test_search_follows_updates(spark):
    p = [patterns.Pattern("d", (("isDirectory",),)), patterns.Pattern("i", (("ImageIcon",),))]
    old = spark.createDataFrame(FILES[:2], "path string, text string")
    hits = lambda df: {r.path for r in patterns.search(_docs(spark, [tuple(r) for r in df.collect()]), p).collect()}
    assert hits(old) == {"Test1", "Test2"}
    gone = maintenance.upsert(old, spark.createDataFrame([("Test1", None, 1, "delete")], "path string, text string, seq int, op string"), "path", "seq", "op")
    assert hits(gone) == {"Test2"}
    back = maintenance.upsert(gone, spark.createDataFrame([("Test3", "", 1, "put"), ("Test3", FILES[2][1], 2, "put")], "path string, text string, seq int, op string"), "path", "seq", "op")
    assert hits(back) == {"Test2", "Test3"}


# Sources and the clone that they share are fixed values.
CLONES = {
    "test/Test1.java": "package test; public class Test1 { private void test() { java.io.File f = null; f.isDirectory(); } }",
    "test/Test2.java": "package test; public class Test2 { private int a; private void test() { java.io.File f = null; f.isDirectory(); } }",
    "test/Test3.java": "package test; public class Test3 { private void test() { for (int i = 0; i < 10; i++) { System.err.println(3 * i); System.err.println(4 * i); } }",
}


def test_clones_are_accepted_once(spark):
    found = clones.fragments(spark.createDataFrame(list(CLONES.items()), "path string, content string"))
    (one,) = clones.occurrences(found, clones.accepted(found)).collect()
    assert {s.path: CLONES[s.path][s.start_off : s.end_off] for s in one.spans} == dict.fromkeys(list(CLONES)[:2], "private void test() { java.io.File f = null; f.isDirectory(); }")


def test_clones_across_indexes(spark):
    files = lambda path: spark.createDataFrame([(path, CLONES[path])], "path string, content string")
    both = clones.fragments(files("test/Test1.java")).unionByName(clones.fragments(files("test/Test2.java")))
    assert clones.accepted(both).count() == 1


def test_trees_that_share_eight_digits_are_no_clones(spark):
    one, two = (f"class A {{ void f(int a) {{ m{n}(a, a + 1, a + 2); }} }}" for n in (83054, 95930))
    short = {h[:8] for code in (one, two) for h, *_ in clones.generalised(code)}
    assert "ACB84A1F" in short and len(short) < len(clones.generalised(one)) + len(clones.generalised(two))
    found = clones.fragments(spark.createDataFrame([("a", one), ("b", two)], "path string, content string"))
    assert clones.accepted(found).isEmpty()
    assert found.filter(clones.short_hash(F.col("hash")).startswith("ACB84A1F:")).count() == 2


def slow_accepted(rows):
    """The greedy walk as it reads: heaviest first, each against all accepted ones."""
    by = {}
    for path, hash_, value, start, end, _ in rows:
        by.setdefault((hash_, value), []).append((path, start, end))
    out = []
    for (hash_, value), spans in sorted(by.items(), key=lambda x: (-x[0][1], x[0][0])):
        spans.sort()
        if len({p for p, *_ in spans}) < 2:
            continue
        holds = lambda big, small: {p for p, *_ in big} == {p for p, *_ in small} and any(p == big[0][0] and (big[0][1] <= s and big[0][2] > e or big[0][1] < s and big[0][2] >= e) for p, s, e in small)
        if not any(holds(b, spans) for _, b in out):
            out.append((hash_, spans))
    return sorted(h for h, _ in out)


def test_acceptance_equals_the_greedy_walk(spark):
    r = random.Random(3)
    bodies = [f"int m{i}(int a) {{ int b = a * {i}; if (a > {i % 3}) {{ b = b + {'x.y(' * (i % 3)}a{')' * (i % 3)}; go(b, a - b); }} return b + a; }}" for i in range(6)]
    rows = [(f"f{k}", "class K%d { %s }" % (k, " ".join(r.choice(bodies) for _ in range(r.randrange(1, 5))))) for k in range(14)]
    files = spark.createDataFrame(rows, "path string, content string")
    found = clones.fragments(files)
    got = sorted(x.hash for x in clones.accepted(found).collect())
    assert got == slow_accepted([tuple(x) for x in found.collect()]) and len(got) > 3
    assert clones.accepted(found, hashes=found.select("hash").limit(3)).count() >= 1


def test_clones_elsewhere_and_warnings(spark):
    found = clones.fragments(spark.createDataFrame(list(CLONES.items()), "path string, content string"))
    own, known = found.filter("path = 'test/Test1.java'"), found.select("hash", "path").distinct()
    got = clones.elsewhere(own, "test/Test1.java", known)
    (one,) = got.collect()
    assert one.paths == ["test/Test2.java"] and CLONES["test/Test1.java"][one.start_off : one.end_off].startswith("private void test")
    assert clones.elsewhere(own, "test/Test1.java", known, spark.createDataFrame([("other",)], "path string")).isEmpty()
    (w,) = clones.warnings(own, got).collect()
    assert w.message == "Duplicate of code from test/Test2.java" and w.severity == "warning"


def test_missing_hashes_are_remembered(spark):
    remote = spark.createDataFrame([("00", "T1"), ("00", "T2"), ("02", "T9")], "hash string, path string")
    cache = spark.createDataFrame([("02", "T5")], "hash string, path string")
    asked = spark.createDataFrame([("00",), ("01",), ("02",)], "hash string")
    answers, fuller = clones.cached(asked, cache, remote)
    assert sorted(map(tuple, answers.collect())) == [("00", "T1"), ("00", "T2"), ("02", "T5")]
    again, same = clones.cached(asked, fuller, remote.limit(0))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, answers.collect())) and same.filter("hash = '01'").count() == 1


def test_long_clone_is_one_run(spark):
    ten = "\n".join(f"line number {i} of the clone stands here" for i in range(10))
    rows = [("a", "own start here\n" + ten + "\nend of a"), ("b", ten + "\n\nother things\n" + ten), ("c", "nothing"), ("d", None)]
    docs = spark.createDataFrame(rows, "path string, text string")
    (one,) = duplicates.offsets(duplicates.runs(docs, "path", "text"), docs, "path", "text").collect()
    assert (one.n_lines, one.n_files, one.n_spans, one.value) == (10, 2, 3, 80)
    assert rows[0][1][one.start_off : one.end_off] == ten


def test_hash_categories(spark):
    found = spark.createDataFrame([("h1", "s1", 4), ("h1", "s1", 2), ("h1", "s2", 9), ("h2", "s2", 7)], "hash string, segment string, path long")
    asked = spark.createDataFrame([("h1",), ("none",)], "hash string")
    got = {(r.hash, r.segment): r.files for r in duplicates.by_category(asked, found, found).collect()}
    assert got == {("h1", "s1"): [2, 4], ("h1", "s2"): [9], ("none", "s1"): [], ("none", "s2"): []}


def test_hash_carries_its_weight(spark):
    (r,) = spark.createDataFrame([("a b c",)], "t string").select(duplicates.fragment_hash(F.col("t"), duplicates.weight(F.col("t"))).alias("h")).select("h", duplicates.hash_weight(F.col("h")).alias("w")).collect()
    assert r.w == 3 and len(r.h) == 10


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("y", "y")], "child string, parent string")
    got = {(r.child, r.ancestor): r.depth for r in lookup.closure(e).collect()}
    assert got[("x", "c")] == 3 and got[("a", "c")] == 2 and ("a", "a") not in got and len(got) == 9


def test_closure_of_a_long_chain(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(100)], "child string, parent string")
    assert lookup.closure(e).count() == 5050
    with pytest.raises(ValueError):
        lookup.closure(e, max_depth=64)


def test_narrowest_equals_brute_force(spark):
    r = random.Random(1)
    spans = [(k, s, s + r.choice([0, 1, 3, 7, 40, 300])) for k in "ab" for s in (r.randrange(500) for _ in range(60))]
    points = [(k, r.randrange(600)) for k in "abc" for _ in range(60)]
    got = {(x.key, x.point): (x.start_off, x.end_off) for x in lookup.narrowest(spark.createDataFrame(points, "key string, point long"), spark.createDataFrame(spans, "key string, start_off long, end_off long"), "key", "point").collect()}
    want = {}
    for k, p in points:
        held = [(e - s, s, e) for q, s, e in spans if q == k and s <= p <= e]
        if held:
            want[(k, p)] = min(held)[1:]
    assert got == want


def test_every_hit_of_a_line(spark):
    lines = spark.createDataFrame([("p", 0, "a the b the c"), ("p", 1, "none"), ("p", 2, "\tthe the ")], "path string, line int, text string")
    got = [(r.line, r.column) for r in report.diagnostics(lines, "the ", F.lit("note"), "x").collect()]
    assert sorted(got) == [(1, 3), (1, 9), (3, 2), (3, 6)]
    assert report.diagnostics(lines, "the ", F.lit("note"), "x").filter("line = 3 and column = 6").first().message.split("\n")[2] == "\t    ^"


def test_root_that_is_missing(spark):
    roots = spark.createDataFrame([("a/", 1), ("a/b/", 0)], "root string, ordinal int")
    rows = spark.createDataFrame([("a/b/x",), ("a/y",)], "file string")
    assert sorted((r.file, r.root) for r in lookup.root_of(rows, "file", roots).collect()) == [("a/b/x", "a/b/"), ("a/y", "a/")]
    assert sorted((r.root, r.files) for r in lookup.lists_by_root(rows, "file", roots).collect()) == [("a/", ["a/b/x", "a/y"]), ("a/b/", ["a/b/x"])]
    with pytest.raises(Exception, match="no source root for q"):
        lookup.root_of(spark.createDataFrame([("q",)], "file string"), "file", roots).collect()


def test_legacy_only_without_direct(spark):
    wanted = spark.createDataFrame([("s1", "o1", "r1"), ("s2", "o2", "r2")], "signature string, legacy string, reference string")
    used = spark.createDataFrame([("s1", 1), ("o1", 2), ("o2", 3), ("o2", 3)], "signature string, file int")
    got = sorted(tuple(r) for r in lookup.usages_of(wanted, used, spark.createDataFrame([("r1", 9)], "signature string, file int")).collect())
    assert got == [("s1", 1, "direct", 1), ("s1", 9, "resource", 1), ("s2", 3, "legacy", 2)]


def test_nested_roots(spark):
    rows = spark.createDataFrame([("a/b/c.txt",), ("a/d.txt",), ("z.txt",)], "file string")
    roots = spark.createDataFrame([("a/", 0), ("a/b/", 1), ("q/", 2)], "root string, ordinal int")
    assert sorted((r.file, r.root) for r in lookup.by_root(rows, "file", roots).collect()) == [("a/b/c.txt", "a/"), ("a/b/c.txt", "a/b/"), ("a/d.txt", "a/")]
    assert sorted((r.file, r.root) for r in lookup.first_root(rows, "file", roots, "file").collect()) == [("a/b/c.txt", "a/b/"), ("a/d.txt", "a/")]


def test_span_codec(spark):
    df = spark.createDataFrame([("1:4:7:9",), ("",)], "s string").select("s", text.pack_spans(text.unpack_spans(F.col("s"))).alias("again"))
    assert all(r.s == r.again for r in df.collect())


def test_diff(spark):
    a = "\n".join(f"line {i}" for i in range(12)) + "\n"
    (r,) = spark.createDataFrame([("T.java", a, a.replace("line 5", "changed"))], "p string, a string, b string").select(report.diff("p", "a", "b").alias("d")).collect()
    assert r.d.startswith("--- a/T.java\n+++ b/T.java\n@@ -3,7 +3,7 @@") and "-line 5\n+changed\n" in r.d
    assert report.unified("x", a, a) == ""


def test_totals(spark):
    found = spark.createDataFrame([("error",), ("warning",), ("warning",), ("note",)], "severity string")
    assert tuple(report.totals(found).first()) == (1, 2, 1)


def test_publish_and_read(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    maintenance.publish(spark.range(3), root)
    assert maintenance.published(spark, root).count() == 3
    maintenance.publish(spark.range(5), root, files=1)
    assert maintenance.published(spark, root).count() == 5


def test_read_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "X.java").write_text("class X {}\n")
    (tmp_path / "b.txt").write_text("é")
    got = sorted(map(tuple, corpus.read_tree(spark, str(tmp_path)).collect()))
    assert got == [("a/X.java", "class X {}\n", "java", 11), ("b.txt", "é", "txt", 2)]


def test_change_stream_upserts(spark, tmp_path):
    from tesserae.streaming import counters

    folder, state = f"{tmp_path}/changes", f"{tmp_path}/state"
    spark.createDataFrame([("a", "old")], "path string, text string").write.parquet(state + "/0")
    seen = []

    def batch(df, number):
        old = spark.read.parquet(f"{state}/{len(seen)}")
        maintenance.upsert(old, df, "path", "seq", "op").write.parquet(f"{state}/{len(seen) + 1}")
        seen.append(number)

    kind = "path string, text string, seq int, op string"
    for rows in ([("b", "new", 1, "put")], [("a", None, 2, "delete")]):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(folder)
        counters.apply_changes(counters.stream(spark, folder, kind), f"{tmp_path}/cp", batch)
    assert [tuple(r) for r in spark.read.parquet(f"{state}/2").collect()] == [("b", "new")]
