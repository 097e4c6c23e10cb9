import pytest

from tesserae.operators import java, rules, syntax


def one(code, name="test"):
    return next(d for d in java.declarations(code) if d.name == name)


# The signatures below are fixed values of the encoding.
@pytest.mark.parametrize(
    ("member", "expected"),
    [
        ("void test() {}", "()V;"),
        ("<T extends String> void test(Map<List<String>, T> m, boolean p) {}", "<T:Ljava/lang/String;>(Ljava/util/Map<Ljava/util/List<Ljava/lang/String;>;TT;>;Z)V;"),
        ("void test() throws java.io.IOException {}", "()V^Ljava/io/IOException;;"),
        ("void test(List<? extends String> l) {}", "(Ljava/util/List<+Ljava/lang/String;>;)V;"),
    ],
)
def test_signatures(member, expected):
    assert one("package test; import java.util.List; import java.util.Map; public class Test { " + member + " }").signature == expected


def test_signatures_with_parameters_of_the_class():
    head = "package test; import java.util.List; import java.util.Map; public class Test<T extends String> { "
    assert one(head + "void test(Map<List<String>, T> m, boolean p) {} }").signature == "(Ljava/util/Map<Ljava/util/List<Ljava/lang/String;>;TT;>;Z)V;"
    assert one(head + "<P extends T> void test(P p) {} }").signature == "<P:TT;>(TP;)V;"


def test_declarations():
    code = """package p; /* class No {} */ public class A extends B implements java.io.Serializable {
      private static final int X = f(1, 2), Y; @Deprecated A(int i) { new Object() { void no() {} }; }
      public String s(int[] a, String... b) { return "class }"; } class In { } enum E { ONE, TWO(3) { void x() {} }; int q; } }"""
    got = [(d.kind, d.name) for d in java.declarations(code)]
    assert got == [("CLASS", "p.A"), ("FIELD", "X"), ("FIELD", "Y"), ("CONSTRUCTOR", "<init>"), ("METHOD", "s"), ("CLASS", "p.A$In"), ("ENUM", "p.A$E"), ("ENUM_CONSTANT", "ONE"), ("ENUM_CONSTANT", "TWO"), ("FIELD", "q")]
    by = {d.name: d for d in java.declarations(code)}
    assert by["p.A"].supertypes == ["p.B", "java.io.Serializable"] and by["s"].descriptor == "([I[Ljava/lang/String;)Ljava/lang/String;"
    assert java.serialized(by["X"]) == "FIELD:p.A:X" and by["X"].modifiers == ["PRIVATE", "STATIC", "FINAL"]


def test_broken_code_does_not_fail():
    for code in ("", "class", "class A {", "class A { void", "}}}} (", "class A { int x = ; void f(", '"', "/* open", "@", "import", "enum E {", "class A<T extends { }"):
        java.declarations(code)


def test_rewrite():
    (r,) = rules.parse("$var.isEmpty() => $var.size() == 0;;")
    assert rules.rewrite(r, "boolean b = c.isEmpty() || x.y(1, 2).isEmpty();") == "boolean b = c.size() == 0 || x.y(1, 2).size() == 0;"


def test_patterns_over_two_files():
    a = "class Test1 { void t() { java.io.File f = null; f.isDirectory(); } }"
    b = "class Test2 { void t() { new javax.swing.ImageIcon(null); } }"
    d, i = rules.parse("$1.isDirectory();; new ImageIcon($1);;")
    assert [len(rules.find(r, c)) for r in (d, i) for c in (a, b)] == [1, 0, 0, 1]


@pytest.mark.parametrize(
    ("rule", "before", "after"),
    [
        ("$var.isEmpty() => $var.size() == 0;;", "class T { boolean a = !c.isEmpty(), b = c.isEmpty() && x; }", "class T { boolean a = !(c.size() == 0), b = c.size() == 0 && x; }"),
        ("f($1) => g($1);;", "class T { int x = f(f(x)) + f(1); }", "class T { int x = g(g(x)) + g(1); }"),
        ("$1.a() => $1.b();;", "x.a().a().a()", "x.b().b().b()"),
        ("minus($a, $b) => $a - $b;;", "class T { int q = minus(a, minus(b, c)) * minus(1, 2); }", "class T { int q = (a - (b - c)) * (1 - 2); }"),
        ("f($a$, 1) => g($a$);;", "class T { int q = f(x, y, 1) + f(1); }", "class T { int q = g(x, y) + g(); }"),
        ("if ($c) { $s$; } => while ($c) { $s$; };;", "class T { void t() { if (a) { x(); y(); } } }", "class T { void t() { while (a) { x(); y(); } } }"),
        ('$1.open("http://x") => $1.open("https://x;;=>");;', 'class T { void t() { a.open("http://x"); } }', 'class T { void t() { a.open("https://x;;=>"); } }'),
        ("$x.trim() => norm($x);;", "class T { String s = (a + b).trim(); }", "class T { String s = norm((a + b)); }"),
        ("$a ? $b : $c => pick($a, $b, $c);;", "class T { int i = (p ? 1 : 2) + 3; }", "class T { int i = (pick(p, 1, 2)) + 3; }"),
        ("neg($a) => -$a;;", "class T { int i = neg(a + b) - neg(c); int j = neg(d).e; }", "class T { int i = -(a + b) - -c; int j = (-d).e; }"),
    ],
)
def test_rewrites_keep_the_meaning(rule, before, after):
    (r,) = rules.parse(rule)
    assert rules.rewrite(r, before) == after


# Sources and outcomes of the cases below are fixed values.
@pytest.mark.parametrize(
    ("pattern", "code", "n"),
    [
        ("$1.isDirectory() :: $1 instanceof java.io.File", "package test; public class Test1 { private void test() { java.io.File f = null; f.isDirectory(); } }", 1),
        ("$1.isDirectory() :: $1 instanceof java.io.File", "package test; public class Test2 { private void isDirectory() { this.isDirectory(); } }", 0),
        ("$1.length() :: $1 instanceof java.lang.CharSequence", "package test; public class Test1 { private void test() { String str = null; int l = str.length(); } }", 1),
        ("$this.computeNext() :: $this instanceof test.Test1.O", "package test; public class Test1 { private static final class O implements Iterable<String> { private String next; private String computeNext() { return null; } public String hasNext() { next = computeNext(); } } }", 1),
        ("new $type() {\n $mods$ $resultType $methodName($args$) {\n $statements$;\n }\n }\n", "package test; public class Test1 { private void test() { Runnable r = new Runnable() { public void run() { System.err.println(); } } } }", 1),
        ("new ImageIcon($1)", "package test; public class Test2 { private void test() { new javax.swing.ImageIcon(null); } }", 1),
        ("$1.isDirectory() :: $1 instanceof java.io.File", "import my.own.File; class T { void t(File f) { f.isDirectory(); } }", 0),
        ("$1.isDirectory() :: $1 instanceof java.io.File", "class T { void t(my.File f) { f.isDirectory(); } void u(java.io.File f) { f.isDirectory(); } }", 1),
        ("$1.run() :: $1 instanceof java.lang.Runnable", "class T { void t() { make().run(); new Thread().run(); } Runnable make() { return null; } }", 2),
    ],
)
def test_typed_patterns(pattern, code, n):
    (r,) = rules.parse(pattern + ";;")
    assert len(rules.find(r, code)) == n


# A rule on a qualified name, and what it leaves.
def test_qualified_names_are_found_and_written_short():
    (r,) = rules.parse("'test':\njava.lang.Character.toLowerCase($1) :: $1 instanceof char => java.lang.Character.toUpperCase($1) ;;")
    assert rules.rewrite(r, "package test; public class Test {private void test() {Character.toLowerCase('a');}}") == "package test; public class Test {private void test() {Character.toUpperCase('a');}}"


def test_all_replacements_and_all_errors():
    (r,) = rules.parse("'x': $1.a() => $1.b() => $1.c() :: $1 instanceof String;;")
    assert [x[0] for x in r.replacements] == ["$1.b()", "$1.c()"] and r.replacements[1][1] == (("$1", "String"),)
    assert rules.rewrite(r, "x.a()", 0) == "x.b()" and rules.rewrite(r, "x.a()", 1) == "x.a()" and rules.rewrite(r, '"s".a()', 1) == '"s".c()'
    assert len(rules.errors("$1.a(;; $2.b() => $2.c();; :: $x instanceof T;; $1.q() :: $1 foo Bar;;")) == 3


def test_records_and_nested_types():
    code = "package p; public record R(int a, java.util.List<String> b) implements Runnable { R { } static int z; record In(long q) { } public void run() { } } interface I extends R.X { default void m() { } }"
    got = [(d.kind, d.name, d.descriptor) for d in java.declarations(code)]
    assert got == [("RECORD", "p.R", ""), ("FIELD", "a", ""), ("FIELD", "b", ""), ("CONSTRUCTOR", "<init>", "(ILjava/util/List;)V"), ("FIELD", "z", ""), ("RECORD", "p.R$In", ""), ("FIELD", "q", ""), ("METHOD", "run", "()V"), ("INTERFACE", "p.I", ""), ("METHOD", "m", "()V")]
    assert java.declarations(code)[0].supertypes == ["java.lang.Runnable"] and java.declarations(code)[8].supertypes == ["p.R$X"]


def test_grammar():
    code = """class A<T extends B & C> extends X<T> implements I, J { int a, b[] = {1,2}; static { int x = 1; } A(int i) { this(i, 2); }
     <P> void m(List<? extends P> l, int... r) throws E { for (int i = 0; i < 10; i++) { x.y(3 * i).z[2]++; } for (String s : l) { s.a(); } if (a instanceof B b && !c) return; else { throw new E(); }
     switch (a) { case 1: foo(); break; default: bar(); } int q = switch (a) { case 1, 2 -> 3; default -> { yield 4; } }; try (R r2 = open()) { } catch (E | F e) { } finally { } Runnable rr = () -> { };
     f(x -> x + 1, (a, b) -> a, String::length, int[]::new); a = (String) b; c = (a) + b; d = (int) -1; List<List<String>> ls = new ArrayList<>(); z = a >> 2 >>> 3 > 4 ? b : c; synchronized (this) { } do { } while (x);
     label: while (true) { continue label; } assert a : b; Object o = new Object() { void k() { } }; Outer.Inner i = o.new Inner(); int[][] g = new int[2][]; x <<= 1; y >>>= 2; } @interface An { int v() default 3; } enum E { ONE, TWO(3) { void x() {} }; int q; } }"""
    p = syntax.Parser(code)
    tree = p.file()
    assert p.problems == [] and not [n for n in tree.walk() if n.kind == "ERRONEOUS"]
    kinds = {n.kind for n in tree.walk()}
    assert {"ENHANCED_FOR_LOOP", "UNSIGNED_RIGHT_SHIFT", "RIGHT_SHIFT", "TYPE_CAST", "LAMBDA_EXPRESSION", "MEMBER_REFERENCE", "SWITCH_EXPRESSION", "UNION_TYPE", "CONDITIONAL_EXPRESSION", "UNSIGNED_RIGHT_SHIFT_ASSIGNMENT", "NEW_ARRAY"} <= kinds
    for n in tree.walk():
        assert n.start <= n.end and all(n.start <= k.start and k.end <= n.end for k in n.kids if k.kind not in ("MODIFIERS", "PRIMITIVE_TYPE", "IDENTIFIER", "ARRAY_TYPE", "PARAMETERIZED_TYPE")), (n.kind, code[n.start : n.end])


def test_deep_code_does_not_fail():
    assert rules.find(rules.parse("$a + $a;;")[0], "class T { int i = " + " + ".join(["1"] * 3000) + "; String s = " + "(" * 300 + "x" + ")" * 300 + "; }") is not None


OVER = "package test; public class Test extends A implements B { public void tt() { } } class A implements B { public void tt() {} } interface B { public void tt(); }"


# Which methods of direct supertypes are overridden.
def test_overridden_methods(spark):
    files = spark.createDataFrame([("a", "package test; public class Test { public String toString() { return null; } }")], "path string, content string")
    got = {(r.element, r.overridden) for r in java.overrides(java.extract(files)).collect()}
    assert got == {("METHOD:test.Test:toString:()Ljava/lang/String;", "METHOD:java.lang.Object:toString:()Ljava/lang/String;")}
    files = spark.createDataFrame([("b", OVER)], "path string, content string")
    got = sorted((r.element, r.overridden) for r in java.overrides(java.extract(files)).collect())
    assert got == [("METHOD:test.A:tt:()V", "METHOD:test.B:tt:()V"), ("METHOD:test.Test:tt:()V", "METHOD:test.A:tt:()V"), ("METHOD:test.Test:tt:()V", "METHOD:test.B:tt:()V")]


def test_usages_across_files(spark):
    a = "package a; public class A { public B b; public static A make() { return null; } public void over(int i) { } public void over(String s) { } }"
    b = "package a; public class B extends Base { public C c() { return null; } }"
    base = "package a; class Base { protected int held; public Runnable go() { return null; } }"
    c = "package a; public class C<T extends Comparable<T>> { public <X> void put(T t, X x) { held(); } void held() { } C() { } C(int i) { this(); } }"
    use = "package b; import a.*; import a.A; class U extends a.B { int held() { return held + A.make().b.c().hashCode(); } void u(A x) { x.over(1); x.over(\"\"); x.b.go().run(); new C(2).put(null, x); go(); } }"
    files = spark.createDataFrame([("A", a), ("B", b), ("Base", base), ("C", c), ("U", use)], "path string, content string")
    rows = java.usages(files, java.extract(files)).filter("path = 'U'").collect()
    got = {(use[r.pos : r.pos + 4], r.element) for r in rows if not r.is_override}
    assert {("make", "METHOD:a.A:make:()La/A;"), ("b.c(", "FIELD:a.A:b"), ("c().", "METHOD:a.B:c:()La/C;"), ("hash", "METHOD:java.lang.Object:hashCode:()I"), ("over", "METHOD:a.A:over:(I)V"), ("over", "METHOD:a.A:over:(Ljava/lang/String;)V")} <= got
    assert {("go()", "METHOD:a.Base:go:()Ljava/lang/Runnable;"), ("run(", "METHOD:java.lang.Runnable:run:()V"), ("held", "FIELD:a.Base:held"), ("a.B ", "PACKAGE:a"), ("B { ", "CLASS:a.B")} <= got
    assert len([r for r in rows if r.element == "METHOD:a.Base:go:()Ljava/lang/Runnable;"]) == 2
    inner = java.usages(files, java.extract(files)).filter("path = 'C'").collect()
    assert {r.element for r in inner} >= {"METHOD:a.C:held:()V", "CONSTRUCTOR:a.C:<init>:()V", "INTERFACE:java.lang.Comparable"}


def test_subtypes_at_any_depth(spark):
    files = spark.createDataFrame([(f"f{i}", f"package p; class K{i} extends K{i + 1} {{ static class N extends K{i} {{ }} }}") for i in range(70)], "path string, content string")
    got = {(r.type, r["class"]) for r in java.subtypes(java.extract(files)).collect()}
    assert ("p.K70", "p.K0") in got and ("p.K3", "p.K0$N") in got and ("p.K0", "p.K0$N") in got and ("p.K0", "p.K0") not in got


def test_type_constraint():
    (r,) = rules.parse("$1.isDirectory() :: $1 instanceof java.io.File => !$1.isFile();;")
    assert rules.rewrite(r, "void t(java.io.File f) { f.isDirectory(); }") == "void t(java.io.File f) { !f.isFile(); }"
    assert rules.find(r, "void t(Other f) { f.isDirectory(); }") == []


def test_anonymous_class_and_same_variable():
    (r,) = rules.parse("new $type() { $mods$ $resultType $methodName($args$) { $statements$; } };;")
    assert rules.find(r, "x = new Runnable() { public void run() { a(); b(); } };")
    (s,) = rules.parse("$a == $a;;")
    assert len(rules.find(s, "f(x == x, x == y)")) == 1


def test_rule_errors():
    assert rules.errors("$1.a(;;") and rules.errors(":: $1 instanceof T;;") and not rules.errors("'ok': $1.a();;")


def test_rule_tests():
    text = "$1.a() => $1.b();;\n%%TestCase pos-pos\nx.a()\n%%=>\nx.b()\n%%TestCase pos-neg\nx.a()\n%%TestCase neg-pos\nx.c()\n%%TestCase neg-neg\nx.c()\n%%=>\nx.d()\n"
    failed = rules.run_tests(text)
    assert len(failed) == 2 and "pos-neg" in failed[0] and "neg-neg" in failed[1]


def test_precedence():
    assert not rules.should_apply(True, True, True) and rules.should_apply(False, True, False) and rules.should_apply(False, False, True)
    some = rules.parse("'a': $1.a();; 'b': $1.b();;")
    assert [r.label for r in rules.effective(some, {"b": False})] == ["a"] and rules.effective(some, {}, run_declarative=False) == []
    with pytest.raises(KeyError):
        rules.effective(some, {}, only="c")


def test_on_tables(spark):
    files = spark.createDataFrame([("g", "T.java", "class T {\n void t() {\n  c.isEmpty();\n }\n}\n"), ("g", "U.java", "class U {}"), ("h", "V.java", "class V {}")], "group string, path string, content string")
    some = rules.parse("'Usage': $var.isEmpty() => $var.size() == 0;;")
    assert [(r.path, r.line, r.column) for r in rules.occurrences(files, some).collect()] == [("T.java", 3, 3)]
    (out,) = rules.applied(files, some).collect()
    assert "c.size() == 0;" in out.content and out["diff"].startswith("--- a/T.java")
    assert sorted(map(tuple, rules.group_status(files, some).collect())) == [("g", "SUCCESS"), ("h", "NOTHING_TO_DO")]
    assert {(r.kind, r.simple_name) for r in java.extract(files).collect()} == {("CLASS", "T"), ("METHOD", "t"), ("CLASS", "U"), ("CLASS", "V")}
