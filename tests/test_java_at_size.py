"""What keeps the queries over Java sources within bounds on large corpora: few rounds, files read once, nothing large sent to all tasks."""

import os
import uuid

from tesserae.operators import java, locate, lookup, rounds, rules

FILES = [
    ("A", "package p; class A { A next() { return null; } int n(int x) { return x; } }"),
    ("B", "package p; class B extends A implements java.io.Serializable { B next() { return null; } }"),
    ("C", "package p; import java.util.List; class C extends B { List<String> l; void f(C o) { o.next().n(1); l.isEmpty(); } }"),
]


def counted(spark, folder, rows=FILES):
    """Files as a table that leaves a mark whenever one of them is read."""
    where = str(folder)

    def run(batches):
        for batch in batches:
            for _ in range(len(batch)):
                open(os.path.join(where, uuid.uuid4().hex), "w").close()
            yield batch

    return spark.createDataFrame(rows, "path string, content string").mapInPandas(run, "path string, content string")


def test_closure_takes_few_rounds(spark, monkeypatch):
    calls, real = [], rounds.checkpointed
    monkeypatch.setattr(rounds, "checkpointed", lambda df: calls.append(1) or real(df))
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(40)] + [("40", "38"), ("0", "40")], "child string, parent string")
    got = {(r.child, r.ancestor): r.depth for r in lookup.closure(edges).collect()}
    assert len(calls) <= 8 and got[("0", "39")] == 3 and got[("1", "40")] == 39 and ("40", "40") not in got


def test_subtypes_read_files_once(spark, tmp_path):
    got = {(r.type, r["class"]) for r in java.subtypes(java.extract(counted(spark, tmp_path), java.KINDS)).collect()}
    assert {("p.A", "p.B"), ("p.A", "p.C"), ("java.io.Serializable", "p.C"), ("java.lang.Object", "p.A")} <= got
    assert len(os.listdir(tmp_path)) == len(FILES)


def test_usages_read_files_once_and_broadcast_nothing(spark, tmp_path):
    used = java.usages(counted(spark, tmp_path))
    assert "Broadcast" not in used._jdf.queryExecution().toString()
    got = {(r.path, r.element, r.is_override) for r in used.collect()}
    assert {("C", "METHOD:p.B:next:()Lp/B;", False), ("C", "METHOD:p.A:next:()Lp/A;", True), ("C", "METHOD:p.A:n:(I)I", False), ("C", "CLASS:p.C", False), ("C", "FIELD:p.C:l", False)} <= got
    assert len(os.listdir(tmp_path)) == len(FILES)


def test_circles_of_types_end(spark):
    files = [("A", "package p; class A extends B { void f() { g(1); } }"), ("B", "package p; class B extends A { void h() { g(1); } }")]
    assert not [r for r in java.usages(spark.createDataFrame(files, "path string, content string")).collect() if "METHOD" in r.element]


def test_flags_of_a_type_follow_no_other_types(spark, monkeypatch):
    monkeypatch.setattr(lookup, "closure", lambda *a, **k: 1 / 0)
    declared, raw = java.analysed(spark.createDataFrame(FILES, "path string, content string"))
    got = {r.path: (r.usage, r.subtypes) for r in locate.file_flags(java.usages(None, declared, raw), declared, "CLASS:p.A").collect()}
    assert got["B"] == (True, ["p.B"]) and got["C"] == (False, ["p.C"])


def test_typed_searches_read_files_once(spark, tmp_path):
    some = rules.parse("$1.isEmpty();;")
    read = rounds.checkpointed(rules.typed(counted(spark, tmp_path), some))
    found = [[(r.path, r.freq) for r in rules.typed_search(None, some, t, read=read).collect()] for t in (["java.io.Serializable"], ["p.A", "java.util.Collection"], ["p.Other"])]
    assert found == [[("C", 1)], [("C", 1)], []]
    assert len(os.listdir(tmp_path)) == len(FILES)
