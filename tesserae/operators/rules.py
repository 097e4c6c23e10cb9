"""Rules over Java sources: tree patterns with variables, type constraints, rewrites, rule tests.

A rule is ``'label': pattern :: $v instanceof T && ... => replacement => other replacement ;;``.
``$v`` stands for one tree, ``$v$`` for any number of arguments or statements, ``$this`` also for
the receiver that a call leaves out; a variable that comes again stands for the same
tree. Names of types match however they are qualified. Files that lack a word of the
pattern are left out by a column filter before any Python runs.

A constraint holds if the type of what the variable stands for, or one of its supertypes, is
the one named; a type that neither the file nor the known library tells does not pass.
Rule text is never run. Rewrites put parentheses where the surroundings need them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import java, lookup, report, syntax
from tesserae.operators.rounds import checkpointed
from tesserae.operators.syntax import POSTFIX, STRENGTH, Broken, Node, dotted
from tesserae.sources.shipping import ship


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    constraints: tuple[tuple[str, str], ...] = ()
    replacements: tuple[tuple[str, tuple[tuple[str, str], ...]], ...] = ()
    severity: str = "warning"
    enabled: bool = True

    @property
    def replacement(self) -> str | None:
        return self.replacements[0][0] if self.replacements else None


class RuleError(ValueError):
    """A rule that cannot be read."""


_PIECE = re.compile(r"""(?P<skip>//[^\n]*|/\*.*?\*/)|(?P<text>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<mark>;;|=>|::|&&)|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<other>.)""", re.S | re.X)
_CONSTRAINT = re.compile(r"(\$\w+)\s+instanceof\s+([\w.$<>\[\], ?]+)")


def _cut(body: str, *marks: str) -> list[str]:
    """Parts of a rule text between marks that stand outside of strings, comments and brackets."""
    out, now, depth = [], "", 0
    for m in _PIECE.finditer(body):
        if m.lastgroup == "mark" and m[0] in marks and (depth <= 0 or m[0] == ";;"):
            out.append(now)
            now, depth = "", 0
            continue
        depth += (m.lastgroup == "open") - (m.lastgroup == "close")
        now += " " if m.lastgroup == "skip" else m[0]
    return [*out, now]


def _where(text: str) -> tuple[tuple[str, str], ...]:
    out = []
    for c in filter(None, (c.strip() for c in _cut(text, "&&"))):
        m = _CONSTRAINT.fullmatch(c)
        if not m:
            raise RuleError(f"a constraint that is not known: {c!r}")
        out.append((m[1], m[2].strip()))
    return tuple(out)


def _split_where(text: str) -> tuple[str, tuple[tuple[str, str], ...]]:
    """A pattern or replacement and its constraints. A :: that no constraint follows is a method reference."""
    parts = _cut(text, "::")
    for i in range(len(parts) - 1, 0, -1):
        where = "::".join(parts[i:])
        if "instanceof" in where or not "::".join(parts[:i]).strip() or not re.fullmatch(r"\s*(\w+|new)\b.*", where, re.S):
            return "::".join(parts[:i]).strip(), _where(where)
    return text.strip(), ()


def _rule(part: str) -> Rule:
    label = re.match(r"\s*'([^']*)'\s*:(?!:)", part)
    head, *then = _cut(part[label.end() :] if label else part, "=>")
    pattern, constraints = _split_where(head)
    if not pattern:
        raise RuleError(f"a rule without a pattern: {part.strip()!r}")
    try:
        syntax.fragment(pattern)
    except Broken as e:
        raise RuleError(f"{e}: {pattern!r}") from None
    return Rule(label[1] if label else pattern, pattern, constraints, tuple(_split_where(t) for t in then))


def read(text: str) -> tuple[list[Rule], list[str]]:
    """The rules of a rule file and what is wrong with the others; tests behind ``%%`` are not read."""
    out, wrong = [], []
    for part in _cut(re.split(r"^%%", text, maxsplit=1, flags=re.M)[0], ";;"):
        if part.strip():
            try:
                out.append(_rule(part))
            except RuleError as e:
                wrong.append(str(e))
    return out, wrong


def parse(text: str) -> list[Rule]:
    """The rules of a rule file."""
    found, wrong = read(text)
    if wrong:
        raise RuleError("; ".join(wrong))
    return found


def errors(text: str) -> list[str]:
    """All reasons why rules of a file cannot be read."""
    return read(text)[1]


@lru_cache(maxsize=512)
def _pattern(text: str) -> tuple[Node, ...]:
    out = syntax.fragment(text)
    if len(out) == 1 and out[0].kind == "EXPRESSION_STATEMENT" and not text.rstrip().endswith(";"):
        out = out[0].kids
    return tuple(out)


def words(rule: Rule) -> list[str]:
    """Plain names that a file must hold for the rule to match. Packages can be left out in the file."""
    out = set()
    for top in _pattern(rule.pattern):
        for n in top.walk():
            if n.kind == "MEMBER_SELECT" and n.name[:1].isupper() and all(p[:1].islower() for p in dotted(n).split(".")[:-1]):
                out.add(n.name)
                out.discard(None)
            elif n.name and "$" not in n.name and n.kind in ("IDENTIFIER", "MEMBER_SELECT", "METHOD", "VARIABLE", "CLASS") and not _is_package(n, rule.pattern):
                out.add(n.name)
    return sorted(out - {"<init>"})


def _is_package(n: Node, text: str) -> bool:
    """Whether a name begins a chain that leads to a type."""
    return n.name[:1].islower() and re.match(r"\s*(\.\s*[a-z]\w*\s*)*\.\s*[A-Z]", text[n.end :]) is not None and dotted(n) != ""


# matching


def _variable(n: Node) -> str:
    return n.name if n.kind == "IDENTIFIER" and n.name.startswith("$") else ""


def same(a, b) -> bool:
    """Whether two trees, lists of trees or names are alike."""
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, Node) and isinstance(b, Node):
        if a.kind == "MODIFIERS":
            return a.part["names"] == (b.part.get("names") if b.kind == "MODIFIERS" else None)
        return a.kind == b.kind and a.name == b.name and same(a.kids, b.kids)
    return a == b


class Matcher:
    """One source, and what patterns find in it."""

    def __init__(self, source: str):
        self.source, self.shift = source, 0
        for before, behind in (("", ""), ("class _ {", "}"), ("class _ { void _() {", "}}"), ("class _ { Object _ = ", ";}")):
            found = java.Attribution(before + source + behind)
            if not found.unit.parser.problems and found.unit.tree.kids or not before and not source.strip():
                break
        else:
            before, found = "", java.Attribution(source)
        self.shift, self.a = len(before), found
        self.up: dict[Node, tuple[Node, int]] = {}
        for n in self.a.unit.tree.walk():
            for i, k in enumerate(n.kids):
                self.up.setdefault(k, (n, i))

    def nodes(self) -> Iterator[Node]:
        for n in self.a.unit.tree.walk():
            if n.start >= self.shift and n.end <= self.shift + len(self.source):
                yield n

    def text(self, value) -> str:
        if isinstance(value, str):
            return value
        if isinstance(value, list):
            return self.text_between(value[0].start, value[-1].end) if value else ""
        return self.text_between(value.start, value.end)

    def text_between(self, a: int, b: int) -> str:
        return self.source[max(0, a - self.shift) : b - self.shift]

    def one(self, p: Node, n: Node, bound: dict) -> Iterator[dict]:
        name = _variable(p)
        if name:
            if n.kind not in ("MODIFIERS", "STATEMENTS"):
                yield from self.bind(name, n, bound)
            return
        if p.kind == "STATEMENTS":
            yield from self.bind(p.name, [n], bound)
            return
        if p.kind in ("IDENTIFIER", "MEMBER_SELECT") and n.kind in ("IDENTIFIER", "MEMBER_SELECT") and "$" not in (d := dotted(p)) and d:
            s = self.a.symbol.get(n)
            if s is not None and s.role == "TYPE":
                full = java.canonical(s.name)
                if full == d or "." not in d and full.rpartition(".")[2] == d:
                    yield bound
                return
        if p.kind in ("PARAMETERIZED_TYPE", "IDENTIFIER", "MEMBER_SELECT") and n.kind == "PARAMETERIZED_TYPE" and p.kind != n.kind:
            yield from self.one(p, n.kids[0], bound)
            return
        if p.kind != n.kind:
            return
        if p.kind == "METHOD_INVOCATION":
            yield from self.call(p, n, bound)
            return
        if p.kind == "MODIFIERS":
            yield from self.modifiers(p, n, bound)
            return
        if p.name.startswith("$") and p.kind in ("METHOD", "VARIABLE", "CLASS", "MEMBER_SELECT"):
            for b in self.bind(p.name, n.name, bound):
                yield from self.all(p.kids, n.kids, b)
        elif p.name == n.name:
            yield from self.all(p.kids, n.kids, bound)

    def modifiers(self, p: Node, n: Node, bound: dict) -> Iterator[dict]:
        free = [x for x in p.part["names"] if x.startswith("$")]
        if not p.part["names"] or free:
            if set(p.part["names"]) - set(free) <= set(n.part["names"]):
                yield {**bound, **{x: n for x in free}}
        elif set(p.part["names"]) == set(n.part["names"]):
            yield bound

    def call(self, p: Node, n: Node, bound: dict) -> Iterator[dict]:
        t, u = p.part["target"], n.part["target"]
        if t.kind == "MEMBER_SELECT" and u.kind == "IDENTIFIER" and t.name == u.name:
            name = _variable(t.kids[0])
            owner = self.a.implicit_receiver(u)
            if name == "$this" and owner:
                hidden = Node("IDENTIFIER", n.start, n.start, "this")
                self.a.type[hidden] = owner if owner in self.a.unit.types else self.a.inside.get(u)
                for b in self.bind(name, hidden, bound):
                    yield from self.all(p.part["args"], n.part["args"], b)
            return
        for b in self.one(t, u, bound):
            yield from self.all(p.part["args"], n.part["args"], b)

    def bind(self, name: str, value, bound: dict) -> Iterator[dict]:
        if name not in bound:
            yield {**bound, name: value}
        elif same(bound[name], value):
            yield bound

    def all(self, ps: list[Node], ns: list[Node], bound: dict) -> Iterator[dict]:
        if not ps:
            if not ns:
                yield bound
            return
        p, rest = ps[0], ps[1:]
        name = p.name if p.kind == "STATEMENTS" or p.kind == "IDENTIFIER" and re.fullmatch(r"\$\w+\$", p.name) else ""
        if name:
            for k in range(len(ns) + 1):
                for b in self.bind(name, ns[:k], bound):
                    yield from self.all(rest, ns[k:], b)
        elif ns:
            for b in self.one(p, ns[0], bound):
                yield from self.all(rest, ns[1:], b)

    def passes(self, constraints, bound: dict) -> bool:
        for variable, wanted in constraints:
            value = bound.get(variable)
            if not isinstance(value, Node) or not self.is_a(self.a.type.get(value) if value.kind != "VARIABLE" else self.a.symbol[value].type, wanted):
                return False
        return True

    def is_a(self, has: str | None, wanted: str) -> bool:
        wanted = re.sub(r"<.*>", "", wanted).replace(" ", "")
        if has is None:
            return False
        if has in java.PRIMITIVE or wanted in java.PRIMITIVE or has.endswith("[]") or wanted.endswith("[]"):
            return has == wanted or wanted in ("Object", "java.lang.Object") and has.endswith("[]") or java.canonical(has).rpartition(".")[2] == wanted and wanted not in java.PRIMITIVE
        return any(java.canonical(t) == wanted or "." not in wanted and java.canonical(t).rpartition(".")[2] == wanted for t in self.a.lineage(has))

    def matches(self, rule: Rule) -> list[tuple[int, int, dict, Node]]:
        """Start, end, variables and first tree of every match, outer ones first."""
        ps, out = _pattern(rule.pattern), []
        for n in self.nodes():
            if len(ps) == 1 and ps[0].kind != "STATEMENTS":
                for b in self.one(ps[0], n, {}):
                    if self.passes(rule.constraints, b):
                        out.append((n.start, n.end, b, n))
                        break
            elif n.kind in ("BLOCK", "CASE") or n.kind in java.KINDS:
                i = 0
                while i < len(n.kids):
                    hit = next(((k, b) for k in range(len(n.kids), i, -1) for b in self.all(list(ps), n.kids[i:k], {}) if self.passes(rule.constraints, b)), None)
                    if hit:
                        out.append((n.kids[i].start, n.kids[hit[0] - 1].end, hit[1], n.kids[i]))
                        i = hit[0]
                    else:
                        i += 1
        return out

    # rewriting

    def rewritten(self, rule: Rule, which: int = 0) -> str:
        """The source with every match replaced, inner ones within outer ones too."""
        replaced = []
        for a, b, bound, n in self.matches(rule):
            some = [r for r in rule.replacements[which:] if self.passes(r[1], bound)]
            if some and (which == 0 or some[0] is rule.replacements[which]):
                replaced.append((a, b, bound, n, some[0][0]))
        return self._render(self.shift, self.shift + len(self.source), replaced)

    def _render(self, start: int, end: int, replaced: list) -> str:
        out, at = [], start
        inside = [r for r in replaced if start <= r[0] and r[1] <= end]
        for r in inside:
            a, b, bound, n, to = r
            if a < at:
                continue  # within the one before, which has taken care of it
            others = [x for x in replaced if x is not r and a <= x[0] and x[1] <= b]
            out += [self.text_between(at, a), self._filled(to, bound, n, others)]
            at = b
        return "".join([*out, self.text_between(at, end)])

    def _filled(self, to: str, bound: dict, n: Node, others: list) -> str:
        try:
            trees = list(_pattern(to))
        except Broken:
            trees = []
        parent = {k: (m, i) for t in trees for m in t.walk() for i, k in enumerate(m.kids)}
        edits = []  # start, end, text
        for t in trees:
            for m in t.walk():
                if m.kind == "STATEMENTS" and m.name in bound:
                    edits.append((m.start, m.end + (to[m.end : m.end + 1] == ";"), self._value(bound[m.name], others, None)))
                elif m.kind == "IDENTIFIER" and m.name in bound:
                    edits.append((m.start, m.end, self._value(bound[m.name], others, parent.get(m))))
                elif m.name in bound and m.at >= 0:
                    edits.append((m.at, m.at + len(m.name), self._value(bound[m.name], others, None)))
                elif m.kind == "MEMBER_SELECT" and m.name[:1].isupper() and (d := dotted(m)) and self.a.unit.resolve(m.name, self.a.inside.get(n, "")) == java._binary(d):
                    edits.append((m.start, m.end, m.name))
        out, at = "", 0
        for a, b, x in sorted(edits, key=lambda e: (e[0], -e[1])):
            if a < at:
                continue
            between = to[at:a]
            if not x and to[b:].lstrip().startswith(",") and not between.rstrip().endswith(","):
                b += len(to[b:]) - len(to[b:].lstrip()) + 1
                b += len(to[b:]) - len(to[b:].lstrip())
            elif not x and between.rstrip().endswith(","):
                between = between.rstrip()[:-1]
            out, at = out + between + x, b
        out += to[at:]
        if not edits and not trees:
            out = re.sub(r"\$\w+\$?", lambda m: self.text(bound[m[0]]) if m[0] in bound else m[0], to)
        if len(trees) == 1 and n in self.up and weak(trees[0], *self.up[n]):
            return f"({out})"
        return out

    def _value(self, value, others: list, where) -> str:
        if isinstance(value, str):
            return value
        if isinstance(value, list):
            return self._render(value[0].start, value[-1].end, others) if value else ""
        if value.start == value.end:
            return value.name  # a receiver that is not written
        out = self._render(value.start, value.end, others)
        kind = next((o for o in others if (o[0], o[1]) == (value.start, value.end)), None)
        tree = value
        if kind is not None:
            try:
                tree = _pattern(kind[4])[0]
            except Broken:
                return out
        return f"({out})" if where is not None and weak(tree, *where) and not (kind is not None and out.startswith("(") and out.endswith(")")) else out


def weak(n: Node, parent: Node, i: int) -> bool:
    """Whether a tree needs parentheses as the i-th part of another."""
    has, kind = STRENGTH.get(n.kind, 40), parent.kind
    if kind in ("MEMBER_SELECT", "MEMBER_REFERENCE") or kind == "ARRAY_ACCESS" and i == 0 or kind == "METHOD_INVOCATION" and n is parent.part.get("target"):
        return has < POSTFIX
    if kind.startswith("POSTFIX"):
        return has < POSTFIX
    if kind == "TYPE_CAST":
        return i > 0 and has < 20
    if kind == "CONDITIONAL_EXPRESSION":
        return has <= 2 if i == 0 else has < 2 and i == 2 and n.kind != "LAMBDA_EXPRESSION"
    if kind in STRENGTH and kind != "LAMBDA_EXPRESSION" and not kind.endswith("ASSIGNMENT"):
        needs = STRENGTH[kind]
        return has < needs if i == 0 or needs == 20 else has <= needs
    return False


def find(rule: Rule, source: str | Matcher) -> list[tuple[int, int, dict[str, str]]]:
    """Start, end and variables (their text) of matches, by start, outer ones first."""
    m = source if isinstance(source, Matcher) else Matcher(source)
    return [(a - m.shift, b - m.shift, {k: m.text(v) for k, v in bound.items()}) for a, b, bound, _ in sorted(m.matches(rule), key=lambda x: (x[0], -x[1]))]


def rewrite(rule: Rule, source: str, which: int = 0) -> str:
    """The source with every match replaced; as it is for a rule without a replacement."""
    return Matcher(source).rewritten(rule, which) if rule.replacements else source


def rewrite_all(rules: list[Rule], source: str) -> str:
    for r in rules:
        if r.enabled and all(w in source for w in words(r)):
            source = rewrite(r, source)
    return source


def run_tests(text: str) -> list[str]:
    """Failures of the tests of a rule file: ``%%TestCase name``, code, then each ``%%=>`` with an expected result."""
    rules, out = parse(text), []
    for case in re.split(r"^%%TestCase\s+", text, flags=re.M)[1:]:
        name, _, rest = case.partition("\n")
        code, *expected = re.split(r"^%%=>[^\n]*\n?", rest, flags=re.M)
        got = [x for x in (rewrite(r, code, i) for r in rules for i in range(max(1, len(r.replacements)))) if x != code]
        if [x.strip() for x in got] != [x.strip() for x in expected]:
            out.append(f"[test_failure] {name.strip()}: expected {[x.strip() for x in expected]}, actual {[x.strip() for x in got]}")
    return out


# tables


def candidates(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Files that hold all words of some rule."""
    each = [reduce(lambda a, b: a & b, [F.col("content").contains(w) for w in words(r)], F.lit(True)) for r in rules if r.enabled]
    return files.filter(reduce(lambda a, b: a | b, each, F.lit(False)))


def occurrences(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """path, label, severity, start_off, end_off, line and column of every match. files: path, content."""
    some = [r for r in rules if r.enabled]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, source in zip(batch["path"], batch["content"]):
                held = None
                for r in some:
                    if all(w in source for w in words(r)):
                        held = held or Matcher(source)
                        for a, b, _ in find(r, held):
                            rows.append((path, r.label, r.severity, a, b, source.count("\n", 0, a) + 1, a - source.rfind("\n", 0, a)))
            yield pd.DataFrame(rows, columns=["path", "label", "severity", "start_off", "end_off", "line", "column"])

    ship(files.sparkSession)
    return candidates(files.select("path", "content").filter("content is not null"), some).mapInPandas(run, "path string, label string, severity string, start_off long, end_off long, line long, column long")


def applied(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """path, the rewritten content and the unified diff of files that change."""
    some = [r for r in rules if r.enabled and r.replacement is not None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, source in zip(batch["path"], batch["content"]):
                new = rewrite_all(some, source)
                if new != source:
                    rows.append((path, new, report.unified(path, source, new)))
            yield pd.DataFrame(rows, columns=["path", "content", "diff"])

    ship(files.sparkSession)
    return candidates(files.select("path", "content").filter("content is not null"), some).mapInPandas(run, "path string, content string, diff string")


def spans(files: DataFrame, rule: Rule) -> DataFrame:
    """path and the packed begins and ends of the rule's matches; files without one have no row."""
    found = occurrences(files, [rule]).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start_off", "end_off"))).alias("s"))
    return found.select("path", F.array_join(F.flatten(F.transform("s", lambda s: F.array(s["start_off"].cast("string"), s["end_off"].cast("string")))), ":").alias("spans"))


def documents(files: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """path, tokens (kinds and names of the trees, in order) and types: all types of expressions, erased, with all their supertypes, as canonical names.

    declared: declarations of the corpus, if supertypes are to be followed into other files.
    """
    ship(files.sparkSession)
    raw = files.select("path", "content").mapInPandas(_documents, "path string, tokens array<string>, direct array<string>")
    all_ = java.with_library(java.extract(files) if declared is None else declared)
    up = lookup.closure(java.supertypes(all_)).select("child", "ancestor")
    each = checkpointed(raw)
    direct = each.select("path", F.explode("direct").alias("type"))
    every = direct.unionByName(direct.join(up, direct["type"] == up["child"]).select("path", F.col("ancestor").alias("type"))).distinct()
    types = every.groupBy("path").agg(F.sort_array(F.collect_set(F.translate("type", "$", "."))).alias("types"))
    return each.select("path", "tokens").join(types, "path", "left").select("path", "tokens", F.coalesce("types", F.array().cast("array<string>")).alias("types"))


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, code in zip(batch["path"], batch["content"]):
            a = java.Attribution(code or "")
            rows.append((path, [x for n in a.unit.tree.walk() for x in (n.kind, n.name) if x], _direct(a)))
        yield pd.DataFrame(rows, columns=["path", "tokens", "direct"])


def _direct(a: java.Attribution) -> list[str]:
    """The types of a file's expressions, erased, and those that it declares."""
    direct = {t.rstrip("[]") for t in a.type.values() if t} | {d.name for d in a.unit.found if d.kind in java.KINDS}
    direct |= {a.implicit_receiver(n) for n in a.symbol if n.kind == "IDENTIFIER"} - {None}
    return sorted(direct - set(java.PRIMITIVE))


_TYPED = "path string, patterns array<struct<pattern:string,freq:long>>, direct array<string>, declared array<struct<kind:string,name:string,supertypes:array<string>>>"


def typed(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """What :func:`typed_search` needs of each file, read once for any number of searches: matches by pattern, the types of its expressions, and its own types."""
    some = [r for r in rules if r.enabled]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = pa.list_(pa.string())
        kinds = [pa.list_(pa.struct([("pattern", pa.string()), ("freq", pa.int64())])), names, pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("supertypes", names)]))]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                paths, rows = batch.column("path").slice(at, 1000), []
                for code in batch.column("content").slice(at, 1000).to_pylist():
                    held, freq = None, {}
                    for r in some:
                        if code is not None and all(w in code for w in words(r)):
                            held = held or Matcher(code)
                            if found := len(find(r, held)):
                                freq[r.label] = freq.get(r.label, 0) + found
                    a = held.a if held is not None and not held.shift else java.Attribution(code or "")
                    rows.append((list(freq.items()), _direct(a), [(d.kind, d.name, d.supertypes) for d in a.unit.found if d.kind in java.KINDS]))
                yield pa.RecordBatch.from_arrays([paths, *(pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds))], ["path", "patterns", "direct", "declared"])

    ship(files.sparkSession)
    return files.select("path", F.col("content").cast("string").alias("content")).mapInArrow(run, _TYPED)


def typed_search(files: DataFrame | None, rules: list[Rule], types: list[str], declared: DataFrame | None = None, read: DataFrame | None = None) -> DataFrame:
    """path, pattern and freq of files in which a pattern matches and expressions of all the given types occur.

    Only what is below the given types is looked for, not what is above those of all files.
    read: what :func:`typed` gave for the files and rules, kept, if there are more searches.
    """
    if not types:
        return occurrences(files, rules).groupBy("path", F.col("label").alias("pattern")).agg(F.count("*").alias("freq"))
    read = checkpointed(typed(files, rules)) if read is None else read
    own = read.select("path", F.inline("declared")) if declared is None else declared
    direct = checkpointed(java.hierarchy(own)[1])
    wanted = set(types)
    uses = read.filter(F.size("patterns") > 0).select("path", F.explode("direct").alias("child")).distinct()
    canon = F.translate("ancestor", "$", ".")
    low = lookup.below(direct, direct.select(F.col("parent").alias("ancestor")).filter(canon.isin(*wanted)))
    met = uses.join(low.hint("merge"), "child").select("path", canon.alias("type")).unionByName(uses.select("path", F.translate("child", "$", ".").alias("type")).filter(F.col("type").isin(*wanted)))
    has = met.groupBy("path").agg(F.count_distinct("type").alias("n")).filter(F.col("n") == len(wanted)).select("path")
    return read.select("path", F.inline("patterns")).groupBy("path", "pattern").agg(F.sum("freq").alias("freq")).join(has.hint("merge"), "path", "left_semi")


# which rules run


def effective(rules: list[Rule], config: dict[str, bool], run_declarative: bool = True, only: str | None = None) -> list[Rule]:
    """Rules that run: one by its label, or those that the configuration leaves enabled."""
    if only is not None:
        found = [r for r in rules if r.label == only]
        if not found:
            raise KeyError(only)
        return found
    return [r for r in rules if config.get(r.label, run_declarative and r.enabled)]


def should_apply(no_apply: bool, apply: bool, configured: bool | None) -> bool:
    """--no-apply beats --apply, which beats the configuration."""
    return False if no_apply else True if apply else bool(configured)


def group_status(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """group and status of every group of files. files: group, path, content."""
    if not rules:
        return files.select("group").distinct().withColumn("status", F.lit("NO_HINTS_FOUND"))
    hits = occurrences(files, rules).groupBy("path").agg(F.max((F.col("severity") == "error").cast("int")).alias("bad"))
    each = files.select("group", "path").join(hits, "path", "left")
    return report.status(each.select("group", F.when(F.col("bad").isNull(), "NOTHING_TO_DO").when(F.col("bad") == 1, "FAILURE").otherwise("SUCCESS").alias("status")))
