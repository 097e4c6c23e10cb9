"""Syntax trees of Java sources, by recursive descent, for whole files and for patterns.

Kinds of nodes carry the names of the language's public tree API. Broken code does not
fail: what cannot be read becomes an ERRONEOUS node up to the next semicolon or
brace. In patterns ``$name`` stands where a name may, and ``$name$`` where a list may.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

_TOKEN = re.compile(r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"{3}.*?(?:\"{3}|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<number>(?:\d|\.\d)(?:[eEpP][+-]|[\w.])*)|(?P<name>[^\W\d][\w$]*|\$\w+\$?)|(?P<mark>->|::|==|!=|<=|&&|\|\||\+\+|--|\.\.\.|<<=|<<|[-+*/%&|^]=|.)""", re.S | re.X)
MODIFIERS = ("public", "protected", "private", "static", "abstract", "final", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed", "non-sealed")
PRIMITIVE = ("boolean", "byte", "short", "int", "long", "char", "float", "double", "void")
_TYPES = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "@interface": "ANNOTATION_TYPE", "record": "RECORD"}
_BINARY = [
    {"||": "CONDITIONAL_OR"},
    {"&&": "CONDITIONAL_AND"},
    {"|": "OR"},
    {"^": "XOR"},
    {"&": "AND"},
    {"==": "EQUAL_TO", "!=": "NOT_EQUAL_TO"},
    {"<": "LESS_THAN", ">": "GREATER_THAN", "<=": "LESS_THAN_EQUAL", ">=": "GREATER_THAN_EQUAL", "instanceof": "INSTANCE_OF"},
    {"<<": "LEFT_SHIFT", ">>": "RIGHT_SHIFT", ">>>": "UNSIGNED_RIGHT_SHIFT"},
    {"+": "PLUS", "-": "MINUS"},
    {"*": "MULTIPLY", "/": "DIVIDE", "%": "REMAINDER"},
]
_LEVEL = {op: i for i, level in enumerate(_BINARY) for op in level}
_ASSIGN = {"=": "ASSIGNMENT", "+=": "PLUS_ASSIGNMENT", "-=": "MINUS_ASSIGNMENT", "*=": "MULTIPLY_ASSIGNMENT", "/=": "DIVIDE_ASSIGNMENT", "%=": "REMAINDER_ASSIGNMENT", "&=": "AND_ASSIGNMENT", "|=": "OR_ASSIGNMENT", "^=": "XOR_ASSIGNMENT", "<<=": "LEFT_SHIFT_ASSIGNMENT", ">>=": "RIGHT_SHIFT_ASSIGNMENT", ">>>=": "UNSIGNED_RIGHT_SHIFT_ASSIGNMENT"}
_PREFIX = {"++": "PREFIX_INCREMENT", "--": "PREFIX_DECREMENT", "+": "UNARY_PLUS", "-": "UNARY_MINUS", "!": "LOGICAL_COMPLEMENT", "~": "BITWISE_COMPLEMENT"}
#: How strongly the parts of an expression hang together; what is not listed needs no parentheses.
STRENGTH = {k: 3 + i for i, level in enumerate(_BINARY) for k in level.values()} | dict.fromkeys(_ASSIGN.values(), 1) | {"LAMBDA_EXPRESSION": 1, "CONDITIONAL_EXPRESSION": 2} | dict.fromkeys((*_PREFIX.values(), "TYPE_CAST"), 20)
POSTFIX = 30  #: of what stands before a dot or bracket


sys.setrecursionlimit(max(sys.getrecursionlimit(), 50_000))  # trees can be deep


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


def tokens(code: str) -> list[Token]:
    """The tokens of a source, without white space and comments."""
    return [Token(m.lastgroup, m[0], m.start(), m.end()) for m in _TOKEN.finditer(code) if m.lastgroup != "skip"]


@dataclass(eq=False, slots=True)
class Node:
    """A tree. ``at`` is where its name stands, -1 for none; ``part`` holds what is needed by role."""

    kind: str
    start: int
    end: int
    name: str = ""
    at: int = -1
    kids: list[Node] = field(default_factory=list)
    part: dict = field(default_factory=dict)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += n.kids[::-1]


class Broken(Exception):
    """The code is not what the parser expects here."""


class Parser:
    """One pass over the tokens; where the grammar needs a look ahead, it tries and goes back."""

    def __init__(self, code: str):
        self.code, self.t, self.i = code, tokens(code), 0
        # nothing stands behind the last token, as far as is looked ahead
        self.texts, self.kinds = [t.text for t in self.t] + [""] * 8, [t.kind for t in self.t] + [""] * 8
        self.problems: list[tuple[int, str]] = []

    # tokens

    def text(self, ahead: int = 0) -> str:
        return self.texts[self.i + ahead]

    def kind(self, ahead: int = 0) -> str:
        return self.kinds[self.i + ahead]

    def at(self, *texts: str) -> bool:
        return self.texts[self.i] in texts and self.kinds[self.i] != "string"

    def place(self) -> int:
        return self.t[self.i].start if self.i < len(self.t) else len(self.code)

    def past(self) -> int:
        return self.t[self.i - 1].end if 0 < self.i <= len(self.t) else 0

    def take(self, *texts: str) -> str:
        if self.i >= len(self.t) or texts and not self.at(*texts):
            raise Broken(f"expected {' or '.join(texts) or 'more'}")
        self.i += 1
        return self.texts[self.i - 1]

    def skip(self, *texts: str) -> bool:
        if self.texts[self.i] in texts and self.kinds[self.i] != "string":
            self.i += 1
            return True
        return False

    def ident(self) -> str:
        if self.kind() != "name" or self.text() in _RESERVED:
            raise Broken("expected a name")
        return self.take()

    def attempt(self, read: Callable):
        """What read gives, or None and no token taken."""
        i, n = self.i, len(self.problems)
        try:
            return read()
        except Broken:
            self.i = i
            del self.problems[n:]
            return None

    def node(self, kind: str, start: int, kids=(), name: str = "", at: int = -1, **part) -> Node:
        return Node(kind, start, max(start, self.past()), name, at, [k for k in kids if k is not None], part)

    # types

    def type(self, params: bool = True) -> Node:
        self.annotations()
        start = self.place()
        if self.skip("?"):
            if self.at("extends", "super"):
                kind = "EXTENDS_WILDCARD" if self.take() == "extends" else "SUPER_WILDCARD"
                return self.node(kind, start, [self.type()])
            return self.node("UNBOUNDED_WILDCARD", start)
        if self.text() in PRIMITIVE:
            out = self.node("PRIMITIVE_TYPE", start, name=self.take())
            out.end = self.past()
        else:
            out = self.named(start)
            if params and self.at("<"):
                out = self.node("PARAMETERIZED_TYPE", start, [out, *self.type_arguments()])
            while self.at(".") and self.kind(1) == "name" and self.text(1) not in _RESERVED:
                self.take()
                at, name = self.place(), self.ident()
                out = self.node("MEMBER_SELECT", start, [out], name, at)
                if params and self.at("<"):
                    out = self.node("PARAMETERIZED_TYPE", start, [out, *self.type_arguments()])
        return self.dims(out, start)

    def dims(self, out: Node, start: int) -> Node:
        while True:
            if self.at("@"):
                self.attempt(self.annotations)
            if self.at("[") and self.text(1) == "]":
                self.i += 2
                out = self.node("ARRAY_TYPE", start, [out])
            else:
                return out

    def named(self, start: int) -> Node:
        at, name = self.place(), self.ident()
        out = self.node("IDENTIFIER", start, name=name, at=at)
        while self.at(".") and self.kind(1) == "name" and self.text(1) not in _RESERVED:
            self.take()
            at, name = self.place(), self.ident()
            out = self.node("MEMBER_SELECT", start, [out], name, at)
        return out

    def type_arguments(self) -> list[Node]:
        self.take("<")
        out = []
        while not self.at(">"):
            out.append(self.type())
            if not self.skip(","):
                break
        self.take(">")
        return out

    def type_parameters(self) -> list[Node]:
        self.take("<")
        out = []
        while not self.at(">"):
            self.annotations()
            start, name, bounds = self.place(), self.ident(), []
            if self.skip("extends"):
                bounds.append(self.type())
                while self.skip("&"):
                    bounds.append(self.type())
            out.append(self.node("TYPE_PARAMETER", start, bounds, name))
            if not self.skip(","):
                break
        self.take(">")
        return out

    # declarations

    def annotations(self) -> list[Node]:
        out = []
        while self.at("@") and self.text(1) != "interface":
            start = self.place()
            self.take()
            kids = [self.named(self.place())]
            if self.skip("("):
                while not self.at(")"):
                    kids.append(self.initializer() if self.at("{") else self.expression())
                    if not self.skip(","):
                        break
                self.take(")")
            out.append(self.node("ANNOTATION", start, kids))
        return out

    def modifiers(self) -> Node:
        start, kids, names = self.place(), [], []
        while True:
            if self.at("@") and self.text(1) != "interface":
                kids += self.annotations()
            elif self.at("non") and self.text(1) == "-" and self.text(2) == "sealed":
                self.i += 3
                names.append("NON_SEALED")
            elif self.text() in MODIFIERS and not (self.at("default") and self.text(1) in (":", "->")) and not (self.at("sealed") and self.text(1) in ("=", ".", ";", "(")):
                names.append(self.take().upper())
            elif self.text()[:1] == "$" and re.fullmatch(r"\$\w+\$", self.text()) and self.kind(1) == "name" and self.kind(2) == "name":
                names.append(self.take())
            else:
                return Node("MODIFIERS", start, self.past() if kids or names else start, kids=kids, part={"names": names})

    def file(self) -> Node:
        start, kids, package, imports = 0, [], "", []
        while self.i < len(self.t):
            i = self.i
            try:
                held = self.attempt(self.modifiers) if self.at("@") else None
                if self.skip("package"):
                    name = self.named(self.place())
                    package = _dotted(name)
                    self.take(";")
                    kids.append(self.node("PACKAGE", name.start, [name]))
                    continue
                if held is not None:
                    self.i = i
                if self.at("import"):
                    kids.append(self.import_())
                    imports.append((kids[-1].part["static"], _dotted(kids[-1].kids[0])))
                    continue
                if self.skip(";"):
                    continue
                kids.append(self.type_declaration(self.place(), self.modifiers()))
            except Broken as e:
                self.lost(i, kids, e)
        return Node("COMPILATION_UNIT", start, len(self.code), kids=kids, part={"package": package, "imports": imports})

    def import_(self) -> Node:
        """The name ends in .* for all of a package or class."""
        start = self.place()
        self.take("import")
        static = self.skip("static")
        name = self.named(self.place())
        if self.skip("."):
            at = self.place()
            self.take("*")
            name = self.node("MEMBER_SELECT", name.start, [name], "*", at)
        self.take(";")
        return self.node("IMPORT", start, [name], static=static)

    def lost(self, i: int, kids: list[Node], error: Broken) -> None:
        """Skip to behind the next semicolon or closed brace."""
        self.i = max(i, min(self.i, len(self.t)))
        self.problems.append((self.place(), str(error)))
        start = self.t[i].start if i < len(self.t) else len(self.code)
        self.i, depth = i, 0
        while self.i < len(self.t):
            x = self.take()
            depth += (x == "{") - (x == "}")
            if depth < 0:
                break
            if depth == 0 and x in (";", "}"):
                break
        kids.append(self.node("ERRONEOUS", start))

    def at_type(self) -> bool:
        return self.at("class", "interface", "enum") or self.at("@") and self.text(1) == "interface" or self.at("record") and self.kind(1) == "name" and self.text(2) in ("(", "<")

    def type_declaration(self, start: int, modifiers: Node) -> Node:
        if not self.at_type():
            raise Broken("expected a type")
        word = self.take()
        if word == "@":
            word += self.take()
        at, name, kids, above = self.place(), self.ident(), [modifiers], []
        params = self.type_parameters() if self.at("<") else []
        kids += params
        members: list[Node] = []
        if word == "record":
            header = self.parameters()
            for h in header:
                h.part["field"] = True
            members += header
        while self.at("extends", "implements", "permits"):
            role = self.take()
            some = [self.type()]
            while self.skip(","):
                some.append(self.type())
            kids += some
            if role != "permits":
                above += some
        out = self.node(_TYPES[word], start, kids, name, at, modifiers=modifiers, params=params, above=above, members=members)
        self.body(out, word == "enum")
        return out

    def body(self, out: Node, enum: bool = False) -> None:
        """Read the members of a type into it."""
        members = out.part["members"]
        self.take("{")
        if enum:
            while not self.at(";", "}") and self.i < len(self.t):
                i = self.i
                try:
                    members.append(self.constant())
                    if not self.skip(","):
                        break
                except Broken as e:
                    self.lost(i, members, e)
            self.skip(";")
        while not self.at("}") and self.i < len(self.t):
            if self.skip(";"):
                continue
            i = self.i
            try:
                members += self.member(out.name)
            except Broken as e:
                self.lost(i, members, e)
        self.skip("}")
        out.kids = out.kids + members
        out.end = self.past()

    def constant(self) -> Node:
        start = self.place()
        self.annotations()
        at, name = self.place(), self.ident()
        args = self.arguments() if self.at("(") else []
        body = []
        if self.at("{"):
            body = [self.anonymous()]
        return self.node("VARIABLE", start, [*args, *body], name, at, role="ENUM_CONSTANT", modifiers=Node("MODIFIERS", start, start, part={"names": ["PUBLIC", "STATIC", "FINAL"]}), type=None)

    def anonymous(self) -> Node:
        out = Node("CLASS", self.place(), self.place(), part={"members": [], "params": [], "above": [], "modifiers": Node("MODIFIERS", self.place(), self.place(), part={"names": []}), "anonymous": True})
        self.body(out)
        return out

    def member(self, simple: str) -> list[Node]:
        start = self.place()
        if re.fullmatch(r"\$\w+\$", self.text()) and self.text(1) in (";", "}"):
            out = self.node("IDENTIFIER", start, name=self.take(), at=start)
            self.skip(";")
            return [out]
        modifiers = self.modifiers()
        if self.at("{"):
            return [self.node("BLOCK", start, [*self.block().kids], role="STATIC_INIT" if "STATIC" in modifiers.part["names"] else "INSTANCE_INIT")]
        if self.at_type():
            return [self.type_declaration(start, modifiers)]
        params = self.type_parameters() if self.at("<") else []
        if self.kind() == "name" and (self.text() == simple or simple == "") and self.text(1) in ("(", "{") and self.text() not in _RESERVED:
            at, name = self.place(), self.take()
            return [self.method(start, modifiers, params, None, "<init>", at, compact=self.at("{"))]
        type_ = self.type()
        if self.kind() != "name":
            raise Broken("expected a name")
        if self.text(1) == "(":
            at, name = self.place(), self.ident()
            return [self.method(start, modifiers, params, type_, name, at)]
        out = self.variables(start, modifiers, type_)
        self.take(";")
        for v in out:
            v.end = self.past()
            v.part["field"] = True
        return out

    def parameters(self) -> list[Node]:
        self.take("(")
        out = []
        while not self.at(")"):
            start = self.place()
            if re.fullmatch(r"\$\w+\$", self.text()) and self.text(1) in (",", ")"):
                out.append(self.node("IDENTIFIER", start, name=self.take(), at=start))
                out[-1].end = self.past()
            else:
                modifiers, type_ = self.modifiers(), self.type()
                if self.skip("..."):
                    type_ = self.node("ARRAY_TYPE", type_.start, [type_])
                at, name = self.place(), self.text()
                if self.skip("this"):
                    pass
                else:
                    name = self.ident()
                    type_ = self.dims(type_, type_.start)
                    out.append(self.node("VARIABLE", start, [modifiers, type_], name, at, role="PARAMETER", modifiers=modifiers, type=type_))
            if not self.skip(","):
                break
        self.take(")")
        return out

    def method(self, start, modifiers, params, returned, name, at, compact: bool = False) -> Node:
        args = [] if compact else self.parameters()
        if returned is not None:
            returned = self.dims(returned, returned.start)
        thrown, default, body = [], None, None
        if self.skip("throws"):
            thrown.append(self.type())
            while self.skip(","):
                thrown.append(self.type())
        if self.skip("default"):
            default = self.initializer() if self.at("{") else self.expression()
        if self.at("{"):
            body = self.block()
        else:
            self.take(";")
        return self.node("METHOD", start, [modifiers, returned, *params, *args, *thrown, body, default], name, at, modifiers=modifiers, params=params, args=args, returned=returned, thrown=thrown, body=body, compact=compact)

    def variables(self, start: int, modifiers: Node, type_: Node, role: str = "FIELD") -> list[Node]:
        out = []
        while True:
            at, name = self.place(), self.ident()
            mine, init = self.dims(type_, type_.start), None
            if self.skip("="):
                init = self.initializer() if self.at("{") else self.expression()
            out.append(self.node("VARIABLE", start if not out else at, [modifiers, mine, init], name, at, role=role, modifiers=modifiers, type=mine, init=init))
            if not self.skip(","):
                return out

    def initializer(self) -> Node:
        start, kids = self.place(), []
        self.take("{")
        while not self.at("}"):
            kids.append(self.initializer() if self.at("{") else self.expression())
            if not self.skip(","):
                break
        self.take("}")
        return self.node("NEW_ARRAY", start, kids)

    # statements

    def block(self) -> Node:
        start, kids = self.place(), []
        self.take("{")
        while not self.at("}") and self.i < len(self.t):
            i = self.i
            try:
                kids += self.statements()
            except Broken as e:
                self.lost(i, kids, e)
                if self.code[max(0, self.past() - 1) : self.past()] == "}" and self.closed(i):
                    self.i -= 1
        if not self.skip("}"):
            self.problems.append((self.place(), "expected }"))
        return self.node("BLOCK", start, kids)

    def closed(self, i: int) -> bool:
        """Whether the tokens from i on close a brace that they do not open."""
        depth = 0
        for t in self.t[i : self.i]:
            depth += (t.text == "{") - (t.text == "}")
            if depth < 0:
                return True
        return False

    def condition(self) -> Node:
        start = self.place()
        self.take("(")
        inner = self.expression()
        self.take(")")
        return self.node("PARENTHESIZED", start, [inner])

    def statement(self) -> Node:
        out = self.statements()
        if len(out) != 1:
            raise Broken("expected one statement")
        return out[0]

    def local(self) -> list[Node]:
        start, modifiers = self.place(), self.modifiers()
        type_ = self.type()
        if self.kind() != "name" or self.text() in _RESERVED or self.text(1) not in ("=", ";", ",", "[", ":", ")"):
            raise Broken("expected a variable")
        return self.variables(start, modifiers, type_, "LOCAL_VARIABLE")

    def statements(self) -> list[Node]:
        start, word = self.place(), self.text()
        if self.kind() == "string":
            word = ""
        if word == "{":
            return [self.block()]
        if word == ";":
            self.take()
            return [self.node("EMPTY_STATEMENT", start)]
        if re.fullmatch(r"\$\w+\$", word) and self.text(1) in (";", "}", ""):
            out = Node("STATEMENTS", start, self.t[self.i].end, self.take(), start)
            self.skip(";")
            return [out]
        if self.kind() == "name" and self.text(1) == ":" and word not in _RESERVED and word != "default":
            self.i += 2
            return [self.node("LABELED_STATEMENT", start, [self.statement()], word)]
        if word in ("if", "while", "for", "do", "switch", "try", "return", "throw", "break", "continue", "synchronized", "assert") or word == "yield" and self.text(1) not in ("=", ".", "(", "++", "--"):
            self.take()
            return [getattr(self, f"_{word}")(start)]
        i = self.i
        held = self.attempt(self.modifiers)
        if held is not None and self.at_type():
            return [self.type_declaration(start, held)]
        self.i = i
        found = self.attempt(self.local)
        if found is not None:
            self.semicolon()
            for v in found:
                v.end = self.past()
            return found
        inner = self.expression()
        if inner.kind not in _STATEMENT and not inner.name.startswith("$") and not (inner.kind == "SWITCH_EXPRESSION"):
            raise Broken("not a statement")
        if self.i < len(self.t):
            self.semicolon()
        return [self.node("EXPRESSION_STATEMENT", start, [inner])]

    def semicolon(self) -> None:
        """A semicolon; before a closing brace it may be missing, which is a problem but loses nothing."""
        if not self.skip(";"):
            if not self.at("}"):
                raise Broken("expected ;")
            self.problems.append((self.place(), "expected ;"))

    def _if(self, start):
        kids = [self.condition(), self.statement()]
        if self.skip("else"):
            kids.append(self.statement())
        return self.node("IF", start, kids)

    def _while(self, start):
        return self.node("WHILE_LOOP", start, [self.condition(), self.statement()])

    def _do(self, start):
        body = self.statement()
        self.take("while")
        cond = self.condition()
        self.take(";")
        return self.node("DO_WHILE_LOOP", start, [body, cond])

    def _for(self, start):
        self.take("(")
        first, found = self.place(), self.attempt(self.local)
        if found and self.skip(":"):
            source = self.expression()
            self.take(")")
            found[0].end = found[0].at + len(found[0].name)
            return self.node("ENHANCED_FOR_LOOP", start, [found[0], source, self.statement()])
        kids = found or []
        if not found and not self.at(";"):
            kids = [self._bare(first)]
            while self.skip(","):
                kids.append(self._bare(self.place()))
        self.take(";")
        if not self.at(";"):
            kids.append(self.expression())
        self.take(";")
        while not self.at(")"):
            kids.append(self._bare(self.place()))
            if not self.skip(","):
                break
        self.take(")")
        return self.node("FOR_LOOP", start, [*kids, self.statement()])

    def _bare(self, start):
        return self.node("EXPRESSION_STATEMENT", start, [self.expression()])

    def cases(self) -> list[Node]:
        self.take("{")
        out = []
        while not self.at("}"):
            start, labels = self.place(), []
            if self.take("case", "default") == "case":
                labels.append(self.label())
                while self.skip(","):
                    labels.append(self.label())
                if self.skip("when"):
                    labels.append(self.expression())
            if self.skip("->"):
                if self.at("{", "throw"):
                    body = self.statements()
                else:
                    begin, inner = self.place(), self.expression()
                    self.take(";")
                    body = [self.node("EXPRESSION_STATEMENT", begin, [inner])]
            else:
                self.take(":")
                body = []
                while not self.at("case", "default", "}"):
                    body += self.statements()
            out.append(self.node("CASE", start, [*labels, *body]))
        self.take("}")
        return out

    def label(self) -> Node:
        def pattern() -> Node:
            start, modifiers, type_ = self.place(), self.modifiers(), self.type()
            at, name = self.place(), self.ident()
            if not self.at("->", ":", ",", "when"):
                raise Broken("no pattern")
            return self.node("VARIABLE", start, [modifiers, type_], name, at, role="LOCAL_VARIABLE", modifiers=modifiers, type=type_)

        return self.attempt(pattern) or self.ternary()

    def _switch(self, start):
        return self.node("SWITCH", start, [self.condition(), *self.cases()])

    def _try(self, start):
        kids = []
        if self.skip("("):
            while not self.at(")"):
                found = self.attempt(self.local)
                kids += found if found else [self.expression()]
                if not self.skip(";"):
                    break
            self.take(")")
        kids.append(self.block())
        while self.at("catch"):
            begin = self.place()
            self.take()
            self.take("(")
            at0, modifiers, type_ = self.place(), self.modifiers(), self.type()
            if self.at("|"):
                some = [type_]
                while self.skip("|"):
                    some.append(self.type())
                type_ = self.node("UNION_TYPE", type_.start, some)
            at, name = self.place(), self.ident()
            var = self.node("VARIABLE", at0, [modifiers, type_], name, at, role="EXCEPTION_PARAMETER", modifiers=modifiers, type=type_)
            self.take(")")
            kids.append(self.node("CATCH", begin, [var, self.block()]))
        if self.skip("finally"):
            kids.append(self.block())
        return self.node("TRY", start, kids)

    def _return(self, start):
        kids = [] if self.at(";") else [self.expression()]
        self.take(";")
        return self.node("RETURN", start, kids)

    def _throw(self, start):
        inner = self.expression()
        self.take(";")
        return self.node("THROW", start, [inner])

    def _yield(self, start):
        inner = self.expression()
        self.take(";")
        return self.node("YIELD", start, [inner])

    def _break(self, start, kind="BREAK"):
        name = "" if self.at(";") else self.ident()
        self.take(";")
        return self.node(kind, start, name=name)

    def _continue(self, start):
        return self._break(start, "CONTINUE")

    def _synchronized(self, start):
        return self.node("SYNCHRONIZED", start, [self.condition(), self.block()])

    def _assert(self, start):
        kids = [self.expression()]
        if self.skip(":"):
            kids.append(self.expression())
        self.take(";")
        return self.node("ASSERT", start, kids)

    # expressions

    def expression(self) -> Node:
        found = self.lambda_()
        if found is not None:
            return found
        start, left = self.place(), self.ternary()
        op, n = self.operator()
        if op in _ASSIGN:
            self.i += n
            return self.node(_ASSIGN[op], start, [left, self.expression()])
        return left

    def operator(self) -> tuple[str, int]:
        """The operator here and its tokens; ``>`` comes one by one, as type arguments need it."""
        if self.kind() not in ("mark", "name") or self.kind() == "name" and self.text() != "instanceof":
            return "", 0
        if not self.at(">"):
            return self.text(), 1
        out, n = ">", 1
        while n < 4 and self.i + n < len(self.t) and self.t[self.i + n].start == self.t[self.i + n - 1].end and self.text(n) in (">", "=", "=="):
            if self.text(n) == "==":
                break
            out += self.text(n)
            n += 1
            if out[-1] == "=":
                break
        return out, n

    def lambda_(self) -> Node | None:
        start = self.place()
        if self.kind() == "name" and self.text(1) == "->" and self.text() not in _RESERVED:
            at = self.place()
            args = [self.node("VARIABLE", at, name=self.take(), at=at, role="PARAMETER", modifiers=None, type=None)]
        elif self.at("(") and self.arrow():
            args = self.attempt(self.parameters)
            if args is None:
                self.take("(")
                args = []
                while not self.at(")"):
                    at = self.place()
                    args.append(self.node("VARIABLE", at, name=self.ident(), at=at, role="PARAMETER", modifiers=None, type=None))
                    if not self.skip(","):
                        break
                self.take(")")
        else:
            return None
        self.take("->")
        body = self.block() if self.at("{") else self.expression()
        return self.node("LAMBDA_EXPRESSION", start, [*args, body], args=args, body=body)

    def arrow(self) -> bool:
        """Whether the parenthesis here closes before an arrow."""
        depth, i = 0, self.i
        while i < len(self.t):
            depth += (self.t[i].text == "(") - (self.t[i].text == ")")
            i += 1
            if not depth:
                return i < len(self.t) and self.t[i].text == "->"
        return False

    def ternary(self) -> Node:
        start, cond = self.place(), self.binary(0)
        if not self.skip("?"):
            return cond
        yes = self.expression()
        self.take(":")
        no = self.lambda_() or self.ternary()
        return self.node("CONDITIONAL_EXPRESSION", start, [cond, yes, no])

    def binary(self, level: int) -> Node:
        """Operators of a level and those that bind more strongly, each with what stands on its left so far."""
        start, left, most = self.place(), self.unary(), len(_BINARY)
        while True:
            op, n = self.operator()
            here = _LEVEL.get(op, -1)
            if not level <= here <= most:
                return left
            self.i, most = self.i + n, here
            if op == "instanceof":
                left = self.node("INSTANCE_OF", start, [left, self.tested()])
            else:
                left = self.node(_BINARY[here][op], start, [left, self.binary(here + 1)])

    def tested(self) -> Node:
        start, modifiers, type_ = self.place(), self.modifiers(), self.type()
        if self.kind() == "name" and self.text() not in _RESERVED:
            at = self.place()
            return self.node("VARIABLE", start, [modifiers, type_], self.take(), at, role="LOCAL_VARIABLE", modifiers=modifiers, type=type_)
        return type_

    def unary(self) -> Node:
        start = self.place()
        if self.kind() == "mark" and self.text() in _PREFIX:
            kind = _PREFIX[self.take()]
            return self.node(kind, start, [self.unary()])
        if self.at("("):
            cast = self.attempt(self.cast)
            if cast is not None:
                return cast
        out = self.postfix(self.primary(), start)
        while self.at("++", "--"):
            out = self.node("POSTFIX_INCREMENT" if self.take() == "++" else "POSTFIX_DECREMENT", start, [out])
        return out

    def cast(self) -> Node:
        start = self.place()
        self.take("(")
        type_, more = self.type(), []
        while self.skip("&"):
            more.append(self.type())
        self.take(")")
        plain = type_.kind == "PRIMITIVE_TYPE"
        if not plain and not (self.kind() in ("string", "number") or self.at("(", "!", "~") or self.kind() == "name" and self.text() not in ("instanceof",)):
            raise Broken("no cast")
        inner = self.lambda_() or self.unary()
        return self.node("TYPE_CAST", start, [type_, *more, inner], type=type_)

    def arguments(self) -> list[Node]:
        self.take("(")
        out = []
        while not self.at(")"):
            out.append(self.expression())
            if not self.skip(","):
                break
        self.take(")")
        return out

    def primary(self) -> Node:
        start, kind, word = self.place(), self.kind(), self.text()
        if kind == "number":
            self.take()
            real = not word.lower().startswith("0x") and re.search(r"[.eEfFdD]", word)
            name = ("FLOAT_LITERAL" if word[-1] in "fF" else "DOUBLE_LITERAL") if real else "LONG_LITERAL" if word[-1] in "lL" else "INT_LITERAL"
            return self.node(name, start, name=word)
        if kind == "string":
            self.take()
            return self.node("CHAR_LITERAL" if word[0] == "'" else "STRING_LITERAL", start, name=word)
        if word in ("true", "false", "null"):
            self.take()
            return self.node("NULL_LITERAL" if word == "null" else "BOOLEAN_LITERAL", start, name=word)
        if word == "(":
            self.take()
            inner = self.expression()
            self.take(")")
            return self.node("PARENTHESIZED", start, [inner])
        if word == "new":
            return self.new(None, start)
        if word == "switch":
            self.take()
            return self.node("SWITCH_EXPRESSION", start, [self.condition(), *self.cases()])
        if word in PRIMITIVE or kind == "name" and self.text(1) in ("[", "<", "."):
            ref = self.attempt(self.class_literal) or (self.attempt(self.typed_reference) if word in PRIMITIVE or self.text(1) in ("[", "<") else None)
            if ref is not None:
                return ref
        if word in ("this", "super") or kind == "name" and word not in _RESERVED:
            self.take()
            out = self.node("IDENTIFIER", start, name=word, at=start)
            if self.at("("):
                return self.call(out, start)
            return out
        raise Broken("expected an expression")

    def class_literal(self) -> Node:
        start, type_ = self.place(), self.type(params=False)
        self.take(".")
        at = self.place()
        self.take("class")
        return self.node("MEMBER_SELECT", start, [type_], "class", at)

    def typed_reference(self) -> Node:
        start, type_ = self.place(), self.type()
        if not self.at("::") or type_.kind in ("IDENTIFIER", "MEMBER_SELECT"):
            raise Broken("no reference")
        return self.reference(type_, start)

    def reference(self, target: Node, start: int) -> Node:
        self.take("::")
        if self.at("<"):
            self.type_arguments()
        at = self.place()
        return self.node("MEMBER_REFERENCE", start, [target], self.take() if self.at("new") else self.ident(), at)

    def call(self, target: Node, start: int, types=()) -> Node:
        args = self.arguments()
        return self.node("METHOD_INVOCATION", start, [*types, target, *args], target.name, target.at, target=target, args=args)

    def new(self, outer: Node | None, start: int) -> Node:
        self.take("new")
        self.annotations()
        begin = self.place()
        if self.text() in PRIMITIVE:
            type_ = self.node("PRIMITIVE_TYPE", begin, name=self.take())
            type_.end = self.past()
        else:
            type_ = self.named(begin)
            if self.at("<"):
                type_ = self.node("PARAMETERIZED_TYPE", begin, [type_, *self.type_arguments()])
        if self.at("["):
            kids = [type_]
            while self.at("["):
                self.take()
                if not self.at("]"):
                    kids.append(self.expression())
                self.take("]")
            if self.at("{"):
                kids += self.initializer().kids
            return self.node("NEW_ARRAY", start, kids, type=type_)
        args = self.arguments()
        body = self.anonymous() if self.at("{") else None
        return self.node("NEW_CLASS", start, [outer, type_, *args, body], at=type_.start, type=type_, args=args, body=body)

    def postfix(self, out: Node, start: int) -> Node:
        while True:
            if self.at("."):
                self.take()
                if self.at("new"):
                    out = self.new(out, start)
                    continue
                types = self.type_arguments() if self.at("<") else []
                at, name = self.place(), self.take()
                if not re.match(r"[^\W\d]|\$", name):
                    raise Broken("expected a name")
                out = self.node("MEMBER_SELECT", start, [out], name, at)
                if self.at("("):
                    out = self.call(out, start, types)
            elif self.at("["):
                self.take()
                inner = self.expression()
                self.take("]")
                out = self.node("ARRAY_ACCESS", start, [out, inner])
            elif self.at("::"):
                out = self.reference(out, start)
            else:
                return out


_RESERVED = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends false final finally float for goto if implements import instanceof int interface long native new null package private protected public return short static strictfp super switch synchronized this throw throws transient true try void volatile while".split())
_STATEMENT = frozenset([*_ASSIGN.values(), "METHOD_INVOCATION", "NEW_CLASS", "PREFIX_INCREMENT", "PREFIX_DECREMENT", "POSTFIX_INCREMENT", "POSTFIX_DECREMENT"])


def _dotted(n: Node | None) -> str:
    """The name that a chain of names spells; nothing for other trees."""
    if n is None:
        return ""
    if n.kind == "IDENTIFIER":
        return n.name
    if n.kind == "MEMBER_SELECT" and n.kids and n.kids[0].kind in ("IDENTIFIER", "MEMBER_SELECT"):
        left = _dotted(n.kids[0])
        return f"{left}.{n.name}" if left else ""
    return ""


dotted = _dotted


def parse(code: str) -> Node:
    """The tree of a source."""
    return Parser(code).file()


def fragment(code: str) -> list[Node]:
    """The trees of a pattern: one expression, or statements, or members of a class. Broken if it is none of them."""
    first: Broken | None = None
    for read in (lambda p: [p.expression()], _all_statements, _all_members):
        p = Parser(code)
        if not p.t:
            raise Broken("nothing to read")
        try:
            out = read(p)
            if p.i == len(p.t) and not p.problems:
                return out
            raise Broken(f"not understood from {code[p.place():][:20]!r}" if p.i < len(p.t) else p.problems[0][1])
        except Broken as e:
            first = first or e
    raise first


def _all_statements(p: Parser) -> list[Node]:
    out = []
    while p.i < len(p.t):
        out += p.statements()
    return out


def _all_members(p: Parser) -> list[Node]:
    out = []
    while p.i < len(p.t):
        out += p.member("")
    return out
