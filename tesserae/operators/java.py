"""Symbols of Java sources: declarations, signatures, types of expressions, usages, overridden methods.

One file is attributed at a time, from its own declarations, imports and the names of
a library; what lies in other files is named, and found by joins (:func:`usages`,
:func:`overrides`). Broken code does not fail; what is not understood has no symbol.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache, partial, reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.signatures import PRIMITIVE
from tesserae.operators import lookup, syntax
from tesserae.operators.rounds import checkpointed
from tesserae.operators.syntax import MODIFIERS, Node, Token, dotted, tokens
from tesserae.sources.shipping import ship

__all__ = ["MODIFIERS", "Token", "tokens"]
KINDS = ("CLASS", "INTERFACE", "ENUM", "ANNOTATION_TYPE", "RECORD")
#: Names of java.lang that need no import (fixed values).
_LANG = ("Appendable", "AutoCloseable", "Boolean", "Byte", "CharSequence", "Character", "Class", "ClassLoader", "Cloneable", "Comparable", "Deprecated", "Double", "Enum", "Error", "Exception", "Float", "FunctionalInterface", "IllegalArgumentException", "IllegalStateException", "IndexOutOfBoundsException", "Integer", "InterruptedException", "Iterable", "Long", "Math", "NullPointerException", "Number", "Object", "Override", "Process", "Readable", "Record", "Runnable", "RuntimeException", "SafeVarargs", "Short", "String", "StringBuffer", "StringBuilder", "SuppressWarnings", "System", "Thread", "Throwable", "UnsupportedOperationException", "Void")

#: The part of the Java library that is known by itself, as declarations (fixed values). Others can be given as files.
LIBRARY = {
    "java/lang": """package java.lang;
public class Object { public Object() {} public String toString(); public boolean equals(Object o); public int hashCode(); public final Class<?> getClass(); protected Object clone(); public final void notify(); public final void wait(); protected void finalize(); }
public interface CharSequence { int length(); char charAt(int i); CharSequence subSequence(int a, int b); boolean isEmpty(); }
public interface Comparable<T> { int compareTo(T o); }
public interface Runnable { void run(); }
public interface AutoCloseable { void close(); }
public interface Iterable<T> { java.util.Iterator<T> iterator(); }
public abstract class Enum<E> implements Comparable<E> { public final String name(); public final int ordinal(); }
public abstract class Record { }
public abstract class Number { public int intValue(); public long longValue(); public double doubleValue(); }
public final class Integer extends Number implements Comparable<Integer> { public static Integer valueOf(int i); public static int parseInt(String s); public static String toString(int i); }
public final class Long extends Number implements Comparable<Long> { public static Long valueOf(long i); public static long parseLong(String s); }
public final class Double extends Number implements Comparable<Double> { public static Double valueOf(double d); }
public final class Boolean implements Comparable<Boolean> { public static Boolean valueOf(boolean b); public boolean booleanValue(); }
public final class Character implements Comparable<Character> { public static char toLowerCase(char c); public static char toUpperCase(char c); public static int toLowerCase(int c); public static int toUpperCase(int c); public static boolean isDigit(char c); }
public final class String implements CharSequence, Comparable<String> { public String() {} public String(String s) {} public int length(); public boolean isEmpty(); public char charAt(int i); public String substring(int a); public String substring(int a, int b); public boolean equals(Object o); public boolean equalsIgnoreCase(String s); public boolean startsWith(String s); public boolean endsWith(String s); public boolean contains(CharSequence s); public int indexOf(String s); public String trim(); public String toLowerCase(); public String toUpperCase(); public String concat(String s); public String replace(CharSequence a, CharSequence b); public String[] split(String s); public String toString(); public int hashCode(); public int compareTo(String s); public static String valueOf(Object o); public static String format(String f, Object... a); }
public class StringBuilder implements CharSequence { public StringBuilder() {} public StringBuilder append(String s); public StringBuilder append(int i); public String toString(); public int length(); }
public final class Math { public static int max(int a, int b); public static int min(int a, int b); public static int abs(int a); }
public final class System { public static final java.io.PrintStream out; public static final java.io.PrintStream err; public static long currentTimeMillis(); public static void exit(int c); public static String getProperty(String k); }
public class Thread implements Runnable { public Thread() {} public Thread(Runnable r) {} public void start(); public void run(); public static Thread currentThread(); }
public class Throwable { public Throwable() {} public Throwable(String m) {} public String getMessage(); public void printStackTrace(); }
public class Exception extends Throwable { public Exception() {} public Exception(String m) {} }
public class Error extends Throwable { public Error() {} }
public class RuntimeException extends Exception { public RuntimeException() {} public RuntimeException(String m) {} }
public class IllegalArgumentException extends RuntimeException { public IllegalArgumentException() {} public IllegalArgumentException(String m) {} }
public class IllegalStateException extends RuntimeException { public IllegalStateException() {} public IllegalStateException(String m) {} }
""",
    "java/util": """package java.util;
public interface Iterator<E> { boolean hasNext(); E next(); void remove(); }
public interface Collection<E> extends Iterable<E> { int size(); boolean isEmpty(); boolean add(E e); boolean contains(Object o); boolean remove(Object o); void clear(); Iterator<E> iterator(); }
public interface List<E> extends Collection<E> { E get(int i); E set(int i, E e); int indexOf(Object o); }
public interface Set<E> extends Collection<E> { }
public interface Map<K, V> { V get(Object k); V put(K k, V v); boolean containsKey(Object k); int size(); boolean isEmpty(); Set<K> keySet(); Collection<V> values(); }
public class ArrayList<E> implements List<E> { public ArrayList() {} public ArrayList(int n) {} public int size(); public boolean isEmpty(); public E get(int i); public boolean add(E e); }
public class LinkedList<E> implements List<E> { public LinkedList() {} }
public class HashSet<E> implements Set<E> { public HashSet() {} }
public class HashMap<K, V> implements Map<K, V> { public HashMap() {} }
""",
    "java/io": """package java.io;
public interface Serializable { }
public interface Closeable extends AutoCloseable { }
public class PrintStream implements Closeable { public void println(); public void println(String s); public void println(Object o); public void println(int i); public void print(String s); public void close(); }
public class File implements Serializable, Comparable<File> { public File(String p) {} public File(File d, String p) {} public boolean isDirectory(); public boolean isFile(); public boolean exists(); public long length(); public boolean delete(); public String getName(); public String getPath(); public File getParentFile(); public File[] listFiles(); public int compareTo(File f); }
public class IOException extends Exception { public IOException() {} public IOException(String m) {} }
""",
}


@dataclass
class Declaration:
    kind: str
    owner: str
    name: str
    modifiers: list[str]
    position: int
    signature: str = ""
    descriptor: str = ""
    supertypes: list[str] = field(default_factory=list)
    params: list[str] = field(default_factory=list)
    result: str = ""
    span: tuple[int, int, int, int] = (-1, -1, -1, -1)
    node: Node | None = None


class Unit:
    """One file and its symbols. ``known``: names of types that other files and the library have."""

    def __init__(self, code: str, known: frozenset[str] = frozenset()):
        self.parser = syntax.Parser(code)
        self.tree = self.parser.file()
        self.code, self.known = code, known
        self.package, self.imports = self.tree.part["package"], {}
        self.wide, self.static, self.static_wide = [], {}, []
        for static, name in self.tree.part["imports"]:
            owner, _, last = name.rpartition(".")
            if last == "*":
                (self.static_wide if static else self.wide).append(owner)
            elif static:
                self.static[last] = owner
            else:
                self.imports[last] = name
        self.found: list[Declaration] = []
        self.types: dict[str, Node] = {}  # by binary name
        self.name_of: dict[Node, str] = {}
        self.outer: dict[str, str] = {}
        self.bounds: dict[str, dict[str, tuple]] = {}  # type parameters by type
        for n in self.tree.kids:
            if n.kind in KINDS:
                self._name(n, "", self.package)
        for n in self.tree.kids:
            if n.kind in KINDS:
                self._declare(n, self.package)
        self.members: dict[str, list[Declaration]] = {}
        for d in self.found:
            self.members.setdefault(d.owner, []).append(d)

    # names

    def _name(self, n: Node, outer: str, package: str) -> None:
        binary = f"{outer}${n.name}" if outer else f"{package}.{n.name}" if package else n.name
        self.types.setdefault(binary, n)
        self.name_of[n], self.outer[binary] = binary, outer
        for m in n.part["members"]:
            if m.kind in KINDS:
                self._name(m, binary, package)
        self._local(n, binary, package)

    def _local(self, n: Node, binary: str, package: str) -> None:
        """Anonymous and local classes are numbered in the order in which they stand."""
        count = 0
        stack = [m for m in n.part["members"] if m.kind not in KINDS][::-1]
        if n.part.get("anonymous"):
            stack = n.part["members"][::-1]
        while stack:
            m = stack.pop()
            if m.kind in KINDS:
                count += 1
                inner = f"{binary}${count}{m.name}"
                self.types[inner], self.name_of[m], self.outer[inner] = m, inner, binary
                for k in m.part["members"]:
                    if k.kind in KINDS:
                        self._name(k, inner, package)
                self._local(m, inner, package)
            else:
                stack += m.kids[::-1]

    def resolve(self, name: str, inside: str = "") -> str:
        """The binary name of a type, seen from inside a type of this file."""
        first, _, rest = name.partition(".")
        at = inside
        while at:
            if f"{at}${first}" in self.types:
                return f"{at}${first}" + (f"${rest.replace('.', '$')}" if rest else "")
            if self.types[at].name == first:
                return at + (f"${rest.replace('.', '$')}" if rest else "")
            at = self.outer.get(at, "")
        full = ""
        if first in self.imports:
            full = self.imports[first]
        elif (own := f"{self.package}.{first}" if self.package else first) in self.types:
            full = own
        elif rest and first[:1].islower():
            return _binary(name)
        elif first in _LANG:
            full = "java.lang." + first
        else:
            some = [f"{w}.{first}" for w in self.wide if f"{w}.{first}" in self.known]
            full = some[0] if some and own not in self.known else own
        return _binary(full) + (f"${rest.replace('.', '$')}" if rest else "")

    # types

    def read(self, n: Node | None) -> tuple:
        """(name, arguments, dimensions) of a type tree."""
        if n is None:
            return ("Object", [], 0)
        if n.kind == "ARRAY_TYPE":
            base, args, dims = self.read(n.kids[0])
            return (base, args, dims + 1)
        if n.kind == "PARAMETERIZED_TYPE":
            return (self.read(n.kids[0])[0], [self.read(k) for k in n.kids[1:]], 0)
        if n.kind == "UNION_TYPE":
            return ("Throwable", [], 0)
        if n.kind in ("EXTENDS_WILDCARD", "SUPER_WILDCARD"):
            return ("+" if n.kind[0] == "E" else "-", [self.read(n.kids[0])], 0)
        if n.kind == "UNBOUNDED_WILDCARD":
            return ("*", [], 0)
        if n.kind == "MEMBER_SELECT" and n.kids[0].kind == "PARAMETERIZED_TYPE":
            return (f"{self.read(n.kids[0])[0]}.{n.name}", [], 0)
        return (n.name if n.kind == "PRIMITIVE_TYPE" else dotted(n), [], 0)

    def encode(self, t: tuple, scope: dict, inside: str) -> str:
        name, args, dims = t
        if name in ("+", "-") and args:
            return name + self.encode(args[0], scope, inside)
        if name == "*":
            return "*"
        if name in PRIMITIVE:
            return "[" * dims + PRIMITIVE[name]
        if name in scope:
            return "[" * dims + f"T{name};"
        inner = f"<{''.join(self.encode(a, scope, inside) for a in args)}>" if args else ""
        return "[" * dims + "L" + self.resolve(name, inside).replace(".", "/") + inner + ";"

    def erase(self, t: tuple, scope: dict, inside: str) -> str:
        """The erased type: a primitive or a binary name, with [] for each dimension."""
        name, _, dims = t
        seen = set()
        while name in scope and name not in seen:
            seen.add(name)
            name = scope[name][0]
        if name in PRIMITIVE:
            return name + "[]" * dims
        return ("java.lang.Object" if name in seen or name in ("*", "-") else self.resolve(name, inside)) + "[]" * dims

    # declarations

    def _scope(self, params: list[Node], outer: dict) -> dict:
        return {**outer, **{p.name: (self.read(p.kids[0]) if p.kids else ("Object", [], 0)) for p in params}}

    def _declare(self, n: Node, owner: str) -> None:
        binary = self.name_of[n]
        scope = self._scope(n.part["params"], self.bounds.get(self.outer.get(binary, ""), {}))
        self.bounds[binary] = scope
        above = [self.erase(self.read(a), {}, binary) for a in n.part["above"]]
        mods = n.part["modifiers"].part["names"]
        self.found.append(Declaration(n.kind, owner, binary, mods, n.at, supertypes=above, span=(n.start, n.end, n.at, n.at + len(n.name)), node=n))
        for m in n.part["members"]:
            if m.kind in KINDS:
                self._declare(m, binary)
            elif m.kind == "VARIABLE":
                self._field(m, n, binary, scope)
            elif m.kind == "METHOD":
                self._method(m, binary, scope)

    def _field(self, m: Node, n: Node, binary: str, scope: dict) -> None:
        span = (m.start, m.end, m.at, m.at + len(m.name))
        if m.part["role"] == "ENUM_CONSTANT":
            self.found.append(Declaration("ENUM_CONSTANT", binary, m.name, ["PUBLIC", "STATIC", "FINAL"], m.at, "L" + binary.replace(".", "/") + ";", result=binary, span=span, node=m))
            return
        t = self.read(m.part["type"])
        mods = m.part["modifiers"].part["names"] if n.kind != "RECORD" or m.part["role"] != "PARAMETER" else ["PRIVATE", "FINAL"]
        self.found.append(Declaration("FIELD", binary, m.name, mods, m.at, self.encode(t, scope, binary), result=self.erase(t, scope, binary), span=span, node=m))

    def _method(self, m: Node, binary: str, outer: dict) -> None:
        scope = self._scope(m.part["params"], outer)
        args = [self.read(a.part["type"]) for a in m.part["args"] if a.kind == "VARIABLE"]
        if m.part["compact"]:
            args = [self.read(a.part["type"]) for a in self.types[binary].part["members"] if a.kind == "VARIABLE" and a.part["role"] == "PARAMETER"]
        back = ("void", [], 0) if m.part["returned"] is None else self.read(m.part["returned"])
        head = "".join(f"{p.name}:" + ":".join(self.encode(self.read(b), scope, binary) for b in (p.kids or [None])) for p in m.part["params"])
        sig = (f"<{head}>" if head else "") + "(" + "".join(self.encode(a, scope, binary) for a in args) + ")" + self.encode(back, scope, binary)
        sig += "".join("^" + self.encode(self.read(x), scope, binary) for x in m.part["thrown"]) + ";"
        plain, result = [self.erase(a, scope, binary) for a in args], self.erase(back, scope, binary)
        kind = "CONSTRUCTOR" if m.name == "<init>" else "METHOD"
        width = len(self.types[binary].name) if kind == "CONSTRUCTOR" else len(m.name)
        self.found.append(Declaration(kind, binary, m.name, m.part["modifiers"].part["names"], m.at, sig, descriptor(plain, result), params=plain, result=result, span=(m.start, m.end, m.at, m.at + width), node=m))


@lru_cache(maxsize=1 << 14)
def _binary(name: str) -> str:
    """a.b.C.D as a.b.C$D: what follows the first capitalised part is nested in it."""
    parts = name.split(".")
    top = next((i for i, p in enumerate(parts) if p[:1].isupper()), len(parts) - 1)
    return ".".join(parts[: top + 1]) + "".join("$" + p for p in parts[top + 1 :])


def canonical(name: str) -> str:
    return name.replace("$", ".")


def vm(erased: str) -> str:
    """The descriptor of an erased type."""
    base = erased.rstrip("[]")
    return "[" * erased.count("[]") + (PRIMITIVE.get(base) or "L" + base.replace(".", "/") + ";")


def descriptor(params: list[str], result: str) -> str:
    return "(" + "".join(map(vm, params)) + ")" + vm(result)


def declarations(code: str, known: frozenset[str] = frozenset()) -> list[Declaration]:
    """Types, methods, constructors, fields and enum constants of a source, in order."""
    return Unit(code, known).found


def serialized(d: Declaration) -> str:
    """kind:owner:name[:descriptor] of a declaration; types are kind:name."""
    if d.kind in KINDS:
        return f"{d.kind}:{d.name}"
    if d.kind in ("FIELD", "ENUM_CONSTANT"):
        return f"{d.kind}:{d.owner}:{d.name}"
    return f"{d.kind}:{d.owner}:{d.name}:{d.descriptor}"


@cache
def library() -> dict[str, list[Declaration]]:
    """The declarations of the known library, by owner; types are in their own list."""
    out: dict[str, list[Declaration]] = {}
    for code in LIBRARY.values():
        for d in declarations(code, library_names()):
            out.setdefault(d.name if d.kind in KINDS else d.owner, []).append(d)
    return out


@cache
def library_names() -> frozenset[str]:
    out = set()
    for code in LIBRARY.values():
        tree = syntax.parse(code)
        out |= {f"{tree.part['package']}.{n.name}" for n in tree.kids if n.kind in KINDS}
    return frozenset(out)


# scopes and types of expressions within one file


@dataclass
class Symbol:
    """What a name stands for: a variable with its role and type, or a declaration, or a type or package."""

    role: str
    name: str
    type: str | None = None
    declaration: Declaration | None = None
    node: Node | None = None


_TYPE_TREES = ("PRIMITIVE_TYPE", "ARRAY_TYPE", "PARAMETERIZED_TYPE", "UNION_TYPE", "EXTENDS_WILDCARD", "SUPER_WILDCARD", "UNBOUNDED_WILDCARD", "TYPE_PARAMETER")


#: A member that only other files can tell: the type it is looked for in, its name, and its arguments' types (None for a field).
@dataclass(frozen=True)
class Step:
    name: str
    args: tuple | None


class Attribution:
    """Symbols of the names in a file, and types of its expressions as far as this file and the library tell.

    ``symbol`` has a Symbol for each identifier, selection, call and creation that is
    understood; ``path`` has (type, steps) for those that hang on other files.
    """

    def __init__(self, code: str, known: frozenset[str] = frozenset()):
        self.unit = Unit(code, known | library_names())
        self.symbol: dict[Node, Symbol] = {}
        self.path: dict[Node, tuple[str, tuple[Step, ...]]] = {}
        self.type: dict[Node, str | None] = {}
        self.inside: dict[Node, str] = {}
        for n in self.unit.tree.kids:
            if n.kind in KINDS:
                self._class(n, [])
            elif n.kind in ("PACKAGE", "IMPORT"):
                self._imported(n)

    def _imported(self, n: Node) -> None:
        """Names of the package clause and of imports."""
        name = n.kids[0]
        if n.kind == "IMPORT" and (name.name == "*" or n.part["static"]):
            name = name.kids[0]
        parts = dotted(name).split(".")
        top = len(parts) if n.kind == "PACKAGE" else next((i for i, p in enumerate(parts) if p[:1].isupper()), len(parts))
        for i in range(len(parts) - 1, -1, -1):
            full = ".".join(parts[: i + 1])
            self.symbol[name] = Symbol("TYPE", _binary(full)) if i >= top else Symbol("PACKAGE", full)
            name = name.kids[0] if name.kids else name

    # the hierarchy that is at hand

    def members(self, owner: str) -> list[Declaration]:
        return [d for d in self.unit.members.get(owner, []) if d.kind not in KINDS] or [d for d in library().get(owner, []) if d.kind not in KINDS]

    def above(self, owner: str) -> list[str]:
        """Direct supertypes; java.lang.Object for a class without any."""
        n = self.unit.types.get(owner)
        if n is not None:
            some = next((d.supertypes for d in self.unit.found if d.kind in KINDS and d.name == owner), None)
            if some is None:
                some = [self.unit.erase(self.unit.read(a), {}, owner) for a in n.part["above"]]
            return some if n.kind == "CLASS" and some and self._is_class(some[0]) else ["java.lang.Object", *some]
        for d in library().get(owner, []):
            if d.kind in KINDS:
                return d.supertypes if d.supertypes and self._is_class(d.supertypes[0]) else [*(["java.lang.Object"] if owner != "java.lang.Object" else []), *d.supertypes]
        return []

    def _is_class(self, name: str) -> bool:
        if name in self.unit.types:
            return self.unit.types[name].kind == "CLASS"
        return all(d.kind == "CLASS" for d in library().get(name, []) if d.kind in KINDS)

    def lineage(self, owner: str) -> list[str]:
        """The type and all its supertypes that are at hand, nearest first."""
        out, todo = [], [owner]
        while todo:
            at = todo.pop(0)
            if at not in out:
                out.append(at)
                todo += self.above(at)
        return out

    def complete(self, owner: str) -> bool:
        """Whether all supertypes are at hand."""
        return all(t in self.unit.types or t in library() for t in self.lineage(owner))

    def member(self, owner: str, name: str, args: tuple | None) -> Declaration | None:
        for t in self.lineage(owner):
            some = [d for d in self.members(t) if d.name == name and (d.kind in ("FIELD", "ENUM_CONSTANT") if args is None else d.kind in ("METHOD", "CONSTRUCTOR") and (len(d.params) == len(args) or d.params and d.params[-1].endswith("[]") and len(args) >= len(d.params) - 1))]
            if some:
                return max(some, key=lambda d: fit(d.params, args or ()))
            if name == "<init>":
                break
        return None

    # scopes

    def _class(self, n: Node, env: list[dict]) -> None:
        if n not in self.unit.name_of:
            return
        binary = self.unit.name_of[n]
        if n.part.get("anonymous") or binary not in self.unit.bounds:
            self.unit.bounds.setdefault(binary, self.unit._scope(n.part["params"], self.unit.bounds.get(self.unit.outer.get(binary, ""), {})))
            if binary not in self.unit.members:
                held = self.unit.found
                self.unit.found = []
                for m in n.part["members"]:
                    if m.kind == "VARIABLE":
                        self.unit._field(m, n, binary, self.unit.bounds[binary])
                    elif m.kind == "METHOD":
                        self.unit._method(m, binary, self.unit.bounds[binary])
                self.unit.members[binary], self.unit.found = self.unit.found, held
        for m in n.kids:
            if m.kind in KINDS:
                self._class(m, env)
            elif m in n.part["members"] or m.kind == "MODIFIERS":
                self._visit(m, env, binary)
            else:
                self._types(m, env, binary)

    def _declare(self, v: Node, env: list[dict], binary: str, type_: str | None = None) -> None:
        if type_ is None and v.part.get("type") is not None:
            t = self.unit.read(v.part["type"])
            if t[0] == "var" and v.part.get("init") is not None:
                type_ = self.type.get(v.part["init"])
            else:
                type_ = self.unit.erase(t, self._bounds(env, binary), binary)
        role = v.part.get("role", "LOCAL_VARIABLE")
        env[-1][v.name] = Symbol(role, v.name, type_, node=v)
        self.symbol[v] = env[-1][v.name]

    def _bounds(self, env: list[dict], binary: str) -> dict:
        out = dict(self.unit.bounds.get(binary, {}))
        for e in env:
            out.update(e.get("<>", {}))
        return out

    def _types(self, n: Node, env: list[dict], binary: str) -> None:
        """Names in the place of a type."""
        self.inside[n] = binary
        if n.kind in ("IDENTIFIER", "MEMBER_SELECT") and (name := dotted(n)):
            if name != "var" and not name.startswith("$") and name not in self._bounds(env, binary):
                self._chain(n, name, binary)
        elif n.kind == "MEMBER_SELECT":
            self._types(n.kids[0], env, binary)
        else:
            for k in n.kids:
                (self._visit if k.kind == "ANNOTATION" else self._types)(k, env, binary)

    def _chain(self, n: Node, name: str, binary: str) -> None:
        """a.b.C.D: packages up to the first capitalised part, types from there on."""
        parts = name.split(".")
        top = next((i for i, p in enumerate(parts) if p[:1].isupper()), len(parts) - 1)
        for i in range(len(parts) - 1, -1, -1):
            self.inside[n] = binary
            part = ".".join(parts[: i + 1])
            self.symbol[n] = Symbol("TYPE", self.unit.resolve(part, binary)) if i >= top else Symbol("PACKAGE", part)
            n = n.kids[0] if n.kids else n

    def _visit(self, n: Node, env: list[dict], binary: str) -> None:
        self.inside[n] = binary
        kind = n.kind
        if kind in KINDS:
            self._class(n, env)
        elif kind == "METHOD":
            inner = [*env, {"<>": self.unit._scope(n.part["params"], {})}]
            for a in n.part["args"]:
                if a.kind == "VARIABLE":
                    self._declare(a, inner, binary)
            named = [n.part["returned"], *n.part["params"], *n.part["thrown"]]
            for k in n.kids:
                (self._types if k in named else self._visit)(k, inner, binary)
        elif kind == "VARIABLE":
            if n.part.get("field") or n.part.get("role") == "ENUM_CONSTANT":
                d = next((d for d in self.unit.members.get(binary, []) if d.node is n), None)
                self.symbol[n] = Symbol(n.part["role"], n.name, d.result if d else None, d, n)
                for k in n.kids:
                    (self._types if k is n.part["type"] else self._visit)(k, env, binary)
            else:
                for k in n.kids:
                    (self._types if k is n.part["type"] else self._visit)(k, env, binary)
                self._declare(n, env, binary, env[-1][n.name].type if n.name in env[-1] and env[-1][n.name].node is n else None)
        elif kind in ("BLOCK", "FOR_LOOP", "CATCH", "CASE", "TRY", "SWITCH"):
            inner = [*env, {}]
            for k in n.kids:
                self._visit(k, inner, binary)
        elif kind == "ENHANCED_FOR_LOOP":
            inner, (var, source, body) = [*env, {}], n.kids
            self._visit(source, inner, binary)
            t = self.type.get(source)
            self._visit(var, inner, binary)
            if self.symbol[var].type is None or self.unit.read(var.part["type"])[0] == "var":
                self._declare(var, inner, binary, t[:-2] if t and t.endswith("[]") else None)
            self._visit(body, inner, binary)
        elif kind == "LAMBDA_EXPRESSION":
            inner = [*env, {}]
            for a in n.part["args"]:
                if a.kind == "VARIABLE":
                    self._declare(a, inner, binary)
            for k in n.kids:
                if k not in n.part["args"]:
                    self._visit(k, inner, binary)
        elif kind == "IDENTIFIER":
            self._identifier(n, env, binary)
        elif kind == "MEMBER_SELECT":
            self._select(n, env, binary)
        elif kind == "METHOD_INVOCATION":
            self._call(n, env, binary)
        elif kind == "NEW_CLASS":
            self._new(n, env, binary)
        elif kind in _TYPE_TREES:
            self._types(n, env, binary)
        else:
            named = n.kids[:1] if kind in ("TYPE_CAST", "ANNOTATION") or kind == "NEW_ARRAY" and n.part.get("type") is not None else n.kids[1:2] if kind == "INSTANCE_OF" and n.kids[1].kind != "VARIABLE" else []
            for k in n.kids:
                (self._types if k in named else self._visit)(k, env, binary)
            self.type[n] = self._plain(n, binary, env)

    def _plain(self, n: Node, binary: str, env: list[dict]) -> str | None:
        """The type of an expression that is no name, call or creation."""
        kind, of = n.kind, [self.type.get(k) for k in n.kids]
        fixed = {"INT_LITERAL": "int", "LONG_LITERAL": "long", "FLOAT_LITERAL": "float", "DOUBLE_LITERAL": "double", "CHAR_LITERAL": "char", "BOOLEAN_LITERAL": "boolean", "STRING_LITERAL": "java.lang.String", "INSTANCE_OF": "boolean", "LOGICAL_COMPLEMENT": "boolean", "CONDITIONAL_AND": "boolean", "CONDITIONAL_OR": "boolean", "EQUAL_TO": "boolean", "NOT_EQUAL_TO": "boolean", "LESS_THAN": "boolean", "GREATER_THAN": "boolean", "LESS_THAN_EQUAL": "boolean", "GREATER_THAN_EQUAL": "boolean"}
        if kind in fixed:
            return fixed[kind]
        if kind in ("PARENTHESIZED", "POSTFIX_INCREMENT", "POSTFIX_DECREMENT", "PREFIX_INCREMENT", "PREFIX_DECREMENT", "UNARY_MINUS", "UNARY_PLUS", "BITWISE_COMPLEMENT") or kind.endswith("ASSIGNMENT"):
            return of[0] if of else None
        if kind == "TYPE_CAST":
            return self.unit.erase(self.unit.read(n.part["type"]), self._bounds(env, binary), binary)
        if kind == "ARRAY_ACCESS":
            return of[0][:-2] if of[0] and of[0].endswith("[]") else None
        if kind == "NEW_ARRAY" and n.part.get("type") is not None:
            return self.unit.erase(self.unit.read(n.part["type"]), self._bounds(env, binary), binary) + "[]"
        if kind == "CONDITIONAL_EXPRESSION":
            return of[1] or of[2]
        if kind == "PLUS" and "java.lang.String" in of:
            return "java.lang.String"
        if kind in ("PLUS", "MINUS", "MULTIPLY", "DIVIDE", "REMAINDER", "AND", "OR", "XOR") and None not in of and set(of) <= set(PRIMITIVE):
            order = ("boolean", "int", "long", "float", "double")
            return max((t if t in order else "int" for t in of), key=order.index)
        return None

    def _around(self, binary: str) -> Iterator[str]:
        """The type and those that it stands in."""
        while binary:
            yield binary
            binary = self.unit.outer.get(binary, "")

    def _variable(self, name: str, env: list[dict]) -> Symbol | None:
        return next((e[name] for e in reversed(env) if name in e and name != "<>"), None)

    def _identifier(self, n: Node, env: list[dict], binary: str) -> None:
        if n.name in ("this", "super"):
            self.type[n] = binary if n.name == "this" else next((t for t in self.above(binary) if self._is_class(t)), "java.lang.Object")
            return
        found = self._variable(n.name, env)
        if found is not None:
            self.symbol[n], self.type[n] = found, found.type
            return
        at = binary
        while at:
            d = self.member(at, n.name, None)
            if d is not None:
                self._set(n, d)
                return
            at = self.unit.outer.get(at, "")
        if n.name in self.unit.static:
            self._named(n, self.unit.resolve(self.unit.static[n.name]), (Step(n.name, None),))
            return
        if n.name in self._bounds(env, binary):
            return
        if n.name[:1].isupper() or f"{binary}${n.name}" in self.unit.types:
            name = self.unit.resolve(n.name, binary)
            if name not in self.unit.types and name not in library() and n.name.isupper() and len(n.name) > 1 and not self.complete(binary) and n.name not in self.unit.imports:
                self._named(n, binary, (Step(n.name, None),))
                return
            self.symbol[n] = Symbol("TYPE", name)
            return
        if not self.complete(binary):
            self._named(n, binary, (Step(n.name, None),))
            return
        self.symbol[n] = Symbol("PACKAGE", n.name)

    def _set(self, n: Node, d: Declaration) -> None:
        self.symbol[n], self.type[n] = Symbol(d.kind, d.name, d.result, d), d.result

    def _named(self, n: Node, owner: str, steps: tuple[Step, ...]) -> None:
        """A member of a type: at hand, or left to other files."""
        if len(steps) == 1:
            d = self.member(owner, steps[0].name, steps[0].args)
            if d is not None:
                self._set(n, d)
                return
            if steps[0].name == "<init>" and owner in self.unit.types and not steps[0].args:
                self._set(n, Declaration("CONSTRUCTOR", owner, "<init>", [], -1, "()V;", "()V", result="void"))
                return
            if owner in ("", *PRIMITIVE) or owner.endswith("[]") or owner in library() and owner not in self.unit.types:
                return
        self.path[n] = (owner, steps)

    def _select(self, n: Node, env: list[dict], binary: str) -> None:
        left = n.kids[0]
        parts = dotted(left).split(".")
        if n.name[:1].isupper() and all(p[:1].islower() for p in parts) and parts[0] not in ("this", "super") and self._variable(parts[0], env) is None and not any(self.member(t, parts[0], None) for t in self._around(binary)):
            self._chain(n, dotted(n), binary)
            return
        self._visit(left, env, binary)
        if n.name == "class":
            self.type[n] = "java.lang.Class"
            return
        if n.name == "this":
            self.type[n] = self.symbol[left].name if left in self.symbol else None
            return
        held = self.symbol.get(left)
        if held is not None and held.role == "PACKAGE":
            full = f"{held.name}.{n.name}"
            self.symbol[n] = Symbol("TYPE" if n.name[:1].isupper() else "PACKAGE", full)
            return
        if held is not None and held.role == "TYPE":
            if f"{held.name}${n.name}" in self.unit.types or n.name[:1].isupper() and not n.name.isupper() and self.member(held.name, n.name, None) is None:
                self.symbol[n] = Symbol("TYPE", f"{held.name}${n.name}")
                return
            self._named(n, held.name, (Step(n.name, None),))
            return
        self._member_of(n, left, Step(n.name, None))

    def _member_of(self, n: Node, left: Node, step: Step) -> None:
        if self.type.get(left):
            if step.name == "length" and step.args is None and self.type[left].endswith("[]"):
                self.type[n] = "int"
                return
            self._named(n, self.type[left], (step,))
        elif left in self.path:
            owner, steps = self.path[left]
            self.path[n] = (owner, (*steps, step))

    def _call(self, n: Node, env: list[dict], binary: str) -> None:
        for k in n.kids:
            if k is not n.part["target"]:
                self._visit(k, env, binary)
        args = tuple(self.type.get(a) for a in n.part["args"])
        target = n.part["target"]
        self.inside[target] = binary
        if target.kind == "IDENTIFIER":
            if target.name in ("this", "super"):
                owner = binary if target.name == "this" else next((t for t in self.above(binary) if self._is_class(t)), "java.lang.Object")
                self._named(target, owner, (Step("<init>", args),))
            else:
                self._implicit(target, binary, Step(target.name, args))
        elif target.kind == "MEMBER_SELECT":
            left = target.kids[0]
            self._visit(left, env, binary)
            held = self.symbol.get(left)
            step = Step(target.name, args)
            if held is not None and held.role == "TYPE":
                self._named(target, held.name, (step,))
            else:
                self._member_of(target, left, step)
        if target in self.symbol:
            self.symbol[n] = self.symbol[target]
            self.type[n] = self.type.get(target)
            if self.symbol[target].declaration is not None and self.symbol[target].name == "getClass":
                self.type[n] = "java.lang.Class"
        elif target in self.path:
            self.path[n] = self.path[target]

    def _implicit(self, n: Node, binary: str, step: Step) -> None:
        """A call without a receiver: of the nearest enclosing type that has the method, or else a static import, or what other files have."""
        at, open_ = binary, ""
        while at:
            if self.member(at, step.name, step.args) is not None:
                self._named(n, at, (step,))
                return
            if not open_ and not self.complete(at):
                open_ = at
            at = self.unit.outer.get(at, "")
        if step.name in self.unit.static:
            self._named(n, self.unit.resolve(self.unit.static[step.name]), (step,))
        elif open_:
            self._named(n, open_, (step,))
        elif self.unit.static_wide:
            self._named(n, self.unit.resolve(self.unit.static_wide[0]), (step,))

    def _new(self, n: Node, env: list[dict], binary: str) -> None:
        for k in n.kids:
            if k.kind in KINDS:
                k.part["above"] = [n.part["type"]]
                self._class(k, env)
            else:
                (self._types if k is n.part["type"] else self._visit)(k, env, binary)
        base = self.unit.erase((self.unit.read(n.part["type"])[0], [], 0), self._bounds(env, binary), binary)
        self.type[n] = base
        held = self.type[n]
        self._named(n, base, (Step("<init>", tuple(self.type.get(a) for a in n.part["args"])),))
        self.type[n] = held

    def implicit_receiver(self, n: Node) -> str | None:
        """The type that a call without a receiver is a member of."""
        d = self.symbol[n].declaration if n in self.symbol else None
        if d is not None:
            return d.owner
        return self.path[n][0] if n in self.path and len(self.path[n][1]) == 1 else None


def fit(params: list[str] | tuple, args: tuple) -> int:
    """How well arguments go with parameters: equal types count most, unknown ones a little."""
    return sum(4 if a == p else 1 if a is None else 2 if a == "int" and p in ("long", "double") else 1 if a not in PRIMITIVE and p == "java.lang.Object" else 0 for p, a in zip(params, args)) + 2 * (len(params) == len(args))


# tables

SCHEMA = "path string, kind string, owner string, name string, simple_name string, modifiers array<string>, position long, signature string, descriptor string, element string, supertypes array<string>, params array<string>, result string, name_span array<long>"


def _row(path, d: Declaration) -> tuple:
    return (path, d.kind, d.owner, d.name, d.name.replace("$", ".").rpartition(".")[2], d.modifiers, d.position, d.signature, d.descriptor, serialized(d), d.supertypes, d.params, d.result, list(d.span))


def _extract(batches: Iterator[pd.DataFrame], kinds: tuple[str, ...] | None = None) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, code in zip(batch["path"], batch["content"]):
            rows += [_row(path, d) for d in declarations(code or "", library_names()) if kinds is None or d.kind in kinds]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def extract(files: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The declarations of all files, or those of some kinds. files: path, content."""
    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(partial(_extract, kinds=kinds), SCHEMA)


def with_library(declared: DataFrame) -> DataFrame:
    """Declarations and those of the known library, which have no path; default constructors are added."""
    rows = [_row(None, d) for some in library().values() for d in some]
    both = declared.unionByName(declared.sparkSession.createDataFrame(rows, SCHEMA))
    types = both.filter(F.col("kind").isin("CLASS", "ENUM"))
    made = both.filter("kind = 'CONSTRUCTOR'").select(F.col("owner").alias("name")).distinct().hint("merge")
    default = types.join(made, "name", "left_anti").select(
        "path", F.lit("CONSTRUCTOR").alias("kind"), F.col("name").alias("owner"), F.lit("<init>").alias("name"), F.lit("<init>").alias("simple_name"), F.array().cast("array<string>").alias("modifiers"), F.lit(-1).cast("long").alias("position"), F.lit("()V;").alias("signature"), F.lit("()V").alias("descriptor"),
        F.concat(F.lit("CONSTRUCTOR:"), "name", F.lit(":<init>:()V")).alias("element"), F.array().cast("array<string>").alias("supertypes"), F.array().cast("array<string>").alias("params"), F.lit("void").alias("result"), F.array().cast("array<long>").alias("name_span"),
    )
    return both.unionByName(default)


def supertypes(declared: DataFrame) -> DataFrame:
    """child and parent of all direct supertypes. A type without a superclass has java.lang.Object. declared: from :func:`with_library`."""
    types = declared.filter(F.col("kind").isin(*KINDS) & (F.col("name") != "java.lang.Object"))
    each = types.select(F.col("name").alias("child"), "kind", F.explode_outer("supertypes").alias("parent"))
    classes = types.filter("kind = 'CLASS'").select(F.col("name").alias("parent"), F.lit(True).alias("is_class")).distinct().hint("merge")
    known = each.join(classes, "parent", "left")
    rooted = known.groupBy("child").agg(F.max(F.coalesce((F.col("kind") == "CLASS") & F.col("is_class"), F.lit(False))).alias("has"), F.max((F.col("kind") == "CLASS") & F.col("parent").isNotNull() & F.col("is_class").isNull()).alias("maybe"))
    top = rooted.filter("not has").select("child", F.lit("java.lang.Object").alias("parent"))
    return known.filter("parent is not null").select("child", "parent").unionByName(top).distinct()


def hierarchy(declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The types of the corpus, and child and parent of all direct supertypes with the library's. Declarations are read once."""
    own = checkpointed(declared.filter(F.col("kind").isin(*KINDS)).select("path", "kind", "name", "supertypes"))
    rows = [("", d.kind, d.name, d.supertypes) for some in library().values() for d in some if d.kind in KINDS]
    return own, supertypes(own.unionByName(own.sparkSession.createDataFrame(rows, own.schema)))


def subtypes(declared: DataFrame, only: list[str] | None = None) -> DataFrame:
    """type, path and class: every class of the corpus with each of its supertypes, by canonical names, at any depth.

    only: canonical names of supertypes, if others are not asked for; then no others are followed.
    """
    own, direct = hierarchy(declared)
    if only is None:
        up = lookup.closure(direct)
    else:
        direct = checkpointed(direct)
        up = lookup.below(direct, direct.select(F.col("parent").alias("ancestor")).filter(F.translate("ancestor", "$", ".").isin(*only)))
    return own.select("path", F.col("name").alias("child")).join(up.hint("merge"), "child").select(F.translate("ancestor", "$", ".").alias("type"), "path", F.col("child").alias("class"))


def overrides(declared: DataFrame) -> DataFrame:
    """path, element and overridden: each method with the methods of its type's direct supertypes that it overrides."""
    all_ = checkpointed(with_library(declared))
    m = all_.filter("kind = 'METHOD'")
    free = lambda c: ~F.arrays_overlap(c, F.array(F.lit("STATIC"), F.lit("PRIVATE")))
    low = m.filter(F.col("path").isNotNull() & free("modifiers")).select("path", "element", F.col("owner").alias("child"), "name", "params")
    high = m.filter(free("modifiers")).select(F.col("owner").alias("parent"), "name", F.col("element").alias("overridden"), F.col("params").alias("o_params"), F.col("signature").alias("o_signature"))
    met = low.join(supertypes(all_).hint("merge"), "child").join(high.hint("merge"), ["parent", "name"]).filter(F.size("params") == F.size("o_params"))
    # a parameter of a type variable takes any class
    generic = F.regexp_extract("o_signature", r"\((.*)\)", 1).rlike(r"(^|[;\[VZBSIJCFD])T[A-Z]\w*;")
    same = F.forall(F.arrays_zip(F.col("params").alias("a"), F.col("o_params").alias("b")), lambda z: (z["a"] == z["b"]) | (generic & (z["b"] == "java.lang.Object")))
    return met.filter(same).select("path", "element", "overridden").distinct()


_USED = "path string, pos long, element string, owner string, steps array<struct<name:string,args:array<string>,call:boolean>>"


def uses(code: str, known: frozenset[str] = frozenset()) -> list[tuple[int, str | None, str | None, list]]:
    """(position, element, type, steps) of every name, selection and creation that stands for a package, type or member: the element, or where other files have it."""
    return uses_of(Attribution(code, known))


def uses_of(a: Attribution) -> list[tuple[int, str | None, str | None, list]]:
    """:func:`uses` of a file that is attributed already."""
    out = []
    for n in a.unit.tree.walk():
        if n.kind == "METHOD_INVOCATION" or n.kind not in ("IDENTIFIER", "MEMBER_SELECT", "NEW_CLASS"):
            continue
        pos = n.start if n.kind == "NEW_CLASS" else n.at
        s = a.symbol.get(n)
        if s is not None:
            if s.role == "PACKAGE":
                out.append((pos, f"PACKAGE:{s.name}", None, []))
            elif s.role == "TYPE":
                out.append((pos, None, s.name, []))
            elif s.declaration is not None:
                out.append((pos, serialized(s.declaration), None, []))
        elif n in a.path:
            owner, steps = a.path[n]
            out.append((pos, None, owner, [(x.name, [t or "" for t in x.args or ()], x.args is not None) for x in steps]))
    return out


def _uses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, code in zip(batch["path"], batch["content"]):
            for pos, element, owner, steps in uses(code or "", library_names()):
                rows.append((path, pos, element, owner, [{"name": n, "args": a, "call": c} for n, a, c in steps]))
        yield pd.DataFrame(rows, columns=["path", "pos", "element", "owner", "steps"])


def _both(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    declared = pa.list_(pa.struct([(n, kinds[t]) for n, t in map(str.split, SCHEMA.split(", ")[1:])]))
    step = pa.struct([("name", pa.string()), ("args", pa.list_(pa.string())), ("call", pa.bool_())])
    used = pa.list_(pa.struct([("pos", pa.int64()), ("element", pa.string()), ("owner", pa.string()), ("steps", pa.list_(step))]))
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            paths, left, right = batch.column("path").slice(at, 1000), [], []
            for code in batch.column("content").slice(at, 1000).to_pylist():
                a = Attribution(code or "", library_names())
                left.append([_row(None, d)[1:] for d in a.unit.found])
                right.append([(pos, element, owner, steps) for pos, element, owner, steps in uses_of(a)])
            yield pa.RecordBatch.from_arrays([paths, pa.array(left, declared), pa.array(right, used)], ["path", "declared", "used"])


def analysed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The declarations of all files, as :func:`extract` gives them, and what their names stand for, as :func:`usages` takes it; every file is read once."""
    ship(files.sparkSession)
    declared, used = (", ".join(x.replace(" ", ":", 1) for x in schema.split(", ")[1:]) for schema in (SCHEMA, _USED))
    schema = f"path string, declared array<struct<{declared}>>, used array<struct<{used}>>"
    both = checkpointed(files.select("path", F.col("content").cast("string").alias("content")).mapInArrow(_both, schema))
    return tuple(checkpointed(both.select("path", F.inline(c))) for c in ("declared", "used"))


def _nearest(asked: DataFrame, direct: DataFrame, members: DataFrame) -> DataFrame:
    """element and result of the member that each asked (owner, name, args, call) is: of the nearest of the type and its supertypes that takes the arguments.

    What a type has not goes on to its direct supertypes, but no way comes twice to a type.
    """
    key, done = ["owner", "name", "args", "call"], []
    at = checkpointed(asked.select(*key, F.col("owner").alias("ancestor"), F.array("owner").alias("trail")))
    while not at.isEmpty():
        met = at.join(members.hint("merge"), ["ancestor", "name", "call"]).filter(~F.col("call") | (F.size("params") == F.size("args")))
        zipped = F.arrays_zip(F.col("params").alias("p"), F.col("args").alias("a"))
        score = F.aggregate(zipped, F.lit(0), lambda s, z: s + F.when(z["p"] == z["a"], 4).when(z["a"] == "", 1).otherwise(0))
        best = checkpointed(met.groupBy(*key).agg(F.min_by(F.struct("element", "result"), F.struct(-score, "element")).alias("m")).select(*key, "m.element", "m.result"))
        done.append(best)
        rest = at.filter("name != '<init>'").join(best.hint("merge"), key, "left_anti")
        up = rest.join(direct.hint("merge"), F.col("ancestor") == F.col("child")).filter(~F.array_contains("trail", F.col("parent")))
        at = checkpointed(up.select(*key, F.col("parent").alias("ancestor"), F.array_append("trail", F.col("parent")).alias("trail")).dropDuplicates([*key, "ancestor"]))
    return reduce(DataFrame.unionByName, done) if done else asked.select(*key, F.lit(None).cast("string").alias("element"), F.lit(None).cast("string").alias("result"))


def usages(files: DataFrame, declared: DataFrame | None = None, raw: DataFrame | None = None) -> DataFrame:
    """path, pos, element and is_override: what every name in the files stands for, and for methods also what these override.

    Names that hang on other files go step by step: a type and a member's name meet the members of the type and of its
    supertypes, of which the nearest that takes the arguments is it, and its type is where the next step is looked for.
    Rounds are as many as the longest chain of calls, each with as many as supertypes are climbed; a round joins the
    distinct types and names only. declared, raw: from :func:`analysed`, or declarations alone that can be others than the files'.
    """
    if declared is None:
        declared, raw = analysed(files)
    elif raw is None:
        ship(files.sparkSession)
        declared = checkpointed(declared)
        raw = checkpointed(files.select("path", "content").mapInPandas(_uses, _USED))
    all_ = checkpointed(with_library(declared).select("kind", "owner", "name", "element", "supertypes", "params", "result"))
    types = all_.filter(F.col("kind").isin(*KINDS)).groupBy(F.col("name").alias("owner")).agg(F.min("element").alias("t_element"))
    named = raw.filter("element is null and size(steps) = 0").join(types.hint("merge"), "owner", "left").select("path", "pos", F.coalesce("t_element", F.concat(F.lit("CLASS:"), "owner")).alias("element"))
    done = [raw.filter("element is not null").select("path", "pos", "element")]
    direct = checkpointed(supertypes(all_))
    members = all_.filter(~F.col("kind").isin(*KINDS)).select(F.col("owner").alias("ancestor"), "name", F.col("kind").isin("METHOD", "CONSTRUCTOR").alias("call"), "params", "element", "result")
    left = raw.filter("size(steps) > 0").select("path", "pos", "owner", "steps")
    while not left.isEmpty():
        step = F.col("steps")[0]
        left = left.select("*", step["name"].alias("name"), step["args"].alias("args"), step["call"].alias("call"))
        best = _nearest(left.select("owner", "name", "args", "call").distinct(), direct, members)
        next_ = checkpointed(left.join(best.hint("merge"), ["owner", "name", "args", "call"]).select("path", "pos", F.col("result").alias("owner"), F.expr("slice(steps, 2, size(steps))").alias("steps"), "element"))
        done.append(next_.filter("size(steps) = 0").select("path", "pos", "element"))
        left = next_.filter("size(steps) > 0").select("path", "pos", "owner", "steps")
    members_used = reduce(DataFrame.unionByName, done)
    over = checkpointed(overrides(declared.unionByName(declared.sparkSession.createDataFrame([_row("", d) for some in library().values() for d in some], SCHEMA))).select("element", "overridden").distinct())
    more = members_used.filter("element like 'METHOD:%'").join(over.hint("merge"), "element")  # types and fields override nothing
    return members_used.unionByName(named).select("*", F.lit(False).alias("is_override")).unionByName(more.select("path", "pos", F.col("overridden").alias("element"), F.lit(True).alias("is_override")))
