"""Decoding of method and type signatures into what a reader expects."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters of the virtual machine's descriptors (fixed values).
PRIMITIVE = {"void": "V", "boolean": "Z", "byte": "B", "short": "S", "int": "I", "long": "J", "char": "C", "float": "F", "double": "D"}
_BY_LETTER = {v: k for k, v in PRIMITIVE.items()}


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1] if self.at <= len(self.text) else ""

    def until(self, stops: str) -> str:
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in stops:
            self.at += 1
        return self.text[start : self.at]

    def type(self) -> str:
        c = self.take()
        if c in _BY_LETTER:
            return _BY_LETTER[c]
        if c == "[":
            return self.type() + "[]"
        if c == "T":
            name = self.until(";")
            self.take()
            return name
        if c == "+":
            return "? extends " + self.type()
        if c == "-":
            return "? super " + self.type()
        if c == "*":
            return "?"
        if c != "L":
            return "unknown"
        name = self.until("<;")
        args = []
        if self.peek() == "<":
            self.take()
            while self.peek() not in (">", ""):
                args.append(self.type())
            self.take()
        while self.peek() not in (";", ""):  # what is nested in a generic class
            name = name + self.until("<;")
            if self.peek() == "<":
                self.until(">")
                self.take()
        self.take()
        simple = name.replace("$", "/").rpartition("/")[2]
        return f"{simple}<{', '.join(args)}>" if args else simple


def decode_type(text: str) -> str:
    """The simple name of an encoded type, with its arguments."""
    return _Reader(text).type()


def decode_parameters(text: str) -> str:
    """The parameters of an encoded method, in parentheses; type parameters are skipped."""
    r = _Reader(text)
    if r.peek() == "<":
        depth = 0
        while r.peek():
            depth += {"<": 1, ">": -1}.get(r.take(), 0)
            if not depth:
                break
    if r.take() != "(":
        return "unknown"
    out = []
    while r.peek() not in (")", ""):
        out.append(r.type())
    return "(" + ", ".join(out) + ")"


@F.pandas_udf(StringType())
def parameters(encoded: pd.Series) -> pd.Series:
    return encoded.map(decode_parameters, na_action="ignore")


@F.pandas_udf(StringType())
def type_name(encoded: pd.Series) -> pd.Series:
    return encoded.map(decode_type, na_action="ignore")
