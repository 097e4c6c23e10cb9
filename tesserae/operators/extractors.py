"""Extractors: functions from one file to many rows, known by name, of which any number run in one pass.

An extractor gets (path, content) and yields (key, value) strings. Extractors that only some files need say so by a
test of the path. They are named in the job, so workers find them by importing the module that registers them.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from tesserae.sources.shipping import ship

SCHEMA = "extractor string, path string, key string, value string"


@dataclass(frozen=True)
class Extractor:
    name: str
    run: Callable[[str, str], Iterator[tuple[str, str]]]
    accepts: Callable[[str], bool]
    module: str


_known: dict[str, Extractor] = {}


def extractor(name: str, accepts: Callable[[str], bool] = lambda path: True):
    """Register a function under a name; a later one of the same name takes its place."""

    def add(run):
        _known[name] = Extractor(name, run, accepts, run.__module__)
        return run

    return add


def known() -> list[str]:
    return sorted(_known)


def extract(files: DataFrame, *names: str) -> DataFrame:
    """extractor, path, key and value of all rows that the named extractors make of files (path, content). An unknown name is an error."""
    wanted = [(n, _known[n].module) for n in names]
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, module in wanted:
            importlib.import_module(module)
        some = [_known[n] for n, _ in wanted]
        for batch in batches:
            rows = [(x.name, path, k, v) for path, code in zip(batch["path"], batch["content"]) for x in some if x.accepts(path) for k, v in x.run(path, code or "")]
            yield pd.DataFrame(rows, columns=["extractor", "path", "key", "value"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


@extractor("imports")
def imports(path: str, code: str) -> Iterator[tuple[str, str]]:
    """Names that a Java source imports; static ones are marked."""
    from tesserae.operators import syntax

    for static, name in syntax.parse(code).part["imports"]:
        yield ("static" if static else "import", name)


@extractor("sizes")
def sizes(path: str, code: str) -> Iterator[tuple[str, str]]:
    yield ("lines", str(code.count("\n")))
    yield ("characters", str(len(code)))
