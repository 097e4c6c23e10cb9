"""Clones of code: subtrees that are alike once local names are generalised.

Every tree below a file's root is spelled as the kinds of its nodes in order, with names
as they are, but variables, parameters and private members numbered by their first
place; its weight is the number of nodes without those; its hash is the whole MD5 in
hex with the weight behind a colon, as of eight digits different trees share some among
a few hundred thousand (:func:`short_hash`). Trees of less than ten are left out.

A group of equal trees is accepted if no accepted heavier group over the same files holds
one of its trees inside its own first one. Which groups hold which comes from an equi-join
on the trees above each tree, never from comparing spans; the order of acceptance
is followed in rounds, as many as accepted trees lie in each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators import duplicates
from tesserae.operators.java import Attribution
from tesserae.operators.rounds import checkpointed
from tesserae.operators.syntax import Node
from tesserae.sources.shipping import ship

SCHEMA = "path string, hash string, value long, start_off long, end_off long, inside array<struct<start_off:long,end_off:long>>"
LOCAL = ("LOCAL_VARIABLE", "PARAMETER", "EXCEPTION_PARAMETER")


def _general(a: Attribution, n: Node):
    """What stands for a name that is generalised; None for others."""
    s = a.symbol.get(n)
    if s is None:
        return None
    if s.role in LOCAL:
        return s.node
    if s.declaration is not None and "PRIVATE" in s.declaration.modifiers:
        return s.declaration.node
    if s.role == "FIELD" and s.node is n and n.kind == "VARIABLE" and "PRIVATE" in n.part["modifiers"].part["names"]:
        return n
    return None


def generalised(code: str, least: int = duplicates.MIN_WEIGHT) -> list[tuple[str, int, int, int, list]]:
    """(hash, value, start, end, spans of the trees above) of every tree of a source that weighs enough."""
    a, flat, above = Attribution(code), [], {}
    ends: list[int] = []

    def spell(root: Node) -> None:
        stack = [(root, -1)]
        while stack:
            n, up = stack.pop()
            if n is None:
                ends[up] = len(flat)
                continue
            i = len(flat)
            key = _general(a, n) if n.kind in ("IDENTIFIER", "VARIABLE") else None
            flat.append((n, key, n.name if n.kind in ("IDENTIFIER", "VARIABLE") else ""))
            ends.append(0)
            above[i] = up
            stack.append((None, i))
            stack += [(k, i) for k in n.kids[::-1]]

    spell(a.unit.tree)
    out, weigh = [], {}
    for i in range(1, len(flat)):
        names, text, value, j = {}, [], 0, i
        while j < ends[i]:
            n, key, name = flat[j]
            text.append(n.kind)
            value += 1
            if key is not None:
                text.append(names.setdefault(id(key), f"${len(names)}"))
                value -= n.kind == "IDENTIFIER"
            else:
                text.append(name)
            j = ends[j] if n.kind == "NEW_CLASS" else j + 1
        if value >= least:
            weigh[i] = (flat[i][0].start, flat[i][0].end)
            inside, up = [], above[i]
            while up > 0:
                if up in weigh and weigh[up] != weigh[i]:
                    inside.append(weigh[up])
                up = above[up]
            mark = hashlib.md5("".join(text).encode()).hexdigest().upper()
            out.append((f"{mark}:{value}", value, *weigh[i], inside))
    return out


def short_hash(hash_: Column) -> Column:
    """The form with eight digits, for indexes that keep that; different trees may share it."""
    return F.concat(F.substring(hash_, 1, 8), F.lit(":"), F.substring_index(hash_, ":", -1))


def _fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, code in zip(batch["path"], batch["content"]):
            rows += [(path, h, v, s, e, [{"start_off": x, "end_off": y} for x, y in inside]) for h, v, s, e, inside in generalised(code or "") if s >= 0 and e >= 0]
        yield pd.DataFrame(rows, columns=["path", "hash", "value", "start_off", "end_off", "inside"])


def fragments(files: DataFrame) -> DataFrame:
    """Generalised trees of all files. files: path, content."""
    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(_fragments, SCHEMA)


def groups(found: DataFrame, min_files: int = 2, min_spans: int = 2) -> DataFrame:
    """hash, value, n_files, n_spans, the mark of the set of files and the first span of hashes found often enough."""
    by_file = found.groupBy("hash", "value", "path").agg(F.count("*").alias("n"), F.min(F.struct("path", "start_off", "end_off")).alias("first"))
    all_ = by_file.groupBy("hash", "value").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_spans"), *duplicates.file_set("path"), F.min("first").alias("first"))
    return all_.filter((F.col("n_files") >= min_files) & (F.col("n_spans") >= min_spans))


def accepted(found: DataFrame, min_files: int = 2, min_spans: int = 2, hashes: DataFrame | None = None) -> DataFrame:
    """Groups that no accepted heavier one subsumes. hashes: if given, only these are looked at, and one span is enough."""
    if hashes is not None:
        found, min_files, min_spans = found.join(hashes.select("hash").distinct(), "hash", "left_semi"), 1, 1
    all_ = checkpointed(groups(found, min_files, min_spans))
    mark = ["files_sum", "files_xor", "n_files"]
    small = found.join(all_.select("hash", *mark), "hash").select("hash", *mark, "path", F.explode("inside").alias("in")).select("hash", *mark, "path", F.col("in.start_off").alias("start_off"), F.col("in.end_off").alias("end_off"))
    big = all_.select(F.col("hash").alias("big"), *mark, F.col("first.path").alias("path"), F.col("first.start_off").alias("start_off"), F.col("first.end_off").alias("end_off"))
    holds = checkpointed(small.join(big, [*mark, "path", "start_off", "end_off"]).select("hash", "big").distinct())
    taken = all_.select("hash").join(holds.select("hash").distinct(), "hash", "left_anti")
    taken, left = checkpointed(taken), holds
    while not left.isEmpty():
        # what an accepted group holds goes; then what nothing holds that still waits is accepted
        gone = left.join(taken.select(F.col("hash").alias("big")), "big", "left_semi").select("hash").distinct()
        waits = left.join(gone, "hash", "left_anti").join(gone.select(F.col("hash").alias("big")), "big", "left_anti")
        waits = checkpointed(waits.join(taken.select(F.col("hash").alias("big")), "big", "left_anti"))
        free = left.select("hash").distinct().join(gone, "hash", "left_anti").join(waits.select("hash").distinct(), "hash", "left_anti")
        taken, left = checkpointed(taken.unionByName(free).distinct()), waits
    return all_.join(taken, "hash", "left_semi").drop("files_sum", "files_xor")


def occurrences(found: DataFrame, some: DataFrame) -> DataFrame:
    """hash, value and spans of groups."""
    spans = F.sort_array(F.collect_list(F.struct("path", "start_off", "end_off")))
    return found.join(some.select("hash"), "hash", "left_semi").groupBy("hash", "value").agg(spans.alias("spans"))


def elsewhere(own: DataFrame, path: str, known: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Duplicates of one file's fragments in others, heaviest first; a fragment inside an accepted one is left out.

    own: fragments of the file. known: hash and path of all others. present: paths that are at hand; others are left out.
    Only the first span of a hash counts. hash, value, start_off, end_off and the other paths come back.
    """
    there = known.filter(F.col("path") != path)
    if present is not None:
        there = there.join(present.select("path").distinct(), "path", "left_semi")
    first = own.filter((F.col("start_off") >= 0) & (F.col("end_off") >= 0)).groupBy("hash", "value").agg(F.min(F.struct("start_off", "end_off", "inside")).alias("s")).select("hash", "value", "s.*")
    met = there.join(first.select("hash"), "hash", "left_semi").groupBy("hash").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    hit = checkpointed(first.join(met, "hash"))
    spans = hit.select(F.col("start_off").alias("b_start"), F.col("end_off").alias("b_end")).distinct()
    above = hit.select("hash", F.explode("inside").alias("i")).join(spans, (F.col("i.start_off") == F.col("b_start")) & (F.col("i.end_off") == F.col("b_end"))).select("hash").distinct()
    one = hit.join(above, "hash", "left_anti")
    heaviest = one.groupBy("start_off", "end_off").agg(F.max_by("hash", F.struct("value", "hash")).alias("hash"))  # one of those with equal spans
    return one.join(heaviest.select("hash"), "hash", "left_semi").select("hash", "value", "start_off", "end_off", "paths").orderBy(F.desc("value"), "hash")


def cached(asked: DataFrame, cache: DataFrame, remote: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers for asked hashes, from the cache (hash, path) or else the remote table, and the cache with what it learned.

    A hash that is nowhere is cached with a null path, so that it is not asked for again.
    """
    missing = asked.select("hash").distinct().join(cache.select("hash").distinct(), "hash", "left_anti")
    got = missing.join(remote.select("hash", "path").distinct(), "hash", "left")
    fuller = checkpointed(cache.select("hash", "path").unionByName(got.select("hash", "path")))
    return fuller.join(asked.select("hash").distinct(), "hash", "left_semi").filter("path is not null"), fuller


def warnings(own: DataFrame, found: DataFrame) -> DataFrame:
    """One warning for each span of each duplicated hash of a file: start_off, end_off, severity and message. found: what :func:`elsewhere` gave."""
    each = own.select("hash", "start_off", "end_off").join(found.select("hash", "paths"), "hash")
    return each.select("hash", "start_off", "end_off", F.lit("warning").alias("severity"), F.concat(F.lit("Duplicate of code from "), F.element_at("paths", 1)).alias("message"))
