"""SimHash near-duplicates: fingerprints, an exact tiled comparison, connected groups.

Fingerprints that differ in at most ``radius`` bits are linked. All pairs are
compared, by exclusive-or and bit counts in numpy, but only within tiles that can
hold a link: the 64 bits are cut into four words, and the four population counts
of a fingerprint name its *cell*. Two fingerprints within the radius have cells
whose counts differ by the radius in sum at most, so only such cells meet. A cell
of more than ``tile`` fingerprints is cut into several home tiles. Each tile's
fingerprints travel as one block, to the tile itself and, as visitors, to the tiles of
the cells after its own that they may link to; blocks stream past the home tile,
so a task holds one tile and one batch of blocks.

A tile reports links that span what it has found connected, not every pair.
Groups are the connected components of those links, by alternating large-star
and small-star steps, each written to the shared folder.

Defined results: null and empty texts have fingerprint zero and are linked like
any other; a null doc_id never names a group that has another; repeated rows have
one fingerprint and each its row; a bit set in exactly half of the hashes is 0; a text
of any length is hashed whole; columns other than doc_id and text are not looked at by
:func:`near_groups` and kept as they are by :func:`one_of_each`; an empty table gives an
empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORDS, WORD_BITS = 4, 16
SIDE = WORD_BITS + 1  #: population counts of a word run from 0 to 16


def hashes(data: bytes, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of every word shingle of a text, lower-cased in ASCII. Fewer words: of them all."""
    words = data.lower().split()  # bytes split at the six ASCII white space characters
    if not words:
        return np.empty(0, ">u8")
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.frombuffer(xxhash.xxh64_digest(joined, seed), ">u8")
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-shingle]]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :])]), ">u8")


def fingerprint(h: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):  # bounded memory on very long texts
        part = h[i : i + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big") if len(h) else 0


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([fingerprint(hashes(t, shingle, seed)) for t in batch.column(batch.num_columns - 1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out.view(np.int64))], [*batch.schema.names[:-1], "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, *more: Column) -> DataFrame:
    """doc_id, the columns asked for, and the fingerprint of every row as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, common.text_of(docs).cast("binary").alias("text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1]) + ", fp long"
    return common.map_arrow(rows, _fingerprints(shingle, seed), schema)


def offsets(radius: int) -> list[list[int]]:
    """Differences of two cells that can hold a link, one of each pair of opposites, and no difference."""
    every = itertools.product(range(-radius, radius + 1), repeat=WORDS)
    return [list(d) for d in every if sum(map(abs, d)) <= radius and d >= (0,) * WORDS]


def near(a: np.ndarray, b: np.ndarray, radius: int, size: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of pairs within the radius, block by block."""
    rows = max(1, size // max(1, len(b)))
    for i in range(0, len(a), rows):
        x, y = np.nonzero(np.bitwise_count(a[i : i + rows, None] ^ b[None, :]) <= radius)
        if len(x):
            yield x + i, y


class Tile:
    """One home tile and what has been found connected in it."""

    def __init__(self, radius: int):
        self.radius, self.home, self.label, self.copy = radius, np.empty(0, np.uint64), None, False
        self.parts: list[np.ndarray] = []

    def add(self, home: np.ndarray, copy: bool = False) -> None:
        self.parts.append(home)
        self.copy |= copy

    def _merge(self, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links between the labels of home fingerprints that are not yet one."""
        for a, b in set(zip(self.label[one].tolist(), self.label[two].tolist())):
            a, b = self._root(a), self._root(b)
            if a != b:
                self.up[b] = a
                yield int(self.home[a]), int(self.home[b])

    def _root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def _settle(self) -> None:
        """Let labels be roots, so that a later merge sees few pairs."""
        up = np.array(self.up)
        while (up[up] != up).any():
            up = up[up]
        self.label = up
        self.up = up.tolist()

    def close(self) -> Iterator[tuple[int, int]]:
        """All home fingerprints are there: link them among themselves, unless this is a copy of a tile that does so elsewhere."""
        if self.label is None:
            self.home = np.concatenate(self.parts) if self.parts else self.home
            self.label, self.up = np.arange(len(self.home)), list(range(len(self.home)))
            for x, y in near(self.home, self.home, self.radius) if not self.copy else ():
                m = x < y
                if m.any():
                    yield from self._merge(x[m], y[m])
                    self._settle()

    def meet(self, guests: np.ndarray) -> Iterator[tuple[int, int]]:
        """Link visitors to the home tile."""
        if not len(self.home):
            return
        for x, y in near(guests, self.home, self.radius):
            first = np.concatenate([[True], x[1:] != x[:-1]])
            yield from zip(guests[x[first]].tolist(), self.home[y[first]].tolist())
            lead = y[np.flatnonzero(first)[np.cumsum(first) - 1]]
            m = self.label[lead] != self.label[y]
            if m.any():
                yield from self._merge(lead[m], y[m])
                self._settle()


HOME, COPY, GUEST = 0, 1, 2


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile, out = None, Tile(radius), []

        def flush():
            got = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["u", "v"])

        for batch in batches:
            key, role = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            blocks = batch.column(2)
            fps, ends = blocks.values.to_numpy().view(np.uint64), blocks.offsets.to_numpy()
            for i in range(batch.num_rows):
                block = fps[ends[i] : ends[i + 1]]
                if key[i] != now:
                    out.extend(tile.close())
                    now, tile = key[i], Tile(radius)
                if role[i] == GUEST:
                    out.extend(tile.close())
                    out.extend(tile.meet(block))
                else:
                    tile.add(block, role[i] == COPY)
            if len(out) > 10_000:
                yield flush()
        out.extend(tile.close())
        yield flush()

    return run


def links(fps: DataFrame, radius: int = 3, tile: int = 4096, visitors: int = 256) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints that span all links within the radius.

    A home tile that more than ``visitors`` tiles visit is copied, and each copy meets its share of them.
    """
    spark = fps.sparkSession
    counts = [F.bit_count(F.shiftrightunsigned("fp", WORD_BITS * i).bitwiseAND(F.lit((1 << WORD_BITS) - 1))) for i in range(WORDS)]
    cell_no = lambda cs: sum((c * SIDE**i for i, c in enumerate(cs)), F.lit(0)).cast("int")
    rows = fps.select("fp", F.array(*counts).alias("counts"), cell_no(counts).alias("cell"))
    # at most 17 ** 4 cells, whatever the input
    cells = common.materialize(rows.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles")), "cells")
    own = rows.join(F.broadcast(cells), "cell").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    # a block is a tile's fingerprints, some ``tile`` at most; from here on blocks travel, a row for each pair of tiles that may hold links
    blocks = own.groupBy("cell", "tile").agg(F.first("counts").alias("counts"), F.collect_list("fp").alias("block"))
    blocks = common.materialize(blocks, "tiles")
    steps = F.array(*[F.array(*map(F.lit, d)) for d in offsets(radius)])
    there = F.explode(F.filter(F.transform(steps, lambda d: F.transform(F.arrays_zip(F.col("counts").alias("c"), d.alias("d")), lambda z: z["c"] + z["d"])), lambda cs: F.forall(cs, lambda c: (c >= 0) & (c < SIDE))))
    aim = lambda df, *more: df.select(*more, F.col("cell").alias("from"), there.alias("cs")).select(*more, "from", cell_no([F.col("cs")[i] for i in range(WORDS)]).alias("cell"))
    # how many tiles visit each tile of a cell, and so how many copies there are of it
    come = aim(rows.select("cell", "counts").distinct()).join(F.broadcast(cells.withColumnRenamed("cell", "from").withColumnRenamed("tiles", "n")), "from").groupBy("cell").agg(F.sum("n").alias("n"))
    copies = common.materialize(cells.join(come, "cell", "left").select("cell", "tiles", F.greatest(F.ceil(F.col("n") / F.lit(visitors)), F.lit(1)).cast("int").alias("copies")), "tile-copies")
    known = F.broadcast(copies)
    home = blocks.join(known, "cell").select("cell", "tile", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "block").withColumn("role", F.when(F.col("copy") == 0, HOME).otherwise(COPY))
    sent = aim(blocks, "block", "tile").withColumnRenamed("tile", "from_tile").join(known, "cell")
    sent = sent.select("block", "cell", "copies", "from", "from_tile", F.when(F.col("cell") == F.col("from"), F.col("from_tile")).otherwise(F.col("tiles")).alias("upto")).filter("upto > 0")
    guests = sent.select("cell", F.explode(F.sequence(F.lit(0), F.col("upto") - 1)).alias("tile"), F.pmod(F.xxhash64("from", "from_tile"), F.col("copies")).cast("int").alias("copy"), "block", F.lit(GUEST).alias("role"))
    key = (F.col("cell").cast("long") * F.lit(1 << 40) + F.col("tile").cast("long") * F.lit(1 << 16) + F.col("copy")).alias("key")
    n = max(common.conf_int(spark, "spark.sql.shuffle.partitions", 200), 4 * spark.sparkContext.defaultParallelism)
    dealt = home.unionByName(guests).select(key, "role", "block").repartition(n, "key").sortWithinPartitions("key", "role")
    return common.map_arrow(dealt, _links(radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge list (u, v); root is the smallest node it can reach."""
    now = common.materialize(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        then = common.materialize(small, "edges")
        common.drop(now)
        now, was = then, mark
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(rows: DataFrame, radius: int = 3, tile: int = 4096) -> DataFrame:
    """fp, and component_id: the smallest doc_id reachable. rows: doc_id, fp."""
    fps = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    found = components(links(fps, radius, tile))
    rooted = fps.join(found, fps["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = common.materialize(rooted, "rooted")
    return rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")


def near_groups(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    rows = common.materialize(fingerprints(docs, shingle, seed), "simhash-rows")
    return rows.join(grouped(rows, radius), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their group: by doc_id, nulls last, then by the MD5 of the text.

    Of rows that agree in both, one stays.
    """
    mark = F.md5(common.text_of(docs).cast("binary"))
    rows = common.materialize(fingerprints(docs, shingle, seed, mark.alias("mark")), "simhash-rows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    fps = common.materialize(rows.groupBy("fp").agg(best.alias("best"), F.min("doc_id").alias("first")), "fingerprints")
    found = components(links(fps, radius))
    rooted = fps.join(found, fps["fp"] == found["node"], "left").select(F.coalesce("root", "fp").alias("root"), "best")
    stay = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.doc_id").alias("k_id"), F.col("best.mark").alias("k_mark"))
    stay = common.materialize(stay, "simhash-first")
    (own,) = common.unused(docs, "mark")
    keyed = docs.withColumn(own, mark)
    some = keyed.join(stay, (keyed[own] == stay["k_mark"]) & keyed["doc_id"].cast("long").eqNullSafe(stay["k_id"]), "left_semi")
    return some.dropDuplicates(["doc_id", own]).drop(own)
