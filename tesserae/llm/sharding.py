"""Sharding by minimax contiguous partition.

Rows with equal texts form one atomic group. Groups are ordered by the SHA-256 of
their text, which spreads them evenly and lets any range of groups be named by a
prefix. The smallest capacity C for which a greedy walk over that order needs no
more than the asked number of shards is found by binary search, and the shards
are cut where that walk cuts.

The walk must not see every group on the driver. It runs over *segments*: first
equal ranges of hash prefixes with their byte sums (a bounded table), of which
only those that a cut may fall into are split further, until every cut falls
between known groups. Treating a segment as divisible gives a lower bound of C
and the latest place of each cut; treating it as atomic gives an upper bound and
the earliest place. What lies outside all those intervals is never split.

A group larger than the mean shard gets a shard of its own, and the order on
either side of it is partitioned by the same search, so that one huge group of
copies does not leave other shards empty.

Defined results: a null text counts as an empty one (size 8); null doc_ids and
repeated rows are rows like any other; rows that tie in doc_id and text have any of their slots; a
text of any length is one group, whose bytes are counted and not held; columns other than doc_id and
text are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BROADCAST_ROWS = 500_000  #: offsets that are sent to all tasks; more are shuffled
HEX = 15  #: hex digits of the hash that ranges are counted in: 60 bits, which fit a long


def _step(pos: int, cap: int, ends: np.ndarray, whole: np.ndarray, divide: bool) -> int:
    """Where a shard that begins at byte pos ends. Bytes are counted along the order."""
    to = pos + cap
    if to >= ends[-1]:
        return int(ends[-1])
    j = int(np.searchsorted(ends, to, side="right")) - 1
    if divide and not whole[j]:
        return to
    return max(pos, int(ends[j]))


def _walk(cap: int, shards: int, ends: np.ndarray, whole: np.ndarray, divide: bool) -> list[int]:
    at, out = 0, []
    for _ in range(shards):
        at = _step(at, cap, ends, whole, divide)
        out.append(at)
    return out


def smallest_capacity(shards: int, ends: np.ndarray, whole: np.ndarray, divide: bool) -> int:
    """The least capacity whose greedy walk reaches the end, by binary search."""
    total = int(ends[-1])
    low, high = max(1, -(-total // shards)), max(1, total)
    while low < high:
        mid = (low + high) // 2
        if _walk(mid, shards, ends, whole, divide)[-1] >= total:
            high = mid
        else:
            low = mid + 1
    return low


def _solve(shards: int, size: np.ndarray, whole: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Indexes of segments that begin shards, and which segments must be split first."""
    if not len(size) or shards <= 1:
        return [], np.zeros(len(size), bool)
    ends = np.concatenate([[0], np.cumsum(size)])
    low = smallest_capacity(shards, ends, whole, True)
    high = smallest_capacity(shards, ends, whole, False)
    first, last = _walk(low, shards, ends, whole, False), _walk(high, shards, ends, whole, True)
    split = np.zeros(len(size), bool)
    for a, b in zip(first, last):
        split |= (ends[:-1] < b) & (ends[1:] > a) & ~whole
    starts = [int(np.searchsorted(ends, p, side="left")) for p in _walk(high, shards, ends, whole, False)[:-1]]
    return starts, split


def cut(shards: int, size: np.ndarray, whole: np.ndarray, largest: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Starts of shards 1, 2, ... as segment indexes, and the segments to split before these are final.

    whole: segments that are one group. largest: the size of a segment's largest group.
    """
    n, total = len(size), int(size.sum())
    if n == 0 or shards <= 1:
        return [], np.zeros(n, bool)
    over = largest * shards > total
    if (over & ~whole).any():
        return [], over & ~whole
    if over.any() and n > 1:
        i = int(np.argmax(np.where(over, size, -1)))
        left, right = int(size[:i].sum()), int(size[i + 1 :].sum())
        k = shards - 1
        if k >= (i > 0) + (i < n - 1):
            a = round(k * left / (left + right))
            a = min(max(a, int(i > 0)), k - int(i < n - 1))
            ls, lo = cut(a, size[:i], whole[:i], largest[:i])
            rs, ro = cut(k - a, size[i + 1 :], whole[i + 1 :], largest[i + 1 :])
            ls = ls + [i] * (a - 1 - len(ls)) if a else []
            starts = ls + ([i] if a else []) + ([i + 1] if k - a else []) + [i + 1 + s for s in rs]
            starts += [n] * (shards - 1 - len(starts))
            bytes_in = np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(size)])[starts], [total]]))
            if int(bytes_in.max()) <= int(size[i]):
                return starts, np.concatenate([lo, [False], ro])
    return _solve(shards, size, whole)


def find_cuts(groups: DataFrame, shards: int, resolution: int = 1 << 14, exact: int = 100_000) -> list[str]:
    """Keys at which shards 1, 2, ... begin. groups: key (hex), prefix (its first 60 bits), size.

    The driver gets at most ``resolution`` ranges or ``exact`` groups at a time.
    """
    parts: list[tuple[str, int, int, int, int, int]] = []  # key, low, high, bytes, groups, largest
    ranges = [(0, 1 << (4 * HEX))]
    while True:
        wanted = F.lit(False)
        for lo, hi in ranges:
            wanted = wanted | ((F.col("prefix") >= lo) & (F.col("prefix") < hi))
        inside = groups.filter(wanted) if parts else groups
        count = sum(p[4] for p in parts if any(lo <= p[1] < hi for lo, hi in ranges)) if parts else None
        old = [p for p in parts if not any(lo <= p[1] < hi for lo, hi in ranges)]
        span = sum(hi - lo for lo, hi in ranges)
        if count is not None and (count <= exact or span <= resolution):
            found = inside.select("key", "prefix", "size").collect()
            new = [(r.key, r.prefix, r.prefix + 1, r.size, 1, r.size) for r in found]
        else:
            width = 1 << max(0, (max(1, span // resolution) - 1).bit_length())
            ranged = inside.withColumn("bin", F.expr(f"prefix div {width}"))
            found = ranged.groupBy("bin").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("size").alias("largest"), F.min("key").alias("key")).collect()
            new = [(f"{r.bin * width:0{HEX}x}", r.bin * width, (r.bin + 1) * width, r.size, r.n, r.largest) for r in found]
        parts = sorted(old + new)
        size = np.array([p[3] for p in parts], dtype=np.int64)
        whole = np.array([p[4] == 1 for p in parts], dtype=bool)
        largest = np.array([p[5] for p in parts], dtype=np.int64)
        starts, split = cut(shards, size, whole, largest)
        if not split.any():
            return [parts[s][0] if s < len(parts) else "g" for s in starts]  # "g" is above every hex key
        # one range for each stretch of segments to split; single groups in between are fetched again
        fixed = np.cumsum(~whole & ~split)
        ranges, last = [], None
        for i in np.flatnonzero(split).tolist():
            lo, hi = parts[i][1], parts[i][2]
            if last is not None and fixed[last] == fixed[i]:
                ranges[-1] = (ranges[-1][0], hi)
            else:
                ranges.append((lo, hi))
            last = i


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, key, size and text_crc32 of every row."""
    text = common.text_of(docs)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.sha2(text, 256).alias("key"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def _shard_of(cuts: list[str]) -> Column:
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("key")))


PIECE_ROWS = 50_000  #: rows of a shard that are put in order at a time


def assign(docs: DataFrame, shards: int = 24, pieces: int | None = None, resolution: int = 1 << 14, exact: int = 100_000) -> DataFrame:
    """Every row of docs with its shard and its place in that shard.

    slot counts from 0 without gaps in each shard. It comes from counts of
    shards x pieces buckets of rows, so no task sorts a whole shard; there are as many pieces as keep them small.
    """
    rows = common.materialize(measured(docs), "shard-rows")
    if pieces is None:
        pieces = max(64, -(-rows.count() // (shards * PIECE_ROWS)))
    groups = rows.groupBy("key").agg(F.sum("size").alias("size")).withColumn("prefix", F.conv(F.substring("key", 1, HEX), 16, 10).cast("long"))
    cuts = find_cuts(groups, shards, resolution, exact)
    placed = rows.withColumn("shard", _shard_of(cuts).cast("int")).withColumn("piece", F.pmod(F.xxhash64("doc_id", "key"), F.lit(pieces)).cast("int"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "piece").orderBy("doc_id", "key")
    numbered = placed.withColumn("nth", F.row_number().over(inside) - 1)
    # offsets has shards x pieces rows at most, a row for some 50,000 documents
    joined = numbered.join(F.broadcast(offsets) if shards * pieces <= BROADCAST_ROWS else offsets, ["shard", "piece"])
    return joined.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
