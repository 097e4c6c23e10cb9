"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are counted: one from documents that
are labelled as trusted, one from all raw text. A document's log weight is the
log ratio of their probabilities for ``LENGTH`` of its n-grams, so long documents are not
favoured. Adding Gumbel noise to the log weights and keeping the k largest samples k
documents without replacement in proportion to their weights.

``LENGTH`` is the temperature: at 256 n-grams the noise, with a deviation of 1.28, is worth a
hundredth or two of a mean log ratio, which is how far documents near the edge of the trusted ones
lie apart. So a document near the edge is drawn by chance, in proportion to its weight, one well
above it is nearly always kept, and one well below it nearly never.

k is a budget of rows. Where none is given it is estimated: a part of the trusted documents is
held out of the target model, and k is the number of documents whose log weight is at least
that of all but ``miss`` of the held-out ones.

Bounds: at most ``max_labels`` labelled documents, those with the smallest hash,
are used as the target; their ids are sent to all tasks. The model has a fixed
number of buckets. Raw counts come from every document.

Defined results: a document without words (null, empty, white space) has no log
weight and is never kept; equal keys are told apart by a second hash, and rows that agree in
doc_id and text are kept or lost together; a text of any length is counted and scored whole; null
ids and labels are left out of the target; columns other than doc_id and text are not looked at
by :func:`classify` and kept as they are by :func:`keep`; without trusted labels and budget every
document with words is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 20
LENGTH = 256  #: n-grams of the document that log weights are scaled to: the temperature of the sampling
SMOOTH = 5.0  #: added to each bucket's counts, both on the scale of the target model
PRIOR = 20  #: n-grams of ratio one that every document has besides its own


def buckets(data: bytes, order: int, size: int) -> np.ndarray:
    """The bucket of every n-gram of a text, in order."""
    words = data.split()
    h = xxhash.xxh64_intdigest
    if order > 1:
        words = [b" ".join(words[i : i + order]) for i in range(len(words) - order + 1)]
    return np.array([h(w) % size for w in words], np.int64)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _count(target: np.ndarray, order: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, trusted = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            mine = np.isin(ids, target)
            for text, hit in zip(_texts(batch.column(1)), mine):
                b = buckets(text, order, size)
                np.add.at(raw, b, 1)
                if hit:
                    np.add.at(trusted, b, 1)
        at = np.flatnonzero(raw)
        for i in range(0, len(at), 100_000):
            part = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(raw[part]), pa.array(trusted[part])], ["bucket", "raw", "trusted"])

    return run


class Model:
    """Log ratios by bucket, and how documents are hashed."""

    def __init__(self, ratio: np.ndarray, order: int):
        self.ratio, self.order = ratio, order

    def log_weight(self, text: bytes) -> float:
        b = buckets(text, self.order, len(self.ratio))
        return float(self.ratio[b].sum(dtype=np.float64)) * LENGTH / (len(b) + PRIOR) if len(b) else -math.inf


def trusted_ids(labels: DataFrame, max_labels: int) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids of trusted documents: for the target model, and held out. max_labels at most."""
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct()
    some = good.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(max_labels).toArrow()
    ids, fold = some.column("id").to_numpy(), some.column("h").to_numpy() % 5
    return np.sort(ids[fold != 0]), np.sort(ids[fold == 0])


def fit(docs: DataFrame, target: np.ndarray, order: int = 1, size: int = BUCKETS) -> Model:
    """Count both models over all documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    counted = common.map_arrow(rows, _count(target, order, size), "bucket long, raw long, trusted long")
    # one row for each bucket at most
    got = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toArrow()
    raw, trusted = np.zeros(size), np.zeros(size)
    at = got.column("bucket").to_numpy()
    raw[at], trusted[at] = got.column("raw").to_numpy(), got.column("trusted").to_numpy()
    share = trusted.sum() / raw.sum() if raw.sum() else 0.0
    return Model(np.log((trusted + SMOOTH) / (raw * share + SMOOTH)).astype(np.float32), order)


def gumbel(noise: np.ndarray) -> np.ndarray:
    """Gumbel noise from 64-bit hashes."""
    u = ((noise.view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    return -np.log(-np.log(u))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = np.array([model.value.log_weight(t) for t in _texts(batch.column(1))], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w), pa.array(w + gumbel(batch.column(2).to_numpy())), batch.column(3)], ["doc_id", "log_weight", "sample_key", "tie"])

    return run


def _noise(docs: DataFrame, seed: int):
    return F.xxhash64(docs["doc_id"], common.text_of(docs), F.lit(seed))


def _tie(docs: DataFrame, seed: int):
    """What tells equal sample keys apart: 62 bits, so that differences are longs too."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), common.text_of(docs), docs["doc_id"]), 2)


def scored(docs: DataFrame, model, seed: int) -> DataFrame:
    """doc_id, log_weight, sample_key and tie of every row; model is a broadcast Model of fixed size."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _noise(docs, seed).alias("noise"), _tie(docs, seed).alias("tie"))
    return common.map_arrow(rows, _score(model), "doc_id long, log_weight double, sample_key double, tie long")


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 4096, exact: int = 20_000) -> tuple[float, int]:
    """The k-th largest value, and how many of the rows that have it belong to the k, by histograms of ever narrower ranges.

    No more than ``exact`` values are fetched.
    """
    x = F.col(column)
    low, high, n = rows.agg(F.min(x), F.max(x), F.count(x)).first()
    if n == 0 or k <= 0:
        return math.inf, 0
    k = min(k, n)
    whole, inside = isinstance(low, int), rows
    while n > exact and low < high:
        width = max(1, -(-(high - low + 1) // bins)) if whole else (high - low) / bins
        if not whole and (width == 0 or low + width == low):
            # a few neighbouring doubles: each is a bin of its own
            found = {r.v: r.n for r in inside.groupBy(x.alias("v")).agg(F.count("*").alias("n")).collect()}
            for v in sorted(found, reverse=True):
                if k <= found[v]:
                    return v, k
                k -= found[v]
        place = F.expr(f"(`{column}` - {low}L) div {width}L") if whole else F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        found = {r.b: (r.n, r.lo, r.hi) for r in inside.groupBy(place.cast("int").alias("b")).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect()}
        for b in sorted(found, reverse=True):
            if k <= found[b][0]:
                n, low, high = found[b]
                break
            k -= found[b][0]
        inside = rows.filter((x >= F.lit(low)) & (x <= F.lit(high)))
    if low == high:
        return low, k
    values = sorted((r[0] for r in inside.select(x).collect()), reverse=True)
    return values[k - 1], k - sum(v > values[k - 1] for v in values)


def cut(rows: DataFrame, k: int) -> tuple[float, int]:
    """The least sample key that is kept, and the least ``tie`` of rows that have just that key."""
    least, of_equals = kth_largest(rows, "sample_key", k)
    if least == math.inf:
        return least, 0
    return least, int(kth_largest(rows.filter(F.col("sample_key") == F.lit(least)), "tie", of_equals)[0])


def sampled(docs: DataFrame, labels: DataFrame, miss: float, max_labels: int, seed: int, order: int, rows: int | None = None):
    """The fitted model (broadcast), the scored rows, and the least sample key and tie that are kept (None: all of them)."""
    spark = docs.sparkSession
    target, held = trusted_ids(labels, max_labels)
    model = spark.sparkContext.broadcast(fit(docs, target, order))
    scores = common.materialize(scored(docs, model, seed), "importance")
    real = scores.filter(F.col("log_weight") > F.lit(-math.inf))
    if rows is None:
        ids = spark.createDataFrame([(int(i),) for i in held], "held_id long")
        # the held-out ids are bounded by max_labels
        known = [r[0] for r in real.join(F.broadcast(ids), real["doc_id"] == ids["held_id"]).select("log_weight").collect()] if len(held) else []
        if not known:
            return model, scores, None
        rows = real.filter(F.col("log_weight") >= F.lit(float(np.quantile(known, miss)))).count()
    return model, scores, cut(real, rows)


def classify(docs: DataFrame, labels: DataFrame, miss: float = 0.015, max_labels: int = 100_000, seed: int = 11, order: int = 1, rows: int | None = None) -> DataFrame:
    """doc_id, log_weight, sample_key and kept of every row. rows: how many to sample."""
    _, scores, least = sampled(docs, labels, miss, max_labels, seed, order, rows)
    words = F.col("log_weight") > F.lit(-math.inf)
    key = F.col("sample_key")
    kept = F.lit(True) if least is None else (key > F.lit(least[0])) | ((key == F.lit(least[0])) & (F.col("tie") >= F.lit(least[1])))
    return scores.select("doc_id", F.when(words, F.col("log_weight")).alias("log_weight"), F.when(words, key).alias("sample_key"), (kept & words).alias("kept"))


def _keep(model, least: tuple[float, int] | None, text: int, columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = np.array([model.value.log_weight(t) for t in _texts(batch.column(text))], np.float64)
            mask = w > -math.inf
            if least is not None:
                noise, tie = (batch.column(columns + i).to_numpy() for i in range(2))
                key = w + gumbel(noise)
                mask &= (key > least[0]) | ((key == least[0]) & (tie >= least[1]))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(mask)) for c in batch.columns[:columns]], batch.schema.names[:columns])

    return run


def keep(docs: DataFrame, labels: DataFrame, miss: float = 0.015, max_labels: int = 100_000, seed: int = 11, order: int = 1, rows: int | None = None) -> DataFrame:
    """The rows of docs that are sampled, with all their columns; no text is shuffled."""
    model, scores, least = sampled(docs, labels, miss, max_labels, seed, order, rows)
    common.drop(scores)
    noise, tie = common.unused(docs, "noise", "tie")
    run = _keep(model, least, docs.columns.index("text"), len(docs.columns))
    return common.map_arrow(docs.withColumns({noise: _noise(docs, seed), tie: _tie(docs, seed)}), run, docs.schema)
