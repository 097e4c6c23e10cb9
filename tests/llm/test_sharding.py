import zlib

import numpy as np

from tesserae.llm import sharding


def fewest(sizes, cap):
    n, held = 1, 0
    for s in sizes:
        if s > cap:
            return 10**9
        if held + s > cap:
            n, held = n + 1, 0
        held += s
    return n


def test_capacity_is_smallest():
    r = np.random.default_rng(0)
    for _ in range(30):
        size = r.integers(1, 50, r.integers(1, 40))
        k = int(r.integers(1, 10))
        ends = np.concatenate([[0], np.cumsum(size)])
        cap = sharding.smallest_capacity(k, ends, np.ones(len(size), bool), False)
        assert fewest(size, cap) <= k and (cap == 1 or fewest(size, cap - 1) > k)


def test_refined_cuts_equal_full_knowledge():
    r = np.random.default_rng(1)
    for _ in range(20):
        size = r.integers(1, 30, 200)
        whole = np.ones(200, bool)
        full, none = sharding.cut(7, size, whole, size)
        assert not none.any()
        ends = np.concatenate([[0], np.cumsum(size)])
        best = sharding.smallest_capacity(7, ends, whole, False)
        parts = np.diff(np.concatenate([[0], ends[full], [ends[-1]]]))
        assert parts.max() == best


def test_huge_groups_never_cost_capacity():
    """A group with a shard of its own: the largest shard is no larger than what a plain walk needs."""
    r = np.random.default_rng(3)
    for _ in range(200):
        size = r.integers(1, 30, int(r.integers(2, 60)))
        for _ in range(int(r.integers(0, 3))):
            size[int(r.integers(0, len(size)))] = int(r.integers(50, 3000))
        k = int(r.integers(1, 12))
        ends, whole = np.concatenate([[0], np.cumsum(size)]), np.ones(len(size), bool)
        starts, left = sharding.cut(k, size, whole, size)
        assert not left.any() and len(starts) <= k - 1 + (k == 1)
        parts = np.diff(np.concatenate([[0], ends[starts], [ends[-1]]]))
        assert parts.max() <= sharding.smallest_capacity(k, ends, whole, False) and parts.sum() == size.sum()


def test_many_pieces(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE_ROWS", 1)
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", 0)
    out = sharding.assign(docs, shards=3).collect()
    for s in range(3):
        assert sorted(o.slot for o in out if o.shard == s) == list(range(sum(o.shard == s for o in out)))
    assert len(out) == len(rows)


def test_rows(spark, docs, rows):
    for resolution, exact in ((1 << 14, 100_000), (4, 3)):  # the second splits ranges again and again
        out = sharding.assign(docs, shards=5, resolution=resolution, exact=exact).collect()
        assert len(out) == len(rows)
        want = sorted((d is None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
        assert sorted((o.doc_id is None, o.doc_id or 0, o["size"], o.text_crc32) for o in out) == want
        for s in range(5):
            slots = sorted(o.slot for o in out if o.shard == s)
            assert slots == list(range(len(slots)))
        homes = {}
        for o in out:
            homes.setdefault((o.text_crc32, o["size"]), set()).add(o.shard)
        assert all(len(x) == 1 for x in homes.values())
        assert len({o.shard for o in out}) == 5  # the huge group leaves no shard empty


def test_even_without_hot_groups(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "repeat(md5(cast(id as string)), 1 + cast(id % 5 as int)) as text")
    by = {r.shard: r.b for r in sharding.assign(df).groupBy("shard").sum("size").toDF("shard", "b").collect()}
    assert len(by) == 24 and max(by.values()) < 1.1 * sum(by.values()) / 24


def test_empty(no_docs):
    assert sharding.assign(no_docs).count() == 0


def test_many_ranges_of_one_group(spark):
    """About as many groups as ranges: most ranges hold one or two, and those to split do not lie side by side."""
    df = spark.range(12_000).selectExpr("id as doc_id", "repeat(md5(cast(id as string)), 1 + cast(id % 9 as int)) as text")
    rows = sharding.measured(df)
    groups = rows.groupBy("key").agg({"size": "sum"}).withColumnRenamed("sum(size)", "size").selectExpr("key", "size", "cast(conv(substring(key, 1, 15), 16, 10) as long) as prefix")
    got = sharding.find_cuts(groups, 24)
    known = sorted((r.key, r["size"]) for r in groups.collect())
    size = np.array([s for _, s in known])
    ends = np.concatenate([[0], np.cumsum(size)])
    starts = [next((i for i, (k, _) in enumerate(known) if k >= c), len(known)) for c in got]
    best = sharding.smallest_capacity(24, ends, np.ones(len(size), bool), False)
    assert int(np.diff(np.concatenate([[0], ends[starts], [ends[-1]]])).max()) == best
