import random

import numpy as np
import xxhash

from tesserae.llm import simhash


def slow(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    r = random.Random(2)
    for _ in range(200):
        t = " ".join(r.choice(["A", "b", "É", "c d", "\n", "Z9"]) for _ in range(r.randrange(0, 30)))
        assert simhash.fingerprint(simhash.hashes(t.encode(), 3, 42)) == slow(t)
    long = " ".join(r.choice("abcdefghij") for _ in range(40_000))
    assert simhash.fingerprint(simhash.hashes(long.encode(), 3, 42)) == slow(long)


def test_groups(spark, docs, rows):
    out = simhash.near_groups(docs).collect()
    fp = [(d, slow(t)) for d, t, *_ in rows]
    nodes = {f for _, f in fp}
    root = roots(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for d, f in fp:
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    want = sorted((str(d), f"{f:016x}", str(least.get(root[f]))) for d, f in fp)
    assert sorted((str(o.doc_id), o.fingerprint, str(o.component_id)) for o in out) == want
    assert len({o.component_id for o in out}) < len({o.fingerprint for o in out}) + 2


def test_links_span_every_pair(spark):
    r = np.random.default_rng(4)
    seeds = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    some = [int(s) for s in seeds]
    for s in seeds:
        x = int(s)
        for _ in range(30):  # chains of near fingerprints
            for b in r.choice(64, r.integers(1, 4), replace=False):
                x ^= 1 << int(b)
            some.append(x)
    nodes = sorted(set(some))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = roots(nodes, [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (a ^ b).bit_count() <= 3])
    df = spark.createDataFrame([(signed(n),) for n in nodes], "fp long")
    for tile, visitors in ((4096, 256), (3, 256), (3, 1), (4096, 2)):
        got = roots(nodes, [(r.u & (1 << 64) - 1, r.v & (1 << 64) - 1) for r in simhash.links(df, tile=tile, visitors=visitors).collect()])
        assert got == want


def test_components(spark):
    r = random.Random(6)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    want = roots({x for p in pairs for x in p}, pairs)
    got = {x.node: x.root for x in simhash.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert all(got.get(n, n) == want[n] for n in touched)


def test_empty(no_docs):
    assert simhash.near_groups(no_docs).count() == 0
