import re
from collections import defaultdict

from tesserae.llm import mixing


def level(sizes, weights, limit):
    total, open_ = sum(sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w > limit * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = limit * sizes[i]
            open_.discard(i)
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
    return out


def check(out, limit=3):
    by = defaultdict(list)
    for o in out:
        by[o.source].append(o)
    names = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    sizes = [sum(o["size"] for o in by[s]) for s in names]
    want = level(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], limit)
    for s, n, w in zip(names, sizes, want):
        longest = max(o["size"] for o in by[s])
        assert all(o.source_size == n and abs(o.target - w) < 1e-6 * max(1, w) for o in by[s])
        assert all(o.taken <= limit * o["size"] and (o["size"] == 0 or o.taken % o["size"] == 0) for o in by[s])
        assert abs(sum(o.taken for o in by[s]) - w) <= longest / 2 + 1


def test_rows(spark, docs, rows):
    out = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((o.doc_id is None, o.doc_id or 0, o["size"]) for o in out) == sorted((d is None, d or 0, size(t)) for d, t, *_ in rows)
    check(out)
    key = lambda o: (o.doc_id is None, o.doc_id or 0, o["size"], o.taken)
    assert sorted(map(key, out)) == sorted(map(key, mixing.mix(docs.repartition(7)).collect()))


def test_many(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source", "repeat('w ', 1 + cast(id % 50 as int)) as text")
    for bins in (4, 256):
        check(mixing.mix(df, bins=bins).collect())


def test_water_level_fills_small_sources(spark):
    df = spark.range(1000).selectExpr("id as doc_id", "if(id < 3, 'a', if(id < 10, 'b', 'c')) as source", "'w w w' as text")
    check(mixing.mix(df).collect())


def test_empty(no_docs):
    assert mixing.mix(no_docs).count() == 0
