import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tesserae.llm import suffix_dedup as S


def slow(rows):
    """Brute force over all 50-byte strings."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - 49):
                w = b[i : i + 50]
                first[w] = min(d, first.get(w, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - 49):
                if first[b[i : i + 50]] < d:
                    gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((str(d), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def fast(spark, rows, hot=S.HOT):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((str(o.doc_id), o.n_bytes, o.n_removed, o.n_spans, o.kept_sha256) for o in S.measure(df, hot).collect())


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé") for _ in range(r.randrange(1, 8))) for _ in range(30)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages = [text(r.randrange(8, 40)) for _ in range(6)] + ["ab" * 60, "x" * 80, "exactly fifty bytes long, this one here, as it is!"]
    rows = []
    for i in range(70):
        t = text(r.randrange(0, 40))
        for _ in range(r.randrange(0, 4)):
            p = r.choice(passages)
            cut = r.randrange(0, 10)
            t = t[: r.randrange(0, len(t) + 1)] + p[cut:] + t[r.randrange(0, len(t) + 1) :]
        rows.append((i * 3 % 71, t))
    rows += [(200, rows[5][1]), (201, rows[5][1]), (-3, rows[9][1]), (202, None), (203, ""), (None, rows[5][1]), (None, text(60)), (204, rows[2][1] + "!"), (204, rows[2][1] + "!"), (204, rows[3][1] + "?"), (205, "x" * 49), (206, "x" * 50), (207, "x" * 400)]
    r.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    for seed in range(3):
        rows = corpus(seed)
        assert fast(spark, rows) == slow(rows)


@pytest.mark.parametrize("hot", [2, 4, 12])
def test_hot_minimizers_taken_apart(spark, hot):
    rows = corpus(5)
    assert fast(spark, rows, hot) == slow(rows)


def test_small_batches_and_parts(spark, monkeypatch):
    """Batches of a text or two, as on many executors; the packing itself is called here, not in the workers."""
    rows = [(d, hashlib.md5(t.encode()).digest(), t.encode()) for d, t in corpus(7) if d is not None and t and len(t.encode()) >= 50]
    first = {}
    for d, tid, text in sorted(rows):
        first.setdefault(tid, (d, text))
    parts, texts = 3, [(tid, d, text) for tid, (d, text) in sorted(first.items())]
    monkeypatch.setattr(S, "BATCH_BYTES", 300)
    monkeypatch.setattr(S, "SORT_WINDOWS", 40)
    batch = lambda rows, cols: [pa.RecordBatch.from_pydict({c: [r[i] for r in rows] for i, c in enumerate(cols)})]
    table = lambda bs: [r for b in bs for r in b.to_pylist()]
    for hot in (3, 1 << 14):
        offers = table(S._offer(parts)(iter(batch([(t, x) for t, _, x in texts], ["tid", "text"]))))
        answers = table(S._answer(2, hot)(iter(batch(sorted((o["part"], o["texts"], o["counts"], o["low"]) for o in offers), "abcd"))))
        keys = {r["tid"]: r["keys"] for r in table(S._gather(iter(batch(sorted((a["bucket"], a["texts"], a["counts"], a["keys"]) for a in answers), "abcd"))))}
        sent = table(S._send(parts)(iter(batch([(t, d, x, keys[t]) for t, d, x in texts if t in keys], "abcd"))))
        found = table(S._find(iter(batch(sorted((s["part"], *[s[f] for f in S._MESSAGE]) for s in sent if s["part"] >= 0), "abcdefg"))))
        spans = {}
        for b in {s["batch"] for s in sent}:
            left = pa.Table.from_pylist([s for s in sent if s["batch"] == b], S._schema(S._SENT))
            right = pa.Table.from_pylist([f for f in found if f["batch"] == b], S._schema(S._FOUND))
            spans.update({r["tid"]: np.frombuffer(r["spans"], np.uint32).reshape(-1, 2).tolist() for r in S._place(left, right).to_pylist()})
        assert len({s["batch"] for s in sent}) > 10
        starts = {}
        for _, d, x in texts:
            for i in range(len(x) - 49):
                starts[x[i : i + 50]] = min(d, starts.get(x[i : i + 50], d))
        for tid, d, x in texts:
            gone = np.zeros(len(x), bool)
            for i in range(len(x) - 49):
                if starts[x[i : i + 50]] < d:
                    gone[i : i + 50] = True
            mine = np.zeros(len(x), bool)
            for a, b in spans.get(tid, []):
                mine[a:b] = True
            assert (mine == gone).all()


def test_clashing_columns_and_long_text(spark):
    long = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
    rows = [(2, long, "a", b"x", 1), (1, "lead " + long[300_000:300_400] + " tail", "b", None, 2), (1, "lead " + long[300_000:300_400] + " tail", "b", None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tid string, spans binary, first int")
    got = {o.doc_id: (o.n_removed, o.n_spans) for o in S.measure(df).collect()}
    assert got == {1: (0, 0), 2: (400, 1)} and S.measure(df).count() == 3


def test_messy(spark, rows):
    few = [(d, t) for d, t, *_ in rows]
    assert fast(spark, few) == slow(few)


def test_every_window_is_in_one_run():
    r = random.Random(1)
    for n in (0, 49, 50, 51, 400):
        data = bytes(r.choice(b"ab ") for _ in range(n))
        h, a, b = S.runs(data)
        assert [i for x, y in zip(a, b) for i in range(x, y)] == list(range(max(0, n - 49)))


def test_deep_shallow_order():
    r = random.Random(2)
    data = ("".join(r.choice("ab") for _ in range(200)) * 4 + "q" * 50 + "a" * 130).encode()
    at = np.arange(len(data) - 49)
    group = np.array([r.randrange(2) for _ in at])
    order, number = S.deep_shallow(data, at, group)
    key = [(group[i], data[i : i + 50]) for i in order.tolist()]
    assert key == sorted(key) and sorted(order.tolist()) == at.tolist()
    assert [n for n in np.diff(number)] == [int(x != y) for x, y in zip(key[:-1], key[1:])]


def test_multikey_quicksort():
    r = random.Random(4)
    for n in (0, 1, 2, 700):
        words = np.array([[r.randrange(4) for _ in range(n)] for _ in range(3)], np.uint64).reshape(3, n)
        group = np.array([r.randrange(3) for _ in range(n)], np.int64)
        got = [(group[i], *words[:, i]) for i in S.multikey_quicksort(words, group).tolist()]
        assert got == sorted(got) and len(got) == n


def test_blind_trie():
    r = random.Random(3)
    for _ in range(50):
        t, want = S.BlindTrie(), {}
        for i in range(200):
            s = bytes(r.choice(b"ab") for _ in range(r.choice([6])))
            t.add(s, i)
            want.setdefault(s, []).append(i)
        assert sorted(t.leaves) == sorted(want.items())
        assert list(t.ordered()) == [want[s] for s in sorted(want)]


def test_cut_keeps_the_rest(spark):
    rows = [(1, "h " + "p" * 30 + "q" * 40), (2, "other " + "p" * 30 + "q" * 40 + " tail")]
    (got,) = S.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert bytes(got.kept) == b"other tail"[:5] + b" tail" and got.n_removed == 71


def test_empty(no_docs):
    assert S.measure(no_docs).count() == 0
