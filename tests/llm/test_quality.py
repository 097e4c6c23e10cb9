import re
from collections import Counter

import numpy as np
import pytest

from tesserae.llm import common, importance, quality_rules

W = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = W.findall(text)
    lines = [x for x in text.split("\n") if W.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


EXTRA = ["a b c d e a b c d e", "x x x x x x x", "a\nb\na\n\n \nb", "# * | & <é>", "p q r s t u p q r s t v p q r s t", "1 2 3 4 5 6 2 3 4 5 6 7"]


@pytest.fixture(scope="module")
def more(spark, rows):
    extra = [(1000 + i, t, "en", "a", 1, 1, 1, "x") for i, t in enumerate(EXTRA)]
    return [*rows, *extra]


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], int(r[0] % 4 != 0), int(r[0] % 7 == 0), 1) for r in rows if r[0] is not None and r[0] % 2 == 0] + [(None, 1, 0, 1), (6, 1, None, 2)], "doc_id long, quality int, toxic int, score int")


def test_base_rules(spark, docs, more, labels):
    df = spark.createDataFrame(more, docs.schema)
    out = quality_rules.judge(df, labels).collect()
    want = sorted((str(d), *base(t)) for d, t, *_ in more)
    assert sorted((str(o.doc_id), o.n_words, o.word_chars, o.n_symbols, o.n_dup_lines, o.n_repeat_words) for o in out) == want
    for o in out:
        assert o.base_failed == (o.n_words < 10 or 100 * o.n_repeat_words > 20 * o.n_words)
        assert o.kept is not None and not (o.kept and o.base_failed)


@pytest.mark.parametrize("order", [1, 2])
def test_scores(spark, docs, rows, labels, order):
    """Scores equal a plain count of words, where no two n-grams share a bucket."""
    known = quality_rules.trusted(labels, 1000)
    used = {r.t_id for r in known.collect() if r.fold != 0}
    raw, hits = Counter(), Counter()
    grams = lambda t: [" ".join(x) for x in zip(*[W.findall(t or "")[i:] for i in range(order)])]
    for d, t, *_ in rows:
        raw.update(grams(t))
        if d in used:
            hits.update(grams(t))
    share = sum(hits.values()) / sum(raw.values())
    ratio = {g: np.log((hits[g] + 5) / (raw[g] * share + 5)) for g in raw}
    size = 1 << 30
    out = quality_rules.measured(docs, quality_rules.weights(docs, known, order, size), order, size).collect()
    want = sorted((str(d), round(sum(ratio[g] for g in grams(t)) / (len(grams(t)) + 20), 6)) for d, t, *_ in rows)
    got = sorted((str(o.doc_id), round(o.score, 6)) for o in out)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert max(abs(g[1] - w[1]) for g, w in zip(got, want)) < 2e-6


def test_both_tell_trusted_from_junk(spark):
    good = [(i, " ".join(f"good{(i * 7 + j) % 50}" for j in range(48))) for i in range(200)]
    bad = [(1000 + i, " ".join(f"bad{(i * 7 + j) % 50}" for j in range(48))) for i in range(60)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)] + [(1000 + i, 0, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    for out in (quality_rules.judge(df, labels), importance.classify(df, labels)):
        kept = {r.doc_id for r in out.collect() if r.kept}
        assert len([k for k in kept if k < 1000]) >= 190 and not [k for k in kept if k >= 1000]


def test_importance_rows(spark, docs, rows, labels):
    out = importance.classify(docs, labels).collect()
    assert sorted(str(o.doc_id) for o in out) == sorted(str(r[0]) for r in rows)
    target, held = importance.trusted_ids(labels, 1000)
    raw, hits = Counter(), Counter()
    for d, t, *_ in rows:
        w = importance.buckets((t or "").encode(), 1, importance.BUCKETS).tolist()
        raw.update(w)
        if d in set(target.tolist()):
            hits.update(w)
    share = sum(hits.values()) / sum(raw.values())
    byid = {o.doc_id: o for o in out}
    for d, t, *_ in rows:
        w = importance.buckets((t or "").encode(), 1, importance.BUCKETS).tolist()
        if d is None:
            continue
        if not w:
            assert byid[d].log_weight is None and not byid[d].kept
        else:
            want = sum(np.log((hits[b] + 5) / (raw[b] * share + 5)) for b in w) * importance.LENGTH / (len(w) + 20)
            assert abs(byid[d].log_weight - want) < 1e-3
    kept = [o.sample_key for o in out if o.kept]
    lost = [o.sample_key for o in out if not o.kept and o.sample_key is not None]
    assert kept and min(kept) > max(lost, default=-1e9)
    staying = importance.keep(docs, labels)
    assert staying.columns == docs.columns
    assert sorted(str(r.doc_id) for r in staying.collect()) == sorted(str(o.doc_id) for o in out if o.kept)


def test_kth_largest(spark):
    import random

    r = random.Random(1)
    values = [r.gauss(0, 1) for _ in range(500)] + [0.25] * 40 + [1e9, -1e9]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 30, 250, 542):
        at = sorted(values, reverse=True)[k - 1]
        assert importance.kth_largest(df, "x", k, bins=4, exact=5) == (at, k - sum(v > at for v in values))
    ints = [r.randrange(1 << 62) for _ in range(300)] + [7] * 20
    df = spark.createDataFrame([(v,) for v in ints], "x long")
    for k in (1, 150, 305, 320):
        at = sorted(ints, reverse=True)[k - 1]
        assert importance.kth_largest(df, "x", k, bins=4, exact=5) == (at, k - sum(v > at for v in ints))


def test_exactly_k_of_equal_keys(spark):
    near = [1.0, float(np.nextafter(1.0, 2)), float(np.nextafter(1.0, 0))]
    df = spark.createDataFrame([(near[i % 3], i * 7919 % 1000) for i in range(900)], "sample_key double, tie long")
    for k in (1, 299, 300, 301, 450, 900):
        least, tie = importance.cut(df, k)
        assert df.filter(f"sample_key > {least!r}D or (sample_key = {least!r}D and tie >= {tie})").count() == k
    original = importance.kth_largest
    assert original(df, "sample_key", 450, exact=10) == original(df, "sample_key", 450)


def test_sampling_follows_the_weights(spark):
    """Kept sets differ by seed and from the noise-free ones, and inclusion is what the weights say."""
    words = [f"t{i}" for i in range(30)] + [f"r{i}" for i in range(30)]
    r = np.random.default_rng(5)
    rows = [(i, " ".join(r.choice(words[:30] if r.random() < (0.5 + 0.02 * (i % 7 - 3)) else words[30:]) for _ in range(150))) for i in range(400)]
    rows += [(1000 + i, " ".join(r.choice(words[:30] if r.random() < 0.53 else words[30:]) for _ in range(150))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1000 + i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    target, _ = importance.trusted_ids(labels, 1000)
    model = spark.sparkContext.broadcast(importance.fit(df, target))
    weight = {o.doc_id: o.log_weight for o in importance.scored(df, model, 0).collect()}
    ids = sorted(weight)
    w, k, seeds = np.array([weight[i] for i in ids]), 120, 12
    assert 0.3 < w.std() < 30
    kept = []
    for seed in range(seeds):
        out = importance.classify(df, labels, seed=seed, rows=k).collect()
        assert sum(o.kept for o in out) == k
        kept.append({o.doc_id for o in out if o.kept})
    plain = {ids[i] for i in np.argsort(-w)[:k]}
    assert len(set(map(frozenset, kept))) == seeds and all(s != plain for s in kept)
    freq = np.array([sum(i in s for s in kept) for i in ids]) / seeds
    u = np.random.default_rng(6).gumbel(size=(4000, len(ids))) + w
    want = np.mean(u >= np.sort(u, axis=1)[:, -k][:, None], axis=0)
    order = np.argsort(want)
    for part in np.array_split(order, 6):
        assert abs(freq[part].mean() - want[part].mean()) < 0.05
    assert 0.02 < want[order[len(ids) // 2]] < 0.98  # chance decides in the middle


def test_gumbel_samples_in_proportion():
    noise = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, (20_000, 3))
    w = np.log([1.0, 2.0, 5.0])
    first = np.argmax(w + importance.gumbel(noise.ravel()).reshape(-1, 3), axis=1)
    assert np.allclose(np.bincount(first) / 20_000, [1 / 8, 2 / 8, 5 / 8], atol=0.015)


def test_empty(spark, no_docs, labels):
    none = labels.limit(0)
    for a in (labels, none):
        assert quality_rules.judge(no_docs, a).count() == 0
        assert importance.classify(no_docs, a).count() == 0
        assert importance.keep(no_docs, a).count() == 0


def test_no_labels_keep_all(spark, docs, labels):
    out = importance.classify(docs, labels.limit(0)).collect()
    assert all(o.kept == (o.log_weight is not None) for o in out)
    assert all(o.kept == (not o.base_failed) for o in quality_rules.judge(docs, labels.limit(0)).collect())


def test_all_trusted_labels_are_used(spark, docs, monkeypatch):
    n, seen, real = 100_500, {}, common.materialize

    def kept(df, name):
        out = real(df, name)
        seen[name] = out
        return out

    monkeypatch.setattr(common, "materialize", kept)
    many = spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    quality_rules.judge(docs, many)
    assert seen["trusted"].count() == n
