"""Operators held against slow programs that share no code with them."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash

from tesserae.llm import decontaminate, importance, quality_rules, secret_scan

LETTERS = r"\p{L}\p{M}"
UNITS = decontaminate.UNITS


def words_of(text, folded):
    """(outline, value) of every template word, by one walk over the text instead of replacements."""
    text = regex.sub("[\x01\x02\x03]", " ", text.upper() if folded else text)
    if folded:
        text = text.lower()
    units = sorted({u.lower() for u in UNITS} if folded else set(UNITS), key=list(dict.fromkeys(u.lower() if folded else u for u in UNITS)).index)
    number = r"[0-9]+(?:[.,][0-9]+)*"
    unit = "|".join(units)
    parts = [rf"(?P<sign>[$€£¥])\s?(?P<price>{number})", rf"(?P<n>{number})\s?(?P<u>{unit})(?![{LETTERS}])", rf"(?P<only>{number})", rf"(?P<w>[{LETTERS}]+)"]
    out = []
    for m in regex.finditer("|".join(parts), text):
        if m["sign"]:
            out += [("U", m["sign"].lower()), ("N", m["price"])]
        elif m["n"]:
            out += [("N", m["n"]), ("U", m["u"].lower())]
        elif m["only"]:
            out.append(("N", m["only"]))
        else:
            # a word is plain up to its first capital that no letter stands before
            w = m["w"]
            out.append(("A", w.lower()) if not folded and regex.match(r"\p{Lu}", w) else (w.lower(), w.lower()))
    return out


def found_in(doc, item, folded):
    """The share of an item's windows that a document holds, values included."""
    d, q = words_of(doc, folded), words_of(item, folded)
    win = lambda ws: [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    outline = lambda w: tuple(o for o, _ in w)
    mine = [(i, w) for i, w in enumerate(win(q)) if sum(o not in "NAU" for o, _ in w) >= 2]
    if not mine:
        return None
    all_ = {outline(w) for _, w in mine}
    have = defaultdict(list)
    for i, w in enumerate(win(d)):
        have[outline(w)].append((i, w))
    if len(all_ & set(have)) / len(all_) < 0.8:
        return 0.0
    lines = defaultdict(list)
    for i, w in mine:
        for j, v in have.get(outline(w), []):
            lines[j - i].append((i, w, v))
    sound = set()
    for pairs in lines.values():
        slots = {(i + k, a[1], b[1]) for i, w, v in pairs for k, (a, b) in enumerate(zip(w, v)) if a[0] in "NAU"}
        kind = {(i + k): a[0] for i, w, v in pairs for k, a in enumerate(w)}
        by = defaultdict(Counter)
        for at, a, b in slots:
            by[kind[at], a][b] += 1
        partner = {a: max(c, key=lambda x: (c[x], x == a[1], x)) for a, c in by.items()}
        for i, w, v in pairs:
            if all(a[1] == b[1] for a, b in zip(w, v)) or all(a[0] not in "NAU" or partner[a[0], a[1]] == b[1] for a, b in zip(w, v)):
                sound.add(outline(w))
    return len(sound) / len(all_)


def slow_contaminated(docs, bench):
    out = {}
    for d, text in docs:
        for q, item in bench:
            shares = [found_in(text or "", item or "", f) for f in (False, True)]
            if any(s is None for s in shares) and all(not s for s in shares):
                need = " ".join(v for _, v in words_of(item or "", True))
                if need and f" {need} " in f" {' '.join(v for _, v in words_of(text or '', True))} ":
                    out.setdefault(d, set()).add(q)
            elif max(s or 0.0 for s in shares) >= 0.8:
                out.setdefault(d, set()).add(q)
    return out


NAMES = ["Alice", "Bob", "Carol", "Dmitri", "Émile", "Fatima"]
PLAIN = "market apples train leaves station before walks every garden small boxes with and the buys sells river long counts money then".split()


def items(r, n):
    def one():
        out = []
        for _ in range(r.randrange(14, 30)):
            x = r.random()
            out.append(r.choice(NAMES) if x < 0.12 else str(r.randrange(2, 90)) if x < 0.22 else f"{r.randrange(2, 90)} kg" if x < 0.27 else f"${r.randrange(2, 90)}" if x < 0.3 else r.choice(PLAIN) + (r.choice(",.?") if r.random() < 0.1 else ""))
        return " ".join(out)

    return [(i, one()) for i in range(n)]


def renamed(r, text):
    """The text with other names and numbers, each throughout."""
    to = dict(zip(NAMES, r.sample(["Zoe", "Yuri", "Xenia", "Walt", "Vera", "Uma"], 6)))
    numbers = {}
    swap = lambda m: to.get(m[0]) or numbers.setdefault(m[0], str(100 + len(numbers) * 7 + r.randrange(7)))
    return regex.sub("|".join(NAMES) + r"|\d+", swap, text)


def test_contaminated_equals_brute_force(spark):
    r = random.Random(8)
    bench = [*items(r, 12), (50, "What is 12 + 7?"), (51, None), (52, "1 2 3 4 5 6 7"), (53, "?!")]
    fill = lambda: " ".join(r.choice(PLAIN + NAMES) for _ in range(r.randrange(0, 25)))
    docs = []
    for _, text in bench:
        t = text or ""
        words = t.split()
        for made in (t, t.upper(), renamed(r, t), " ".join(words[: int(len(words) * 0.9)]), " ".join(words[: len(words) // 2]), regex.sub(r"\d+", lambda m: str(r.randrange(2, 90)), t), " ".join(r.choice(PLAIN) if r.random() < 0.03 else w for w in words)):
            docs.append((len(docs), f"{fill()} {made} {fill()}"))
    docs += [(1000, None), (1001, ""), (1002, fill())]
    got = {x.doc_id: set(x.item_ids) for x in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), any_case=True).collect()}
    assert got == slow_contaminated(docs, bench)
    assert len(got) > 25 and len(got) < len(docs)


def test_recall_of_reparameterised_items(spark):
    r = random.Random(9)
    bench = items(r, 60)
    docs = [(q, " ".join(r.choice(PLAIN) for _ in range(20)) + " " + renamed(r, text) + " " + " ".join(r.choice(PLAIN) for _ in range(20))) for q, text in bench]
    clean = [(1000 + i, text) for i, text in items(r, 60)]
    got = {x.doc_id: x.item_ids for x in decontaminate.contaminated(spark.createDataFrame(docs + clean, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), any_case=True).collect()}
    assert sum(q in got.get(q, []) for q, _ in bench) >= 0.9 * len(bench)
    assert not [d for d in got if d >= 1000]


def test_share_of_just_four_fifths(spark):
    """Ten windows of an item, of which a document has eight or seven."""
    item = " ".join(f"word{chr(97 + i)}" for i in range(14))
    docs = [(1, " ".join(item.split()[:12])), (2, " ".join(item.split()[:11])), (3, item)]
    got = {x.doc_id: x.share for x in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"), any_case=True).collect()}
    assert got == {1: pytest.approx(0.8), 3: 1.0}


def test_very_long_text_is_looked_through(spark):
    item = "the miller keeps nine geese behind the old stone wall and feeds them barley every cold morning"
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(60_000))
    docs = [(1, long + " " + item), (2, long)]
    assert [x.doc_id for x in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"), any_case=True).collect()] == [1]
    secret = long + " password: hunter2hunter2 " + long
    (got,) = secret_scan.scan(spark.createDataFrame([(1, secret)], "doc_id long, text string")).collect()
    assert [(s.kind, s.start, s.end) for s in got.spans] == [("assign", len(long) + 1, len(long) + 25)]


SPACE = regex.compile(r"[^\x20\x09-\x0D]+")


def base_fails(words):
    five = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(five)
    covered = {i + j for i, w in enumerate(five) if n[w] > 1 for j in range(5)}
    return len(words) < 10 or 100 * len(covered) > 20 * len(words)


def quantile(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    lo, hi = math.floor(at), math.ceil(at)
    return values[lo] + (values[hi] - values[lo]) * (at - lo)


@pytest.fixture(scope="module")
def labelled(rows):
    r = random.Random(4)
    good, bad = [f"good{i}" for i in range(60)], [f"bad{i}" for i in range(60)]
    mixed = [(2000 + i, " ".join(r.choice(good if r.random() < p else bad) for _ in range(60))) for i, p in enumerate([0.95, 0.6, 0.4, 0.1] * 45)]
    docs = [(d, t) for d, t, *_ in rows] + mixed
    labels = [(2000 + i, int(i % 4 == 0), 0) for i in range(0, 180, 2)] + [(5, 1, 0), (8, 0, 1), (None, 1, 0)]
    return docs, labels


def test_quality_verdicts(spark, labelled):
    docs, labels = labelled
    size, miss = quality_rules.BUCKETS, 0.015
    bucket = lambda w: (lambda h: (h - (1 << 64) if h >> 63 else h) % size)(xxhash.xxh64_intdigest(w.encode(), 42))
    mark = lambda i: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42))
    trusted = {d for d, q, t in labels if q == 1 and t == 0 and d is not None}
    used, held = {d for d in trusted if mark(d) % 5}, {d for d in trusted if mark(d) % 5 == 0}
    raw, hits = Counter(), Counter()
    for d, t in docs:
        b = [bucket(w) for w in SPACE.findall(t or "")]
        raw.update(b)
        if d in used:
            hits.update(b)
    share = sum(hits.values()) / sum(raw.values())
    ratio = {b: math.log((hits[b] + 5) / (raw[b] * share + 5)) for b in raw}
    score = lambda t: (lambda ws: sum(ratio[bucket(w)] for w in ws) / (len(ws) + 20))(SPACE.findall(t or ""))
    least = quantile([score(t) for d, t in docs if d in held and SPACE.search(t or "")], miss)
    want = sorted((str(d), not base_fails(SPACE.findall(t or "")) and score(t) >= least - 1e-12) for d, t in docs)
    out = quality_rules.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sorted((str(o.doc_id), o.kept) for o in out) == want
    assert 30 < sum(k for _, k in want) < len(want) - 30


def test_importance_verdicts(spark, labelled):
    docs, labels = labelled
    seed, size = 11, importance.BUCKETS
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    long8 = lambda i: i.to_bytes(8, "little", signed=True)
    mark = lambda i: signed(xxhash.xxh64_intdigest(long8(i), 42))
    trusted = {d for d, q, t in labels if q == 1 and t == 0 and d is not None}
    used, held = {d for d in trusted if math.fmod(mark(d), 5) != 0}, {d for d in trusted if math.fmod(mark(d), 5) == 0}
    raw, hits = Counter(), Counter()
    of = lambda t: [xxhash.xxh64_intdigest(w) % size for w in (t or "").encode().split()]
    for d, t in docs:
        raw.update(of(t))
        if d in used:
            hits.update(of(t))
    share = sum(hits.values()) / sum(raw.values())
    ratio = {b: np.float32(math.log((hits[b] + 5) / (raw[b] * share + 5))) for b in raw}
    rows = []
    for d, t in docs:
        b = of(t)
        if b:
            w = float(sum(float(ratio[x]) for x in b)) * 256 / (len(b) + 20)
            h = 42  # hashes of several columns go on from one another; a null passes the hash on
            for part in ([] if d is None else [long8(d)]) + [(t or "").encode()]:
                h = xxhash.xxh64_intdigest(part, h)
            h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), h)
            u = ((h >> 11) + 0.5) / (1 << 53)
            rows.append((w - math.log(-math.log(u)), w, d, hashlib.md5((t or "").encode()).hexdigest()))
    floor = quantile([w for _, w, d, _ in rows if d in held], 0.015)
    k = sum(w >= floor for _, w, *_ in rows)
    want = Counter((str(d), m) for _, _, d, m in sorted(rows, key=lambda x: -x[0])[:k])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = Counter((str(o.doc_id), hashlib.md5((o.text or "").encode()).hexdigest()) for o in importance.keep(df, lab).collect())
    assert got == want or sum((got - want).values()) <= 1  # copies of a row at the edge stay together
    out = importance.classify(df, lab).collect()
    assert Counter(str(o.doc_id) for o in out if o.kept) == Counter(d for d, _ in got.elements())


def secrets(text):
    """Kinds with a checksum, by looking at every place of the text."""
    out = []
    import base64
    import json
    import zlib

    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    token = regex.compile(r"(gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
    at = 0
    for m in token.finditer(text):
        n, check = zlib.crc32(m[2].encode()), ""
        for _ in range(6):
            n, d = divmod(n, 62)
            check = digits[d] + check
        if check == m[3]:
            out.append(("npm" if m[1] == "npm" else "github", m.start(), m.end()))
    for m in regex.finditer(r"(eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", text):
        try:
            head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
        except ValueError:
            continue
        if isinstance(head, dict) and "alg" in head:
            out.append(("jwt", m.start(), m.end()))
    return out


def test_checked_secrets():
    import base64
    import zlib

    r = random.Random(12)
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

    def token(head, right=True):
        body = "".join(r.choice(digits) for _ in range(30))
        n, check = zlib.crc32(body.encode()), ""
        for _ in range(6):
            n, d = divmod(n, 62)
            check = digits[d] + check
        return f"{head}_{body}{check if right else check[::-1]}"

    b64 = lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")
    jwt = lambda head: f"{b64(head)}.{b64('{"sub":"1"}')}.sig-{r.randrange(1000)}"
    for _ in range(300):
        parts = [r.choice([token("ghp"), token("npm"), token("gho", False), token("ghs") + "x", jwt('{"alg":"none"}'), jwt('{"typ":"x"}'), "eyJ.eyJ.", "é words", "npm_", "ghp_" * 3]) for _ in range(r.randrange(0, 6))]
        text = r.choice([" ", "é", ";", ""]).join(parts)
        got = sorted((k, a, b) for k, a, b in secret_scan.spans_of(text.encode()) if k in ("github", "npm", "jwt"))
        assert got == sorted(secrets(text)), text
