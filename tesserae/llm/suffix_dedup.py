"""Suffix dedup: bytes covered by a long string that an earlier document has too.

Every 50-byte string of a document belongs to the *run* of neighbouring strings
that share a minimizer: the least hash of the 24-byte strings inside them. Equal
strings have equal minimizers wherever they stand, so equal strings can only be
found among runs of one minimizer. That cuts the global suffix array into parts
that are sorted on their own:

0. Each distinct text is kept once, with its smallest doc_id, in a table bucketed by
   its MD5. Texts are shuffled this once; all later joins read the buckets.
1. Each text's minimizers go, as 32-bit values in packed blobs, to the parts
   their hash names. Parts answer with those that two different texts have, and
   mark the *hot* ones, which very many texts have.
2. Texts are read in batches. Equal byte strings of a batch's answered runs are
   merged, and go to the part of their minimizer with the least and the greatest
   doc_id that has them there; where they stand stays behind, beside the batch. Runs
   of hot minimizers are taken apart: each of their 50-byte strings goes by itself, as
   a 128-bit digest, to the part that the digest names, so no part holds a hot one.
3. In a part, the suffixes of all runs whose minimizer has several byte strings
   are sorted to 50 bytes: a multikey quicksort, by words of eight bytes, down to a
   shallow depth; blind tries order what is still equal there. Neighbours that are
   equal to the end get the least doc_id of them all. Batches are told of strings
   that have a smaller doc_id than their own greatest.
4. Each batch turns that into spans of its texts, spans are joined, and cut out.

Equal texts are worked on once, for their smallest doc_id; larger ones lose
everything if they have 50 bytes. The number of parts follows the bytes of the
input, so a part stays small; no part is ever dropped or capped. What parts send and
are sent has a row for a batch and part, not for a text or place.

Defined results: null texts are empty; rows with the same doc_id never remove
from each other, and repeated rows are judged alike; a row without doc_id neither
loses bytes nor removes any; of a tie the smallest doc_id keeps its bytes; a text of
any length is worked on whole, in one batch of its own if it is very long; columns
other than doc_id and text are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 50  #: of the strings that count
GRAM = 24  #: of the strings whose least hash is the minimizer
SHALLOW = 16  #: bytes that the multikey quicksort goes down to
PART_BYTES = 24 << 20  #: text for each part
BATCH_BYTES = 8 << 20  #: text worked on before blobs are sent
SORT_WINDOWS = 1 << 19  #: suffixes sorted at once, if one minimizer has no more
HOT = 1 << 14  #: texts from which a minimizer is taken apart

DIGEST = 16  #: bytes of what stands for a 50-byte string of a hot minimizer
_HOT_BIT = np.uint64(1 << 63)

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = [np.uint64(pow(0x100000001B3, 1 << i, 1 << 64)) for i in range(5)]


def _byte_table() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * _MIX
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


_TABLE = _byte_table()


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every 24-byte string, from hashes of 1, 2, 4, 8 and 16 bytes."""
    h = _TABLE[data]
    for i in range(3):
        n = 1 << i
        h = h[:-n] * _STEP[i] + h[n:]
    h = (h[:-8] * _STEP[3] + h[8:])[: len(h) - 16] * _STEP[3] + h[16:]
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[: len(h) - (width - done)], h[width - done :]) if done < width else h


def runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, first and one past the last start of each run of 50-byte strings."""
    if len(data) < LENGTH:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none, none
    least = sliding_min(gram_hashes(np.frombuffer(data, np.uint8)), LENGTH - GRAM + 1)
    edge = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[edge], edge, np.append(edge[1:], len(least))


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Upper bits name the part; lower bits are what is sent."""
    return ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(edge[1:] > edge[:-1]):
        yield int(p), order[edge[p] : edge[p + 1]]


def _batched(rows: Iterator[tuple], size) -> Iterator[list[tuple]]:
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += size(r)
        if n >= BATCH_BYTES:
            yield held
            held, n = [], 0
    if held:
        yield held


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):  # a batch may hold very long texts: not all of them twice
            yield from zip(*[c.to_pylist() for c in batch.slice(i, 256).columns])


def run_keys(h: np.ndarray, parts: int) -> np.ndarray:
    """What a minimizer is known by: its part and its lower 32 bits. The top bit is free."""
    return (part_of(h, parts).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


# 1: which minimizers do two texts have?


def _offer(parts: int):
    kind = pa.schema([("part", pa.int32()), ("texts", pa.binary()), ("counts", pa.binary()), ("low", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _batched(_rows(batches), lambda r: len(r[1])):
            found = [np.unique(runs(text)[0]) for _, text in some]
            h = np.concatenate(found)
            owner = np.repeat(np.arange(len(found), dtype=np.uint32), [len(f) for f in found])
            out = {f.name: [] for f in kind}
            for p, at in _by_part(part_of(h, parts), parts):
                who, n = np.unique(owner[at], return_counts=True)
                out["part"].append(p)
                out["texts"].append(b"".join(some[i][0] for i in who))
                out["counts"].append(n.astype(np.uint32).tobytes())
                out["low"].append(h[at].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_pydict(out, kind)

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each part; they come sorted by part."""
    now, held = None, []
    for r in _rows(batches):
        if r[0] != now and held:
            yield now, held
            held = []
        now = r[0]
        held.append(r[1:])
    if held:
        yield now, held


_ANSWER = pa.schema([("bucket", pa.int32()), ("texts", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])


def _answer(buckets: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in _groups(batches):
            ids, owner, low = {}, [], []
            for texts, counts, some in blobs:
                local = np.array([ids.setdefault(texts[i : i + 16], len(ids)) for i in range(0, len(texts), 16)], np.int64)
                owner.append(np.repeat(local, np.frombuffer(counts, np.uint32)))
                low.append(np.frombuffer(some, np.uint32))
            owner, low = np.concatenate(owner), np.concatenate(low)
            order = np.lexsort((owner, low))
            owner, low = owner[order], low[order]
            first = np.concatenate([[True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])])
            owner, low = owner[first], low[first]  # two minimizers may have one lower half
            edge = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
            n = np.diff(np.append(edge, len(low)))
            n = np.repeat(n, n)
            many = n > 1
            if not many.any():
                continue
            owner, n = owner[many], n[many]
            keys = (np.uint64(part) << np.uint64(32)) | low[many].astype(np.uint64)
            keys[n >= hot] |= _HOT_BIT
            names = list(ids)
            to = np.array([int.from_bytes(t[:8], "big") % buckets for t in names], np.int64)
            order = np.lexsort((owner, to[owner]))
            owner, keys = owner[order], keys[order]
            bucket = to[owner]
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            out = {f.name: [] for f in _ANSWER}
            for a, b in zip(edge[:-1], edge[1:]):
                who, count = np.unique(owner[a:b], return_counts=True)
                out["bucket"].append(int(bucket[a]))
                out["texts"].append(b"".join(names[i] for i in who))
                out["counts"].append(count.astype(np.uint32).tobytes())
                out["keys"].append(keys[a:b].tobytes())
            yield pa.RecordBatch.from_pydict(out, _ANSWER)

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text: its keys from all parts."""
    for _, blobs in _groups(batches):
        found: dict[bytes, list[bytes]] = {}
        for texts, counts, keys in blobs:
            ends = np.concatenate([[0], np.cumsum(np.frombuffer(counts, np.uint32), dtype=np.int64) * 8]).tolist()
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                found.setdefault(texts[16 * i : 16 * i + 16], []).append(keys[a:b])
        yield pa.RecordBatch.from_pydict({"tid": list(found), "keys": [b"".join(x) for x in found.values()]}, pa.schema([("tid", pa.binary()), ("keys", pa.binary())]))


# 2: the bytes of runs that may repeat

#: A row for each part that a batch sends to, and one for the batch's texts (part -1).
_SENT = {"batch": "binary", "part": "int", "texts": "binary", "firsts": "binary", "owner": "binary", "start": "binary", "which": "binary", "sizes": "binary", "hashes": "binary", "least": "binary", "most": "binary", "bytes": "binary"}
_MESSAGE = ["batch", "sizes", "hashes", "least", "most", "bytes"]
_PLACES = ["part", "texts", "firsts", "owner", "start", "which"]


def _schema(fields: dict[str, str]) -> pa.Schema:
    return pa.schema([(n, pa.int32() if t == "int" else pa.binary()) for n, t in fields.items()])


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields.items())


def _pack(some: list[tuple], parts: int) -> dict[str, list]:
    """Rows for one batch of (tid, first, text, keys)."""
    owner, hashes, start, span, heat = [], [], [], [], []
    for k, (_, _, text, keys) in enumerate(some):
        h, a, b = runs(text)
        mine, keys = run_keys(h, parts), np.frombuffer(keys, np.uint64)
        hot = np.isin(mine, keys[keys >= _HOT_BIT] ^ _HOT_BIT)
        m = hot | np.isin(mine, keys)
        owner.append(np.full(int(m.sum()), k, np.int64))
        hashes.append(h[m])
        start.append(a[m])
        span.append((b - a)[m])
        heat.append(hot[m])
    owner, hashes, start, span, heat = map(np.concatenate, (owner, hashes, start, span, heat))
    texts, strings, which = [r[2] for r in some], {}, []
    cold = np.flatnonzero(~heat)
    for k, s, n in zip(owner[cold].tolist(), start[cold].tolist(), span[cold].tolist()):
        which.append(strings.setdefault(texts[k][s : s + n + LENGTH - 1], len(strings)))
    p_owner, p_start, n_cold = [owner[cold]], [start[cold]], len(strings)
    minimizer = np.zeros(n_cold, np.uint64)
    minimizer[np.array(which, np.int64)] = hashes[cold]
    digest = xxhash.xxh3_128_digest
    for i in np.flatnonzero(heat).tolist():
        k, s, n = int(owner[i]), int(start[i]), int(span[i])
        text = texts[k]
        which += [strings.setdefault(digest(text[j : j + LENGTH]), len(strings)) for j in range(s, s + n)]
        p_owner.append(np.full(n, k, np.int64))
        p_start.append(np.arange(s, s + n))
    owner, start, which = np.concatenate(p_owner), np.concatenate(p_start), np.array(which, np.int64)
    names = list(strings)
    digests = np.frombuffer(b"".join(names[n_cold:]), ">u8")[::2].astype(np.uint64)
    to = part_of(np.concatenate([minimizer, digests]), parts)
    first = np.array([r[1] for r in some], np.int64)
    least, most = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.iinfo(np.int64).min)
    np.minimum.at(least, which, first[owner])
    np.maximum.at(most, which, first[owner])
    out = {f: [] for f in _SENT}

    def add(**row) -> None:
        for f in _SENT:
            out[f].append(row.get(f))

    batch, press = uuid.uuid4().bytes, zstandard.ZstdCompressor(level=1)
    add(batch=batch, part=-1, texts=b"".join(r[0] for r in some), firsts=first.tobytes())
    rank, of = np.zeros(len(names), np.int64), to[which]
    places = dict(_by_part(of, parts))
    size = np.array([len(x) for x in names], np.uint32)
    minimizer = np.concatenate([minimizer, np.zeros(len(digests), np.uint64)])
    for p, at in _by_part(to, parts):
        rank[at] = np.arange(len(at))
        here = places[p]
        here = here[np.argsort(which[here], kind="stable")]
        data = press.compress(b"".join([names[i] for i in at.tolist()]))
        add(batch=batch, part=p, owner=owner[here].astype(np.uint32).tobytes(), start=start[here].astype(np.uint32).tobytes(), which=rank[which[here]].astype(np.uint32).tobytes(), sizes=size[at].tobytes(), hashes=minimizer[at][size[at] != DIGEST].tobytes(), least=least[at].tobytes(), most=most[at].tobytes(), bytes=data)
    return out


def _send(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _batched(_rows(batches), lambda r: len(r[2])):
            yield pa.RecordBatch.from_pydict(_pack(some, parts), _schema(_SENT))

    return run


# 3: sort suffixes, find equal ones


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, side by side."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def multikey_quicksort(words: np.ndarray, group: np.ndarray) -> np.ndarray:
    """An order of strings by group, and in it by their words; words[d, i] is the d-th word of string i.

    Each round parts all open segments at once in three around a pivot of their own: smaller ones and greater
    ones stay at their depth, equal ones go one word deeper.
    """
    order = np.argsort(group, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1], [True]])) if len(order) else np.zeros(1, np.int64)
    low, size = edge[:-1], np.diff(edge)
    depth = np.zeros(len(low), np.int64)
    while True:
        keep = (size > 1) & (depth < len(words))
        low, size, depth = low[keep], size[keep], depth[keep]
        if not len(low):
            return order
        a, b, c = (words[depth, order[low + at]] for at in (np.zeros_like(size), size // 2, size - 1))
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
        at = _ranges(low, size)
        members = order[at]
        key, of = words[np.repeat(depth, size), members], np.repeat(pivot, size)
        kind = (key >= of).astype(np.int64) + (key > of)
        begin = np.cumsum(size) - size
        upto = np.stack([np.cumsum(kind == k) for k in range(3)])
        last = upto[:, begin + size - 1]
        count = last - np.concatenate([np.zeros((3, 1), np.int64), last[:, :-1]], axis=1)
        place = np.stack([low, low + count[0], low + count[0] + count[1]])
        segment = np.repeat(np.arange(len(low)), size)
        rank = upto[kind, np.arange(len(kind))] - 1 - (last - count)[kind, segment]
        order[place[kind, segment] + rank] = members
        low, size, depth = place.ravel(), count.ravel(), np.concatenate([depth, depth + 1, depth])


class BlindTrie:
    """Strings of one length by the places where they branch; equal strings share a leaf.

    A node is [place, {byte: child}], a leaf the number of an entry of ``leaves``: (string, members).
    """

    def __init__(self):
        self.root, self.leaves = None, []

    def add(self, s: bytes, member: int) -> None:
        if self.root is None:
            self.leaves.append((s, [member]))
            self.root = 0
            return
        at = self.root
        while type(at) is list:  # blind: only the branching bytes are looked at
            at = at[1].get(s[at[0]])
            if at is None:
                break
        probe = at if at is not None else self._any(s)
        found, members = self.leaves[probe]
        if found == s:
            members.append(member)
            return
        x = int.from_bytes(found, "big") ^ int.from_bytes(s, "big")
        place = len(s) - (x.bit_length() + 7) // 8  # where the two part
        self.leaves.append((s, [member]))
        leaf, at, up, key = len(self.leaves) - 1, self.root, None, None
        while type(at) is list and at[0] < place:
            up, key = at, s[at[0]]
            at = at[1][key]
        if type(at) is list and at[0] == place:
            at[1][s[place]] = leaf
            return
        node = [place, {found[place]: at, s[place]: leaf}]
        if up is None:
            self.root = node
        else:
            up[1][key] = node

    def _any(self, s: bytes) -> int:
        """A leaf below the node where the way for s ends."""
        at = self.root
        while type(at) is list:
            at = at[1].get(s[at[0]], next(iter(at[1].values())))
        return at

    def ordered(self) -> Iterator[list[int]]:
        """The members of each leaf, leaves in the order of their strings."""
        stack = [self.root] if self.leaves else []
        while stack:
            at = stack.pop()
            if type(at) is list:
                stack += [at[1][b] for b in sorted(at[1], reverse=True)]
            else:
                yield self.leaves[at][1]


def deep_shallow(data: bytes, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 50-byte strings that begin at ``at``, in order by group and then by themselves, and a number for each place of it, the same for equal ones."""
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    eight = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), 8)
    word = lambda d: np.ascontiguousarray(eight[at + d]).view(">u8").ravel().astype(np.uint64)
    words = np.stack([word(d) for d in range(0, SHALLOW, 8)])
    order = multikey_quicksort(words, group)
    new = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    for w in words:
        new[1:] |= w[order][1:] != w[order][:-1]
    # a group that is equal to the end needs no trie; the others are those with a place where neighbours differ
    parts = np.zeros(len(at), bool)
    for d in sorted({*range(SHALLOW, LENGTH - 7, 8), LENGTH - 8}):
        w = word(d)[order]
        parts[1:] |= w[1:] != w[:-1]
    edge = np.append(np.flatnonzero(new), len(at))
    mixed = np.add.reduceat(parts & ~new, edge[:-1]) > 0
    for a, b in zip(edge[:-1][mixed].tolist(), edge[1:][mixed].tolist()):
        trie, some = BlindTrie(), order[a:b]
        for i, place in zip(some.tolist(), at[some].tolist()):
            trie.add(data[place : place + LENGTH], i)
        i = a
        for members in trie.ordered():
            order[i : i + len(members)] = members
            new[i] = True
            i += len(members)
    return order, np.cumsum(new) - 1


_FOUND = {"batch": "binary", "part": "int", "string": "binary", "begin": "binary", "end": "binary", "earliest": "binary"}


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch: which of its strings have windows that a smaller doc_id than its greatest has, and whose."""
    unpress = zstandard.ZstdDecompressor()
    for part, messages in _groups(batches):
        strings, mapped, least, minimizer = {}, [], [], {}
        for _, sizes, hashes, low, _, data in messages:
            sizes = np.frombuffer(sizes, np.uint32)
            ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).tolist()
            data = unpress.decompress(data)
            to = np.array([strings.setdefault(data[a:b], len(strings)) for a, b in zip(ends[:-1], ends[1:])], np.int64)
            minimizer.update(zip(to[sizes != DIGEST].tolist(), np.frombuffer(hashes, np.uint64).tolist()))
            mapped.append(to)
            least.append(np.frombuffer(low, np.int64))
        n = len(strings)
        first = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(first, np.concatenate(mapped), np.concatenate(least))
        names = list(strings)
        del strings
        size = np.array([len(s) for s in names], np.int64)
        count = np.where(size == DIGEST, 1, size - (LENGTH - 1))
        base = np.concatenate([[0], np.cumsum(count)])
        earliest = np.repeat(first, count)
        # strings that share a minimizer with others: their suffixes are sorted
        own = np.flatnonzero(size != DIGEST)
        _, group, many = np.unique(np.array([minimizer[i] for i in own.tolist()], np.uint64), return_inverse=True, return_counts=True)
        shared = many[group] > 1 if len(own) else np.zeros(0, bool)
        own, group = own[shared], group[shared]
        order = np.argsort(group, kind="stable")
        own, group = own[order], group[order]
        # minimizers are sorted a few at a time, which bounds memory by the strings of one
        upto = np.cumsum(count[own])
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else np.zeros(1, np.int64)
        begin = 0
        while begin < len(edge) - 1:
            reach = (upto[edge[begin] - 1] if edge[begin] else 0) + SORT_WINDOWS
            end = max(begin + 1, int(np.searchsorted(upto[edge[begin + 1 :] - 1], reach, side="right")) + begin)
            mine, of = own[edge[begin] : edge[end]], group[edge[begin] : edge[end]]
            begin = end
            data = b"".join([names[i] for i in mine.tolist()])
            window = _ranges(base[mine], count[mine])
            at = _ranges(np.cumsum(size[mine]) - size[mine], count[mine])
            order, number = deep_shallow(data, at, np.repeat(of, count[mine]))
            first_of = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
            low = np.minimum.reduceat(earliest[window[order]], first_of)
            earliest[window[order]] = low[number]
        # pieces of equal value in each string
        new = np.zeros(len(earliest), bool)
        new[base[:-1]] = True
        new[1:] |= earliest[1:] != earliest[:-1]
        cut = np.flatnonzero(new)
        owner = np.searchsorted(base, cut, side="right") - 1
        value, begin = earliest[cut], cut - base[owner]
        end = np.append(cut[1:], len(earliest)) - base[owner]
        pieces = np.searchsorted(owner, np.arange(n + 1))
        smallest = np.minimum.reduceat(earliest, base[:-1])
        out = {f: [] for f in _FOUND}
        for to, (batch, _, _, _, most, _) in zip(mapped, messages):
            most = np.frombuffer(most, np.int64)
            hit = np.flatnonzero(smallest[to] < most)
            some = pieces[to[hit] + 1] - pieces[to[hit]]
            which, at = np.repeat(hit, some), _ranges(pieces[to[hit]], some)
            m = value[at] < most[which]
            which, at = which[m], at[m]
            if len(which):
                for f, x in (("batch", batch), ("part", part), ("string", which.astype(np.uint32).tobytes()), ("begin", begin[at].astype(np.uint32).tobytes()), ("end", end[at].astype(np.uint32).tobytes()), ("earliest", value[at].tobytes())):
                    out[f].append(x)
        yield pa.RecordBatch.from_pydict(out, _schema(_FOUND))


def _place(places: pa.Table, found: pa.Table) -> pa.Table:
    """One batch: spans of each of its texts, from the answers of all parts."""
    rows, answers = places.to_pylist(), {r["part"]: r for r in found.to_pylist()}
    (head,) = [r for r in rows if r["part"] < 0]
    first, texts, out = np.frombuffer(head["firsts"], np.int64), head["texts"], []
    for r in rows:
        if r["part"] in answers:
            a = answers[r["part"]]
            string, begin, end = (np.frombuffer(a[f], np.uint32).astype(np.int64) for f in ("string", "begin", "end"))
            earliest = np.frombuffer(a["earliest"], np.int64)
            owner, start, which = (np.frombuffer(r[f], np.uint32).astype(np.int64) for f in ("owner", "start", "which"))
            lo = np.searchsorted(string, which, side="left")
            n = np.searchsorted(string, which, side="right") - lo
            place, at = np.repeat(np.arange(len(which)), n), _ranges(lo, n)
            m = earliest[at] < first[owner[place]]
            place, at = place[m], at[m]
            out.append(np.stack([owner[place], start[place] + begin[at], start[place] + end[at] + LENGTH - 1], axis=1))
    all_ = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    all_ = all_[np.argsort(all_[:, 0], kind="stable")]
    edge = np.flatnonzero(np.concatenate([[True], all_[1:, 0] != all_[:-1, 0], [True]])) if len(all_) else np.zeros(1, np.int64)
    tids, spans = [], []
    for a, b in zip(edge[:-1], edge[1:]):
        k = int(all_[a, 0])
        tids.append(texts[16 * k : 16 * k + 16])
        spans.append(join_spans(all_[a:b, 1:]).astype(np.uint32).tobytes())
    return pa.table({"tid": pa.array(tids, pa.binary()), "spans": pa.array(spans, pa.binary())})


# 4: cut


def join_spans(spans: np.ndarray) -> np.ndarray:
    """Maximal spans of overlapping or touching ones."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    upto = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > upto[:-1]])
    return np.stack([spans[new, 0], upto[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], axis=1)


_CUT = "tid binary, spans array<struct<start:long,end:long>>, n_removed long, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("tid", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_removed", pa.int64()), ("kept", pa.binary())])
    for batch in batches:
        out = {f.name: [] for f in kind}
        for tid, text, blobs in zip(*[c.to_pylist() for c in batch.columns]):
            spans = join_spans(np.frombuffer(blobs, np.uint32).astype(np.int64).reshape(-1, 2)).tolist()
            edge = [0, *[x for s in spans for x in s], len(text)]
            out["tid"].append(tid)
            out["spans"].append([{"start": a, "end": b} for a, b in spans])
            out["n_removed"].append(sum(b - a for a, b in spans))
            out["kept"].append(b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2])))
        yield pa.RecordBatch.from_pydict(out, kind)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        sha = [hashlib.sha256(x.as_py()).hexdigest() for x in batch.column(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in batch.column(1)], pa.int64()), batch.column(2), pa.array(sha)], ["tid", "n_spans", "n_removed", "kept_sha256"])


def _texts(docs: DataFrame) -> DataFrame:
    text = common.text_of(docs).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("tid"), text.alias("text"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """tid, first (its smallest doc_id) and text of each distinct text that has a doc_id and 50 bytes, written once, bucketed by tid."""
    rows = _texts(docs).filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    return common.bucketed(rows.groupBy("tid").agg(F.min("doc_id").alias("first"), F.first("text").alias("text")), "tid", "dedup-texts")


def repeated(texts: DataFrame, total_bytes: int, hot: int = HOT) -> DataFrame:
    """tid and packed spans of what an earlier document has, one row for each text that loses bytes. texts: what :func:`distinct_texts` gave."""
    n = common.conf_int(texts.sparkSession, "spark.sql.shuffle.partitions", 200)
    parts = max(n, -(-total_bytes // PART_BYTES))
    offers = common.map_arrow(texts.select("tid", "text"), _offer(parts), "part int, texts binary, counts binary, low binary")
    answers = common.map_arrow(offers.repartitionById(parts, F.col("part")).sortWithinPartitions("part"), _answer(parts, hot), "bucket int, texts binary, counts binary, keys binary")
    keys = common.map_arrow(answers.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket"), _gather, "tid binary, keys binary")
    keys = common.materialize(keys, "shared-minimizers")
    wanted = texts.join(keys, "tid").select("tid", "first", "text", "keys")
    sent = common.materialize(common.map_arrow(wanted, _send(parts), _ddl(_SENT)), "dedup-sent")
    common.drop(keys)
    messages = sent.filter("part >= 0").select("part", *_MESSAGE).repartitionById(parts, F.col("part")).sortWithinPartitions("part")
    found = common.map_arrow(messages, _find, _ddl(_FOUND))
    places = sent.select("batch", *_PLACES)
    out = places.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(_place, "tid binary, spans binary")
    out = common.materialize(out, "repeated")
    common.drop(sent)
    return out


def _with_spans(docs: DataFrame, total_bytes: int, hot: int) -> DataFrame:
    """tid, text and the packed spans of each distinct text that loses bytes."""
    texts = distinct_texts(docs)
    return texts.join(repeated(texts, total_bytes, hot), "tid").select("tid", "text", "spans")


def _total(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length(common.text_of(docs)))).first()[0] or 0


def cut(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """tid (MD5 of the text), spans removed, bytes removed and what is kept, for each distinct text that loses bytes in the document with its smallest doc_id."""
    return common.map_arrow(_with_spans(docs, _total(docs), hot), _cut, _CUT)


def measure(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    rows = _texts(docs).select("doc_id", "tid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    rows = common.materialize(rows, "dedup-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    lost = common.map_arrow(_with_spans(docs, total, hot), _digest, "tid binary, n_spans long, n_removed long, kept_sha256 string")
    first = rows.groupBy("tid").agg(F.min("doc_id").alias("first"))
    known = common.materialize(first.join(lost, "tid", "left"), "dedup-known")
    all_ = rows.join(known, "tid")
    copy = F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= LENGTH), F.lit(False))
    some = F.col("doc_id").isNotNull() & F.col("n_removed").isNotNull()
    return all_.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).when(some, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).when(some, F.col("n_spans")).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).when(some, F.col("kept_sha256")).otherwise(F.col("sha")).alias("kept_sha256"),
    )
