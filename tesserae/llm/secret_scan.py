"""Secret scans: Aho-Corasick keywords, anchored patterns near hits, then checksums.

One automaton over all keywords runs once over the lower-cased bytes of a text
and gives the few places where a secret may begin. A pattern is matched there,
anchored, on the original bytes. Hex strings have no keyword: every 4th byte is
looked at, and only a text with eight hex digits in a row among those, as any run
of 32 must have, is matched against the pattern.

Kinds with an embedded checksum or structure are reported only if it holds:
``github`` and ``npm`` tokens end in the base-62 CRC-32 of the part before, and
the head of a ``jwt`` must decode to JSON that names its algorithm.

Offsets count code points, ends are exclusive. Defined results: a null text is
an empty one and has no spans; repeated rows and null doc_ids are kept as they
are; spans that begin at one place are listed in the order of the kinds; a text of any length is
scanned whole; columns other than doc_id and text are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: In the order in which spans that begin at the same place are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
BASE = KINDS[:3]
SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"

_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")
_CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_KEYWORDS = {
    **{k: "assign" for k in ("password", "passwd", "secret", "token", "apikey", "api_key")},
    "akia": "access",
    **{k: "github" for k in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")},
    "npm_": "npm",
    "eyj": "jwt",
}
_IS_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))
_automaton = None


def automaton() -> ahocorasick.Automaton:
    """Built once in each Python worker."""
    global _automaton
    if _automaton is None:
        built = ahocorasick.Automaton()
        for word, kind in _KEYWORDS.items():
            built.add_word(word, (kind, len(word)))
        built.make_automaton()
        _automaton = built
    return _automaton


def crc_holds(body: bytes, check: bytes) -> bool:
    """Whether check is the CRC-32 of body in base 62, six digits with leading zeros."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out.encode() == check


def jwt_holds(head: bytes) -> bool:
    try:
        found = json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except ValueError:
        return False
    return isinstance(found, dict) and "alg" in found


def _matched(kind: str, data: bytes, at: int) -> tuple[int, bool]:
    """End of the match of kind that begins at a place, -1 for none, and whether it counts."""
    if kind == "assign":
        m = _ASSIGN.match(data, at)
        return (m.end(), m.end(1) - m.start(1) >= 8) if m else (-1, False)
    if kind == "access":
        m = _ACCESS.match(data, at)
        return (m.end(), m.end() - m.start() >= 16) if m else (-1, False)
    if kind == "jwt":
        m = _JWT.match(data, at)
        return (m.end(), jwt_holds(m[1])) if m else (-1, False)
    m = _CHECKED.match(data, at)
    return (m.end(), crc_holds(m[1], m[2])) if m else (-1, False)


def may_have_hex(data: bytes) -> bool:
    """False only if no run of 32 hex digits is there: such a run holds eight of every fourth byte."""
    hit = _IS_HEX[np.frombuffer(data, np.uint8)[3::4]]
    for step in (1, 2, 4):
        if len(hit) <= step:
            return False
        hit = hit[:-step] & hit[step:]
    return bool(hit.any())


def spans_of(data: bytes) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of one UTF-8 text, in code points, by start and then kind."""
    found, until = [], dict.fromkeys(KINDS, 0)
    hits = sorted((end - size + 1, kind) for end, (kind, size) in automaton().iter(data.lower().decode("latin-1")))
    for at, kind in hits:
        if at >= until[kind]:
            end, counts = _matched(kind, data, at)
            if end >= 0:
                until[kind] = end
                if counts:
                    found.append((at, KINDS.index(kind), end))
    if len(data) >= 32 and may_have_hex(data):
        found += [(m.start(), KINDS.index("hex"), m.end()) for m in _HEX.finditer(data)]
    if not found:
        return []
    found.sort()
    if not data.isascii():
        places = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        return [(KINDS[k], int(places[a]), int(places[b])) for a, k, b in found]
    return [(KINDS[k], a, b) for a, k, b in found]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the secret spans of every row."""
    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of(docs).cast("binary").alias("text")), _scan, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of what :func:`scan` found."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
