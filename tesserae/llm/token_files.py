"""Token files: Parquet with a list column of token ids.

Ids are dictionary-encoded 32-bit integers in row groups and pages of controlled
size with column and offset indexes, beside metadata columns, so ids and metadata
can be read selectively. Rows lie in ascending order of doc_id across files; each
row has the number of the file it is in and the ids before it there, and a small
table of sums over files, read from the metadata columns alone, turns that into
its place in the whole.

Encoding goes by pieces: a text is cut where a space is followed by something
else than white space, and around single commas, full stops and line feeds, which are
boundaries of the byte-level pre-tokenizer however the text goes on, and each distinct piece is encoded by the tokenizers
library once for each worker while the tables of pieces and words have room.

A tokenizer file that cuts otherwise (another pre-tokenizer, a normalizer, added tokens that take white
space with them) is seen when it is loaded, and whole texts are encoded with it.

Defined results: a null text is an empty one, of which only the end id is
written; null doc_ids come first; rows that tie are in the order of their texts, and repeated rows each
have their ids; a text of any length is encoded whole; columns other than doc_id and text are not
written; an empty table gives empty files and no rows.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

END = 2
SCHEMA = "doc_id long, file int, before long, n_ids int, ids array<int>"
#: Parquet settings: row groups that a task can hold, pages small enough to be read alone.
LAYOUT = {"parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(2 << 20), "compression": "zstd"}
#: Pieces kept in a worker; beyond it, the half met last goes, which holds the rarer ones.
ROOM = 700_000
_ODD = re.compile(r" (?=\s|\Z)")
_CUT = re.compile(r" (?=\S)")
#: Marks a piece that no space begins.
_BARE = "\x01"
#: Where a comma, full stop or line feed may not stand alone between words.
_MESSY = re.compile(r"[^\w\s][^\w\s]|\s[^\w\s]|\s\s|[_\x01]")
#: The byte-level pre-tokenizer's pattern (fixed value).
_PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Classes of UTF-8 bytes: letters and digits, marks, white space, and what the expression above must decide.
_CLASS = bytes.maketrans(bytes(range(256)), bytes(ord("a" if chr(b).isalnum() and b < 128 or b == 0xC3 or 0x80 <= b < 0xC0 and b not in (0x97, 0xB7) else "?" if b >= 0x80 or b in (0x01, 0x5F) or 0x1C <= b < 0x20 else "s" if chr(b).isspace() else "p") for b in range(256)))
#: Words of characters whose class no version of the tables has changed; a zero byte stands between words.
_COMMON = re.compile("[\x01-\u024f]+")
#: How the byte-level alphabet writes each byte: as itself if it prints, else from 256 on.
_PRINTS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: chr(b) for b in _PRINTS} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTS)}
_loaded: dict[str, Encoder] = {}


def messy(text: str) -> bool:
    """Whether commas, full stops and line feeds may stand otherwise than alone between words."""
    seen = text.encode("utf-8", "surrogatepass").translate(_CLASS)
    if b"pp" in seen or b"sp" in seen or b"ss" in seen:
        return True
    return b"?" in seen and _MESSY.search(text) is not None


def cut(text: str) -> list[str]:
    """The pieces of a text: without the space that they begin with, or marked if none does.

    Where single commas, full stops and line feeds stand between words these are pieces of their own.
    """
    if not messy(text):
        parts = text.replace(",", " \x01,").replace(".", " \x01.").replace("\n", " \x01\n \x01").split(" ")
    else:
        parts = _CUT.split(text) if _ODD.search(text) else text.split(" ")
    if parts[0]:
        parts[0] = _BARE + parts[0]
        return parts
    return parts[1:]


def cuts_like_us(made: dict) -> bool:
    """Whether a tokenizer file cuts texts as ``_PRE`` does, and encodes each piece by itself: byte-level pairs and nothing around them."""
    cut_by, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
    plain = made.get("normalizer") is None and made.get("truncation") is None and made.get("padding") is None
    whole = model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    return plain and whole and cut_by.get("type") == "ByteLevel" and cut_by.get("add_prefix_space") is False and cut_by.get("use_regex", True) is True


class Encoder:
    """A tokenizer with a table of the pieces it has met.

    New pieces are split by the pre-tokenizer's pattern, and their words are encoded
    many at a time, as one text, of which the library says which word each id belongs to.
    """

    def __init__(self, path: str, room: int = ROOM):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer, self.room = Tokenizer.from_file(path), room
        self.pieces, self.words = {_BARE: b""}, {}
        self.single = Tokenizer.from_file(path)
        self.single.pre_tokenizer = Split(_BYTES[0], "removed")
        if hasattr(self.single.model, "_resize_cache"):
            self.single.model._resize_cache(0)  # it would be asked for new words only
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.special = [t.content for t in added]
        self.by_pieces = cuts_like_us(json.loads(self.tokenizer.to_str())) and not any(t.lstrip or t.rstrip or t.single_word or t.normalized or _CUT.search(t.content) or messy(t.content) and any(x in t.content for x in ",.\n ") for t in added)

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, words: list[str], lead: str = "", by: str = "\n") -> list[bytes]:
        """The ids of each word, with what leads it, many at a time."""
        out = []
        for i in range(0, len(words), 4000):
            some = words[i : i + 4000]
            if _COMMON.fullmatch("".join(some)):
                # cut at a mark between them, as they are single words by any version of the tables
                text = lead + ("\0" + lead).join(some)
                got = self.single.encode(text.encode().decode("latin-1").translate(_BYTES), add_special_tokens=False)
                every = 1
            else:
                # the library cuts them; joined by a line feed, every other word that it sees is one
                got = self.tokenizer.encode(by.join([lead + w for w in some]), add_special_tokens=False)
                every = 1 + len(by)
            of, raw = np.array(got.word_ids), np.array(got.ids, "<u4").tobytes()
            if of[-1] != every * (len(some) - 1):  # one of them was not one word after all
                out += [self._plain(lead + w) for w in some]
                continue
            edge = (np.searchsorted(of, np.arange(every * len(some) + 1)) * 4).tolist()
            out += [raw[a:b] for a, b in zip(edge[::every], edge[1::every])]
        return out

    def _learn(self, new: set[str]) -> None:
        """Put pieces into their table: words with a space before them at once, others by their parts."""
        alpha = list(filter(str.isalpha, new))
        self.pieces.update(zip(alpha, self._ids(alpha, " ", "")))
        whole, spaced, other = {}, set(), set()
        for key in new.difference(alpha):
            text = key[1:] if key[:1] == _BARE else " " + key
            if any(x in text for x in self.special):
                self.pieces[key] = self._plain(text)
                continue
            whole[key] = parts = _PRE.findall(text)
            for w in parts:
                if w[0] == " " and w[1:].isalpha():
                    if w[1:] not in self.pieces:
                        spaced.add(w[1:])
                elif w not in self.words:
                    if w.isspace():
                        self.words[w] = self._plain(w)
                    else:
                        other.add(w)
        for table, words, lead, by in ((self.pieces, list(spaced), " ", ""), (self.words, list(other), "", "\n")):
            table.update(zip(words, self._ids(words, lead, by)))
        for key, parts in whole.items():
            self.pieces[key] = b"".join([self.pieces[w[1:]] if w[0] == " " and w[1:].isalpha() else self.words[w] for w in parts])

    def _trim(self) -> None:
        if len(self.pieces) > self.room:
            self.pieces = dict(itertools.islice(self.pieces.items(), self.room // 2))
        if len(self.words) > self.room:
            self.words = dict(itertools.islice(self.words.items(), self.room // 2))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.by_pieces:
            return [self._plain(t) for t in texts]
        out = []
        for i in range(0, len(texts), 64):
            some = texts[i : i + 64]
            pieces = [cut(t) if _BARE not in t else [] for t in some]
            self._trim()
            self._learn(set().union(*pieces).difference(self.pieces))
            get = self.pieces.__getitem__
            done = [b"".join(map(get, c)) for c in pieces]
            for k, t in enumerate(some):
                if _BARE in t:
                    done[k] = self._plain(t)
            out += done
        return out


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _encode(path: str, end: int):
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tool, before = encoder(path), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                ids = [x + tail for x in tool.encode(part.column(2).to_pylist())]
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
                flat = np.frombuffer(b"".join(ids), "<i4")
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(before + ends[:-1], pa.int64()), pa.array(np.diff(ends), pa.int32()), lists], ["doc_id", "file", "before", "n_ids", "ids"])
                before += int(ends[-1])

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END, partitions: int | None = None) -> None:
    """Encode every text and write the ids in ascending order of doc_id."""
    spark = docs.sparkSession
    n = partitions or max(common.conf_int(spark, "spark.sql.shuffle.partitions", 200), 4 * spark.sparkContext.defaultParallelism)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of(docs).alias("text"))
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    marked = dealt.select("doc_id", F.spark_partition_id().alias("file"), "text")
    common.map_arrow(marked, _encode(tokenizer, end), SCHEMA).write.options(**LAYOUT).parquet(path)


def read(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """What :func:`write` wrote; a narrower schema reads no more than its columns."""
    return spark.read.schema(columns).parquet(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "file", "before", "n_tokens", "ids_crc32"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row of the files, from what they hold."""
    rows = common.map_arrow(read(spark, path), _digest, "doc_id long, file int, before long, n_tokens long, ids_crc32 long")
    sums = read(spark, path, "file int, n_ids int").groupBy("file").agg(F.sum("n_ids").alias("n"))
    # one row for each file
    base = sums.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the token files of docs into the shared folder and read their digest back."""
    spark = docs.sparkSession
    path = common.fresh_path(spark, "tokens")
    write(docs, path, tokenizer)
    return digest(spark, path)
