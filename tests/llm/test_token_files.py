import random
import zlib

import numpy as np
import pytest

from tesserae.llm import common, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    r = random.Random(5)
    bits = [" ", "  ", "\n", " \n", "\t", "\xa0", "\x1c", "\x85", " ", "it's", "don't 've", "été", "日本語", "\U0001f600", "12345", "a", "word", "<|endoftext|>", "...", " ,", "\r\n", "　", "'s"]
    plain = ["word", "Été", "x1", "12", ", ", ". ", ".\n", "\n", " ", "it's", ",", ".", "no_w", "日本", "e\u0301", "\x01"]
    some = ["".join(r.choice(bits) for _ in range(r.randrange(0, 30))) for _ in range(4000)]
    some += ["".join(r.choice(plain) for _ in range(r.randrange(0, 12))) for _ in range(6000)]
    return some + ["", " ", "   ", " a", "a ", "a  b", "\n a", "\n", ",", "a\n", "\na", "a.b,c\nd", "3.14, 15.", "<|endoftext|>, a", "a. <|endoftext|>"]


def test_pieces_equal_whole_texts(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    texts = odd_texts()
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    for room in (400_000, 50):
        got = [np.frombuffer(b, "<u4").tolist() for b in token_files.Encoder(path, room).encode(texts)]
        assert got == want


def test_other_tokenizers_encode_whole_texts(path):
    from tokenizers import Tokenizer

    assert token_files.Encoder(path).by_pieces
    other = public_tokenizers.path("word_bpe_49k.json")
    t, mine = Tokenizer.from_file(other), token_files.Encoder(other)
    assert not mine.by_pieces
    texts = odd_texts()[::20]
    assert [np.frombuffer(b, "<u4").tolist() for b in mine.encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    made = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "model": {"type": "BPE"}}
    assert token_files.cuts_like_us(made)
    for key, value in (("normalizer", {"type": "NFC"}), ("pre_tokenizer", None), ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True}), ("model", {"type": "Unigram"}), ("truncation", {"max_length": 5})):
        assert not token_files.cuts_like_us({**made, key: value})


def test_files(spark, docs, rows, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    out = token_files.encoded(docs, path).collect()
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode()))
    want, at = [], 0
    for d, text, *_ in order:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((str(d), at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((str(o.doc_id), o.start, o.n_tokens, o.ids_crc32) for o in out) == sorted(want)


def test_layout(spark, docs, path):
    import glob

    import pyarrow.parquet as pq

    to = common.fresh_path(spark, "tokens-test")
    token_files.write(docs, to, path, partitions=2)
    files = glob.glob(to.removeprefix("file://") + "/*.parquet")
    column = pq.ParquetFile(files[0]).metadata.row_group(0)
    names = {column.column(i).path_in_schema: column.column(i) for i in range(column.num_columns)}
    ids = next(v for k, v in names.items() if k.startswith("ids"))
    assert any("DICTIONARY" in e for e in ids.encodings) and ids.has_offset_index
    assert "ids" not in token_files.read(spark, to, "doc_id long").schema.names


def test_empty(no_docs, path):
    assert token_files.encoded(no_docs, path).count() == 0
