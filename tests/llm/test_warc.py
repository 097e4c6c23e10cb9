import glob
import gzip
import hashlib

from pyspark.sql.datasource import EqualTo

from tesserae.llm import common, warc


def test_round_trip(spark):
    long = "<html>" + "é" * 60 + "\r\n\r\nWARC/1.1\r\n</html>"
    rows = [(1, "http://a/ b\r\nX: y", long, 5), (2, None, long, 5), (0, "u", "short", 5), (9, "u", "short", 5), (4, "u", None, 5), (5, "u", "", 5), (None, "u", long, 5), (1, "again", long, 5), (7, "u", "x" * 99, 5), (8, "u", "x" * 99, 5), (10, "u", "y" * 100, 5), (11, "u", "y" * 100, 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload long")
    got = sorted(map(str, map(tuple, warc.round_trip(df).collect())))
    want = []
    for p, _, h, _ in rows:
        b = (h or "").encode()
        same = [q for q, _, g, _ in rows if g == h and q is not None] if len(b) >= 100 else []
        first = min(same, default=None)
        again = p is not None and first is not None and p != first
        want.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(map(str, want))


def test_pushdown_skips_payloads(spark):
    df = spark.range(50).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat('z', 200 + cast(id % 2 as int)) as html")
    path = common.fresh_path(spark, "warc-test")
    warc.write(df, path)
    only = warc.read(spark, path).filter("warc_type = 'response'")
    assert sorted((r.page_id, len(r.payload)) for r in only.collect()) == [(0, 200), (1, 201)]
    assert warc.read(spark, path, "page_id long, warc_type string").filter("warc_type = 'revisit'").count() == 48
    reader = warc.WarcReader(spark.createDataFrame([], warc.SCHEMA).schema, {"path": path, "partitionbytes": "1"})
    assert list(reader.pushFilters([EqualTo(("warc_type",), "response"), EqualTo(("payload",), b"")])) == [EqualTo(("payload",), b"")]
    parts = reader.partitions()
    assert sum(len(p.files) for p in parts) >= 1 and all(len(p.files) == 1 for p in parts)
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 2 and reader.skipped == 48


def test_header_reads_are_small(spark):
    """Predicates on headers read and inflate little of large records, and none of what they skip."""
    df = spark.range(40).selectExpr("id as page_id", "concat('http://h/', id) as url", "array_join(transform(sequence(1, 6000), i -> sha2(concat(id, ':', i), 256)), '') as html")
    path = common.fresh_path(spark, "warc-large")
    warc.write(df.repartition(2), path)
    kind = lambda ddl: spark.createDataFrame([], ddl).schema
    heads = warc.WarcReader(kind("page_id long, payload_length long"), {"path": path, "bufferbytes": "4096"})
    total = sum(b - a for p in heads.partitions() for _, a, b in p.files)
    rows = [r for p in heads.partitions() for b in heads.read(p) for r in b.to_pylist()]
    assert len(rows) == 40 and {r["payload_length"] for r in rows} == {384000}
    assert total > 7_000_000 and heads.bytes_read < total / 20
    one = warc.WarcReader(kind(warc.SCHEMA), {"path": path, "bufferbytes": "4096"})
    list(one.pushFilters([EqualTo(("page_id",), 7)]))
    assert [len(r["payload"]) for p in one.partitions() for b in one.read(p) for r in b.to_pylist()] == [384000]
    assert one.bytes_read < total / 10 and one.skipped == 39


def test_files_are_cut_at_records(spark, monkeypatch):
    df = spark.range(300).selectExpr("id as page_id", "concat('http://h/', id) as url", "concat(repeat('ab', cast(id as int)), id) as html")
    path = common.fresh_path(spark, "warc-cut")
    warc.write(df.coalesce(1), path)
    for target in (1, 100, 3001, 20_000):
        reader = warc.WarcReader(spark.createDataFrame([], "page_id long, payload binary").schema, {"path": path, "partitionbytes": str(target)})
        parts = reader.partitions()
        rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert sorted(r["page_id"] for r in rows) == list(range(300))
        assert all(r["payload"] == b"ab" * r["page_id"] + str(r["page_id"]).encode() for r in rows)
        assert len(parts) > 1


def test_members_are_plain_gzip_and_long_records_have_several(spark):
    long = "".join(f"{i:x}-" for i in range(6_000_000))  # over two members
    df = spark.createDataFrame([(1, "u", "x" * 10), (2, "u", long), (3, "u", None)], "page_id long, url string, html string")
    path = common.fresh_path(spark, "warc-long")
    warc.write(df.coalesce(1), path)
    (name,) = glob.glob(path.removeprefix("file://") + "/part-*")
    raw = open(name, "rb").read()
    assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == 3 and raw.count(warc.MORE) == -(-len(long) // warc.MEMBER_BYTES) - 1
    reader = warc.WarcReader(spark.createDataFrame([], "page_id long, payload binary").schema, {"path": path, "partitionbytes": "1000000"})
    got = [(r["page_id"], r["payload"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(got) == [(1, b"x" * 10), (2, long.encode()), (3, b"")]
    heads = warc.WarcReader(spark.createDataFrame([], "page_id long").schema, {"path": path})
    assert [r["page_id"] for p in heads.partitions() for b in heads.read(p) for r in b.to_pylist()] == [1, 2, 3]


def test_other_archives(spark, tmp_path):
    record = lambda i: f"WARC/1.0\r\nWARC-Type: resource\r\nX-Page-ID: {i}\r\nContent-Length: 5\r\n\r\nblk{i:02d}\r\n\r\n".encode()
    (tmp_path / "a.warc").write_bytes(record(1) + record(2))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record(3)) + gzip.compress(record(4)))
    got = warc.read(spark, f"file://{tmp_path}").filter("warc_type = 'resource'").collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in got) == [(i, f"blk{i:02d}".encode()) for i in (1, 2, 3, 4)]


def test_file_systems_of_hadoop_only(spark, monkeypatch):
    df = spark.range(30).selectExpr("id as page_id", "'u' as url", "repeat('q', 90 + cast(id as int)) as html", "1 as payload")
    path = common.fresh_path(spark, "warc-far")
    warc.write(df, path)
    near = sorted(map(str, warc.read(spark, path).filter("payload_length > 100").collect()))
    monkeypatch.setattr(warc, "_known", lambda path: False)
    assert sorted(map(str, warc.read(spark, path).filter("payload_length > 100").collect())) == near and near
    assert warc.read(spark, path, "page_id long").count() == 30


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
