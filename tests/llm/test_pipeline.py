from collections import Counter

import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from tesserae.llm import common, importance, mixing, simhash

from test_simhash import roots, slow


def first_of_each(rows):
    """Brute force: the first row of each near-duplicate group."""
    nodes = {slow(t) for _, t in rows}
    root = roots(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 3])
    best = {}
    for d, t in rows:
        import hashlib

        key = (d is None, d or 0, hashlib.md5((t or "").encode()).hexdigest())
        r = root[slow(t)]
        if r not in best or key < best[r][0]:
            best[r] = (key, (d, t))
    return Counter(str(v[1]) for v in best.values())


def test_one_of_each(spark, docs, rows):
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    assert Counter(str((o.doc_id, o.text)) for o in out.collect()) == first_of_each([(r[0], r[1]) for r in rows])


def test_mixed_takes_what_mix_says(spark, docs):
    want = Counter()
    for o in mixing.mix(docs).collect():
        if o["size"]:
            want[(o.doc_id, o["size"])] += o.taken // o["size"]
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert Counter((o.doc_id, len((o.text or "").split())) for o in got.collect()) == +want


@pytest.fixture(scope="module")
def folder(spark, docs, rows, tmp_path_factory):
    to = "file://" + str(tmp_path_factory.mktemp("sf"))
    item = "one two three four five six seven eight nine ten eleven"
    extra = [(500 + i, f"lead in number{i} words " + item + f" tail{i * 7} word", "en", "a", 1, 1, 1, "x") for i in range(2)]
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).write.parquet(to + "/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(to + "/benchmark.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 9 != 0), 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(to + "/labels.parquet")
    return to


def test_run_equals_brute_force(spark, folder):
    docs = common.table(spark, folder, "documents")
    kept = importance.keep(docs, common.table(spark, folder, "labels")).collect()
    left = +first_of_each([(r.doc_id, r.text) for r in kept])
    byname = {str((r.doc_id, r.text)): r for r in kept}
    left = [byname[k] for k in left]
    left = [r for r in left if "one two three four five six seven eight nine ten eleven" not in (r.text or "")]
    some = spark.createDataFrame(left, docs.schema)
    want = Counter()
    for o in mixing.mix(some).collect():
        if o["size"]:
            want[str(o.doc_id)] += o.taken // o["size"]
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter(str(o.doc_id) for o in out) == +want
    for s in {o.shard for o in out}:
        assert sorted(o.slot for o in out if o.shard == s) == list(range(sum(o.shard == s for o in out)))
    assert not {"500", "501"} & {str(o.doc_id) for o in out}


def test_stages_keep_columns(spark, folder):
    docs = common.table(spark, folder, "documents")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes


def test_empty(spark, folder, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_columns_that_clash(spark, folder, docs):
    """Columns named as the stages name their own, and in other case, come through with their values."""
    names = ["mark", "Nth", "noise", "TIE", "tid", "taken_all", "taken_rows", "m_tid", "k_id", "own"]
    some = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    for n in names:
        some = some.withColumn(n, F.concat(F.lit(n + ":"), F.col("doc_id").cast("string")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, some, folder)
        assert after.columns == some.columns
        rows = after.collect()
        assert rows and all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in names)
