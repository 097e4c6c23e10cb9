"""Copies that the templates alone do not find."""

import pytest

import corpus_pipeline
from tesserae.llm import common, queries
from tesserae.llm import decontaminate as D

from test_decontaminate import BENCH, DOCS, FILL, ITEM


@pytest.fixture(scope="module")
def write(spark, tmp_path_factory):
    """A folder with documents and a benchmark."""

    def make(docs, bench):
        to = "file://" + str(tmp_path_factory.mktemp("sf"))
        spark.createDataFrame(docs, "doc_id long, text string").write.parquet(to + "/documents.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(to + "/benchmark.parquet")
        return to

    return make


def caught(spark, folder):
    """doc_id and items by op5, after the pipeline's stage is held against it."""
    docs = common.table(spark, folder, "documents")
    got = {r.doc_id: r for r in queries.op5_decontaminate(spark, folder).collect()}
    left = [r.doc_id for r in corpus_pipeline.decontamination(spark, docs, folder).collect()]
    assert sorted(map(str, left)) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id not in got)
    return got


def test_copies_in_any_case(spark, write):
    more = [(20, FILL + ITEM.upper()), (21, FILL + ITEM.lower()), (22, FILL + " ".join(ITEM.upper().split()[:12]) + " " + FILL), (23, FILL + ITEM.upper().replace("ALICE EATS 7", "ZOE EATS 9"))]
    got = caught(spark, write(DOCS + more, [b[:2] for b in BENCH]))
    # doc 9 is a copy in capitals; 3 and 23 have two values for one, 22 is a part
    assert {9, 10, 20, 21, 1, 2, 11, None} <= set(got) and not {3, 4, 5, 7, 8, 22, 23} & set(got)
    assert got[9].item_ids == [2] and got[20].item_ids == got[21].item_ids == [1, 6]
    assert got[9].share == got[20].share == 1.0 and got[20].n_other == 0


def test_any_case_shuffled_gives_the_same(spark):
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string, window string")
    a, b = (sorted(map(str, D.matches(docs, bench, broadcast_rows=n, any_case=True).collect())) for n in (0, 1000))
    assert a == b and a


def long_item():
    """Sixty words with the name The, Ann and the number 5 many times."""
    return " ".join(f"The {w}ling went by {w}ward with 5 {w}let and Ann {w}some" for w in ("bram", "cors", "dwel", "frim", "glon", "hask"))


@pytest.mark.parametrize("any_case", [False, True])
def test_one_deviating_value_costs_its_windows_only(spark, any_case):
    item = long_item()
    renamed = item.replace("Ann", "Eve").replace("5", "8")
    docs = [
        (1, FILL + item.replace("The dwelling", "This dwelling")),
        (2, FILL + item.replace("5 dwellet", "6 dwellet")),
        (3, FILL + renamed),
        (4, FILL + renamed.replace("8 dwellet", "9 dwellet")),  # other values, one of them not throughout
        (5, FILL + "".join(p if i % 2 else p.replace("5", str(20 + i)).replace("Ann", "Mr%s" % "abcdef"[i]) for i, p in enumerate(item.replace("some ", "some |").split("|")))),  # every other line has values of its own
    ]
    got = {r.doc_id: r for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"), any_case=any_case).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1].n_other == got[2].n_other == 1 and got[3].share == 1.0
    assert all(0.8 <= got[d].share < 1 for d in (1, 2, 4))


def test_items_without_a_window_are_found_in_full(spark, write):
    bench = [(1, "What is 12 + 7?"), (2, "1 2 3 4 5 6 7 8 9 10"), (3, "too short"), (4, "?!"), (5, None), (6, "Ann Bob"), (7, "What is 12 + 7?")]
    docs = [
        (1, FILL + "What is 12 + 7? " + FILL),
        (2, FILL + "WHAT IS 12 + 7"),
        (3, FILL + "What is 12 + 8? " + FILL),  # other values
        (4, "0 1 2 3 4 5 6 7 8 9 10 11"),
        (5, "1 2 3 4 5 6 7 8 9 11 10"),
        (6, "much too short, really"),
        (7, "too, very short"),
        (8, "Ann met Bob. Ann, Bob"),
        (9, "Joann Bob Ann Bobby"),
        (10, None),
        (11, "what is 112 + 7 and what is 12 + 71"),
        (12, "What is 12 + 7? too short"),
    ]
    got = caught(spark, write(docs, bench))
    assert {d: r.item_ids for d, r in got.items()} == {1: [1, 7], 2: [1, 7], 4: [2], 6: [3], 8: [6], 12: [1, 3, 7]}
    assert all(r.share == 1.0 and r.n_other == 0 for r in got.values())


def test_items_in_full_shuffled_give_the_same(spark):
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(BENCH[2:4], "item_id long, text string, window string")
    a, b = (sorted(map(str, D.matches(docs, bench, broadcast_rows=n, any_case=True).collect())) for n in (0, 1000))
    assert a == b and len(a) == 1
