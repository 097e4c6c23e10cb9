import random

import pytest
from pyspark.sql import functions as F

from tesserae.llm import decontaminate as D

ITEM = "Alice buys 12 apples and 7 pears at the old market, then Alice eats 7 of them with her friend Bob before 12 kg are sold for $30 today."
BENCH = [(1, ITEM, "x"), (2, "Wer hat die große Aufgabe mit dem kleinen roten Ball gelöst und warum hat er das so getan?", "x"), (3, "too short", "x"), (4, "1 2 3 4 5 6 7 8 9 10", "x"), (None, "this item has no id but many words in it", "x"), (5, None, "x"), (6, ITEM, "x")]
FILL = "some quite ordinary words that stand around here and do not matter at all "
DOCS = [
    (1, FILL + ITEM + " " + FILL),
    (2, FILL + ITEM.replace("Alice", "Carol").replace("12", "55").replace("7", "31").replace("kg", "lbs").replace("$30", "€8").replace("Bob", "Dave")),
    (3, FILL + ITEM.replace("Alice eats 7", "Zoe eats 9")),  # a name and a number stand for two values
    (4, FILL + " ".join(ITEM.split()[:12]) + " " + FILL),
    (5, FILL * 3),
    (6, "1 2 3 4 5 6 7 8 9 10 11 12 13"),
    (7, None),
    (8, ""),
    (None, "x " + ITEM),
    (9, "ist es so: " + BENCH[1][1].upper() + " oder nicht"),
    (10, "ist es so: " + BENCH[1][1] + " oder nicht"),
    (1, FILL + ITEM + " " + FILL),
    (11, FILL + ITEM.replace("Alice", "Carol") + " and again " + ITEM),
]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string, window string")


@pytest.fixture(scope="module")
def leaky(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("tid", F.lit("clash")).withColumn("item_id", F.lit(1))


def test_finds_copies_and_reparameterised(leaky, bench):
    got = {str(r.doc_id): (r.item_ids, r.n_other) for r in D.contaminated(leaky, bench).collect()}
    assert got == {"1": ([1, 6], 0), "2": ([1, 6], got["2"][1]), "None": ([1, 6], 0), "10": ([2], 0), "11": ([1, 6], 0)}
    assert got["2"][1] >= 5
    assert D.contaminated(leaky, bench).count() == 6  # the repeated row too


def test_shuffled_join_gives_the_same(leaky, bench):
    a, b = (sorted(map(str, D.matches(leaky, bench, broadcast_rows=n).collect())) for n in (0, 1000))
    assert a == b and a


def test_clean_keeps_all_columns(leaky, bench):
    out = D.clean(leaky, bench)
    assert out.columns == leaky.columns
    assert sorted(r.doc_id for r in out.collect()) == [3, 4, 5, 6, 7, 8, 9]


def test_templates_line_up(spark):
    text = "On 3 May Ann paid $4.50, 12 kg of 1,000 GB at 5% (iPhone X2) ÉTÉ été \x01 \x02 z 7m 8 mountains 9.1.2 $1"
    (r,) = spark.createDataFrame([(text,)], "t string").select(D.template(F.col("t")).alias("a"), D.filled(F.col("t")).alias("b")).collect()
    assert r.a == [w[0] if w[0] in "\x01\x02\x03" else w for w in r.b]
    assert "\x03kg" in r.b and "\x014.50" in r.b and "\x02ann" in r.b and "mountains" in r.b and "\x03m" in r.b


def test_texts_without_digits_give_the_same_words(spark):
    """A text's words are those that it has beside a number at its end."""
    r = random.Random(3)
    bits = ["word", "Word", "WORD", "iPhone", "É", "été", "ß", "Straße", "ﬁ", "ΑΣ", "Σ", "σας", "ǅ", "ǆ", "𝐀b", "İx", "ı", "e\u0301", "\u0301E", "日本", "x_y", "don't", "O'Neil", "a-B", "kg", "KG", "\n", "  ", ".", "$", "€", "12", "7kg", "\x02", "ŉ", "Ⅷ", "ⓐ"]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", " ", ", "]) for _ in range(r.randrange(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for folded in (False, True):
        longer = D.template(F.concat("t", F.lit(" ! 5")), folded)
        got = df.select("t", D.template(F.col("t"), folded).alias("a"), longer.alias("b")).collect()
        assert not [(x.t, x.a, x.b) for x in got if [*x.a, D.NUM] != x.b]


def test_empty(spark, leaky, bench, no_docs):
    assert D.contaminated(no_docs, bench).count() == 0
    assert D.contaminated(leaky, bench.limit(0)).count() == 0
    assert D.clean(leaky, bench.limit(0)).count() == len(DOCS)
