import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, fp string"


def messy(seed=1, n=60):
    """Small documents with nulls, empty and long texts, copies, repeated rows and columns whose names clash."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Der", "été", "naïve.", "12", "kg", "x\ny", "\U0001f600"]
    rows = [
        (0, None, "en", "a", None, 1, 2, "x"),
        (1, "", "en", None, 0, 1, 2, "x"),
        (2, " \n\t ", None, "a", 4, None, None, None),
        (None, "no id here at all", "en", "b", 1, 1, 1, "y"),
        (3, "one", "en", "b", 3, 1, 2, "x"),
        (4, "one two", "en", "b", 7, 1, 2, "x"),
        (5, " ".join(r.choice(vocab) for _ in range(6000)), "en", "c", 1, 1, 2, "x"),
        (6, "copy of me " * 30, "en", "a", 1, 1, 2, "x"),
        (6, "copy of me " * 30, "en", "a", 1, 1, 2, "x"),
        (7, None, "en", "a", None, 1, 2, "x"),
    ]
    body = [r.choice(vocab) for _ in range(90)]
    for i in range(8, n):
        if i % 3 == 0:
            text = "copy of me " * 30
        elif i % 3 == 1:
            some = list(body)
            some[r.randrange(90)] = "edit%d" % i
            text = " ".join(some)
        else:
            text = " ".join(r.choice(vocab) for _ in range(r.randrange(1, 120)))
        rows.append((i, text, r.choice(["en", "de"]), r.choice(["a", "b", "c", "d", None]), len(text), 5, 1, "z"))
    return rows


@pytest.fixture(scope="session")
def rows():
    return messy()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
