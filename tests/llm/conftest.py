"""Odd inputs that every operator must take."""

import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long,"
    # names that operators use for columns of their own
    " score double, n_words long, failed long, size long, copies long, s array<long>, h long, id long,"
    " component_id long, w string, place int, line string, k long, body string, place_of string"
)
EXTRA = (0.5, 1, 2, 3, 4, [5], 6, 7, 8, "w", 9, "l", 10, "b", "p")


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta river stone house green water light".split()) + str(rng.randint(0, 99)) for _ in range(n))


def odd_rows():
    rng = random.Random(5)
    one = sentence(rng, 60)
    rows = [
        (1, one, "en", "a"),
        (2, one, "en", "a"),  # an exact copy
        (3, one.replace("alpha", "Alpha"), "en", "b"),  # equal but for case
        (4, None, "en", "b"),
        (5, "", None, "b"),
        (6, " \n\t \n", "de", None),
        (7, "a", "de", None),
        (8, "!!! ??? ...", "de", "c"),
        (9, "\n".join([sentence(rng, 12)] * 30), None, "c"),
        (10, sentence(rng, 20_000), "en", "c"),  # a very long text
        (11, "x" * 50_000, "en", "c"),  # a very long word
        (12, "Grüße aus Köln \U0001f600 " + sentence(rng, 30), "de", "c"),
        (13, sentence(rng, 80), "en", "d"),
        (13, sentence(rng, 80), "en", "d"),  # another row of the same id
        (None, sentence(rng, 10), "en", "d"),
        (14, one, "en", "d"),
        (14, one, "en", "d"),  # the same row twice
    ]
    return [(*r, len(r[1] or ""), *EXTRA) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
