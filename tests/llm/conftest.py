import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and long texts, repeats, near copies, short texts."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    base = [_prose(rng, words, 80) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(20 + i, base[0].replace(" ", "  " if i % 2 else " ", 1), "en", "s0", 1) for i in range(9)]
    for i in range(8):
        near = base[1].split()
        near[5 + i] = "changed"
        rows.append((40 + i, " ".join(near).upper() if i % 2 else " ".join(near), "de", None, None))
    rows += [
        (60, None, "en", "s1", None), (61, "", None, "s1", 0), (62, " \t\n ", "en", None, 4), (63, "one two", "en", "s2", 7), (64, "ONE TWO", "en", "s2", 7),
        (65, "a b c d e", None, None, 9), (66, "12 34 -- ..", "en", "s1", 9), (None, base[2], "en", "s1", 1), (None, None, None, None, None),
        (67, _prose(rng, words, 9000), "en", "s9", 1), (5, base[5], "en", "s2", len(base[5])), (68, "x " * 3000, "en", "s9", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with further columns whose names operators use inside."""
    df = spark.createDataFrame(odd_rows, SCHEMA).repartition(5)
    return df.selectExpr("*", "1 as id", "'x' as body", "2 as n", "'h' as h", "3 as size", "4 as digest", "5 as node", "6 as shuffled", "true as hot", "7 as slot")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
