import random

import pytest

SCHEMA = "doc_id long, text string, line string, score double, band long, n int, words string"


def rows(texts):
    """Rows with extra columns whose names the operators use inside."""
    return [(k, t, "x", 0.5, 7, 3, "y") for k, t in texts]


@pytest.fixture(scope="session")
def edge_texts():
    """(doc_id, text): nulls, empty and blank texts, a very long one, repeated rows, ties, near and exact copies."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7)))
    base = [word() for _ in range(120)]
    near = base[:]
    near[60] = "changed"
    far = base[:40] + [word() for _ in range(80)]
    long_ = [word() for _ in range(20_000)]
    one_line = " ".join(base[:55])
    return [
        (1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, None), (5, ""), (6, " \t\n "), (7, " ".join(base).upper()),
        (8, "one two"), (9, "one two"), (10, "one"), (None, " ".join(base)), (None, "a lone text without id here"), (None, None),
        (11, " ".join(long_)), (12, " ".join(long_[:-50])), (8, "one two"), (13, "é ü 日本語 \x1c z\U0001F600"),
        (14, one_line + "\n" + " ".join(word() for _ in range(12))), (15, "intro words stand here\n" + one_line + " tail"), (-3, " ".join(base)),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_texts):
    return spark.createDataFrame(rows(edge_texts), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
