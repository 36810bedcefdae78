"""Folding against Python's Unicode data: every code point, and random runs of letters and marks."""

import random
import sys
import unicodedata

from pyspark.sql import functions as F

from turnstone.functions import plates
from turnstone.functions.unicode import nfkc, nfkd, strip_marks


def known():
    return [c for c in map(chr, range(1, sys.maxunicode + 1)) if unicodedata.category(c) not in ("Cs", "Cn")]


def test_every_code_point(spark):
    chars = known()
    texts = ["\n".join(chars[k : k + 64]) for k in range(0, len(chars), 64)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", nfkc(F.col("t")).alias("c"), nfkd(F.col("t")).alias("d")).collect()
    assert len(chars) > 140_000
    assert all((r.c, r.d) == (unicodedata.normalize("NFKC", r.t), unicodedata.normalize("NFKD", r.t)) for r in rows)


def test_marks_are_ordered_and_composed(spark):
    draw = random.Random(9)
    marks = [c for c in known() if unicodedata.combining(c)]
    odd = [c for c in known() if unicodedata.decomposition(c)]
    letters = "aeiouAEIOUnkzو يﻻ가각한ก"
    texts = [None, "", "plain"] + ["".join(draw.choice((letters, marks, odd)[draw.randint(0, 2)]) for _ in range(draw.randint(1, 12))) for _ in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", nfkc(F.col("t")).alias("c"), nfkd(F.col("t")).alias("d")).collect()
    for r in rows:
        assert (r.c, r.d) == ((None, None) if r.t is None else (unicodedata.normalize("NFKC", r.t), unicodedata.normalize("NFKD", r.t)))


def test_keys_meet(spark):
    pairs = [("①②-a-⑤", "12-A-5"), ("𝟏𝟐-𝐀-𝟓", "12-A-5"), ("12-ؤ-5", "12-ؤ-5"), ("１２－Ａ－５", "12-A-5")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        plates.normalize_plate(F.col("a")).alias("a"), plates.normalize_plate(F.col("b")).alias("b"), strip_marks(F.lit("Çậ ﷺ")).alias("s")).collect()
    assert all(r.a == r.b for r in rows) and rows[0].s.startswith("Ca ")
