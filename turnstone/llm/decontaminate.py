"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are A-Z lower-cased runs without ASCII separators. A document leaks an item if, with both aligned word by word,
some `window` (13) consecutive words of the item differ in at most `substitutions` (2) places; an item of 8 to 12
words must be there as a whole with `words * 2 // 13` places different at most. Items of fewer than 8 words are no
evidence and never match.

Method: fixed masks select 5 of 6 or 7 consecutive words and ignore the others, so that a substitution on an ignored
place doesn't hide the hit; the two masks together find every such alignment (checked for all patterns in the tests).
Hashes of the selected words of training texts and items meet in an equi-join. Before it, a table of 2^18 slots marks
the leading word pairs of all seeds; positions whose pair isn't marked make no row. Each hit names a diagonal, and the
overlap around it is verified by counting equal words in all its windows.

Rules: null or empty texts and items match nothing; items that repeat an id are all searched; a document is known by
its id and the hash of its text, so that repeated and missing ids are judged by their own texts. Other columns pass
through or aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import ascii_lower, slot_bytes, slot_level, stored

#: Word offsets that count, in each mask. All begin with two neighbours, for the slot table.
MASKS = ((0, 1, 2, 3, 5), (0, 1, 3, 4, 6))
WINDOW, SUBSTITUTIONS, LEAST_WORDS = 13, 2, 8
SLOTS, MARK = 1 << 18, 2
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _word_hashes(text: Column) -> Column:
    """Hashes of all words; separators around the text are cut off first, so that no word is empty."""
    trimmed = F.regexp_replace(ascii_lower(text), f"^{SEPARATORS}|{SEPARATORS}$", "")
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(
        F.transform(F.split(trimmed, SEPARATORS), lambda w: F.xxhash64(w)))


def _slot(pair: Column) -> Column:
    return pair.bitwiseAND(F.lit(SLOTS - 1))


def _pair(words: Column, at: Column) -> Column:
    return F.xxhash64(F.get(words, at), F.get(words, at + 1))


def _positions(words: Column) -> Column:
    """Starts of all masks that fit; the shorter mask also fits one place further."""
    span = min(m[-1] for m in MASKS)
    return F.when(F.size(words) > span, F.sequence(F.lit(0), F.size(words) - 1 - span)).otherwise(F.array().cast("array<int>"))


def _seeds(words: Column, at: Column) -> Column:
    """One hash per mask at a position; null where the mask runs over the end."""
    return F.array(*(
        F.when(at + m[-1] < F.size(words), F.xxhash64(F.lit(k), *(F.get(words, at + p) for p in m))) for k, m in enumerate(MASKS)
    ))


def _cut(rows: DataFrame, *ids: str, marks: bytes | None = None) -> DataFrame:
    """(ids, at, seed) of rows with a words column."""
    at = _positions(F.col("words"))
    if marks is not None:
        at = F.filter(at, lambda i: slot_level(marks, _slot(_pair(F.col("words"), i))) == MARK)
    placed = rows.select(*ids, "words", F.explode(at).alias("at"))
    return placed.select(*ids, "at", F.explode(_seeds(F.col("words"), F.col("at"))).alias("seed")).where("seed is not null")


def _windows(words: Column, item: Column, shift: Column) -> Column:
    """Starts in the item of all windows that differ in few enough places; words[shift + j] stands against item[j]."""
    n = F.size(item)
    size = F.least(n, F.lit(WINDOW))
    allowed = F.when(n >= WINDOW, F.lit(SUBSTITUTIONS)).otherwise(F.floor(n * SUBSTITUTIONS / F.lit(WINDOW)))
    low, high = F.greatest(F.lit(0), -shift), F.least(n, F.size(words) - shift) - size
    fits = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def same(j: Column) -> Column:
        return F.aggregate(F.sequence(j, j + size - 1), F.lit(0), lambda total, k: total + F.when(
            F.get(words, shift + k) == F.get(item, k), 1).otherwise(0))

    return F.filter(fits, lambda j: same(j) >= size - allowed)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> one row per document, item and alignment that leaks.

    Columns: doc_id, text_hash, item_id, first_word (in the document), n_words from the first to the last window.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    items = stored(benchmark.select("item_id", _word_hashes(F.col("text").cast("string")).alias("words"))
                   .where(F.size("words") >= LEAST_WORDS).distinct(), "items")
    seeds = stored(_cut(items.withColumn("item", F.xxhash64("words")), "item_id", "item"), "seeds")
    pairs = items.select(F.col("words"), F.explode(_positions(F.col("words"))).alias("at")).select(
        _slot(_pair(F.col("words"), F.col("at"))).alias("slot")).distinct()
    marks = slot_bytes(pairs.withColumn("level", F.lit(MARK)), SLOTS)
    hashed = rows.select("doc_id", "text_hash", _word_hashes(F.col("text")).alias("words"))
    trained = _cut(hashed, "doc_id", "text_hash", marks=marks)
    hits = trained.join(seeds.withColumnRenamed("at", "item_at"), "seed").select(
        "doc_id", "text_hash", "item_id", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = stored(hits, "hits")
    named = hits.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    own = rows["doc_id"].eqNullSafe(named["_doc"]) & (rows["text_hash"] == named["_hash"])
    found = rows.join(named, own).select("doc_id", "text_hash", "text").dropDuplicates(["doc_id", "text_hash"])
    wide = found.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), _word_hashes(F.col("text")).alias("words"))
    met = hits.join(wide, hits["doc_id"].eqNullSafe(wide["_doc"]) & (hits["text_hash"] == wide["_hash"])).drop("_doc", "_hash")
    tests = items.select(F.xxhash64("words").alias("item"), F.col("words").alias("item_words")).dropDuplicates(["item"])
    checked = met.join(tests, "item").withColumn("starts", _windows(F.col("words"), F.col("item_words"), F.col("shift")))
    size = F.least(F.size("item_words"), F.lit(WINDOW))
    return checked.where(F.size("starts") > 0).select(
        "doc_id", "text_hash", "item_id", (F.col("shift") + F.get("starts", F.lit(0))).cast("long").alias("first_word"),
        (F.element_at("starts", -1) - F.get("starts", F.lit(0)) + size).cast("long").alias("n_words"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that leak an item; all columns stay."""
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    own = docs["doc_id"].eqNullSafe(found["_doc"]) & (F.xxhash64(docs["text"].cast("string")) == found["_hash"])
    return docs.join(found, own, "left_anti")
