"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line's set holds its distinct lower-cased words between ASCII white space. A line is
removed if an earlier line, by (doc_id, line number), has a Jaccard similarity of `similarity` (0.8) or more, whether
or not that line was removed itself; of equal sets the first stays. Lines without words stay; callers may raise
`min_words` to spare short lines too.

Method
------
1. Word counts, by 2^20 hash slots, give every word one of 126 rarity levels: a table of fixed size, written as one row
   and read by the tasks as a scalar subquery. Each line's words are ordered by (level, hash), rarest first.
2. Equal sets become one row with their first position.
3. Of |x| words, two sets that are similar enough share one of the first |x| - ceil(s |x|) + 1 (prefix filter), where
   words that stand once in the corpus can be left out. Lines meet by an equi-join on prefix words, under the length filter, the positional filter (what can still overlap before
   and behind the shared word) and the parity filter: each word flips one of 64 bits, of 128 in lines above 64 words and 256 above 128, and two words more in the
   symmetric difference flip at most two bits more.
4. Large families of variants would meet in all pairs, so each line first meets the first line and the sixteen
   before it of four groups: those with the same three smallest, three largest, three smallest positive and three largest negative
   word hashes. What this removes meets no earlier line again and only stays as a partner of later ones.
5. Pairs that pass are verified on the whole sets of words, read from the texts again.

Rules: null and empty texts have one empty line, which stays. A null doc_id counts as -2^63, the smallest. A doc_id
names one document: rows that repeat it take equal positions, do not remove each other's lines, and where their sets at
a place differ, these are judged together. Columns besides
doc_id and text pass through or aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.llm.common import has_slot, slot_bits, stored

SLOTS, MIN_WORDS = 1 << 20, 1
#: The level of slots in which one word of the corpus fell.
SINGLE = 5
#: 64 bits that words flip: of the whole line, of half its words, of two quarters, one in each half.
PARITY = ["parity", "half", "q2", "q3"]
#: Keys of the groups in which a line meets two others first.
GROUPS = ["lowest", "highest", "above", "below"]
#: How many lines right before it a line meets there, besides the first one.
MET_BEFORE = 16
#: Lines above so many words have the half, and the quarters.
HALVED, QUARTERED = 64, 128
#: Bounds of the quarters of all word hashes: this, its negative and zero.
QUARTER = 1 << 30
#: The place of a line, in order.
PLACE = ["doc", "line_no"]


def _words(text: Column) -> Column:
    """Lower-cased words at single blanks; other white space is turned into blanks first, where there is any."""
    other = [F.lit(c) for c in "\t\x0b\x0c\r\n"]
    odd = reduce(lambda x, y: x | y, (F.contains(text, c) for c in other))
    plain = reduce(lambda x, c: F.replace(x, c, F.lit(" ")), other, text)
    return F.split(F.lower(F.when(odd, plain).otherwise(text)), " ")


def _slot(word_hash: Column) -> Column:
    return word_hash.bitwiseAND(F.lit(SLOTS - 1))


def rarity_levels(docs: DataFrame) -> Column:
    """An array with a number from 1 to 126 per hash slot: 4 * log2 of how many words of the corpus fell there."""
    words = docs.select(F.explode(_words(F.coalesce("text", F.lit("")))).alias("word")).where("word <> ''")
    counts = words.groupBy(_slot(F.xxhash64("word")).alias("slot")).count()
    level = F.least(F.lit(126), 1 + F.floor(4 * F.log2(F.col("count") + 1)))
    every = docs.sparkSession.range(SLOTS, numPartitions=8).select(F.col("id").alias("slot"))
    filled = every.join(counts, "slot", "left").select("slot", F.coalesce(level, F.lit(1)).cast("byte").alias("level"))

    def gathered(rows: DataFrame, key: str, value: str, by: list[Column]) -> DataFrame:
        in_order = F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value])
        return rows.groupBy(*by).agg(in_order.alias("levels"))

    blocks = gathered(filled, "slot", "level", [F.shiftright("slot", 12).alias("block")])
    whole = gathered(blocks, "block", "levels", [])
    return stored(whole.select(F.flatten("levels").alias("levels")), "levels").scalar()


def _doc() -> Column:
    """Orders documents; null ids come first."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc")


def line_sets(docs: DataFrame, levels: Column, s: Fraction) -> DataFrame:
    """(doc_id, line_no, prefix, n, parity, half, q2, q3, lowest, highest, above, below, high, low) of all lines with words.

    prefix: hashes of the rarest words, as many as the prefix filter needs, null for words that stand once in the corpus;
    n: distinct words; lowest and highest: the three smallest and largest word hashes as keys; above and below: the three
    next to zero on either side, null where there are fewer;
    high, low: hash of the set.
    """
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line")).where(
        F.col("line").rlike(r"[^\x20\x09-\x0D]"))  # has words: told by the text, as a filter on the keys would work them out twice
    # used once behind here, so that the subquery ends up inside the lambda and no row carries the table
    words = lines.select("doc_id", "line_no", "line", levels.alias("levels"))
    hashes = F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w)))

    def key(h: Column) -> Column:
        return F.shiftleft(F.col("levels")[_slot(h)].cast("long"), 56).bitwiseOR(F.call_function("shiftrightunsigned", h, F.lit(8)))

    keyed = words.select(
        "doc_id", "line_no", F.sort_array(F.transform(F.array_remove(hashes, F.xxhash64(F.lit(""))), key)).alias("keys"))
    n = F.col("n")
    hashed = keyed.select(
        "doc_id", "line_no", F.size("keys").alias("n"), F.xxhash64("keys").alias("high"), F.xxhash64(F.lit(1), "keys").alias("low"),
        F.transform(F.slice("keys", F.lit(1), _prefix_length(F.size("keys"), s)),
                    lambda k: F.when(F.shiftright(k, 56) > SINGLE, F.hash(k))).alias("prefix"),
        F.sort_array(F.transform("keys", lambda k: F.hash(k))).alias("order"))

    def less(bound: int) -> Column:
        """How many hashes are less: the place the bound takes among them, without a lambda over all words."""
        return F.array_position(F.sort_array(F.array_append("order", F.lit(bound))), bound).cast("int") - 1

    split = hashed.select("*", less(0).alias("half_at"), *(
        F.when(n > QUARTERED, less(bound)).alias(name) for name, bound in (("q2_at", -QUARTER), ("q3_at", QUARTER))))

    def between(first: Column | str, end: Column | str) -> Column:
        first, end = (F.col(c) if isinstance(c, str) else c for c in (first, end))
        return F.slice("order", first + 1, end - first)

    def flipped(part: Column) -> Column:
        bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), w)  # noqa: E731  a shift reads the last six bits
        return F.aggregate(part, F.lit(0).cast("long"), lambda p, w: p.bitwiseXOR(bit(w)))

    parts = [
        flipped(F.col("order")), F.when(n > HALVED, flipped(between("half_at", n))),
        F.when(n > QUARTERED, flipped(between("q2_at", "half_at"))), F.when(n > QUARTERED, flipped(between("q3_at", n)))]
    negative = F.col("half_at")
    return split.select(
        "doc_id", "line_no", "prefix", "n", *(c.alias(name) for name, c in zip(PARITY, parts, strict=True)),
        F.hash(F.slice("order", 1, 3)).alias("lowest"),
        F.hash(F.slice("order", F.greatest(F.lit(1), n - 2), F.lit(3))).alias("highest"),
        F.when(n - negative >= 3, F.hash(F.lit(2), between(negative, negative + 3))).alias("above"),
        F.when(negative >= 3, F.hash(F.lit(3), between(negative - 3, negative))).alias("below"), "high", "low")


def _prefix_length(n: Column, s: Fraction) -> Column:
    return (n - F.floor((n * s.numerator + (s.denominator - 1)) / F.lit(s.denominator)) + 1).cast("int")


def _least_overlap(n_x: Column, n_y: Column, s: Fraction) -> Column:
    """ceil(s / (1 + s) * (n_x + n_y)), in whole numbers."""
    up, down = s.numerator, s.numerator + s.denominator
    return F.floor(((n_x + n_y) * up + (down - 1)) / F.lit(down))


def _has_unequal(s: Fraction) -> Column:
    """Smaller sets have no similar but equal ones, which the classes settle."""
    return F.col("n") * (s.denominator - s.numerator) >= s.numerator


def _possible(x: str, y: str, n: Column, m: Column, s: Fraction) -> Column:
    """The length and parity filters between the columns of x and y, which are prefixes of their names."""
    sized = F.least(n, m) * s.denominator >= F.greatest(n, m) * s.numerator
    whole, half, q2, q3 = (F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}")) for c in PARITY)
    both = F.bit_count(half) + F.bit_count(whole.bitwiseXOR(half))
    four = [q3, half.bitwiseXOR(q3), q2, whole.bitwiseXOR(half).bitwiseXOR(q2)]
    apart = F.coalesce(reduce(lambda a, b: a + b, map(F.bit_count, four)), both, F.bit_count(whole))
    return sized & (apart <= n + m - 2 * _least_overlap(n, m, s))


def _verified(pairs: DataFrame, docs: DataFrame, s: Fraction, name: str) -> DataFrame:
    """(doc, line_no) of the lines of pairs (doc, line_no, met) whose whole sets of words are similar enough to the line met."""
    pairs = stored(pairs.distinct(), f"{name}-pairs")
    wanted = pairs.select(*PLACE).union(pairs.select("met.*")).distinct()
    marks = slot_bits(wanted.select(_slot(F.xxhash64(*PLACE)).alias("slot")), SLOTS, f"{name}-places")
    lines = docs.select(_doc(), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line")).where(
        has_slot(marks, _slot(F.xxhash64(*PLACE))))  # only wanted lines are shuffled
    words = F.array_sort(F.array_remove(F.array_distinct(_words(F.col("line"))), "")).alias("words")
    one = stored(lines.join(wanted, PLACE).select(*PLACE, words).distinct(), f"{name}-words")
    two = one.select(F.struct(*PLACE).alias("met"), F.col("words").alias("other"))
    both = F.size(F.array_intersect("words", "other"))
    either = F.size("words") + F.size("other") - both
    return pairs.join(one, PLACE).join(two, "met").where(both * s.denominator >= either * s.numerator).select(*PLACE).distinct()


def _packed(line_no: Column | str, low: Column | str) -> Column:
    """Two whole numbers from 0 to 2^31 - 1 as one, since every column takes eight bytes of a shuffled row."""
    return F.shiftleft(F.col(line_no).cast("long"), 32).bitwiseOR(F.col(low).cast("long"))


def _upper(packed: str) -> Column:
    return F.shiftright(packed, 32).cast("int")


def _lower(packed: str) -> Column:
    return F.col(packed).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def _signed(packed: str) -> Column:
    """The lower half, as a number with a sign."""
    return F.shiftright(F.shiftleft(packed, 32), 32)


def _earlier(x: str, y: str) -> Column:
    """Whether the place of x is before that of y."""
    return (F.col(f"{x}doc") < F.col(f"{y}doc")) | ((F.col(f"{x}doc") == F.col(f"{y}doc")) & (_upper(f"{x}line_n") < _upper(f"{y}line_n")))


def _neighbours(sets: DataFrame, s: Fraction) -> DataFrame:
    """Pairs of each line with the first and the last lines before it of its groups."""
    key = F.explode(F.array(*GROUPS)).alias("key")
    rows = sets.where(_has_unequal(s)).select(key, *PARITY, "doc", _packed("line_no", "n").alias("line_n")).where("key is not null")
    order = Window.partitionBy("key").orderBy("doc", "line_n")
    # most stand alone, and go before the wide frames; the second window reads the order of the first
    alone = (F.lag("doc").over(order).isNull() & F.lead("doc").over(order).isNull()).alias("alone")
    rows = rows.select("*", alone).where(~F.col("alone")).drop("alone")
    me = F.struct("doc", "line_n", *PARITY)
    before = [F.first(me).over(order), *(F.lag(me, k).over(order) for k in range(1, MET_BEFORE + 1))]
    flat = rows.select("doc", "line_n", *PARITY, F.array(*before).alias("met")).select(
        "doc", "line_n", *PARITY, F.explode("met").alias("y")).where("y is not null").where(_earlier("y.", ""))
    near = _possible("", "y.", _lower("line_n"), _lower("y.line_n"), s)
    return flat.where(near).select("doc", _upper("line_n").alias("line_no"), F.struct("y.doc", _upper("y.line_n").alias("line_no")).alias("met"))


def _prefix_pairs(sets: DataFrame, gone: DataFrame, s: Fraction) -> DataFrame:
    """Pairs of lines that aren't gone with any earlier lines that share a prefix word and pass all filters.

    Lines that are gone carry a negative place of the word; no condition is on one side alone, so both sides read the same
    shuffle. A word without one before it that counts carries itself as the one before.
    """
    marked = sets.join(gone.select(*PLACE, F.lit(True).alias("gone")), PLACE, "left")
    words = F.arrays_zip(F.col("prefix").alias("word"), F.concat(F.array(F.lit(None).cast("int")), "prefix").alias("before"))
    rows = marked.where(_has_unequal(s)).select(
        F.posexplode(words).alias("i", "w"), *PARITY, "doc", _packed("line_no", "n").alias("line_n"), "gone").where("w.word is not null")
    mask = F.lit((1 << 32) - 1)
    both = F.shiftleft(F.col("w.word").cast("long"), 32).bitwiseOR(F.coalesce("w.before", "w.word").cast("long").bitwiseAND(mask))
    rows = rows.select(both.alias("words"), *PARITY, "doc", "line_n", F.when(F.col("gone"), -1 - F.col("i")).otherwise(F.col("i")).alias("at"))
    x, y = rows.alias("x"), rows.alias("y")
    n_x, n_y = _lower("x.line_n"), _lower("y.line_n")
    i, k = F.col("x.at"), F.greatest(F.col("y.at"), -1 - F.col("y.at"))
    # two lines with the same word before this one meet there, too, and with the same bound by position
    starts = (F.col("x.words") != F.col("y.words")) | (F.shiftright("x.words", 32) == _signed("x.words"))
    met = x.join(y, F.shiftright("x.words", 32) == F.shiftright("y.words", 32)).where(
        starts & (F.least(i, k) >= 0) & _earlier("y.", "x.") & _possible("x.", "y.", n_x, n_y, s)
        & (F.least(i, k) + F.least(n_x - i, n_y - k) >= _least_overlap(n_x, n_y, s)))
    return met.select("x.doc", _upper("x.line_n").alias("line_no"), F.struct("y.doc", _upper("y.line_n").alias("line_no")).alias("met"))


def removals(docs: DataFrame, similarity: float = 0.8, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, line_no) of the lines to remove, one row each, line numbers from 0."""
    s = Fraction(similarity).limit_denominator(100)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = line_sets(texts, rarity_levels(texts), s)
    # every line there has a word; a filter on n works out the keys a second time
    lines = stored(found.where(F.col("n") >= min_words) if min_words > 1 else found, "lines")
    # copies meet before the shuffle; all else is the same in equal sets
    firsts = lines.groupBy("high", "low").agg(F.min(F.struct(_doc(), "line_no")).alias("at"), *(
        F.first(c).alias(c) for c in ("prefix", "n", *PARITY, *GROUPS)))
    sets = stored(firsts.select("at.*", "prefix", "n", *PARITY, *GROUPS, "high", "low"), "sets")
    early = stored(_verified(_neighbours(sets, s), texts, s, "early"), "early")
    late = _verified(_prefix_pairs(sets, early, s), texts, s, "late")
    gone = early.unionByName(late).withColumn("gone", F.lit(True))
    classes = sets.select(F.struct(*PLACE).alias("at"), *PLACE, "high", "low").join(gone, PLACE, "left").select(
        "high", "low", "at", F.coalesce("gone", F.lit(False)).alias("gone"))
    met = lines.select("doc_id", "line_no", "high", "low").join(classes, ["high", "low"])
    return met.where(F.col("gone") | (F.struct(_doc(), "line_no") > F.col("at"))).select("doc_id", "line_no").distinct()


def dedup_lines(docs: DataFrame, similarity: float = 0.8, min_words: int = MIN_WORDS, count: str | None = None) -> DataFrame:
    """docs with the removed lines cut out of their texts, all rows and columns kept; `count` names a column for their number.

    A document that loses all its lines stays with an empty text.
    """
    out = removals(docs, similarity, min_words)
    # at most one number for each line of the document itself; a text is cut in one pass over its lines
    numbers = F.sort_array(F.collect_list(F.col("line_no").cast("int")))
    cuts = stored(out.groupBy(F.col("doc_id").alias("_cut_id")).agg(numbers.alias("_cut_lines")), "cuts")
    place = lambda c: _slot(F.xxhash64(c))
    bits = slot_bits(cuts.select(place(F.col("_cut_id")).alias("slot")), SLOTS, "cut-places")
    marked = has_slot(bits, place(docs["doc_id"]))
    text = docs["text"].cast("string")
    cut = F.when(F.col("_cut_lines").isNull(), text).otherwise(_without(text, F.col("_cut_lines"))).alias("text")
    number = [F.coalesce(F.size("_cut_lines"), F.lit(0)).alias(count)] if count else []
    joined = docs.where(marked).join(cuts, docs["doc_id"].eqNullSafe(cuts["_cut_id"]), "left")
    touched = joined.select(*(cut if c == "text" else docs[c] for c in docs.columns), *number)
    rest = docs.where(~marked).select(  # these are not shuffled
        *(text.alias(c) if c == "text" else docs[c] for c in docs.columns), *([F.lit(0).alias(count)] if count else []))
    return touched.union(rest)


def _without(text: Column, numbers: Column) -> Column:
    """The text without the lines of these sorted numbers: the runs of lines between them, put together."""
    lines = F.split(text, "\n")
    starts = F.concat(F.array(F.lit(0)), F.transform(numbers, lambda k: k + 1))
    ends = F.concat(numbers, F.array(F.size(lines)))
    runs = F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, F.greatest(b - a, F.lit(0))))
    return F.array_join(F.flatten(runs), "\n")
