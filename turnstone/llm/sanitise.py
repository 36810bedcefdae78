"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Base spans are found by pattern: e-mail and IP addresses, card and phone numbers. A found value is a protected entity.
Terms are lower-cased runs of three letters or more outside the base spans; lines are the contexts. Over the whole
corpus, n(t) lines hold a term, n(e) an entity, n(t, e) both, of n lines. A term discloses an entity if

* n(t, e) / n(t), the chance of the entity where the term stands, is `chance` (0.5) or more,
* log2(n(t, e) n / (n(t) n(e))), what the term tells about the entity, is `bits` (6) or more, and
* both stand together in `support` (3) different lines or more, so that copies of one line are no evidence.

Disclosing terms become spans wherever they stand, also without the entity. In a sanitised text base spans become
`[KIND]`, terms are removed from `remove` (0.9) on and generalised to `[TERM]` below.

Counts are grouped sums with map-side parts; two tables of 2^19 slots mark the terms that matter, so that other words of
the corpus make no rows. No text is shuffled.

Rules: null and empty texts have no spans; a document is known by its id and the hash of its text, so that repeated and
missing ids are kept apart by their texts; other columns aren't read. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions.binding import let
from turnstone.llm.common import has_slot, slot_bits, stored

KINDS = ("email", "ip", "card", "phone", "term")
# The patterns of the contract. Possessive repeats and look-behinds only spare the engine repeated work:
# a match can't begin inside a run whose first character could begin it. A run of fewer than 12 digits is no card.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=(?:[0-9][\x20-]?){11}[0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
ABOVE_255 = r"(?:^|\.)0*+(?:[1-9][0-9]{3,}|2(?:5[6-9]|[6-9][0-9])|[3-9][0-9]{2})(?:\.|$)"
SLOTS = 1 << 19
#: Matches whose places are worked out in one fold.
CHUNK = 256
CHANCE, BITS, SUPPORT, REMOVE = 0.5, 6.0, 3, 0.9
NOT_LETTERS = r"[^\p{L}]+"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:  # i: 0 for the last digit
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def _holds(kind: str, found: Column) -> Column:
    if kind == "ip":
        return ~found.rlike(ABOVE_255)
    if kind == "card":
        digits = F.regexp_replace(found, "[ -]", "")
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(found, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _kept(kind: str):
    return lambda span: _holds(kind, span["found"])


def _of_kind(k: int):
    return lambda span: span["kind"] == k


def _matches(kind: str, text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    none = F.array().cast("array<string>")
    if NEEDS[kind]:
        return F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(none)
    return found


def _totals_before(lengths: Column) -> Column:
    """Exclusive running sums of an array, in two levels: folds copy what they have, so each is kept short."""
    none = F.array().cast("array<int>")

    def fold(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), none.alias("out"))
        return F.aggregate(values, first, lambda acc, x: F.struct(
            (acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / F.lit(CHUNK)).cast("int")),
                         lambda k: F.slice(lengths, k * CHUNK + 1, F.lit(CHUNK)))

    def spread(found: Column) -> Column:
        heads = fold(F.transform(found, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x)), F.lit(0))
        return F.flatten(F.zip_with(found, heads, fold))

    return let(pieces, spread)


def _placed(gaps: Column, matches: Column, kind: Column) -> Column:
    """(start, kind, end, found) of matches, from the texts between them; time grows with the number of matches."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>")

    def spans(gap: Column) -> Column:
        steps = F.transform(matches, lambda m, i: F.length(F.get(gap, i)) + F.length(m))
        return let(_totals_before(steps), lambda before: F.transform(matches, lambda m, i: F.struct(
            (F.get(before, i) + F.length(F.get(gap, i))).alias("start"), kind.cast("int").alias("kind"),
            (F.get(before, i) + F.length(F.get(gap, i)) + F.length(m)).alias("end"), m.alias("found"))))

    return F.when(F.size(matches) > 0, let(gaps, spans)).otherwise(empty)


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with a text column, and `spans`: base spans by start, then kind."""
    out = docs
    for k, kind in enumerate(KINDS[:4]):
        out = out.withColumn(f"_m{k}", _matches(kind, F.col("text")))
    parts = []
    for k, kind in enumerate(KINDS[:4]):
        gaps = F.split("text", PATTERNS[kind], -1)
        parts.append(F.filter(_placed(gaps, F.col(f"_m{k}"), F.lit(k)), _kept(kind)))
    return out.withColumn("spans", F.array_sort(F.concat(*parts))).drop(*(f"_m{k}" for k in range(4)))


def _terms(text: Column) -> Column:
    """Distinct lower-cased runs of three letters or more outside e-mail addresses."""
    plain = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.filter(F.array_distinct(F.split(F.lower(plain), NOT_LETTERS)), lambda w: F.length(w) >= 3)


def _slots(term: Column) -> tuple[Column, Column]:
    """Two slots of a word, by independent bits of its hash."""
    h = F.xxhash64(term)
    return h.bitwiseAND(F.lit(SLOTS - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(SLOTS - 1))


def _marks(terms: DataFrame) -> list[Column]:
    """Two tables of slots: a word that is none of the terms is marked in both rarely."""
    return [slot_bits(terms.select(s.alias("slot")), SLOTS, "marks") for s in _slots(F.col("term"))]


def _marked(marks: list[Column], term: Column) -> Column:
    one, two = (has_slot(m, s) for m, s in zip(marks, _slots(term), strict=True))
    return one & two


def disclosing_terms(docs: DataFrame, with_spans: DataFrame, chance: float = CHANCE, bits: float = BITS, support: int = SUPPORT) -> DataFrame:
    """(term, chance, bits): the terms that disclose an entity, with the most they say about any."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line"))
    held = with_spans.where(F.size("spans") > 0).select(F.explode(F.split("text", "\n")).alias("text"))
    contexts = stored(base_spans(held).where(F.size("spans") > 0).select(
        F.xxhash64("text").alias("line"), _terms(F.col("text")).alias("terms"),
        F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], F.lower(s["found"])))).alias("entities")), "contexts")
    mentions = contexts.select("line", "terms", F.explode("entities").alias("entity"))
    by_entity = mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    # one row per line, term and entity, so that equal lines count once for the support
    met = mentions.select("line", "entity", F.explode("terms").alias("term")).groupBy("entity", "term", "line").agg(F.count(F.lit(1)).alias("n"))
    both = met.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("n_te")).where(F.col("lines") >= support)
    both = stored(both, "both")
    total = lines.count()
    words = lines.select(F.explode(_terms(F.col("line"))).alias("term")).where(_marked(_marks(both), F.col("term")))
    by_term = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    told = both.join(by_term, "term").join(by_entity, "entity").select(
        "term", (F.col("n_te") / F.col("n_t")).alias("chance"),
        F.log2(F.col("n_te") * F.lit(float(total)) / (F.col("n_t") * F.col("n_e").cast("double"))).alias("bits"))
    return told.where((F.col("chance") >= chance) & (F.col("bits") >= bits)).groupBy("term").agg(F.max("chance").alias("chance"), F.max("bits").alias("bits"))


def _term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, text_hash, term_spans): all places of disclosing terms; one row per document that has some."""
    one, two = _marks(terms)
    with_marks = docs.select("doc_id", "text", one.alias("one"), two.alias("two"))
    own = F.filter(_terms(F.col("text")), lambda w: _marked([F.col("one"), F.col("two")], w))
    near = with_marks.select("doc_id", "text", own.alias("own")).where(F.size("own") > 0)
    # one pass over a text for all its marked words
    rx = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("own", "|"), F.lit(r")(?!\p{L})"))
    found = near.withColumn("matches", F.regexp_extract_all("text", rx, F.lit(0)))
    gaps = F.call_function("split", F.col("text"), rx, F.lit(-1))
    placed = found.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(_placed(gaps, F.col("matches"), F.lit(4))).alias("span"))
    sure = placed.withColumn("term", F.lower("span.found")).join(terms, "term").select("doc_id", "text_hash", "span", "chance").distinct()
    return sure.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("span", "chance")).alias("term_spans"))


def find_personal_data(docs: DataFrame, **thresholds) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text_hash, spans (start, kind, end, found; base), term_spans (span, chance), one row per row."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with_spans = base_spans(rows)
    base = stored(with_spans.select("doc_id", F.xxhash64("text").alias("text_hash"), "spans"), "base")
    terms = stored(disclosing_terms(rows, with_spans, **thresholds), "terms")
    extra = _term_spans(rows, terms).toDF("_id", "_hash", "term_spans")
    whole = base.join(extra, base["doc_id"].eqNullSafe(extra["_id"]) & (base["text_hash"] == extra["_hash"]), "left").drop("_id", "_hash")
    apart = F.filter("term_spans", lambda t: ~F.exists("spans", lambda s: (s["start"] < t["span"]["end"]) & (t["span"]["start"] < s["end"])))
    return whole.withColumn("term_spans", F.coalesce(apart, F.array().cast(extra.schema["term_spans"].dataType)))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, of spans that are in order."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, the hash of the base spans and all spans as text."""
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    every = F.array_sort(F.concat("spans", F.transform("term_spans", lambda t: t["span"])))
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("spans")), 256).alias("base_sha256"), span_text(every).alias("spans"))


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """docs with base spans replaced by their kind and disclosing terms removed or generalised; all columns stay."""
    found = find_personal_data(docs, **thresholds)
    marked = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(
        F.lit("["), F.upper(F.get(F.array(*(F.lit(k) for k in KINDS)), s["kind"])), F.lit("]")).alias("put")))
    told = F.transform("term_spans", lambda t: F.struct(t["span"]["start"].alias("start"), t["span"]["end"].alias("end"),
                                                         F.when(t["chance"] >= REMOVE, "").otherwise("[TERM]").alias("put")))
    cuts = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.array_sort(F.concat(marked, told)).alias("_cuts")).where(
        F.size("_cuts") > 0).dropDuplicates(["_id", "_hash"])
    text = docs["text"].cast("string")
    joined = docs.join(cuts, docs["doc_id"].eqNullSafe(cuts["_id"]) & (F.xxhash64(docs["text"].cast("string")) == cuts["_hash"]), "left")

    def step(acc: Column, c: Column) -> Column:
        inside = c["start"] < acc["at"]  # kinds may overlap: what is already replaced stays so
        grown = F.concat(acc["out"], F.substring(text, acc["at"] + 1, c["start"] - acc["at"]), c["put"])
        return F.struct(F.greatest(acc["at"], c["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(grown).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("_cuts", first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    done = F.when(F.col("_cuts").isNull(), text).otherwise(clean).alias("text")
    return joined.select(*(done if c == "text" else docs[c] for c in docs.columns))
