"""Plate text functions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from turnstone.functions.unicode import drop_format_chars, nfkc, strip_marks

# Digit sets, Arabic letter ranges and dash forms.
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
EASTERN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ARABIC_RANGE = r"\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF\uFB50-\uFDFF\uFE70-\uFEFF"
PLATE_SEP = r"[-\u2010\u2011\u2012\u2013\u2014\u2015\u2212]"
DEFAULT_LETTER = "\u0648"
PLATE_PATTERNS = (
    rf"(\d{{1,6}}\s*{PLATE_SEP}\s*[{ARABIC_RANGE}]+\s*{PLATE_SEP}\s*\d{{1,3}})",
    rf"(\d{{1,6}}\s*{PLATE_SEP}\s*[A-Z]\s*{PLATE_SEP}\s*\d{{1,3}})",
    rf"plaque\s+['\"]?((?=[A-Za-z0-9{ARABIC_RANGE}\-\s]*\d)[A-Za-z0-9{ARABIC_RANGE}\-\s]{{3,20}})",
)


def normalize_plate(col: Column) -> Column:
    text = drop_format_chars(nfkc(F.coalesce(col, F.lit(""))))
    text = F.translate(text, ARABIC_DIGITS + EASTERN_DIGITS + "|–— ", "0123456789" * 2 + "---")
    text = F.regexp_replace(text, "-+", "-")
    return F.upper(F.trim(text, F.lit("-")))


def _tokens(plate: Column) -> Column:
    return F.filter(F.split(plate, "-"), lambda t: t != "")


def loose_key(col: Column) -> Column:
    """``a-*-b`` where the second of three or more tokens has one character."""
    parts = _tokens(normalize_plate(col))
    starred = F.concat(F.get(parts, F.lit(0)), F.lit("-*-"), F.element_at(parts, -1))
    return F.when(
        (F.size(parts) >= 3) & (F.length(F.get(parts, F.lit(1))) == 1), starred
    ).otherwise(F.array_join(parts, "-"))


def reorder_plate(col: Column) -> Column:
    """First number, letter, last number; null where that changes nothing."""
    plate = normalize_plate(col)
    parts = _tokens(plate)
    letters = F.filter(parts, lambda t: t.rlike(rf"^[A-Z{ARABIC_RANGE}]$"))
    numbers = F.filter(parts, lambda t: t.rlike(r"^\d+$"))
    out = F.concat_ws(
        "-", F.get(numbers, F.lit(0)), F.get(letters, F.lit(0)), F.get(numbers, F.size(numbers) - 1)
    )
    usable = (F.size(parts) >= 3) & (F.size(letters) >= 1) & (F.size(numbers) >= 2) & (out != plate)
    return F.when(usable, out)


def plate_vote_key(col: Column) -> Column:
    text = F.upper(F.trim(F.coalesce(col, F.lit(""))))
    return F.translate(text, "| ", "-")


def plate_query_key(col: Column) -> Column:
    """Search key: no case, marks, direction signs, blanks or dashes."""
    text = strip_marks(F.lower(F.coalesce(col, F.lit(""))))
    return F.regexp_replace(drop_format_chars(text), r"[\s-]+", "")


def score_plate(col: Column) -> Column:
    """Plausibility of a plate reading in [0, 1]."""
    text = F.regexp_replace(F.coalesce(col, F.lit("")), r"[^0-9A-Za-z\u0600-\u06FF]+", "")
    length = F.least(F.length(text) / F.lit(7.0), F.lit(1.0))
    digit = F.when(text.rlike(r"(?U)\d"), F.lit(0.2)).otherwise(F.lit(0.0))
    alpha = F.when(text.rlike(r"\p{L}"), F.lit(0.2)).otherwise(F.lit(0.0))
    return F.when(text == "", F.lit(0.0)).otherwise(length * 0.6 + digit + alpha)


def arabic_placeholder(col: Column) -> Column:
    return F.regexp_replace(col, f"[{ARABIC_RANGE}]", "?")


def has_arabic(col: Column) -> Column:
    return col.rlike(f"[{ARABIC_RANGE}]")


def extract_plate(question: Column) -> Column:
    """First plate found by the ordered patterns (raw text), null if none."""
    text = F.translate(drop_format_chars(nfkc(question)), "|", "-")
    text = F.regexp_replace(text, PLATE_SEP + "+", "-")
    found = [
        F.nullif(F.trim(F.regexp_extract(text, "(?iU)" + p, 1)), F.lit("")) for p in PLATE_PATTERNS
    ]
    return F.coalesce(*found)


def display_plate(col: Column) -> Column:
    """Display form with left-to-right and right-to-left isolates around the parts."""
    raw = F.trim(col)
    parts = F.filter(F.split(raw, r"[-|\s]+"), lambda t: t != "")
    number = r"^[0-9]+$"
    arabic = F.filter(parts, lambda t: t.rlike(f"[{ARABIC_RANGE}]"))
    other = F.filter(parts, lambda t: ~t.rlike(number))
    all_numbers = F.filter(parts, lambda t: t.rlike(number))
    letter = F.coalesce(F.get(arabic, F.lit(0)), F.get(other, F.lit(0)))
    letter = F.coalesce(letter, F.when(F.size(all_numbers) >= 2, F.lit(DEFAULT_LETTER)))
    numbers = F.when(F.size(all_numbers) >= 2, all_numbers).otherwise(
        F.regexp_extract_all(raw, F.lit(r"([0-9]+)"))
    )
    n = F.size(numbers)
    first, last = F.get(numbers, F.lit(0)), F.get(numbers, n - 1)
    rest = F.filter(parts, lambda t: (t != letter) & (t != F.coalesce(first, F.lit(""))))
    left = F.coalesce(first, F.get(rest, F.lit(0)))
    right = F.when(n >= 2, F.when(first == last, F.get(numbers, F.lit(1))).otherwise(last)).otherwise(
        F.when(n == 1, F.get(rest, F.lit(0))).otherwise(
            F.array_join(F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0))), "")
        )
    )
    lri, rli, pdi = F.lit("\u2066"), F.lit("\u2067"), F.lit("\u2069")

    def isolate(sign: Column, text: Column) -> Column:
        return F.when(F.coalesce(text, F.lit("")) != "", F.concat(sign, text, pdi))

    shown = F.concat_ws(" - ", isolate(lri, left), isolate(rli, letter), isolate(lri, right))
    has_side = (F.coalesce(left, F.lit("")) != "") | (F.coalesce(right, F.lit("")) != "")
    return F.when((F.coalesce(raw, F.lit("")) == "") | letter.isNull() | ~has_side, raw).otherwise(shown)
