"""Text normalisation and small text measures (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from turnstone.functions.unicode import drop_format_chars, nfkc, strip_marks

SPACES = r"(?U)\s+"
# Amounts like "8 664.94 MAD", file types, limits.
AMOUNT_MAD = r"(?i)\d[\d\s]*[.,]\d{2}\s*MAD"
MIME_TYPES = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}
MAX_QUESTION_CHARS = 500
TRUNCATION_MARK = "\n...[TRUNCATED]"
# Words that mark a line as a template anchor.
STRONG_KEYWORDS = (
    "facture", "releve", "compte", "payeur", "beneficiaire", "montant", "tva", "ttc", "solde",
    "debit", "credit", "virement", "reference", "transaction", "iban",
)


def _filled(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, SPACES, " "))


def norm_doc(col: Column) -> Column:
    """Lower case, no marks, single blanks; line breaks stay."""
    return F.regexp_replace(strip_marks(F.lower(_filled(col))), "[ \t]+", " ")


def norm_text(col: Column) -> Column:
    return squeeze(F.lower(strip_marks(_filled(col))))


def norm_compact(col: Column) -> Column:
    return F.regexp_replace(norm_text(col), "[^a-z0-9]", "")


def to_ascii(col: Column) -> Column:
    return F.regexp_replace(strip_marks(_filled(col)), r"[^\x00-\x7F]", "")


def norm_match(col: Column) -> Column:
    """ASCII, lower case, single blanks."""
    return squeeze(F.lower(to_ascii(col)))


def norm_ascii(col: Column) -> Column:
    """ASCII words separated by single blanks."""
    return F.trim(F.regexp_replace(F.lower(to_ascii(col)), "[^a-z0-9]+", " "))


def norm_question(col: Column) -> Column:
    text = strip_marks(drop_format_chars(nfkc(_filled(col))))
    text = F.replace(text, F.lit("â€™"), F.lit("'"))
    return F.lower(squeeze(F.translate(text, "’‘`", "'''")))


def clean_value(col: Column) -> Column:
    return F.trim(F.regexp_replace(_filled(col), SPACES, " "), F.lit(" :-\t"))


def text_lines(col: Column) -> Column:
    """Trimmed non-blank lines."""
    # Only lines with white space at an end are searched for it.
    edges = lambda s: F.concat(F.left(s, F.lit(1)), F.right(s, F.lit(1)))
    trimmed = lambda s: F.when(edges(s).rlike(r"(?U)\s"), F.regexp_replace(s, r"(?U)^\s+|\s+$", "")).otherwise(s)
    parts = F.transform(F.split(_filled(col), "\r\n|\n|\r"), trimmed)
    return F.filter(parts, lambda s: s != "")


def count_of(text: Column, needle: str) -> Column:
    """Occurrences of a fixed text; cheaper than a pattern."""
    gone = F.length(F.replace(text, F.lit(needle), F.lit("")))
    return ((F.length(text) - gone) / len(needle)).cast("int")


def amount_tokens(col: Column) -> Column:
    return F.regexp_extract_all(_filled(col), F.lit(f"({AMOUNT_MAD})"), F.lit(1))


def score_ocr_text(col: Column) -> Column:
    text = _filled(col)
    printable = F.length(F.regexp_replace(text, r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]", ""))
    alnum = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    words = F.regexp_count(text, F.lit("[A-Za-z0-9]{2,}"))
    junk = F.regexp_count(text, F.lit(r"[<>\[\]{}|\\^~`]"))
    return printable * 0.2 + alnum * 0.8 + words * 4.0 - junk * 2.0


def looks_like_anchor(col: Column) -> Column:
    text = F.trim(_filled(col))
    alpha = F.length(F.regexp_replace(text, r"\P{L}", ""))
    upper = F.length(F.regexp_replace(text, r"\P{Lu}", ""))
    shouted = (alpha > 0) & (upper / alpha >= 0.8) & (F.length(text) <= 60)
    # One pattern, so that the text is folded once and not once for each word.
    strong = norm_text(text).rlike("|".join(STRONG_KEYWORDS))
    return (text != "") & (text.endswith(":") | text.contains(" : ") | strong | shouted)


def anchor_name(col: Column) -> Column:
    return squeeze(F.substring_index(F.trim(col), ":", 1))


def truncate(col: Column, limit: int, mark: str = TRUNCATION_MARK) -> Column:
    cut = F.concat(F.regexp_replace(F.left(col, F.lit(limit)), r"(?U)\s+$", ""), F.lit(mark))
    return F.when(F.length(col) <= limit, col).otherwise(cut)


def sanitize_question(col: Column) -> Column:
    text = F.regexp_replace(_filled(col), r"[\x00-\x1f\x7f]+", " ")
    return F.left(squeeze(text), F.lit(MAX_QUESTION_CHARS))


def file_extension(col: Column) -> Column:
    return F.lower(F.regexp_extract(_filled(col), r"\.([A-Za-z0-9]+)$", 1))


def mime_type(col: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in MIME_TYPES.items() for v in pair])
    return F.coalesce(F.try_element_at(table, file_extension(col)), F.lit("application/octet-stream"))


def upload_allowed(content_type: Column, name: Column) -> Column:
    return content_type.isin(*MIME_TYPES.values()) | file_extension(name).isin(*MIME_TYPES)
