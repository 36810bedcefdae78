"""Numbers written as text (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from turnstone.functions.binding import let


def _decimal_text(raw: Column) -> Column:
    """One decimal point: the last of comma and point wins; repeated points keep the last."""
    comma, point = raw.contains(","), raw.contains(".")
    last_comma = F.length(raw) - F.instr(F.reverse(raw), ",")
    last_point = F.length(raw) - F.instr(F.reverse(raw), ".")
    many = F.size(F.split(raw, r"\.")) > 2
    joined = F.regexp_replace(raw, r"\.(?=.*\.)", "")
    return (
        F.when(comma & ~point, F.replace(raw, F.lit(","), F.lit(".")))
        .when(comma & point & (last_comma > last_point),
              F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(comma & point, F.replace(raw, F.lit(","), F.lit("")))
        .when(many, joined)
        .otherwise(raw)
    )


def two_decimals(number: Column) -> Column:
    """Text of a double with two decimals, rounded on its binary value, halves to even.

    Decimal rounding differs only where the shortest text of the double ends in an exact half cent.
    There the binary value is compared with the text in whole numbers: ``d * 2**j`` is a whole
    number below 2**63 for a suitable j, and scaling by powers of two is exact.
    """

    def shown(d: Column) -> Column:
        text = d.try_cast("decimal(24,10)")
        mills = (F.abs(text) * 1000).cast("decimal(26,0)")
        half = (F.abs(text) * 1000 == mills) & (mills % 10 == 5)
        shift = (F.lit(61) - F.floor(F.log2(F.abs(d)))).cast("int")
        whole = (F.abs(d) * F.pow(F.lit(2.0), shift)).cast("bigint").cast("decimal(20,0)")
        power = F.pow(F.lit(2.0), shift).cast("bigint").cast("decimal(20,0)")
        gap = whole * F.lit(1000).cast("decimal(5,0)") - mills.cast("decimal(18,0)") * power
        even = F.floor((mills - 5) / 10) % 2 == 0
        down = half & (F.abs(d) < 1e12) & (F.abs(d) >= 1) & ((gap < 0) | ((gap == 0) & even))
        cent = F.when(down, F.signum(d) * 0.01).otherwise(F.lit(0.0)).cast("decimal(10,2)")
        return (d.try_cast("decimal(30,2)") - cent).cast("decimal(30,2)").cast("string")

    return let(number, shown)


def money(col: Column) -> Column:
    """Two-decimal text; the trimmed input where no number can be read, '' where no digit is left."""
    raw = F.regexp_replace(F.coalesce(col, F.lit("")), r"[^0-9,.\-]", "")

    def shown(r: Column) -> Column:
        return F.when(r == "", F.lit("")).otherwise(two_decimals(_decimal_text(r).try_cast("double")))

    return F.coalesce(let(raw, shown), F.trim(col))


def quantity(col: Column) -> Column:
    """First integer after repairing letters that readers put for digits."""
    token = F.trim(F.coalesce(col, F.lit("")))
    lone = ~token.rlike(r"\d") & F.replace(F.lower(token), F.lit("e"), F.lit("1")).isin("1", "11")
    repaired = F.translate(token, "Il|Oo", "11100")
    return F.when(lone, F.lit("1")).otherwise(F.regexp_extract(repaired, r"(-?\d+)", 1))


def to_number(col: Column) -> Column:
    """First number in a text, decimal comma allowed; null where there is none."""
    hit = F.regexp_extract(F.replace(col, F.lit(" "), F.lit("")), r"(-?\d+(?:[.,]\d+)?)", 1)
    return F.replace(hit, F.lit(","), F.lit(".")).try_cast("double")


def clamp_confidence(col: Column, default: float = 1.0) -> Column:
    value = F.coalesce(col.try_cast("double"), F.lit(default))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def _fix_digits(col: Column, force: bool) -> Column:
    text = F.trim(F.coalesce(col, F.lit("")))
    text = F.when(text.rlike(r"\d"), F.translate(text, "Oo", "00")).otherwise(text)
    ones = F.translate(text, "Iil|", "1111")
    text = ones if force else F.when(text.rlike(r"^[0-9Iil|.,\- ]+$"), ones).otherwise(text)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cell_quantity(col: Column) -> Column:
    """Quantity of a table cell: first integer, else the repaired text."""

    def shown(fixed: Column) -> Column:
        hit = F.regexp_extract(F.replace(fixed, F.lit(" "), F.lit("")), r"(-?\d+)", 1)
        return F.when(hit != "", hit.cast("bigint").cast("string")).otherwise(fixed)

    return let(_fix_digits(col, True), shown)


def cell_money(col: Column) -> Column:
    """Money of a table cell: two-decimal text, else the repaired text."""

    def shown(fixed: Column) -> Column:
        raw = F.regexp_replace(fixed, r"[^0-9,.\-]", "")
        return F.coalesce(two_decimals(let(raw, _decimal_text).try_cast("double")), fixed)

    return let(_fix_digits(col, False), shown)
