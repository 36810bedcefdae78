"""Unicode folding on the JVM side.

Spark has no normalisation function of its own, but it ships the ICU library for its collations, and `try_reflect` calls
its static methods: whole compatibility composition and decomposition, with canonical order, for all code points. Only
texts with a character beyond ASCII take that way. The call counts as not deterministic, so a folded column is computed in
a projection of its own before it becomes a join key, and filters that should reach a scan stand before the folding.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from turnstone.functions.binding import let

ICU_NORMALIZER = "com.ibm.icu.text.Normalizer"
BEYOND_ASCII = r"[^\x00-\x7F]"


def _icu(col: Column, method: str, then=lambda text: text) -> Column:
    """`method` of the library with compatibility on, and ``then`` of it; ASCII texts and null as they are."""
    def folded(text: Column) -> Column:
        call = then(F.try_reflect(F.lit(ICU_NORMALIZER), F.lit(method), text, F.lit(True)))
        return F.when(text.rlike(BEYOND_ASCII), call).otherwise(text)

    return let(col, folded)


def nfkc(col: Column) -> Column:
    """Compatibility composition."""
    return _icu(col, "compose")


def nfkd(col: Column) -> Column:
    """Compatibility decomposition."""
    return _icu(col, "decompose")


def drop_format_chars(col: Column) -> Column:
    return F.regexp_replace(col, r"\p{Cf}", "")


def strip_marks(col: Column) -> Column:
    """Compatibility decomposition without combining marks."""
    return _icu(col, "decompose", lambda text: F.regexp_replace(text, r"\p{M}", ""))  # ASCII has none
