"""Document type from text: features, scores, type with confidence and reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from turnstone.constants import DOC_TYPES, MIN_CONFIDENCE, MIN_SCORE, UNKNOWN_TYPE
from turnstone.functions.text import count_of, norm_doc, text_lines

# Keyword weights per type.
KEYWORDS: dict[str, dict[str, float]] = {
    "invoice": {
        "facture": 1.2, "invoice": 1.1, "reference facture": 1.0, "client": 0.8, "fournisseur": 0.9,
        "designation": 0.8, "qte": 0.9, "quantite": 0.9, "prix unitaire": 1.0, "total ht": 1.4,
        "tva": 1.3, "ttc": 1.3, "echeance": 0.8, "conditions de paiement": 0.8,
    },
    "bank_statement": {
        "releve de compte": 1.5, "statement": 1.0, "titulaire": 0.9, "compte": 0.8, "periode": 1.0,
        "debit": 1.3, "credit": 1.3, "solde": 1.3, "solde debut": 1.1, "solde fin": 1.1,
        "total debit": 1.0, "total credit": 1.0,
    },
    "payment_receipt": {
        "recu de paiement": 1.5, "recu paiement": 1.3, "avis de debit": 1.2, "canal": 1.0, "agence": 0.8,
        "atm": 0.8, "en ligne": 0.8, "transaction id": 1.2, "auth code": 1.2, "statut": 0.9,
        "payeur": 1.0, "beneficiaire": 1.0, "frais": 0.8,
    },
    "wire_transfer": {
        "ordre de virement": 1.6, "avis de virement": 1.4, "virement": 1.0, "emetteur": 1.1,
        "beneficiaire": 1.0, "banque beneficiaire": 1.2, "iban": 1.0, "rib": 1.0, "date execution": 1.2,
        "reference": 0.8, "motif": 0.8, "frais": 0.7,
    },
}
# Patterns per type with the reason they stand for; each hit counts 0.6.
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "invoice": [
        (r"\binv-\d{4}-\d{4,6}\b", "reference facture detectee"),
        (r"\bht\b", "champ HT detecte"),
        (r"\btva\b", "champ TVA detecte"),
        (r"\bttc\b", "champ TTC detecte"),
    ],
    "bank_statement": [
        (r"\bsolde\b", "champ Solde detecte"),
        (r"\bdebit\b", "champ Debit detecte"),
        (r"\bcredit\b", "champ Credit detecte"),
    ],
    "payment_receipt": [
        (r"\btxn-\d{4}-\d{4,6}\b", "reference TXN detectee"),
        (r"\bauth(?:orization)?\s*code\b", "code d'autorisation detecte"),
        (r"\b(recu|receipt)\b", "motif recu detecte"),
    ],
    "wire_transfer": [
        (r"\btrf-\d{4}-\d{4,6}\b", "reference TRF detectee"),
        (r"\bma\d{2}[0-9 ]{18,}\b", "IBAN marocain plausible detecte"),
        (r"\bvirement\b", "motif virement detecte"),
    ],
}
# Plain texts without which a pattern can't match; a search for them is cheaper than the pattern.
NEEDED: dict[str, tuple[str, ...]] = {
    "invoice": ("inv-", "ht", "tva", "ttc"), "bank_statement": ("solde", "debit", "credit"),
    "payment_receipt": ("txn-", "auth", "rec"), "wire_transfer": ("trf-", "ma", "virement"),
}
PATTERN_SCORE = 0.6
DATE = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
AMOUNT = r"\b\d{1,3}(?:[ .]\d{3})*(?:[.,]\d{2})\b"
BOOSTS = {
    "transactions": (1.8, "beaucoup de lignes type transaction (dates + montants)"),
    "invoice_table": (1.0, "structure tabulaire montants compatible facture"),
    "statement_table": (0.8, "structure tabulaire montants compatible releve"),
    "iban_pair": (1.2, "couple IBAN + beneficiaire detecte"),
    "tax_triplet": (1.4, "triplet HT/TVA/TTC detecte"),
}


def features(docs: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds line counts and hit counts. One projection per step, no explode, no shuffle."""
    rows = docs.withColumn("norm", norm_doc(F.col(text)))
    rows = rows.withColumn("norm_lines", text_lines(F.col("norm")))
    # A date holds a slash or a dash, an amount a point or a comma.
    dated = lambda s: (s.contains("/") | s.contains("-")) & s.rlike(DATE)
    amount = lambda s: (s.contains(".") | s.contains(",")) & s.rlike(AMOUNT)
    flow = lambda s: s.contains("debit") | s.contains("credit") | s.contains("solde")
    # each pattern runs once over a line, and only over lines with a digit
    digit = lambda s: s.rlike("[0-9]")
    marks = F.transform(F.filter("norm_lines", digit), lambda s: F.struct(
        dated(s).alias("dated"), amount(s).alias("amount"), flow(s).alias("flow"), s.alias("line")))
    rows = rows.withColumn("marks", marks)
    count = lambda cond: F.size(F.filter("marks", cond))
    rows = rows.withColumns({
        "line_count": F.size("norm_lines"),
        "date_line_count": count(lambda m: m["dated"]),
        "amount_line_count": count(lambda m: m["amount"]),
        "transaction_line_count": count(lambda m: m["dated"] & (m["amount"] | m["flow"])),
        "multi_amount_lines": count(lambda m: m["amount"] & m["line"].rlike(f"{AMOUNT}.*?{AMOUNT}")),
    })
    norm = F.col("norm")
    hits = {}
    for kind in DOC_TYPES:
        hits[f"kw_{kind}"] = F.array(*[F.when(norm.contains(word), count_of(norm, word)).otherwise(F.lit(0)) for word in KEYWORDS[kind]])
        hits[f"rx_{kind}"] = F.array(*[
            F.when(norm.contains(need), F.regexp_count(norm, F.lit(p))).otherwise(F.lit(0)) for (p, _), need in zip(PATTERNS[kind], NEEDED[kind], strict=True)])
    return rows.withColumns(hits).drop("norm", "norm_lines", "marks")


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def _hit(kind: str, word: str) -> Column:
    return F.get(f"kw_{kind}", F.lit(list(KEYWORDS[kind]).index(word))) > 0


def _capped(n: Column) -> Column:
    return F.least(n, F.lit(3))


def scores(feats: DataFrame, model_votes: DataFrame | None = None) -> DataFrame:
    """Adds ``score_<type>``; ``model_votes`` may bring ``(doc_id, ml_type, ml_conf)``, or ``feats`` holds these columns."""
    dense = (F.col("date_line_count") >= 6) & (F.col("transaction_line_count") >= 4)
    table = (F.col("multi_amount_lines") >= 3) & (F.col("amount_line_count") >= 6)
    iban = _hit("wire_transfer", "iban") & (_hit("wire_transfer", "beneficiaire"))
    triplet = _hit("invoice", "total ht") & _hit("invoice", "tva") & _hit("invoice", "ttc")
    boosts = {
        "invoice": [(table, "invoice_table"), (triplet, "tax_triplet")],
        "bank_statement": [(dense, "transactions"), (table, "statement_table")],
        "payment_receipt": [],
        "wire_transfer": [(iban, "iban_pair")],
    }
    rows = feats
    if model_votes is not None:
        rows = rows.join(model_votes, "doc_id", "left")
    voted = "ml_type" in rows.columns
    for kind in DOC_TYPES:
        kw = [_capped(F.get(f"kw_{kind}", F.lit(i))) * w for i, w in enumerate(KEYWORDS[kind].values())]
        rx = [_capped(F.get(f"rx_{kind}", F.lit(i))) * PATTERN_SCORE for i in range(len(PATTERNS[kind]))]
        extra = [F.when(c, BOOSTS[b][0]).otherwise(0.0) for c, b in boosts[kind]]
        if voted:
            vote = F.least(F.lit(2.0), F.greatest(F.lit(0.0), F.col("ml_conf") * 2))
            extra.append(F.when(F.col("ml_type") == kind, vote).otherwise(0.0))
        texts = [
            F.when(F.get(f"kw_{kind}", F.lit(i)) > 0, F.concat(
                F.lit(f"mot-cle '{w}' x"), F.get(f"kw_{kind}", F.lit(i)).cast("string")))
            for i, w in enumerate(KEYWORDS[kind])
        ] + [
            F.when(F.get(f"rx_{kind}", F.lit(i)) > 0, F.concat(
                F.lit(f"{r} x"), F.get(f"rx_{kind}", F.lit(i)).cast("string")))
            for i, (_, r) in enumerate(PATTERNS[kind])
        ] + [F.when(c, BOOSTS[b][1]) for c, b in boosts[kind]]
        rows = rows.withColumn(f"score_{kind}", _sum(kw + rx + extra))
        rows = rows.withColumn(f"why_{kind}", F.array_compact(F.array(*texts)))
    return rows


def route(docs: DataFrame, text: str = "raw_text", model_votes: DataFrame | None = None) -> DataFrame:
    """Adds ``doc_type``, ``confidence`` and up to six ``reasons``."""
    rows = scores(features(docs, text), model_votes)
    all_scores = F.array(*[F.col(f"score_{k}") for k in DOC_TYPES])
    rows = rows.withColumn("_s", all_scores).withColumn("_top", F.array_max("_s"))
    best = F.array_position("_s", F.col("_top"))
    second = F.get(F.sort_array("_s", asc=False), F.lit(1))
    total = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x)
    top = F.col("_top")
    confidence = F.when(total <= 0, F.lit(0.0)).otherwise(
        0.55 * top / total + 0.30 * (top - second) / F.greatest(top, F.lit(1e-6))
        + 0.15 * F.least(F.lit(1.0), top / 8.0)
    )
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    rows = rows.withColumn("_c", F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)))
    rows = rows.withColumn("_kind", F.element_at(F.array(*[F.lit(k) for k in DOC_TYPES]), best.cast("int")))
    rows = rows.withColumn("_why", F.element_at(F.array(*[F.col(f"why_{k}") for k in DOC_TYPES]), best.cast("int")))
    weak = (top < MIN_SCORE) | (F.col("_c") < MIN_CONFIDENCE)
    note = F.format_string("score/confiance insuffisants (%.2f, %.2f)", top, F.col("_c"))
    reasons = (
        F.when(blank, F.array(F.lit("texte OCR vide")))
        .when(weak, F.array_append(F.slice("_why", 1, 3), note))
        .otherwise(F.slice("_why", 1, 6))
    )
    return rows.select(
        *docs.columns,
        F.when(blank | weak, UNKNOWN_TYPE).otherwise(F.col("_kind")).alias("doc_type"),
        F.when(blank, F.lit(0.0)).otherwise(F.round("_c", 4)).alias("confidence"),
        reasons.alias("reasons"),
    )


def apply_override(routed: DataFrame, forced: str) -> DataFrame:
    """A forced type replaces the found one with full confidence."""
    given = F.col(forced).isin(*DOC_TYPES)
    return routed.withColumn("doc_type", F.when(given, F.col(forced)).otherwise(F.col("doc_type"))).withColumn(
        "confidence", F.when(given, F.lit(1.0)).otherwise(F.col("confidence")))


def extractor_name(doc_type: Column) -> Column:
    return (
        F.when(doc_type == "invoice", "invoice_table")
        .when(doc_type.isin("bank_statement", "payment_receipt", "wire_transfer"), "generic_text_json")
        .otherwise("raw_text_only")
    )
