"""Rule templates per document type.

A template is plain data; ``load_templates`` merges JSON files over these defaults.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnstone.constants import DOC_TYPES

AMOUNT = r"([0-9\s.,]+\s*MAD)"
DAY = r"([0-9]{2}/[0-9]{2}/[0-9]{4})"


def _rx(label: str, value: str = AMOUNT) -> dict:
    return {"type": "regex", "pattern": rf"{label}\s*:\s*{value}"}


def _colon(label: str) -> dict:
    return {"type": "after_colon", "labels": [label]}


# Ordered rules per field, required fields, schema fields.
TEMPLATES: dict[str, dict] = {
    "invoice": {
        "rules": {
            "invoice_number": [_rx("Reference", r"(INV-\d{4}-\d{6})"), _colon("Reference")],
            "invoice_date": [_rx("Date", DAY)],
            "due_date": [_rx("Echeance", DAY)],
            "total_ht": [_rx("Total HT")],
            "tva_20": [_rx(r"TVA\s*20%")],
            "total_ttc": [_rx("Total TTC")],
            "currency": [_colon("Devise")],
            "payment_terms": [{"type": "regex", "pattern": r"(Paiement\s+a\s+[^\n.]+(?:\.)?)"}],
        },
        "required": ["invoice_number", "invoice_date", "total_ttc"],
        "fields": ["invoice_number", "invoice_date", "due_date", "supplier_name", "supplier_address",
                   "client_name", "client_address", "payment_terms", "currency", "total_ht", "tva_20", "total_ttc"],
    },
    "bank_statement": {
        "rules": {
            "reference": [_rx("Reference", r"(STM-\d{4}-\d{6})"), _colon("Reference")],
            "bank_name": [_colon("Banque")],
            "account_holder": [_colon("Titulaire")],
            "account_number": [_colon("Compte")],
            "iban": [_colon("IBAN")],
            "period": [_colon("Periode")],
            "total_debit": [_rx("Total debit")],
            "total_credit": [_rx("Total credit")],
            "opening_balance": [_rx("Solde debut")],
            "closing_balance": [_rx("Solde fin")],
            "currency": [{"type": "regex", "pattern": r"\b(MAD)\b"}],
        },
        "required": ["period", "closing_balance"],
        "fields": ["reference", "bank_name", "account_holder", "account_number", "iban", "period", "total_debit",
                   "total_credit", "opening_balance", "closing_balance", "currency"],
    },
    "payment_receipt": {
        "rules": {
            "reference": [_rx("Reference", r"(TXN-\d{4}-\d{6})"), _colon("Reference")],
            "date": [_rx("Date", DAY)],
            "time": [_rx("Heure", r"([0-9]{2}:[0-9]{2}:[0-9]{2})")],
            "channel": [_colon("Canal")],
            "status": [_colon("Statut")],
            "purpose": [_colon("Motif")],
            "amount": [_rx("Montant")],
            "fees": [_rx("Frais")],
            "total_debited": [_rx("Total debite")],
            "currency": [_colon("Devise")],
            "transaction_id": [_colon("Transaction ID")],
            "auth_code": [_colon("Auth code")],
            "secure_channel": [_colon("Canal securise")],
        },
        "required": ["reference", "date", "amount", "transaction_id"],
        "fields": ["reference", "date", "time", "channel", "status", "payer_name", "payer_account", "beneficiary_name",
                   "beneficiary_account", "purpose", "amount", "fees", "total_debited", "currency", "transaction_id",
                   "auth_code", "secure_channel"],
    },
    "wire_transfer": {
        "rules": {
            "reference": [_rx("Reference", r"(TRF-\d{4}-\d{6})"), _colon("Reference")],
            "sender_name": [_colon("Nom")],
            "sender_bank": [_colon("Banque")],
            "sender_account": [_colon("Compte")],
            "sender_address": [_colon("Adresse")],
            "beneficiary_bank": [_colon("Banque beneficiaire")],
            "beneficiary_iban": [_colon("IBAN")],
            "beneficiary_rib": [_colon("RIB")],
            "purpose": [_colon("Motif")],
            "amount": [_rx("Montant")],
            "fees": [_rx("Frais")],
            "total": [_rx("Total")],
            "currency": [_colon("Devise")],
            "order_date": [_rx("Date ordre", DAY)],
            "execution_date": [_rx("Date execution", DAY)],
            "status": [_colon("Statut")],
        },
        "required": ["reference", "amount", "execution_date"],
        "fields": ["reference", "sender_name", "sender_bank", "sender_account", "sender_address", "beneficiary_name",
                   "beneficiary_bank", "beneficiary_iban", "beneficiary_rib", "purpose", "amount", "fees", "total",
                   "currency", "order_date", "execution_date", "status"],
    },
}
# Fields that boxes may fill and their labels.
BBOX_LABELS = {
    "reference": "Reference", "invoice_number": "Reference", "amount": "Montant", "total_ttc": "Total TTC",
    "closing_balance": "Solde fin", "transaction_id": "Transaction ID",
}


def load_templates(files: dict[str, str] | None = None) -> dict[str, dict]:
    """Defaults with the parts given by JSON texts ``{doc_type: json}`` laid over them."""
    merged = {k: dict(v) for k, v in TEMPLATES.items()}
    for kind, text in (files or {}).items():
        given = json.loads(text)
        for ours, theirs in (("rules", "fields_rules"), ("required", "required_fields")):
            if theirs in given:
                merged[kind][ours] = given[theirs]
        if "schema" in given:
            merged[kind]["fields"] = [k for k, v in given["schema"].items() if not isinstance(v, list)]
    return merged


def rule_table(spark: SparkSession, templates: dict[str, dict] = TEMPLATES) -> DataFrame:
    """Rules as rows ``(doc_type, field, rule_pos, type, pattern, grp, labels)``."""
    rows = [
        (kind, field, pos, r["type"], r.get("pattern"), int(r.get("group", 1)), r.get("labels"))
        for kind in DOC_TYPES for field, rules in templates[kind]["rules"].items() for pos, r in enumerate(rules)
    ]
    return spark.createDataFrame(
        rows, "doc_type string, field string, rule_pos int, type string, pattern string, grp int, labels array<string>")
