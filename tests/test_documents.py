"""Routing, extraction, geometry and matching on small texts, against models where rules are iterative."""

import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from turnstone.functions import numbers as N
from turnstone.operators import docextract as X, docroute as R, layout as L, matching as M

RECEIPT = """RECU DE PAIEMENT
Reference: TXN-2026-958793
Date: 19/02/2026
Canal: En ligne
Statut: Execute
PAYEUR BENEFICIAIRE
Montant: 23 778.80 MAD
Frais: 10.00 MAD
Transaction ID: TXN-2026-658663
Auth code: 883921"""
INVOICE = """FACTURE
Reference: INV-2025-057089
Date: 01/03/2025
FOURNISSEUR CLIENT
Designation Qte PU Total
Support utilisateur 2 4 332.47 MAD 8 664.94 MAD
TOTAUX
Total HT: 79 809.68 MAD
TVA 20%: 15 961.94 MAD
Total TTC: 95 771.62 MAD"""
STATEMENT = """RELEVE DE COMPTE
Titulaire: A
Periode: du 01/02/2026 au 28/02/2026
Date Libelle Debit Credit Solde
02/02/2026 Paiement carte 4 977.05 MAD 46 101.82 MAD
SYNTHESE PERIODE
Solde fin: 31 686.06 MAD"""
WIRE = """ORDRE DE VIREMENT
Reference: TRF-2024-519862
EMETTEUR
BENEFICIAIRE
IBAN: MA64 0000 1111 2222 3333 4444
Montant: 113 432.59 MAD
Date execution: 30/01/2026"""
TEXTS = {1: ("payment_receipt", RECEIPT), 2: ("invoice", INVOICE), 3: ("bank_statement", STATEMENT), 4: ("wire_transfer", WIRE)}


def _docs(spark):
    return spark.createDataFrame([(k, t, x) for k, (t, x) in TEXTS.items()] + [(5, "unknown", "")], "doc_id long, want string, raw_text string")


def test_routing(spark):
    for r in R.route(_docs(spark)).collect():
        assert r.doc_type == r.want
        assert r.confidence >= 0.55 if r.want != "unknown" else r.confidence == 0.0
        assert 1 <= len(r.reasons) <= 6


def test_extraction(spark):
    docs = _docs(spark).withColumnRenamed("want", "doc_type")
    got = {r.doc_id: r.fields for r in X.fields(docs).collect() if r.fields}
    assert got[1]["amount"] == "23 778.80 MAD" and got[1]["transaction_id"] == "TXN-2026-658663"
    assert got[2]["invoice_number"] == "INV-2025-057089" and got[2]["total_ttc"] == "95 771.62 MAD"
    assert got[3]["period"] == "du 01/02/2026 au 28/02/2026" and got[3]["closing_balance"] == "31 686.06 MAD"
    assert got[4]["reference"] == "TRF-2024-519862" and got[4]["execution_date"] == "30/01/2026"
    item = X.invoice_items(docs).first()
    assert (item.designation, item.quantity, item.unit_price, item.line_total) == ("Support utilisateur", "2", "4 332.47 MAD", "8 664.94 MAD")
    txn = X.statement_transactions(docs).first()
    assert (txn.date, txn.debit, txn.credit, txn.balance) == ("02/02/2026", "4 977.05 MAD", "", "46 101.82 MAD")


def test_blocks(spark):
    rows = [(1, 1, 0, "TITRE:", 20.0, 20.0, 120.0, 34.0), (1, 1, 1, "Ligne 1", 20.0, 50.0, 160.0, 64.0), (1, 1, 2, "Ligne 2", 20.0, 66.0, 160.0, 80.0)]
    lines = spark.createDataFrame(rows, "doc_id long, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [(r.kind, r.text) for r in L.paragraph_blocks(lines).orderBy("block").collect()] == [
        ("title", "TITRE:"), ("paragraph", "Ligne 1"), ("title", "Ligne 2")]


def test_column_clustering_equals_model(spark):
    rnd = random.Random(3)
    values = [float(rnd.choice([40, 200, 330, 480]) + rnd.randint(-15, 15)) for _ in range(200)]
    centres = [float(np.quantile(values, q)) for q in np.linspace(0, 1, 6)[1:-1]]
    for _ in range(40):
        groups = [[] for _ in range(4)]
        for v in values:
            groups[min(range(4), key=lambda i: abs(v - centres[i]))].append(v)
        moved = [float(np.mean(g)) if g else centres[i] for i, g in enumerate(groups)]
        done = np.allclose(moved, centres, atol=0.1)
        centres = moved
        if done:
            break
    counts = pd.Series(values).value_counts()
    out = L._centres(pd.DataFrame({"doc_id": 1, "page": 1, "x": counts.index, "n": counts.values})).iloc[0]
    assert np.allclose([out[f"c{i}"] for i in range(4)], sorted(centres))
    tokens = spark.createDataFrame([(1, 1, 1, i, "x", 90, int(v) - 5, 0, int(v) + 5, 10) for i, v in enumerate(values)],
                                   "doc_id long, page int, line_id int, pos int, text string, conf int, x0 int, y0 int, x1 int, y1 int")
    row = L.column_centres(tokens).first()
    assert row.method == "kmeans" and np.allclose([row[f"c{i}"] for i in range(4)], sorted(centres))


def test_fuzzy_equals_all_pairs(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcde ") for _ in range(rnd.randint(3, 14))).strip() or "a"
    refs = sorted({word() for _ in range(60)})
    values = []
    for r in refs:
        s = list(r)
        for _ in range(rnd.randint(0, 2)):
            i = rnd.randrange(len(s))
            s[i] = rnd.choice("abcdez")
        values.append("".join(s))
    entities = spark.createDataFrame([(i, r, []) for i, r in enumerate(refs)], "id long, canonical_name string, aliases array<string>")
    got = {r.value: (r.matched_id, None if r.score is None else round(r.score, 6)) for r in M.fuzzy_match(spark.createDataFrame([(v,) for v in values], "value string"), entities).collect()}
    norm = lambda t: " ".join(t.lower().split())
    for v in set(values):
        best, score = None, -1.0
        for i, r in enumerate(refs):
            s = SequenceMatcher(a=norm(v), b=norm(r)).ratio() * 100
            if s > score:
                best, score = i, s
        if norm(v) and score >= 85:
            assert got[v][1] == round(score, 6)
        else:
            assert got[v] == (None, None)  # never compared, so no score


def test_money(spark):
    cases = {"1.234,50 EUR": "1234.50", "1,234.5": "1234.50", "12,5": "12.50", "1.234.567": "1234.57", "n/a": "", "536.635": "536.63", "66.265": "66.27"}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r.v: r.m for r in df.select("v", N.money(F.col("v")).alias("m")).collect()}
    assert got == cases | {"1.234.567": f"{1234.567:.2f}"}
