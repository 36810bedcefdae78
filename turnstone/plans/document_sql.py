"""DuckDB statements of the rendered document tables."""


def mad(cents: str) -> str:
    return f"(replace(format('{{:,.2f}}', ({cents}) / 100.0), ',', ' ') || ' MAD')"


def cents(col: str) -> str:
    return f"cast(round(abs({col}) * 100) AS BIGINT)"


def _t(*parts: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


_DAY = "strftime({c}, '%d/%m/%Y')"

VIEWS = f"""
inv0 AS (SELECT o_orderkey * 4 AS doc_id, o_custkey, o_orderkey % 9 + 1 AS qty, o_orderdate AS issued, {cents('o_totalprice')} AS ttc,
  'INV-' || year(o_orderdate) || '-' || printf('%06d', o_orderkey % 1000000) AS reference FROM orders),
inv1 AS (SELECT *, (ttc * 10) // 12 AS ht, ((ttc * 10) // 12) // qty AS pu FROM inv0),
inv AS (SELECT doc_id, o_custkey, qty, reference, issued, strftime(issued, '%d/%m/%Y') AS day, strftime(issued + INTERVAL 30 DAY, '%d/%m/%Y') AS due,
  {mad('ht')} AS ht, {mad('ttc - ht')} AS tva, {mad('ttc')} AS ttc, {mad('pu')} AS pu, {mad('pu * qty')} AS line1, {mad('ht - pu * qty')} AS line2,
  ttc AS ttc_cents, ht AS ht_cents, pu AS pu_cents FROM inv1),
stm AS (SELECT c_custkey * 4 + 1 AS doc_id, c_custkey AS k, c_name, {cents('c_acctbal')} + 500000 AS bal FROM customer),
rec AS (SELECT event_id * 4 + 2 AS doc_id, event_id AS k, user_id, ts, {cents('value')} AS amount FROM events),
wir AS (SELECT s_suppkey * 4 + 3 AS doc_id, s_suppkey AS k, s_name, s_nationkey, {cents('s_acctbal')} + 100 AS amount FROM supplier),
ocr AS (
  SELECT doc_id, 'invoice' AS kind, {_t("'FACTURE'", "'Reference: ' || reference", "'Date: ' || day", "'Echeance: ' || due", "'FOURNISSEUR CLIENT'",
    "'ATLAS FOURNITURES AU COMPTOIR ' || o_custkey", "'12 avenue Atlas Maroc  ' || o_custkey || ' rue des Ateliers Maroc'", "'Designation Qte PU Total'",
    "'Support utilisateur ' || qty || ' ' || pu || ' ' || line1", "'Frais de dossier 1 ' || line2 || ' ' || line2", "'CONDITIONS DE PAIEMENT'",
    "'Paiement a 30 jours.'", "'TOTAUX'", "'Total HT: ' || ht", "'TVA 20%: ' || tva", "'Total TTC: ' || ttc", "'Devise: MAD'")} AS raw_text, issued AS date_uploaded FROM inv
  UNION ALL
  SELECT doc_id, 'bank_statement', {_t("'RELEVE DE COMPTE'", "'Reference: STM-2024-' || printf('%06d', k % 1000000)", "'INFORMATIONS COMPTE'", "'Banque: Banque Centrale'",
    "'Titulaire: ' || c_name", "'Compte: 00' || printf('%010d', k)", "'IBAN: MA64 0000 0000 ' || printf('%010d', k) || ' 00'",
    "'Periode: du 01/02/2024 au 29/02/2024'", "'Date Libelle Debit Credit Solde'", "'02/02/2024 Achat carte 100.00 MAD ' || " + mad('bal - 10000'),
    "'10/02/2024 Virement recu 250.00 MAD ' || " + mad('bal + 15000'), "'20/02/2024 Operation mixte 10.00 MAD 20.00 MAD ' || " + mad('bal + 16000'),
    "'SYNTHESE PERIODE'", "'Total debit: 110.00 MAD'", "'Total credit: 270.00 MAD'", "'Solde debut: ' || " + mad('bal'), "'Solde fin: ' || " + mad('bal + 16000'))},
    TIMESTAMP '2024-03-01' + to_minutes((k % 40000)::INT) FROM stm
  UNION ALL
  SELECT doc_id, 'payment_receipt', {_t("'RECU DE PAIEMENT'", "'Reference: TXN-2024-' || printf('%06d', k % 1000000)", "'DETAILS RECU'", "'Date: ' || strftime(ts, '%d/%m/%Y')",
    "'Heure: ' || strftime(ts, '%H:%M:%S')", "'Canal: En ligne'", "'Statut: Execute'", "'PAYEUR BENEFICIAIRE'", "'Client ' || user_id || '  Parking Central'",
    "'Compte: ' || printf('%012d', user_id) || '  Compte: 990000000001'", "'MONTANTS ET MOTIF'", "'Motif: Stationnement'", "'Montant: ' || " + mad('amount'),
    "'Frais: 1.50 MAD'", "'Total debite: ' || " + mad('amount + 150'), "'Devise: MAD'", "'INFORMATIONS TRANSACTION'",
    "'Transaction ID: TXN-2024-' || printf('%06d', k % 1000000)", "'Auth code: ' || printf('%06d', k % 1000000)", "'Canal securise: Oui'")}, ts FROM rec
  UNION ALL
  SELECT doc_id, 'wire_transfer', {_t("'ORDRE DE VIREMENT'", "'Reference: TRF-2024-' || printf('%06d', k % 1000000)", "'EMETTEUR'", "'Nom: Societe Atlas'", "'Banque: Banque Populaire'",
    "'Compte: 001122334455'", "'Adresse: 5 avenue Atlas'", "'BENEFICIAIRE'", "'Nom: ' || s_name", "'Banque beneficiaire: Banque ' || s_nationkey",
    "'IBAN: MA64 0000 1111 ' || printf('%010d', k)", "'RIB: ' || printf('%012d', k)", "'DETAILS VIREMENT'", "'Motif: Reglement'", "'Montant: ' || " + mad('amount'),
    "'Frais: 25.00 MAD'", "'Total: ' || " + mad('amount + 2500'), "'Devise: MAD'", "'EXECUTION'", "'Date ordre: 05/02/2024'", "'Date execution: 07/02/2024'", "'Statut: Execute'")},
    TIMESTAMP '2024-02-07' + to_minutes((k % 40000)::INT) FROM wir),
texts AS (SELECT -doc_id - 1 AS doc_id, text AS raw_text FROM documents UNION ALL SELECT doc_id, raw_text FROM ocr),
lines AS (
  SELECT doc_id, kind, 1 AS page, line_no, text, 20.0::DOUBLE AS x0, (line_no * 20 + CASE WHEN line_no >= 7 THEN 30 ELSE 0 END)::DOUBLE AS y0,
    (length(text) * 7 + 20)::DOUBLE AS x1, (line_no * 20 + CASE WHEN line_no >= 7 THEN 30 ELSE 0 END + 14)::DOUBLE AS y1
  FROM (SELECT doc_id, kind, unnest(string_split(raw_text, chr(10))) AS text, generate_subscripts(string_split(raw_text, chr(10)), 1) - 1 AS line_no FROM ocr)),
tok0 AS (SELECT doc_id, page, line_no, y0, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM lines WHERE kind = 'invoice'),
tokens AS (
  SELECT doc_id, page, line_no, pos, text, ((doc_id * 7 + line_no * 13 + pos * 29) % 100)::INT AS conf, (pos * 90 + 20)::INT AS x0, (y0 + pos % 3)::INT AS y0,
    (pos * 90 + 20 + length(text) * 8)::INT AS x1, (y0 + pos % 3 + 12)::INT AS y1, (line_no + 1)::INT AS line_id, 1 AS block_num,
    (line_no // 8)::INT AS par_num, (line_no % 8)::INT AS line_num FROM tok0)
"""


def sql(text: str, *more: str) -> str:
    return "WITH RECURSIVE " + ", ".join([VIEWS.strip(), *more]) + "\n" + text
