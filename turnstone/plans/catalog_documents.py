"""Registered document queries: text functions, routing, extraction."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from turnstone.catalog import query
from turnstone.constants import DOC_TYPES
from turnstone.functions import text as T
from turnstone.operators import docextract as X, docroute as R
from turnstone.operators.templates import BBOX_LABELS, TEMPLATES, rule_table
from turnstone.plans.document_sql import sql
from turnstone.session import materialize
from turnstone.sources.documents import DocumentTables


def docs(key: str, text: str | None = None, *more: str):
    def add(fn):
        query(key, sql(text, *more) if text else None)(lambda spark, folder: fn(DocumentTables(spark, folder)))
        return fn

    return add


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NORM = "regexp_replace(strip_accents(lower(raw_text)), '[ \\t]+', ' ', 'g')"
LINES = "list_filter(list_transform(string_split_regex({t}, '\\r\\n|\\n|\\r'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '')"


def _count(word: str) -> str:
    return f"((length(norm) - length(replace(norm, {_q(word)}, ''))) // {len(word)})"


def _matches(pattern: str) -> str:
    return f"len(regexp_extract_all(norm, {_q(pattern)}))"


FEATURES = f"""
n0 AS (SELECT doc_id, raw_text, {NORM} AS norm FROM texts),
n1 AS (SELECT *, {LINES.format(t='norm')} AS ls FROM n0),
feat AS (SELECT doc_id, raw_text, norm, len(ls) AS line_count,
  len(list_filter(ls, lambda x: regexp_matches(x, '{R.DATE}'))) AS date_line_count,
  len(list_filter(ls, lambda x: regexp_matches(x, '{R.AMOUNT}'))) AS amount_line_count,
  len(list_filter(ls, lambda x: regexp_matches(x, '{R.DATE}') AND (regexp_matches(x, '{R.AMOUNT}') OR contains(x, 'debit') OR contains(x, 'credit') OR contains(x, 'solde')))) AS transaction_line_count,
  len(list_filter(ls, lambda x: len(regexp_extract_all(x, '{R.AMOUNT}')) >= 2)) AS multi_amount_lines FROM n1)""".strip()
HITS = ", ".join(
    f"list_sum([{', '.join(_count(w) for w in R.KEYWORDS[k])}])::BIGINT AS kw_{k}, list_sum([{', '.join(_matches(p) for p, _ in R.PATTERNS[k])}])::BIGINT AS rx_{k}"
    for k in DOC_TYPES)
FEATURE_COLS = ["line_count", "date_line_count", "amount_line_count", "transaction_line_count", "multi_amount_lines"]


@docs("doc_features", f"SELECT doc_id, {', '.join(FEATURE_COLS)}, {HITS} FROM feat", FEATURES)
def _features(t):
    rows = R.features(t.texts)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x).alias(c)
    return rows.select("doc_id", *FEATURE_COLS, *[total(f"{p}_{k}") for k in DOC_TYPES for p in ("kw", "rx")])


def _score_sql(kind: str) -> str:
    parts = [f"{w} * least({_count(k)}, 3)" for k, w in R.KEYWORDS[kind].items()]
    parts += [f"0.6 * least({_matches(p)}, 3)" for p, _ in R.PATTERNS[kind]]
    table = "multi_amount_lines >= 3 AND amount_line_count >= 6"
    if kind == "invoice":
        parts += [f"CASE WHEN {table} THEN 1.0 ELSE 0 END",
                  "CASE WHEN contains(norm, 'total ht') AND contains(norm, 'tva') AND contains(norm, 'ttc') THEN 1.4 ELSE 0 END"]
    if kind == "bank_statement":
        parts += [f"CASE WHEN {table} THEN 0.8 ELSE 0 END",
                  "CASE WHEN date_line_count >= 6 AND transaction_line_count >= 4 THEN 1.8 ELSE 0 END"]
    if kind == "wire_transfer":
        parts.append("CASE WHEN contains(norm, 'iban') AND contains(norm, 'beneficiaire') THEN 1.2 ELSE 0 END")
    return "(" + " + ".join(parts) + ")::DOUBLE"


SCORES = "sc AS (SELECT doc_id, raw_text, " + ", ".join(f"round({_score_sql(k)}, 6) AS s_{k}" for k in DOC_TYPES) + " FROM feat)"
ROUTED = """r0 AS (SELECT doc_id, raw_text, [s_invoice, s_bank_statement, s_payment_receipt, s_wire_transfer] AS s FROM sc),
r1 AS (SELECT *, list_max(s) AS top, list_reverse_sort(s)[2] AS second, list_sum(s) AS total FROM r0),
r2 AS (SELECT *, CASE WHEN total <= 0 THEN 0.0 ELSE 0.55 * top / total + 0.30 * (top - second) / greatest(top, 1e-6) + 0.15 * least(1.0, top / 8.0) END AS c,
  ['invoice', 'bank_statement', 'payment_receipt', 'wire_transfer'][list_position(s, top)] AS kind FROM r1),
routed AS (SELECT doc_id, CASE WHEN trim(raw_text) = '' OR top < 2.2 OR c < 0.55 THEN 'unknown' ELSE kind END AS doc_type, round(c, 4) AS confidence FROM r2)"""


@docs("agg_doc_scores", "SELECT doc_id, s_invoice, s_bank_statement, s_payment_receipt, s_wire_transfer FROM sc", FEATURES, SCORES)
def _scores(t):
    rows = R.scores(R.features(t.texts))
    return rows.select("doc_id", *[F.round(f"score_{k}", 6).alias(f"s_{k}") for k in DOC_TYPES])


docs("doc_route", "SELECT * FROM routed", FEATURES, SCORES, ROUTED)(
    lambda t: R.route(t.texts).select("doc_id", "doc_type", "confidence"))
docs("doc_extractor_choice", """SELECT doc_id, CASE kind WHEN 'invoice' THEN 'invoice_table' WHEN 'note' THEN 'raw_text_only' ELSE 'generic_text_json' END AS extractor
  FROM (SELECT doc_id, kind FROM ocr UNION ALL SELECT -doc_id - 1, 'note' FROM documents)""")(
    lambda t: t.ocr.select("doc_id", "kind").union(t.texts.filter("doc_id < 0").select("doc_id", F.lit("note"))).select(
        "doc_id", R.extractor_name(F.col("kind")).alias("extractor")))
# Routed once and written, since a sort reads its input twice: for the ranges and for the rows.
docs("src_documents", """SELECT o.doc_id, o.date_uploaded, r.doc_type FROM ocr o JOIN routed r USING (doc_id)""", FEATURES, SCORES, ROUTED)(
    lambda t: materialize(R.route(t.ocr).select("doc_id", "date_uploaded", "doc_type"), "routed").orderBy(F.desc("date_uploaded"), "doc_id"))

# -- text functions over every text --------------------------------------------------------------------
# NFKD-based folding; the prose has accents only, for which plain accent removal is the same.
FOLD = "strip_accents(raw_text)"
SPACE1 = "trim(regexp_replace({t}, '[\\s]+', ' ', 'g'))"
for _key, _fn, _text in [
    ("fn_norm_doc", T.norm_doc, NORM),
    ("fn_norm_compact", T.norm_compact, f"regexp_replace(lower({FOLD}), '[^a-z0-9]', '', 'g')"),
    ("fn_norm_ascii", T.norm_ascii, f"trim(regexp_replace(lower(regexp_replace({FOLD}, '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"),
    ("fn_norm_text_nfk", T.norm_question, SPACE1.format(t=f"replace(replace(lower({FOLD}), '’', ''''), '`', '''')")),
    ("fn_clean_value", T.clean_value, "trim(regexp_replace(raw_text, '\\s+', ' ', 'g'), ' :-' || chr(9))"),
]:
    docs(_key, f"SELECT doc_id, md5({_text}) AS digest, length({_text}) AS n FROM texts")(
        lambda t, fn=_fn: t.texts.select("doc_id", fn(F.col("raw_text")).alias("v")).select(
            "doc_id", F.md5("v").alias("digest"), F.length("v").alias("n")))
docs("fn_split_lines", f"SELECT doc_id, unnest({LINES.format(t='raw_text')}) AS line FROM texts")(
    lambda t: t.texts.select("doc_id", F.explode(T.text_lines(F.col("raw_text"))).alias("line")))
docs("fn_score_ocr_text", """SELECT doc_id, round(0.2 * length(regexp_replace(raw_text, '[\\pC\\n\\t\\r]', '', 'g')) + 0.8 * length(regexp_replace(raw_text, '[^\\pL\\pN]', '', 'g'))
  + 4 * len(regexp_extract_all(raw_text, '[A-Za-z0-9]{2,}')) - 2 * len(regexp_extract_all(raw_text, '[<>\\[\\]{}|\\\\^~`]')), 4)::DOUBLE AS score FROM texts""")(
    lambda t: t.texts.select("doc_id", F.round(T.score_ocr_text(F.col("raw_text")), 4).alias("score")))
docs("fn_amount_tokens", "SELECT doc_id, unnest(regexp_extract_all(raw_text, '(?i)\\d[\\d\\s]*[.,]\\d{2}\\s*MAD')) AS amount FROM ocr")(
    lambda t: t.ocr.select("doc_id", F.explode(T.amount_tokens(F.col("raw_text"))).alias("amount")))
ANCHOR = """(length(regexp_replace(line, '[^\\pL]', '', 'g')) > 0 AND length(regexp_replace(line, '[^\\p{Lu}]', '', 'g')) >= 0.8 * length(regexp_replace(line, '[^\\pL]', '', 'g')) AND length(line) <= 60)
  OR line LIKE '%:' OR contains(line, ' : ') OR """ + " OR ".join(f"contains(lower(strip_accents(line)), '{w}')" for w in T.STRONG_KEYWORDS)
docs("fn_looks_like_anchor", f"""SELECT doc_id, line_no, trim(regexp_replace(string_split(line, ':')[1], '\\s+', ' ', 'g')) AS name FROM (SELECT doc_id, line_no, text AS line FROM lines) WHERE {ANCHOR}""")(
    lambda t: t.lines.filter(T.looks_like_anchor(F.col("text"))).select("doc_id", "line_no", T.anchor_name(F.col("text")).alias("name")))
docs("fn_truncate", """SELECT doc_id, CASE WHEN length(raw_text) <= 6000 THEN raw_text ELSE regexp_replace(left(raw_text, 6000), '\\s+$', '') || chr(10) || '...[TRUNCATED]' END AS short FROM texts""")(
    lambda t: t.texts.select("doc_id", T.truncate(F.col("raw_text"), 6000).alias("short")))
docs("fn_sanitize_question", """SELECT conv_id, turn, left(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1f\\x7f]+', ' ', 'g'), '\\s+', ' ', 'g')), 500) AS q FROM conversations""")(
    lambda t: t.read("conversations").select("conv_id", "turn", T.sanitize_question(F.col("text")).alias("q")))
FILES = """files AS (SELECT doc_id, 'scan_' || doc_id || CASE kind WHEN 'invoice' THEN '.pdf' WHEN 'bank_statement' THEN '.PNG' WHEN 'payment_receipt' THEN '.jpeg' ELSE '.tiff' END AS name,
  date_uploaded FROM ocr)"""


def files(t):
    ext = F.when(F.col("kind") == "invoice", ".pdf").when(F.col("kind") == "bank_statement", ".PNG").when(
        F.col("kind") == "payment_receipt", ".jpeg").otherwise(".tiff")
    return t.ocr.select("doc_id", F.concat(F.lit("scan_"), F.col("doc_id").cast("string"), ext).alias("name"), "date_uploaded")


docs("fn_mime_type", """SELECT doc_id, CASE WHEN name LIKE '%.pdf' THEN 'application/pdf' WHEN name LIKE '%.PNG' THEN 'image/png' WHEN name LIKE '%.jpeg' THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime FROM files""", FILES)(
    lambda t: files(t).select("doc_id", T.mime_type(F.col("name")).alias("mime")))
docs("flt_upload_allowed", "SELECT doc_id, name FROM files WHERE name NOT LIKE '%.tiff' OR doc_id > 200", FILES)(
    lambda t: files(t).filter(T.upload_allowed(F.when(F.col("doc_id") > 200, "image/png").otherwise("text/plain"), F.col("name"))).select("doc_id", "name"))

# -- extraction; the source rows are the oracle ----------------------------------------------------------


def source_fields() -> str:
    """Expected (doc_id, field, value) rows straight from the business tables."""
    from turnstone.plans.document_sql import mad

    rows = []

    def add(table, **cols):
        rows.extend(f"SELECT doc_id, '{f}' AS field, {e} AS value FROM {table}" for f, e in cols.items())

    add("inv", invoice_number="reference", invoice_date="day", due_date="due", total_ht="ht", tva_20="tva", total_ttc="ttc",
        currency="'MAD'", payment_terms="'Paiement a 30 jours.'", supplier_name="'ATLAS FOURNITURES'", client_name="'AU COMPTOIR ' || o_custkey",
        supplier_address="'12 avenue Atlas Maroc'", client_address="o_custkey || ' rue des Ateliers Maroc'")
    add("stm", reference="'STM-2024-' || printf('%06d', k % 1000000)", bank_name="'Banque Centrale'", account_holder="c_name",
        account_number="'00' || printf('%010d', k)", iban="'MA64 0000 0000 ' || printf('%010d', k) || ' 00'", period="'du 01/02/2024 au 29/02/2024'",
        total_debit="'110.00 MAD'", total_credit="'270.00 MAD'", opening_balance=mad("bal"), closing_balance=mad("bal + 16000"), currency="'MAD'")
    add("rec", reference="'TXN-2024-' || printf('%06d', k % 1000000)", date="strftime(ts, '%d/%m/%Y')", time="strftime(ts, '%H:%M:%S')", channel="'En ligne'",
        status="'Execute'", purpose="'Stationnement'", amount=mad("amount"), fees="'1.50 MAD'", total_debited=mad("amount + 150"), currency="'MAD'",
        transaction_id="'TXN-2024-' || printf('%06d', k % 1000000)", auth_code="printf('%06d', k % 1000000)", secure_channel="'Oui'",
        payer_account="printf('%012d', user_id)", beneficiary_account="'990000000001'")
    add("wir", reference="'TRF-2024-' || printf('%06d', k % 1000000)", sender_name="'Societe Atlas'", sender_bank="'Banque Populaire'", sender_account="'001122334455'",
        sender_address="'5 avenue Atlas'", beneficiary_name="s_name", beneficiary_bank="'Banque ' || s_nationkey", beneficiary_iban="'MA64 0000 1111 ' || printf('%010d', k)",
        beneficiary_rib="printf('%012d', k)", purpose="'Reglement'", amount=mad("amount"), fees="'25.00 MAD'", total=mad("amount + 2500"), currency="'MAD'",
        order_date="'05/02/2024'", execution_date="'07/02/2024'", status="'Execute'")
    return "want AS (" + " UNION ALL ".join(rows) + ")"


WANT = source_fields()


def extracted(t):
    return X.fields(t.ocr.withColumnRenamed("kind", "doc_type"))


def field_rows(df):
    # The outer form keeps Spark from testing the map once more below the projection that makes it.
    return df.select("doc_id", F.explode_outer("fields").alias("field", "value")).filter("field IS NOT NULL")


docs("doc_extract_fields", "SELECT * FROM want", WANT)(lambda t: field_rows(extracted(t)))
docs("doc_rule_regex", "SELECT doc_id, coalesce(w.value, '') AS total FROM ocr LEFT JOIN (SELECT * FROM want WHERE field = 'total_ttc') w USING (doc_id)", WANT)(
    lambda t: t.ocr.select("doc_id", X.regex_value(F.col("raw_text"), TEMPLATES["invoice"]["rules"]["total_ttc"][0]["pattern"]).alias("total")))
PARTY = "SELECT doc_id, field, value FROM want WHERE field IN ({f}) AND doc_id % 4 = {k}"
for _key, _kind, _k, _fn in [("doc_invoice_parties", "invoice", 0, X.invoice_parties), ("doc_receipt_parties", "payment_receipt", 2, X.receipt_parties),
                             ("doc_wire_names", "wire_transfer", 3, X.wire_names)]:
    docs(_key, PARTY.format(f={
        "invoice": "'supplier_name','client_name','supplier_address','client_address'", "payment_receipt": "'payer_account','beneficiary_account'",
        "wire_transfer": "'sender_name','beneficiary_name'"}[_kind], k=_k), WANT)(
        lambda t, kind=_kind, fn=_fn: X.prepare(t.ocr.filter(F.col("kind") == kind)).select("doc_id", F.explode(F.create_map(
            *[x for f, v in fn().items() for x in (F.lit(f), v)])).alias("field", "value")))
docs("doc_invoice_items", """SELECT doc_id, 0 AS pos, 'Support utilisateur' AS designation, qty::VARCHAR AS quantity, pu AS unit_price, line1 AS line_total FROM inv
  UNION ALL SELECT doc_id, 1, 'Frais de dossier', '1', line2, line2 FROM inv""")(lambda t: X.invoice_items(t.invoices))
from turnstone.plans.document_sql import mad as _mad  # noqa: E402

docs("doc_statement_txns", f"""SELECT doc_id, 0 AS pos, '02/02/2024' AS date, 'Achat carte' AS label, '100.00 MAD' AS debit, '' AS credit, {_mad('bal - 10000')} AS balance FROM stm
  UNION ALL SELECT doc_id, 1, '10/02/2024', 'Virement recu', '', '250.00 MAD', {_mad('bal + 15000')} FROM stm
  UNION ALL SELECT doc_id, 2, '20/02/2024', 'Operation mixte', '10.00 MAD', '20.00 MAD', {_mad('bal + 16000')} FROM stm""")(
    lambda t: X.statement_transactions(t.statements))
docs("agg_field_completeness", "SELECT doc_id, 1.0::DOUBLE AS confidence, '' AS missing FROM ocr")(
    lambda t: X.completeness(extracted(t)).select("doc_id", "confidence", F.array_join("missing", ",").alias("missing")))
BOX = """SELECT doc_id, 'reference' AS field, value FROM want WHERE field IN ('reference', 'invoice_number')
  UNION ALL SELECT doc_id, 'invoice_number', value FROM want WHERE field IN ('reference', 'invoice_number')
  UNION ALL SELECT doc_id, field, value FROM want WHERE field IN ('amount', 'total_ttc', 'closing_balance', 'transaction_id')"""
docs("jn_right_of_label", BOX, WANT)(lambda t: X.right_of_label_in_rows(t.box_rows, BBOX_LABELS).select("doc_id", F.inline("found")))
# Fields from boxes only: the text rules see nothing because the text is left out.
docs("doc_bbox_backfill", BOX, WANT)(lambda t: field_rows(X.bbox_backfill_in_rows(
    X.fields(t.box_rows.select("doc_id", F.col("kind").alias("doc_type"), F.lit("").alias("raw_text"), "boxes")))))
docs("src_template_rules", "SELECT kind AS doc_type, count(*) AS docs FROM ocr GROUP BY 1")(
    lambda t: rule_table(t.spark).select("doc_type").distinct().join(
        t.ocr.groupBy(F.col("kind").alias("doc_type")).agg(F.count("*").alias("docs")), "doc_type"))
