"""Registered queries: matching, payloads, answers, review, table changes, questions, audits."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from turnstone.catalog import query
from turnstone.functions import dates as D, text as T
from turnstone.functions.plates import extract_plate
from turnstone.operators import access as AQ, answers as A, joins as J, matching as M, payload as P, presence as S, questions as Q, review as R, upserts as U
from turnstone.plans.access_sql import PLATE, sql as asql
from turnstone.plans.catalog_access import DIRECTORY, JAN, SUMMARY, access, january, period_views
from turnstone.plans.catalog_documents import FILES, docs, files
from turnstone.plans.document_sql import mad, sql as dsql
from turnstone.session import materialize, run_folder
from turnstone.sources.access import AccessTables, plate_of
from turnstone.sources.documents import DocumentTables
from turnstone.sources.stored import StoredTables


PERIOD = (date(2024, 1, 1), date(2024, 1, 31))


def table(key: str, name: str, text: str | None):
    return lambda fn: query(key, text)(lambda spark, d: fn(DocumentTables(spark, d).read(name)))


# -- reference matching ----------------------------------------------------------------------------------
def part_names(t):
    """Distinct part names as reference entities, one alias each."""
    names = t.read("part").groupBy(F.col("p_name").alias("canonical_name")).agg(F.min("p_partkey").alias("id"))
    return M.reference_entities(names.select("id", "canonical_name", F.to_json(F.array(
        F.concat(F.lit("art. "), "canonical_name"), F.lit(" "))).alias("aliases")))


docs("src_reference_entities", "SELECT min(p_partkey) AS id, p_name AS canonical_name, 'art. ' || p_name AS aliases FROM part GROUP BY p_name")(
    lambda t: part_names(t).select("id", "canonical_name", F.array_join("aliases", "|").alias("aliases")))
FUZZY = """typed AS (SELECT p_partkey, p_name, CASE p_size % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'Art.  ' || p_name ELSE substr(p_name, 1, 2) || substr(p_name, 4) END AS value,
  p_size % 3 AS k, length(p_name) AS n FROM part), ids AS (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY 1)"""


def typed(t):
    name, k = F.col("p_name"), F.col("p_size") % 3
    dropped = F.concat(F.substring(name, 1, 2), F.substring(name, 4, 1000))
    return t.read("part").select("p_partkey", F.when(k == 0, F.upper(name)).when(k == 1, F.concat(F.lit("Art.  "), name)).otherwise(dropped).alias("value"))


docs("jn_fuzzy_reference", """SELECT p_partkey, value, p_name AS canonical, round(CASE WHEN k < 2 THEN 100.0 ELSE 200.0 * (n - 1) / (2 * n - 1) END, 4) AS score, id AS matched_id,
  CASE WHEN k = 0 THEN 'keep' ELSE 'replace' END AS action FROM typed JOIN ids USING (p_name)""", FUZZY)(
    lambda t: typed(t).join(M.fuzzy_match(typed(t), part_names(t)), "value").withColumn("score", F.round("score", 4)))
docs("doc_review_normalize", """SELECT p_partkey AS doc_id, 'fournisseur' AS field, value AS original, p_name AS suggested, id AS matched_id, CASE WHEN k = 0 THEN 'keep' ELSE 'replace' END AS action,
  CASE WHEN k = 0 THEN value ELSE p_name END AS applied FROM typed JOIN ids USING (p_name)
  UNION ALL SELECT p_partkey, 'note', value, value, NULL, 'keep', value FROM typed""", FUZZY)(
    lambda t: R.normalize_fields(typed(t).select(F.col("p_partkey").alias("doc_id"), F.explode(F.array(F.lit("fournisseur"), F.lit("note"))).alias("field"), "value"),
                                 {"supplier": part_names(t)}).drop("score"))


def invoice_fields(t):
    s = t.invoice_source
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in (
        ("reference", F.col("reference")), ("total_ttc", F.col("ttc")), ("client", F.concat(F.lit("Comptoir "), F.col("o_custkey").cast("string"))))])
    return s.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.*")


WORDS = """fv AS (SELECT doc_id, 'reference' AS field, reference AS value FROM inv UNION ALL SELECT doc_id, 'total_ttc', ttc FROM inv UNION ALL SELECT doc_id, 'client', 'Comptoir ' || o_custkey FROM inv),
fn AS (SELECT *, trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g')) AS v FROM fv),
ln AS (SELECT *, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS c FROM lines WHERE kind = 'invoice'),
sp AS (SELECT f.doc_id, field, page, line_no, least(100.0, (0.6 * len(list_intersect(string_split(v, ' '), string_split(c, ' '))) / len(list_distinct(string_split(v, ' ')))
  + CASE WHEN contains(c, v) THEN 0.25 WHEN contains(v, c) THEN 0.2 ELSE 0 END + 0.2 * least(length(v), length(c)) / greatest(length(v), length(c))) * 100) AS score FROM fn f JOIN ln USING (doc_id)),
bs AS (SELECT doc_id, field, page, line_no, round(score, 2) AS bbox_score FROM sp WHERE round(score, 6) >= 55 QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY round(score, 6) DESC, page, line_no) = 1)"""
docs("jn_field_to_line", "SELECT * FROM bs", WORDS)(lambda t: M.field_to_line(invoice_fields(t), t.lines.filter("kind = 'invoice'")))
ASSETS = """fl AS (SELECT 'scan_' || event_id || '.pdf' AS name, ts AS mtime FROM events),
dd AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN NULL ELSE date_uploaded END AS up FROM ocr),
lk AS (SELECT doc_id, 'scan_' || k || '.pdf' AS name FROM rec WHERE k % 7 = 0),
od AS (SELECT * FROM dd WHERE doc_id NOT IN (SELECT doc_id FROM lk)), free AS (SELECT * FROM fl WHERE name NOT IN (SELECT name FROM lk)),
near AS ({near}), nearfree AS ({nearfree})"""
_NEAR = """SELECT doc_id, CASE WHEN b.mtime IS NULL THEN a.name WHEN a.mtime IS NULL OR epoch_us(up) - epoch_us(b.mtime) <= epoch_us(a.mtime) - epoch_us(up) THEN b.name ELSE a.name END AS name,
  least(coalesce(epoch_us(up) - epoch_us(b.mtime), 9e18), coalesce(epoch_us(a.mtime) - epoch_us(up), 9e18)) / 1e6 AS delta
  FROM od ASOF LEFT JOIN {f} b ON up >= b.mtime ASOF LEFT JOIN {f} a ON up <= a.mtime WHERE up IS NOT NULL"""


def asset_inputs(t):
    e = t.read("events")
    fl = e.select(F.concat(F.lit("scan_"), F.col("event_id").cast("string"), F.lit(".pdf")).alias("name"), F.col("ts").alias("mtime"))
    dd = t.ocr.select("doc_id", F.when(F.col("doc_id") % 50 != 0, F.col("date_uploaded")).alias("at"))
    lk = e.filter("event_id % 7 = 0").select((F.col("event_id") * 4 + 2).alias("doc_id"), F.concat(F.lit("scan_"), F.col("event_id").cast("string"), F.lit(".pdf")).alias("name"))
    return dd, fl, lk


docs("jn_nearest_asset", """SELECT doc_id, name, 'stored' AS source FROM lk
  UNION ALL SELECT n.doc_id, CASE WHEN n.delta > 900 THEN coalesce(f.name, n.name) ELSE n.name END, 'heuristic' FROM near n LEFT JOIN nearfree f USING (doc_id)
  UNION ALL SELECT doc_id, (SELECT arg_min(name, mtime) FROM fl), 'heuristic' FROM od WHERE up IS NULL""",
     ASSETS.format(near=_NEAR.format(f="fl"), nearfree=_NEAR.format(f="free")))(lambda t: M.link_assets(*asset_inputs(t)))

# -- payloads ----------------------------------------------------------------------------------------------
PAY = f"""pay AS (SELECT doc_id, 'invoice' AS kind, '' AS nom, day AS date, ttc AS montant, '' AS adresse, '' AS email, reference AS numero FROM inv
  UNION ALL SELECT doc_id, 'bank_statement', c_name, '', {mad('bal + 16000')}, '', '', '' FROM stm
  UNION ALL SELECT doc_id, 'payment_receipt', 'Client ' || user_id, '', {mad('amount')}, '12 rue du Port', 'c' || user_id || '@example.org', '' FROM rec
  UNION ALL SELECT doc_id, 'wire_transfer', s_name, '', {mad('amount + 2500')}, '', '', '' FROM wir)"""
docs("fn_flatten_json", f"""SELECT doc_id, 'data.extra.items[0].prix' AS path, 'prix' AS key, pu AS value FROM inv UNION ALL SELECT doc_id, 'data.extra.items[0].qte', 'qte', qty::VARCHAR FROM inv
  UNION ALL SELECT doc_id, 'data.extra.items[0].total', 'total', line1 FROM inv UNION ALL SELECT doc_id, 'data.extra.items[0].libelle', 'libelle', 'Support utilisateur' FROM inv
  UNION ALL SELECT doc_id, 'data.extra.taux_tva', 'taux_tva', '20' FROM inv UNION ALL SELECT doc_id, 'data.numero_facture', 'numero_facture', reference FROM inv
  UNION ALL SELECT doc_id, 'data.client_name', 'client_name', 'COMPTOIR ' || o_custkey FROM inv UNION ALL SELECT doc_id, 'data.date', 'date', day FROM inv UNION ALL SELECT doc_id, 'data.total', 'total', ttc FROM inv
  UNION ALL SELECT doc_id, 'data.data.full_name', 'full_name', c_name FROM stm UNION ALL SELECT doc_id, 'data.data.amount', 'amount', {mad('bal + 16000')} FROM stm UNION ALL SELECT doc_id, 'data.bank', 'bank', 'Banque Centrale' FROM stm
  UNION ALL SELECT doc_id, 'data.name', 'name', 'Client ' || user_id FROM rec UNION ALL SELECT doc_id, 'data.amount', 'amount', {mad('amount')} FROM rec UNION ALL SELECT doc_id, 'data.Address', 'address', '12 rue du Port' FROM rec
  UNION ALL SELECT doc_id, 'data.email', 'email', 'c' || user_id || '@example.org' FROM rec UNION ALL SELECT doc_id, 'data.canal', 'canal', 'En ligne' FROM rec
  UNION ALL SELECT doc_id, 'data.nom', 'nom', s_name FROM wir UNION ALL SELECT doc_id, 'data.montant', 'montant', {mad('amount + 2500')} FROM wir UNION ALL SELECT doc_id, 'data.extra.tva', 'tva', '0%' FROM wir""")(
    lambda t: P.leaves(t.ocr).drop("sort"))
# Depth first in (length, text) order of keys: an invoice's "extra" comes after "total" (same length, later text wins last).
docs("fn_find_key", f"""SELECT doc_id, 'data.extra.items[0].total' AS path, line1 AS value FROM inv UNION ALL SELECT doc_id, 'data.montant', {mad('amount + 2500')} FROM wir""")(
    lambda t: P.find_key(P.leaves(t.ocr), ["total", "montant"]))
docs("fn_hybrid_normalize", """SELECT doc_id, nullif(nom, '') AS nom, nullif(date, '') AS date, montant, nullif(adresse, '') AS adresse, nullif(email, '') AS email, nullif(numero, '') AS numero_facture,
  CASE kind WHEN 'invoice' THEN 'client_name,items,taux_tva' WHEN 'bank_statement' THEN 'bank' WHEN 'payment_receipt' THEN 'canal' ELSE 'tva' END AS extra FROM pay""", PAY)(
    lambda t: t.ocr.select("doc_id", P.hybrid(F.col("data")).alias("h")).select(
        "doc_id", *[F.col(f"h.{f}").alias(f) for f in P.CORE_FIELDS if f != "prenom"], F.array_join(F.array_sort(F.map_keys("h.extra")), ",").alias("extra")))
docs("fn_hybrid_merge", """SELECT doc_id, CASE WHEN kind = 'invoice' THEN NULL ELSE nom END AS nom, 'Anne' AS prenom, montant, 'Rabat' AS adresse,
  CASE kind WHEN 'invoice' THEN 'client_name,items,note,taux_tva' WHEN 'bank_statement' THEN 'bank,note' WHEN 'payment_receipt' THEN 'canal,note' ELSE 'note,tva' END AS extra FROM pay""", PAY)(
    lambda t: t.ocr.select("doc_id", P.merge_hybrid(P.hybrid(F.col("data")), P.hybrid(F.lit(
        '{"name":"inconnu","first_name":"Anne","amount":"N/A","address":"Rabat","note":"x"}'))).alias("h")).select(
        "doc_id", "h.nom", "h.prenom", "h.montant", "h.adresse", F.array_join(F.array_sort(F.map_keys("h.extra")), ",").alias("extra")))
docs("fn_normalize_amount_fields", f"""SELECT doc_id, key, round(cents / 100.0, 2)::DOUBLE AS number FROM (SELECT doc_id, 'amount' AS key, bal + 16000 AS cents FROM stm
  UNION ALL SELECT doc_id, 'amount', amount FROM rec UNION ALL SELECT doc_id, 'montant', amount + 2500 FROM wir)""")(
    lambda t: P.numeric_amounts(P.leaves(t.ocr)).filter("number IS NOT NULL").select("doc_id", "key", F.round("number", 2).alias("number")))
docs("fn_json_guard", """SELECT doc_id, kind IN ('payment_receipt', 'wire_transfer') AS usable FROM ocr""")(
    lambda t: t.ocr.select("doc_id", P.guarded_object(F.when(F.col("kind") == "wire_transfer", F.col("data")).when(
        F.col("kind") == "invoice", F.concat(F.lit("reponse : "), F.expr("left(data, length(data) - 1)"))).otherwise(
        F.concat(F.lit("voici "), F.regexp_replace("data", '"name"', '"nom"'), F.lit(" fin"))), ["nom"]).isNotNull().alias("usable")))
docs("fn_payload_value", """SELECT doc_id, CASE kind WHEN 'invoice' THEN 'v' || doc_id WHEN 'bank_statement' THEN 't' || doc_id ELSE doc_id::VARCHAR END AS value, kind = 'invoice' AS boxed FROM ocr""")(
    lambda t: t.ocr.select("doc_id", F.when(F.col("kind") == "invoice", F.format_string('{"value":"v%d","bbox":[1,2,3,4]}', "doc_id")).when(
        F.col("kind") == "bank_statement", F.format_string('{"text":"t%d","bbox":[1,2]}', "doc_id")).otherwise(F.col("doc_id").cast("string")).alias("p")).select(
        "doc_id", P.payload_value(F.col("p")).alias("value"), P.has_bbox(F.col("p")).alias("boxed")))
PATCHED = "doc_id long, " + ", ".join(f"{c} string" for c in P.CORE_FIELDS) + ", extra map<string,string>"


@docs("snk_document_patch", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'null' WHEN kind = 'invoice' THEN NULL ELSE nom END AS nom, 'Anne' AS prenom FROM pay""", PAY)
def _snk_patch(t):
    """Patches are merged into a document's data, or replace it (here for every third document)."""
    tables = StoredTables(t.spark, run_folder(t.spark, "snk-patch"), {"documents": PATCHED})
    tables.change(0, documents=t.ocr.select("doc_id", P.hybrid(F.col("data")).alias("h")).select("doc_id", "h.*"))
    patches = t.ocr.select("doc_id", F.lit('{"first_name":"Anne","nom":"null"}').alias("patch"), (F.col("doc_id") % 3 == 0).alias("replace"))
    twice(tables.change, 1, documents=lambda old: P.patched(old, patches))
    return tables.read("documents").select("doc_id", "nom", "prenom")


# -- answers -----------------------------------------------------------------------------------------------
ASK = ("Quel est le montant total ?", "Quelle est la TVA ?", "Quelle est la date ?", "Quel est l'email ?", "Quelle adresse ?", "Quel client ?", "Donne le fournisseur")
KINDS = ("total", "tva", "date", "email", "address", "client", "supplier")


def asked(t):
    """Every document gets every question."""
    qs = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(q).alias("question")) for i, q in enumerate(ASK)])
    return t.ocr.select("doc_id", F.explode(qs).alias("q")).select((F.col("doc_id") * 10 + F.col("q.n")).alias("question_id"), "doc_id", "q.question")


docs("doc_qa_kind", " UNION ALL ".join(f"SELECT doc_id * 10 + {i} AS question_id, '{k}' AS kind FROM ocr" for i, k in enumerate(KINDS)))(
    lambda t: asked(t).select("question_id", A.question_kind(F.col("question")).alias("kind")))
NF = "('Non trouvé dans ce document', false, 0.0)"
_money = lambda c: f"printf('%.2f', ({c}) / 100.0)"
ANSWERS = f"""ans AS (
  SELECT doc_id * 10 AS question_id, 'Montant total: ' || {_money('pu_cents * qty')} AS answer, 0.95 AS confidence FROM inv
  UNION ALL SELECT doc_id * 10 + 1, 'TVA: 20%', 0.9 FROM inv UNION ALL SELECT doc_id * 10 + 2, 'Date du document: ' || day, 0.92 FROM inv
  UNION ALL SELECT doc_id * 10 + 4, 'Adresse: ' || '12 avenue Atlas Maroc  ' || o_custkey || ' rue des Ateliers Maroc', 0.76 FROM inv UNION ALL SELECT doc_id * 10 + 5, 'Client: COMPTOIR ' || o_custkey, 0.9 FROM inv
  UNION ALL SELECT doc_id * 10 + 2, 'Date du document: ' || strftime(ts, '%d/%m/%Y'), 0.85 FROM rec UNION ALL SELECT doc_id * 10 + 3, 'Email: c' || user_id || '@example.org', 0.9 FROM rec
  UNION ALL SELECT doc_id * 10 + 4, 'Adresse: 12 rue du Port', 0.88 FROM rec
  UNION ALL SELECT doc_id * 10, 'Montant total: ' || {_money('amount + 2500')}, 0.95 FROM wir UNION ALL SELECT doc_id * 10 + 1, 'TVA: 0%', 0.9 FROM wir UNION ALL SELECT doc_id * 10 + 5, 'Client: ' || s_name, 0.86 FROM wir),
allq AS (SELECT doc_id * 10 + n AS question_id FROM ocr, (SELECT unnest(range(7)) AS n))"""
docs("doc_qa_lookup", """SELECT q.question_id, coalesce(answer, 'Non trouvé dans ce document') AS answer, answer IS NOT NULL AS found FROM allq q LEFT JOIN ans USING (question_id)""", ANSWERS)(
    lambda t: A.lookup(t.ocr, asked(t)).select("question_id", "answer", "found"))
docs("doc_qa_normalize", """SELECT q.question_id, answer IS NOT NULL AS found, round(CASE WHEN answer IS NULL THEN 0.35 ELSE confidence END, 2)::DOUBLE AS confidence FROM allq q LEFT JOIN ans USING (question_id)""", ANSWERS)(
    lambda t: A.normalize_answers(A.lookup(t.ocr, asked(t)).withColumn("confidence", F.when(F.col("found"), F.col("confidence")).otherwise(F.lit(7.0)))).select(
        "question_id", "found", F.round("confidence", 2).alias("confidence")))
docs("doc_qa_generic", """SELECT doc_id AS question_id, 'Numero Facture: ' || reference AS answer FROM inv""")(
    lambda t: A.generic(t.ocr, t.ocr.select(F.col("doc_id").alias("question_id"), "doc_id", F.lit("Donne moi le numero de la facture svp").alias("question"))).select("question_id", "answer"))
docs("doc_qa_rows", f"""SELECT doc_id, 0 AS pos, 'Support utilisateur' AS description, qty::VARCHAR AS quantity, {_money('pu_cents')} AS unit_price, {_money('pu_cents * qty')} AS line_total FROM inv
  UNION ALL SELECT doc_id, 0, 'Achat', '?', '100.00', {_money('bal')} FROM stm""")(
    lambda t: A.item_rows(t.invoices.unionByName(t.statements.withColumn("raw_text", F.concat(
        F.lit("Description Prix Total\nAchat 100.00 MAD "), F.regexp_extract("raw_text", r"Solde debut: ([0-9 .]+ MAD)", 1), F.lit("\nTotal 5.00 9.00"))))))

# -- review ------------------------------------------------------------------------------------------------
REVIEWS = """rv AS (SELECT doc_id, k % 3 AS m, k FROM wir)"""


def reviews(t):
    s = t.read("supplier").select((F.col("s_suppkey") * 4 + 3).alias("document_id"), F.col("s_suppkey").alias("k"))
    m = F.col("k") % 3
    return s.select(
        "document_id", F.when(m == 0, '{"nom":"Brut","ville":"Rabat"}').alias("raw_extracted_fields"),
        F.when(m != 1, '{"nom":{"value":"Societe Atlas"},"pays":"Maroc"}').alias("normalized_fields"),
        F.when(m == 2, '{"motif":"Reglement"}').alias("user_corrected_fields"), F.when(m == 1, "validated").otherwise("draft").alias("status"),
        F.lit("2024-03-01").cast("timestamp_ntz").alias("created_at"), F.lit("2024-03-01").cast("timestamp_ntz").alias("updated_at"))


def state(t):
    return R.review_state(t.wires, reviews(t))


docs("doc_review_state", """SELECT doc_id AS document_id, CASE WHEN m = 0 THEN 'nom,ville' ELSE 'extra,montant,nom' END AS raw, CASE WHEN m <> 1 THEN 'nom,pays' ELSE '' END AS normalized,
  CASE WHEN m = 2 THEN 'motif' ELSE '' END AS corrected, CASE WHEN m = 1 THEN 'validated' ELSE 'in_review' END AS status FROM rv""", REVIEWS)(
    lambda t: state(t).select("document_id", *[F.array_join(F.array_sort(F.map_keys(c)), ",").alias(c) for c in ("raw", "normalized", "corrected")], "status"))
docs("set_review_keys", """SELECT doc_id AS document_id, CASE m WHEN 0 THEN 'nom,pays,ville' WHEN 1 THEN 'extra,montant,nom' ELSE 'extra,montant,motif,nom,pays' END AS keys FROM rv""", REVIEWS)(
    lambda t: R.review_keys(state(t)).select("document_id", F.array_join("keys", ",").alias("keys")))
docs("doc_review_bbox_merge", """SELECT doc_id, 'nom' AS field, CASE WHEN m = 1 THEN 8 ELSE 3 END AS line_no FROM rv
  UNION ALL SELECT doc_id, 'montant', 16 FROM rv WHERE m <> 0 UNION ALL SELECT doc_id, 'motif', 13 FROM rv WHERE m = 2""", REVIEWS)(
    lambda t: R.bbox_merge(state(t), t.lines).select("doc_id", "field", "line_no"))

# -- table changes: each query returns the stored table, read back after the last change came twice ---------------
def twice(change, number, **what):
    if not change(number, **what) or change(number, **what):
        raise RuntimeError("a change must count once")


UNKNOWN_ROWS = "id long, plate_number string, image_path string, detected_at timestamp_ntz"


@access("snk_unknown", "SELECT id, plate_number, detected_at FROM unknown_detections UNION ALL SELECT event_id, plate_number, detected_at FROM det WHERE status = 'BLACKLISTED'")
def _snk_unknown(t):
    tables = StoredTables(t.spark, run_folder(t.spark, "snk-unknown"), {"unknown": UNKNOWN_ROWS})
    tables.append(0, unknown=t.unknown)
    twice(tables.append, 1, unknown=t.store.events().filter("status = 'BLACKLISTED'").withColumnRenamed("event_id", "id"))
    return tables.read("unknown").select("id", "plate_number", "detected_at")


CHANGES = """chg AS (SELECT plate_number, max(event_id) AS seq FROM det WHERE plate_number <> '' GROUP BY 1)"""
VEHICLES = ("id long, plate_number string, owner_name string, vehicle_type string, status string, blacklist_reason string, "
            "blacklisted_at timestamp_ntz, created_at timestamp_ntz")
EMPLOYEES = "id long, full_name string, plate_number string, department string, employee_code string, is_active boolean"


def changes(t):
    """Registrations in the readers' spelling, one per detection; the last one of a plate counts."""
    return t.raw_detections.filter("plate_text <> ''").select(
        F.col("event_id").alias("seq"), F.col("plate_text").alias("plate_number"), F.concat(F.lit("Holder "), F.col("event_id").cast("string")).alias("full_name"),
        F.lit("OPS").alias("department"), (F.col("event_id") % 4 != 0).alias("is_authorized"), F.lit("H1").alias("employee_code"))


def registry(t, name):
    tables = StoredTables(t.spark, run_folder(t.spark, name), {"vehicles": VEHICLES, "employees": EMPLOYEES, "unknown": UNKNOWN_ROWS})
    tables.change(0, vehicles=t.vehicles, employees=t.employees, unknown=t.unknown)
    return tables


@access("snk_upsert_authorized", """SELECT 'vehicle' AS kind, coalesce(v.id, (SELECT max(id) FROM vehicles) + row_number() OVER (PARTITION BY v.id IS NULL ORDER BY plate_number)) AS id,
    plate_number, CASE WHEN c.seq IS NULL THEN owner_name ELSE 'Holder ' || c.seq END AS name, CASE WHEN c.seq IS NULL THEN vehicle_type ELSE 'OPS' END AS department,
    CASE WHEN c.seq IS NULL THEN status WHEN c.seq % 4 <> 0 THEN 'AUTHORIZED' ELSE 'BLACKLISTED' END AS status, blacklist_reason AS detail FROM vehicles v FULL JOIN chg c USING (plate_number)
  UNION ALL SELECT 'employee', coalesce(e.id, (SELECT max(id) FROM employees) + row_number() OVER (PARTITION BY e.id IS NULL ORDER BY plate_number)),
    plate_number, CASE WHEN c.seq IS NULL THEN full_name ELSE 'Holder ' || c.seq END, CASE WHEN c.seq IS NULL THEN department ELSE 'OPS' END,
    CASE WHEN CASE WHEN c.seq IS NULL THEN is_active ELSE c.seq % 4 <> 0 END THEN 'true' ELSE 'false' END, CASE WHEN c.seq IS NULL THEN employee_code ELSE 'H1' END FROM employees e FULL JOIN chg c USING (plate_number)""", CHANGES)
def _snk_authorized(t):
    tables = registry(t, "snk-authorized")
    new = changes(t)
    sides = lambda: U.upsert_authorized(tables.read("vehicles"), tables.read("employees"), new)
    twice(tables.change, 1, vehicles=lambda _: U.assign_ids(sides()[0], "plate_number"), employees=lambda _: U.assign_ids(sides()[1], "plate_number"))
    cars = tables.read("vehicles").select(F.lit("vehicle").alias("kind"), "id", "plate_number", F.col("owner_name").alias("name"), F.col("vehicle_type").alias("department"), "status",
                                          F.col("blacklist_reason").alias("detail"))
    return cars.unionByName(tables.read("employees").select(F.lit("employee").alias("kind"), "id", "plate_number", F.col("full_name").alias("name"), "department",
                                                            F.col("is_active").cast("string").alias("status"), F.col("employee_code").alias("detail")))


@access("snk_upsert_blacklist", """SELECT coalesce(v.id, (SELECT max(id) FROM vehicles) + row_number() OVER (PARTITION BY v.id IS NULL ORDER BY plate_number)) AS id, plate_number,
  coalesce(owner_name, 'Unknown') AS owner_name, coalesce(vehicle_type, 'unknown') AS vehicle_type,
  CASE WHEN c.seq IS NULL THEN status ELSE 'BLACKLISTED' END AS status, CASE WHEN c.seq IS NULL THEN blacklist_reason ELSE 'r' || c.seq END AS blacklist_reason FROM vehicles v FULL JOIN chg c USING (plate_number)""", CHANGES)
def _snk_blacklist(t):
    tables = registry(t, "snk-blacklist")
    new = changes(t).select(
        "seq", "plate_number", F.concat(F.lit("r"), F.col("seq").cast("string")).alias("reason"), F.lit("2024-02-01").cast("timestamp_ntz").alias("at"),
        F.lit("").alias("owner_name"), F.lit(None).cast("string").alias("vehicle_type"))
    twice(tables.change, 1, vehicles=lambda cars: U.assign_ids(U.upsert_blacklist(cars, new), "plate_number"))
    return tables.read("vehicles").select("id", "plate_number", "owner_name", "vehicle_type", "status", "blacklist_reason")


@access("snk_delete_unknown", "SELECT id FROM unknown_detections WHERE plate_number NOT IN (SELECT plate_number FROM employees)")
def _snk_delete(t):
    tables = registry(t, "snk-delete")
    gone = t.employees.select(F.concat(F.lit(" "), F.lower("plate_number")).alias("plate_number"))
    twice(tables.change, 1, unknown=lambda rows: U.delete_unknown(rows, gone))
    return tables.read("unknown").select("id")


REPORTS = "id long, report_type string, start_date date, end_date date, generated_at timestamp_ntz, file_name string, summary string, metadata string"


@access("snk_report", f"""SELECT 1::BIGINT AS id, 'monthly' AS report_type, DATE '2024-01-01' AS start_date, total_employees, total_anomalies, first_arrival_name FROM ({SUMMARY})
  UNION ALL SELECT 2, 'custom', DATE '2024-01-01', total_employees, total_anomalies, first_arrival_name FROM ({SUMMARY})""", *period_views(*JAN))
def _snk_report(t):
    """Two reports of one period are stored, the second one twice."""
    tables = StoredTables(t.spark, run_folder(t.spark, "snk-report"), {"reports": REPORTS})
    summary = materialize(january(t).summary(), "summary")
    for number, kind in enumerate(("monthly", "custom")):
        row = U.report_row(summary, kind, *PERIOD, "2024-02-01 08:00:00").withColumn("id", F.lit(number + 1))
        twice(tables.append, number, reports=row)
    return tables.read("reports").select(
        "id", "report_type", "start_date", *[F.get_json_object("summary", f"$.{c}").cast("bigint").alias(c) for c in ("total_employees", "total_anomalies")],
        F.get_json_object("summary", "$.first_arrival_name").alias("first_arrival_name"))


access("fn_summary_json", f"SELECT strftime(first_arrival, '%Y-%m-%dT%H:%M:%S.%f') AS first_arrival, strftime(last_exit, '%Y-%m-%dT%H:%M:%S.%f') AS last_exit FROM ({SUMMARY})", *period_views(*JAN))(
    lambda t: U.report_row(january(t).summary(), "monthly", date(2024, 1, 1), date(2024, 1, 31), "2024-02-01 08:00:00").select(
        *[F.get_json_object("summary", f"$.{c}").alias(c) for c in ("first_arrival", "last_exit")]))
NOW = lambda: F.lit("2024-04-01").cast("timestamp_ntz")
REVIEWS = ("document_id long, raw_extracted_fields string, normalized_fields string, user_corrected_fields string, status string, "
           "created_at timestamp_ntz, updated_at timestamp_ntz")


@docs("snk_review_upsert", """SELECT doc_id AS document_id, CASE WHEN k IS NOT NULL THEN 'validated' ELSE NULL END AS status, CASE WHEN k IS NULL THEN NULL WHEN doc_id % 4 = 3 THEN TIMESTAMP '2024-03-01' ELSE TIMESTAMP '2024-04-01' END AS created_at,
  TIMESTAMP '2024-04-01' AS updated_at FROM (SELECT doc_id, k FROM wir UNION ALL SELECT doc_id, k FROM stm)""")
def _snk_review(t):
    tables = StoredTables(t.spark, run_folder(t.spark, "snk-review"), {"reviews": REVIEWS})
    tables.change(0, reviews=reviews(t))
    rows = t.wires.select("doc_id").union(t.statements.select("doc_id")).select(
        F.col("doc_id").alias("document_id"), F.lit("validated").alias("status"), F.lit("{}").alias("raw_extracted_fields"))
    twice(tables.change, 1, reviews=lambda old: U.upsert_by_key(old, rows, "document_id", NOW()))
    return tables.read("reviews").select("document_id", "status", "created_at", "updated_at")


ASSETS = "document_id long, stored_file_name string, source string, created_at timestamp_ntz"


@docs("snk_asset_upsert", """SELECT doc_id AS document_id, 'new_' || doc_id AS stored_file_name, 'heuristic' AS source, CASE WHEN doc_id % 4 = 3 THEN TIMESTAMP '2024-03-01' ELSE TIMESTAMP '2024-04-01' END AS created_at
  FROM (SELECT doc_id FROM wir UNION ALL SELECT doc_id FROM stm)""")
def _snk_asset(t):
    tables = StoredTables(t.spark, run_folder(t.spark, "snk-asset"), {"assets": ASSETS})
    tables.change(0, assets=reviews(t).select("document_id", F.lit("old").alias("stored_file_name"), F.lit("upload").alias("source"), "created_at"))
    rows = t.wires.select("doc_id").union(t.statements.select("doc_id")).select(
        F.col("doc_id").alias("document_id"), F.concat(F.lit("new_"), F.col("doc_id").cast("string")).alias("stored_file_name"), F.lit("heuristic").alias("source"))
    twice(tables.change, 1, assets=lambda old: U.upsert_by_key(old, rows, "document_id", NOW(), touched=None))
    return tables.read("assets")


BATCH = """bi AS (SELECT o_custkey AS batch_id, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'success' END AS status FROM orders),
bs AS (SELECT batch_id, count(*) AS total_files, count(*) FILTER (status = 'success') AS success_count, count(*) FILTER (status <> 'success') AS failed_count,
  CASE WHEN bool_or(status <> 'success') THEN 'completed_with_errors' ELSE 'completed' END AS status FROM bi GROUP BY 1)"""


def batches(o):
    return U.batch_summary(o.select(F.col("o_custkey").alias("batch_id"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("success").alias("status")))


table("agg_batch_summary", "orders", f"WITH {BATCH} SELECT * FROM bs")(batches)


@table("snk_batch", "orders", f"WITH {BATCH} SELECT bs.*, (SELECT count(*) FROM bi WHERE bi.batch_id = bs.batch_id) AS file_rows FROM bs")
def _snk_batch(o):
    """Files and summaries of all batches: one version holds both tables."""
    tables = StoredTables(o.sparkSession, run_folder(o.sparkSession, "snk-batch"), {
        "files": "batch_id long, file long, status string",
        "batches": "batch_id long, total_files long, success_count long, failed_count long, status string"})
    items = o.select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("file"),
                     F.when(F.col("o_orderstatus") == "P", "failed").otherwise("success").alias("status"))
    twice(tables.append, 0, files=items, batches=U.batch_summary(items))
    counts = tables.read("files").groupBy("batch_id").agg(F.count("*").alias("file_rows"))
    return tables.read("batches").join(counts, "batch_id")


table("src_batches", "orders", f"WITH {BATCH} SELECT * FROM bs ORDER BY batch_id DESC LIMIT 20")(lambda o: batches(o).orderBy(F.desc("batch_id")).limit(20))

# -- report history (one stored report per order) --------------------------------------------------------------
HIST = """WITH h AS (SELECT o_orderkey AS id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'daily' ELSE 'custom' END AS report_type, o_orderdate::DATE AS start_date,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN o_orderdate::DATE ELSE o_orderdate::DATE + 9 END AS end_date, o_orderdate + to_hours((240 + o_custkey % 24)::INT) AS generated_at FROM orders) """


def history(o):
    daily = F.substring("o_orderpriority", 1, 1) == "1"
    day = F.to_date("o_orderdate")
    return o.select(F.col("o_orderkey").alias("id"), F.when(daily, "daily").otherwise("custom").alias("report_type"), day.alias("start_date"),
                    F.when(daily, day).otherwise(F.date_add(day, 9)).alias("end_date"),
                    (F.col("o_orderdate").cast("timestamp_ntz") + F.make_interval(hours=(F.lit(240) + F.col("o_custkey") % 24).cast("int"))).alias("generated_at"))


table("src_report_history", "orders", HIST + "SELECT * FROM h ORDER BY generated_at DESC, id LIMIT 50")(lambda o: history(o).orderBy(F.desc("generated_at"), "id").limit(50))
table("flt_period_overlap", "orders", HIST + "SELECT id FROM h WHERE end_date >= DATE '1996-03-01' AND start_date <= DATE '1996-03-15'")(
    lambda o: history(o).filter((F.col("end_date") >= F.lit(date(1996, 3, 1))) & (F.col("start_date") <= F.lit(date(1996, 3, 15)))).select("id"))
table("flt_generated_on", "orders", HIST + "SELECT id FROM h WHERE generated_at::DATE = DATE '1996-03-15'")(
    lambda o: history(o).filter(AQ.on_day("generated_at", date(1996, 3, 15))).select("id"))

# -- questions -----------------------------------------------------------------------------------------------
TODAY = lambda: F.lit(date(2024, 1, 15))
# (template, intent); {P} plate, {N} name, {D} literal day of the event.
TEMPLATES = [
    ("Qui a la plaque exacte {P} ?", "plate_owner"), ("Historique de la plaque {P}", "plate_history"), ("Derniere entree de la plaque {P}", "plate_last_entry"),
    ("Quel est le statut de la plaque {P} ?", "plate_auth_status"), ("Historique d'accès de {N}", "employee_history"), ("{N} est en retard ?", "employee_late"),
    ("{N} est présent ?", "employee_presence"), ("Infos sur {N}", "employee_info"), ("Qui est present aujourd'hui ?", "present_today"),
    ("Qui est actuellement présent ?", "currently_present"), ("Qui est arrive en retard le {D} ?", "late_today"), ("Qui est absent hier ?", "absent_today"),
    ("Combien d'acces refuses cette semaine ?", "count_denied_today"), ("Quels accès ont ete refuses la semaine dernière ?", "denied_today"),
    ("Quels vehicules inconnus ce mois ?", "unknown_plates_today"), ("Qui est entre entre 8:00 et 09h30 ?", "access_between_times"),
    ("Qui est entre a 8h05 ?", "access_at_time"), ("Employes du departement BUILDING presents aujourd'hui", "dept_present_today"),
    ("Quels sont les 10 derniers acces ?", "last_n_access"), ("Quelle plaque a ete detectee le plus souvent l'annee derniere ?", "most_detected_plate"),
    ("Qui est entre sans sortie ?", "entry_without_exit"), ("Scans rapproches du mois dernier", "multi_scans"), ("Qui a cumule des heures cette annee ?", "top_presence_time"), ("Bonjour", "unknown"),
]
_L = "['" + "','".join(t.replace("'", "''") for t, _ in TEMPLATES) + "']"
_I = "['" + "','".join(i for _, i in TEMPLATES) + "']"
QUEST = f"""qs AS (SELECT event_id AS question_id, event_id % {len(TEMPLATES)} AS k, {PLATE.format(k='user_id')} AS p, 'Customer#' || printf('%09d', user_id) AS n, ts,
  user_id IN (SELECT id FROM employees) AS emp, {_I}[(event_id % {len(TEMPLATES)} + 1)::INT] AS it FROM events),
ent AS (SELECT question_id, k, it, CASE WHEN k < 4 THEN p END AS plate, CASE WHEN k BETWEEN 4 AND 7 AND emp THEN n END AS employee_name, CASE WHEN k = 17 THEN 'BUILDING' END AS department,
  CASE k WHEN 8 THEN DATE '2024-01-15' WHEN 10 THEN ts::DATE WHEN 11 THEN DATE '2024-01-14' WHEN 17 THEN DATE '2024-01-15' END AS date_value,
  CASE k WHEN 12 THEN DATE '2024-01-15' WHEN 13 THEN DATE '2024-01-08' WHEN 14 THEN DATE '2024-01-01' WHEN 19 THEN DATE '2023-01-01' WHEN 21 THEN DATE '2023-12-01' WHEN 22 THEN DATE '2024-01-01' END AS start_date,
  CASE k WHEN 12 THEN DATE '2024-01-21' WHEN 13 THEN DATE '2024-01-14' WHEN 14 THEN DATE '2024-01-31' WHEN 19 THEN DATE '2023-12-31' WHEN 21 THEN DATE '2023-12-31' WHEN 22 THEN DATE '2024-12-31' END AS end_date,
  CASE WHEN k = 15 THEN '08:00:00' END AS start_time, CASE WHEN k = 15 THEN '09:30:00' END AS end_time, CASE WHEN k = 16 THEN '08:05:00' END AS time_value,
  CASE WHEN k IN (12, 13) THEN 'DENIED' WHEN k = 14 THEN 'UNKNOWN' END AS status_keyword FROM qs)"""


def question_rows(t: AccessTables):
    text = F.get(F.array(*[F.lit(x) for x, _ in TEMPLATES]), (F.col("event_id") % len(TEMPLATES)).cast("int"))
    for mark, value in (("{P}", plate_of(F.col("user_id"))), ("{N}", F.concat(F.lit("Customer#"), F.format_string("%09d", "user_id"))), ("{D}", F.date_format("ts", "dd/MM/yyyy"))):
        text = F.replace(text, F.lit(mark), value)
    return t.read("events").select(F.col("event_id").alias("question_id"), text.alias("question"))


access("nlq_entities", "SELECT * EXCLUDE (k, it) FROM ent", QUEST)(
    lambda t: Q.entities(question_rows(t), t.employees, TODAY()).select(
        "question_id", "plate", "employee_name", "department", "date_value", "date_range.start_date", "date_range.end_date",
        "time_range.start_time", "time_range.end_time", "time_value", "status_keyword"))
# A person who is not an employee is not found, so the rule after the name rules decides.
access("nlq_intent", """SELECT question_id, CASE WHEN k = 5 AND employee_name IS NULL THEN 'late_today' WHEN k = 6 AND employee_name IS NULL THEN 'present_today'
  WHEN k BETWEEN 4 AND 7 AND employee_name IS NULL THEN 'unknown' ELSE it END AS intent FROM ent""", QUEST)(
    lambda t: Q.intent(Q.entities(question_rows(t), t.employees, TODAY())).select("question_id", "intent"))
access("jn_dictionary_contains", "SELECT question_id, n AS name FROM qs WHERE k BETWEEN 4 AND 7 AND emp", QUEST)(
    lambda t: M.contained_names(question_rows(t).select("question_id", T.norm_question(F.col("question")).alias("norm")), t.employees.select(F.col("full_name").alias("name")), "question_id"))
access("nlq_use_model", "SELECT question_id, k = 19 AS model FROM qs", QUEST)(
    lambda t: question_rows(t).select("question_id", Q.use_model(F.col("question")).alias("model")))
access("fn_relative_period", "SELECT question_id, start_date, end_date FROM ent", QUEST)(
    lambda t: question_rows(t).select("question_id", D.question_span(F.col("question"), T.norm_question(F.col("question")), TODAY()).alias("r")).select("question_id", "r.*"))
access("fn_time_range", "SELECT question_id, start_time, end_time FROM ent", QUEST)(
    lambda t: question_rows(t).select("question_id", D.time_range(T.norm_question(F.col("question"))).alias("r")).select("question_id", "r.*"))
access("fn_time_value", "SELECT question_id, time_value FROM ent WHERE k <> 15", QUEST)(
    lambda t: question_rows(t).filter(F.col("question_id") % len(TEMPLATES) != 15).select("question_id", D.time_value(T.norm_question(F.col("question"))).alias("time_value")))
access("nlq_resolve_plate", """SELECT q.question_id, coalesce(e.plate_number, v.plate_number) AS plate_number, coalesce(e.full_name, v.owner_name) AS full_name, coalesce(e.department, v.vehicle_type) AS department,
  CASE WHEN e.id IS NOT NULL THEN 'employees' WHEN v.id IS NOT NULL THEN 'vehicles' END AS source
  FROM (SELECT event_id AS question_id, plate_number FROM det WHERE plate_number <> '') q LEFT JOIN employees e USING (plate_number) LEFT JOIN vehicles v ON v.plate_number = q.plate_number""")(
    lambda t: Q.resolve_plates(t.detections.filter("plate_number <> ''").select(F.col("event_id").alias("question_id"), F.col("plate_number").alias("plate_raw")), t.employees, t.vehicles).select(
        "question_id", "plate_number", "full_name", "department", "source"))
access("nlq_fill_names", """SELECT p.id, coalesce(e.full_name, v.owner_name, 'Unknown') AS employee_name, coalesce(e.full_name, v.owner_name, 'Unknown') AS full_name
  FROM logs p LEFT JOIN employees e USING (plate_number) LEFT JOIN vehicles v ON v.plate_number = p.plate_number""")(
    lambda t: J.fill_names(J.enrich(t.logs, t.employees, t.vehicles).withColumn("employee_name", F.when(F.col("id") % 2 == 0, F.col("employee_name")).otherwise(
        F.when(F.col("owner_name").isNull(), F.lit("")).otherwise(F.col("owner_name")))), t.employees).select("id", "employee_name", "full_name"))
SQLS = ["SELECT p.plate_number FROM parking_logs p", "select e.salary from employees e", "DELETE FROM vehicles", "SELECT * FROM secrets",
        "SELECT v.owner_name FROM parking_logs p LEFT JOIN vehicles AS v ON v.plate_number = p.plate_number;", "WITH x AS (SELECT 1) SELECT * FROM x"]
access("sql_audit", f"SELECT event_id AS sql_id, event_id % {len(SQLS)} IN (0, 4) AS allowed FROM events")(
    lambda t: Q.audit_sql(t.read("events").select(F.col("event_id").alias("sql_id"), F.get(F.array(*[F.lit(s) for s in SQLS]), (F.col("event_id") % len(SQLS)).cast("int")).alias("sql"))).select("sql_id", "allowed"))
access("fn_context_pack", "SELECT count(*) AS row_count, 25 AS packed FROM logs")(
    lambda t: Q.context_pack(t.logs.select("id", "plate_number", "entry_time"), [F.desc("entry_time"), F.col("id")]).select(
        "row_count", F.size(F.from_json(F.get_json_object("context", "$.rows"), "array<string>")).alias("packed")))
docs("src_upload_listing", "SELECT name, date_uploaded FROM files WHERE name NOT LIKE '%.tiff'", FILES)(
    lambda t: files(t).filter(T.file_extension(F.col("name")).isin(*T.MIME_TYPES)).select("name", "date_uploaded"))
