"""Field look-up for questions on documents: structured leaves first, then the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnstone.functions.binding import let
from turnstone.functions.numbers import money, quantity
from turnstone.functions.text import norm_match, text_lines
from turnstone.operators.payload import leaves
from turnstone.operators.shuffled import grown_join

# Answers, hint words per question class (in test order), key sets, text patterns.
NOT_FOUND = "Non trouvé dans ce document"
HINTS = {
    "table": ("article", "ligne", "quantite", "prix", "unitaire"),
    "tva": ("tva", "vat", "taxe"),
    "total": ("montant total", "total", "a payer", "montant"),
    "date": ("date", "echeance", "invoice date"),
    "email": ("email", "mail", "courriel"),
    "address": ("adresse", "address"),
    "client": ("client", "customer", "destinataire", "acheteur"),
    "supplier": ("fournisseur", "emetteur", "vendeur", "societe", "entreprise", "issuer"),
}
KEYS = {
    "total": ("montant", "total", "montant_total", "total_ttc", "amount_total", "invoice_total"),
    "tva": ("tva", "taux_tva", "vat", "taxe", "tax_rate"),
    "date": ("date", "date_facture", "invoice_date", "document_date"),
    "email": ("email", "mail", "courriel"),
    "address": ("adresse", "address"),
    "client": ("client", "customer", "nom_client", "client_name", "destinataire", "acheteur"),
    "supplier": ("fournisseur", "emetteur", "issuer", "vendor", "societe", "company"),
}
LABEL = {"total": "Montant total", "tva": "TVA", "date": "Date du document", "email": "Email", "address": "Adresse",
         "client": "Client", "supplier": "Fournisseur"}
KEY_CONFIDENCE = {"total": 0.95, "tva": 0.9, "date": 0.92, "email": 0.9, "address": 0.88, "client": 0.9, "supplier": 0.9}
TEXT_CONFIDENCE = {"total": 0.85, "tva": 0.85, "date": 0.85, "email": 0.82, "address": 0.76, "client": 0.8, "supplier": 0.82}
PATTERNS = {
    "total": r"(?im)^total\s*[:\-]?\s*([0-9][0-9\s.,]*)\s*€?\s*$",
    "tva": r"(?im)^(?:taux\s*)?tva\s*[:\-]?\s*([0-9]+(?:[.,][0-9]+)?\s*%?)",
    "due": r"(?is)date\s+d[' ]?echeance\s*[:\-]?\s*([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4})",
    "date": r"(?im)^date\s*[:\-]?\s*([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4})",
    "email": r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})",
    "address": r"(?im)^(\s*\d{1,5}\s+[A-Za-z0-9 .,'-]+)$",
    "supplier": r"(?i)^(.+?)\s+facture\b",
}
STOPWORDS = ("donne", "moi", "le", "la", "les", "de", "du", "des", "est", "quel", "quelle", "quels", "quelles", "avec",
             "dans", "sur", "ce", "document", "svp", "stp", "please")
_CLIENT = ("client", "customer", "nom_client", "client_name", "nom", "prenom")
_NUMBER = ("numero_facture", "invoice_number", "facture", "numero")
TOKEN_ALIASES = {
    "client": _CLIENT, "customer": _CLIENT, "facture": _NUMBER, "numero": _NUMBER,
    "email": ("email", "mail", "courriel"), "mail": ("email", "mail", "courriel"),
    "adresse": ("adresse", "address"), "address": ("adresse", "address"),
}
ITEM_KEYS = ("articles", "lignes", "line_items", "items")
ROW_STOPS = ("sous total", "total", "tva", "signature", "mode de paiement", "date d'echeance")
ROW_SHAPE = r"^(.*?)(\d[\d\s]*(?:[.,]\d{1,2})?\s*€?)\D*?(\d[\d\s]*(?:[.,]\d{1,2})?\s*€?)\D*$"


def _mentions(norm: Column, words) -> Column:
    cond = F.lit(False)
    for word in words:
        cond = cond | norm.contains(word)
    return cond


def question_kind(question: Column) -> Column:
    def find(norm: Column) -> Column:
        out = None
        for kind, words in HINTS.items():
            out = (F if out is None else out).when(_mentions(norm, words), kind)
        return out.otherwise("generic")

    return let(norm_match(question), find)


def lookup(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers ``(question_id, kind, answer, found, field, evidence, confidence)``.

    ``docs`` has ``(doc_id, raw_text, data)``, ``questions`` ``(question_id, doc_id, question)``.
    Tables and open questions have their own operators.
    """
    asked = questions.withColumn("kind", question_kind(F.col("question")))
    tree = leaves(docs)
    known = list({k for v in KEYS.values() for k in v} | {"nom", "prenom"})
    tree = tree.filter(F.col("key").isin(*known))
    # One row per document holds the first leaf of every kind; everything meets by document.
    entry = F.struct("path", "value")
    hit = lambda cond: F.min_by(F.when(cond, entry), F.when(cond, F.col("sort")))
    found = tree.groupBy("doc_id").agg(
        *[hit(F.col("key").isin(*v)).alias(f"hit_{k}") for k, v in KEYS.items()],
        hit(F.col("key") == "nom").alias("nom"), hit(F.col("key") == "prenom").alias("prenom"))
    kind = F.col("kind")
    own = F.coalesce(*[F.when(kind == k, F.col(f"hit_{k}")) for k in KEYS]).alias("hit")
    rows = grown_join(grown_join(asked, docs.select("doc_id", "raw_text"), "doc_id"), found, "doc_id", "left").select(
        *asked.columns, "raw_text", own, "nom", "prenom")
    word = F.lower("hit.value").isin("none", "null", "nan")
    rows = rows.withColumn("hit", F.when(~(kind.isin("email", "address") & word), F.col("hit")))

    text = F.col("raw_text")
    due = (kind == "date") & norm_match(F.col("question")).contains("echeance")
    grab = lambda name, g=1: F.nullif(F.trim(F.regexp_extract(text, PATTERNS[name], g)), F.lit(""))
    lines = text_lines(text)
    head = F.filter(F.slice(F.split(text, "\n"), 1, 5), lambda s: F.regexp_extract(F.trim(s), PATTERNS["supplier"], 1) != "")
    supplier = F.nullif(F.trim(F.regexp_extract(F.trim(F.get(head, F.lit(0))), PATTERNS["supplier"], 1), F.lit(" -:")), F.lit(""))
    at = F.array_min(F.filter(F.transform(lines, lambda s, i: F.when(norm_match(s) == "client", i)), lambda i: i.isNotNull()))
    below = F.filter(F.slice(lines, F.coalesce(at, F.lit(0)) + 2, 3), lambda s: (norm_match(s) != "") & ~s.contains("@") & ~norm_match(s).contains("http") & ~norm_match(s).contains("www"))
    text_value = (
        F.when(kind == "total", grab("total")).when(kind == "tva", grab("tva")).when(kind == "date", grab("date"))
        .when(kind == "email", grab("email")).when(kind == "address", grab("address")).when(kind == "supplier", supplier)
        .when((kind == "client") & at.isNotNull(), F.get(below, F.lit(0)))
    )
    rows = rows.withColumn("due", F.when(due, grab("due"))).withColumn("text_value", text_value)
    full = F.trim(F.concat_ws(" ", "prenom.value", "nom.value"))
    rows = rows.withColumn("full", F.when((kind == "client") & F.col("hit").isNull(), F.nullif(full, F.lit(""))))

    value = F.coalesce("due", "hit.value", "full", "text_value")
    shaped = F.when(kind == "total", F.coalesce(F.nullif(money(value), F.lit("")), value)).when(
        (kind == "tva") & ~value.contains("%"), F.concat(value, F.lit("%"))).otherwise(value)
    pick = lambda table: F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), kind)
    label = F.when(F.col("due").isNotNull(), "Date d'echeance").otherwise(pick(LABEL))
    confidence = (
        F.when(F.col("due").isNotNull(), 0.88).when(F.col("hit").isNotNull(), pick(KEY_CONFIDENCE))
        .when(F.col("full").isNotNull(), 0.86).otherwise(pick(TEXT_CONFIDENCE))
    )
    source = (
        F.when(F.col("due").isNotNull(), "context.ocr_text").when(F.col("hit").isNotNull(), F.col("hit.path"))
        .when(F.col("full").isNotNull(), F.concat_ws(",", "prenom.path", "nom.path")).when(F.col("text_value").isNotNull(), "context.ocr_text")
    )
    evidence = F.when(F.col("due").isNull() & F.col("hit").isNotNull(), F.concat("hit.path", F.lit("="), "hit.value")).otherwise(value)
    return normalize_answers(rows.select(
        "question_id", "doc_id", "kind", F.concat(label, F.lit(": "), shaped).alias("answer"), value.isNotNull().alias("found"),
        source.alias("field"), evidence.alias("evidence"), confidence.alias("confidence")))


def normalize_answers(rows: DataFrame) -> DataFrame:
    """Without evidence or a finding the fixed answer stands and confidence is at most 0.35."""
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))))
    shown = F.coalesce(F.trim("evidence"), F.lit("")) != ""
    ok = shown & F.coalesce("found", F.lit(False))
    answer = F.when(F.coalesce(F.trim("answer"), F.lit("")) == "", "Information trouvee dans le document.").otherwise(F.trim("answer"))
    return rows.withColumns({
        "answer": F.when(ok, answer).otherwise(NOT_FOUND), "found": ok,
        "confidence": F.when(ok, sure).otherwise(F.least(sure, F.lit(0.35))),
    })


def generic(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """Open questions: the leaf whose key shares most words with the question, first one on ties."""
    split = F.split(norm_match(F.col("question")), "[^a-z0-9_]+")
    tokens = F.array_distinct(F.filter(split, lambda t: (F.length(t) >= 3) & ~t.isin(*STOPWORDS)))
    asked = questions.select("question_id", "doc_id", tokens.alias("tokens")).filter(F.size("tokens") > 0)
    aliases = F.create_map(*[x for k, v in TOKEN_ALIASES.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    parts = F.split("key", "_")
    near = lambda t: F.col("key").contains(t) | F.coalesce(
        F.array_contains(F.try_element_at(aliases, t), F.col("key")) | F.arrays_overlap(parts, F.try_element_at(aliases, t)), F.lit(False))
    rows = grown_join(asked, leaves(docs), "doc_id").withColumn("score", F.size(F.filter("tokens", near)) * 2).filter("score > 0")
    best = rows.groupBy("question_id").agg(F.min_by(F.struct("path", "key", "value", "score"), F.struct((-F.col("score")).alias("s"), "sort")).alias("b"))
    label = F.initcap(F.trim(F.replace("b.key", F.lit("_"), F.lit(" "))))
    return best.select("question_id", F.concat(label, F.lit(": "), "b.value").alias("answer"), F.col("b.path").alias("field"),
                       F.concat("b.path", F.lit("="), "b.value").alias("evidence"), F.lit(0.78).alias("confidence"))


def structured_items() -> Column:
    """Line items of the payload's ``extra`` lists, an array of (pos, description, quantity, unit_price, line_total)."""
    lists = [F.coalesce(F.from_json(F.get_json_object("data", f"$.extra.{k}"), "array<map<string,string>>"), F.array().cast("array<map<string,string>>")) for k in ITEM_KEYS]
    first = lambda m, *keys: F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")) for k in keys], F.lit(""))

    def item(m: Column, pos: Column) -> Column:
        return F.struct(
            pos.alias("pos"), F.trim(first(m, "description", "libelle", "label")).alias("description"),
            quantity(first(m, "quantite", "quantity", "qte")).alias("quantity"),
            money(first(m, "unit_price", "prixUnitaireHT", "prix")).alias("unit_price"),
            money(first(m, "line_total", "totalHT", "total")).alias("line_total"))

    cols = ("description", "quantity", "unit_price", "line_total")
    some = F.filter(F.transform(F.concat(*lists), item), lambda r: F.concat(*[r[c] for c in cols]) != "")
    return F.transform(some, lambda r: F.struct(
        r["pos"].alias("pos"), *[F.when(r[c] == "", "?").otherwise(r[c]).alias(c) for c in cols]))


def structured_rows(docs: DataFrame) -> DataFrame:
    """Line items of the payload's ``extra`` lists ``(doc_id, pos, description, quantity, unit_price, line_total)``."""
    return docs.select("doc_id", F.inline(structured_items()))


def text_rows(docs: DataFrame) -> DataFrame:
    """Line items read from the text below a description/price header."""
    rows = docs.select("doc_id", text_lines(F.col("raw_text")).alias("lines")).withColumn("norms", F.transform("lines", norm_match))
    first = lambda cond: F.array_min(F.filter(F.transform("norms", lambda n, i: F.when(cond(n, i), i)), lambda i: i.isNotNull()))
    start = first(lambda n, i: n.contains("description") & (n.contains("prix") | n.contains("total")))
    rows = rows.withColumn("start", start).filter("start IS NOT NULL")
    stops = lambda n: F.exists(F.array(*[F.lit(w) for w in ROW_STOPS]), lambda w: F.startswith(n, w))
    end = F.coalesce(first(lambda n, i: (i > F.col("start")) & stops(n)), F.size("norms"))
    rows = rows.withColumn("part", F.slice("lines", F.col("start") + 2, F.greatest(end - F.col("start") - 1, F.lit(0))))
    rows = rows.select("doc_id", F.posexplode("part").alias("pos", "line"))
    piece = lambda g: F.regexp_extract("line", ROW_SHAPE, g)
    rows = rows.filter(piece(2) != "").withColumn("words", F.filter(F.split(piece(1), r"\s+"), lambda w: w != ""))
    last = quantity(F.when(F.size("words") > 0, F.element_at("words", -1)))
    rows = rows.withColumn("q", F.coalesce(last, F.lit("")))
    kept = F.when(F.col("q") != "", F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0)))).otherwise(F.col("words"))
    rows = rows.select("doc_id", "pos", F.array_join(kept, " ").alias("description"),
                       F.when(F.col("q") == "", "?").otherwise(F.col("q")).alias("quantity"),
                       money(piece(2)).alias("unit_price"), money(piece(3)).alias("line_total"))
    return rows.filter("description <> ''")


def item_rows(docs: DataFrame) -> DataFrame:
    """Structured items where a document has any, else items from its text; each document decides by itself."""
    rows = docs.withColumn("items", structured_items())
    own = rows.select("doc_id", F.inline("items"))
    return own.unionByName(text_rows(rows.filter(F.size("items") == 0)))
