"""Template extraction: fields, line items, transactions, parties.

Texts stay one row each. Rules become expressions over two arrays made once per document: the
trimmed lines and their normalised forms. A CASE on the document type keeps a document from
being tested against the rules of other types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnstone.constants import DOC_TYPES
from turnstone.functions.text import AMOUNT_MAD, amount_tokens, clean_value, norm_compact, norm_text, text_lines
from turnstone.functions.unicode import strip_marks
from turnstone.operators.templates import BBOX_LABELS, TEMPLATES

LINES, NORMS = "lines", "norms"
# Block markers and words that make a movement a credit.
ITEM_BLOCK = (["designation qte pu total"], ["conditions de paiement", "totaux", "total ht"])
STATEMENT_BLOCK = (["date libelle debit credit solde"], ["synthese periode", "total debit"])
CREDIT_WORDS = ("recu", "encaissement", "versement", "credit")


def prepare(docs: DataFrame, text: str = "raw_text") -> DataFrame:
    rows = docs.withColumn(LINES, text_lines(F.col(text)))
    return rows.withColumn(NORMS, F.transform(LINES, norm_text))


def _has_any(norm: Column, labels: list[str]) -> Column:
    cond = F.lit(False)
    for label in labels:
        cond = cond | norm.contains(label)
    return cond


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def after_colon(labels: list[str]) -> Column:
    """Right side of the first label line, else the next line; a bare label takes the next line."""
    wanted = [_plain(l) for l in labels]

    def value(line: Column, i: Column) -> Column:
        norm, following = F.get(NORMS, i), F.get(LINES, i + 1)
        usable = following.isNotNull() & ~following.contains(":")
        right = F.regexp_extract(line, r"^[^:]*:(.*)$", 1)
        inline = F.when(line.contains(":"), F.when(F.trim(right) != "", clean_value(right)).when(usable, clean_value(following)))
        bare = F.when(norm.isin(*wanted) & usable, clean_value(following))
        return F.when(_has_any(norm, wanted), F.coalesce(inline, bare))

    return _first(F.transform(LINES, value))


def next_line(labels: list[str]) -> Column:
    wanted = [_plain(l) for l in labels]
    value = lambda line, i: F.when(_has_any(F.get(NORMS, i), wanted), F.nullif(clean_value(F.get(LINES, i + 1)), F.lit("")))
    return _first(F.transform(LINES, value))


def regex_value(text: Column, pattern: str, group: int = 1) -> Column:
    return clean_value(F.regexp_extract(text, "(?i)" + pattern, group))


def _plain(label: str) -> str:
    import unicodedata

    folded = unicodedata.normalize("NFKD", label)
    return " ".join("".join(c for c in folded if not unicodedata.combining(c)).lower().split())


def rule_value(rule: dict, text: Column) -> Column:
    kind = rule.get("type", "").strip().lower()
    if kind == "regex" and rule.get("pattern"):
        return regex_value(text, rule["pattern"], int(rule.get("group", 1)))
    if kind == "after_colon":
        return after_colon(rule["labels"])
    if kind == "next_line":
        return next_line(rule["labels"])
    return F.lit(None).cast("string")  # box rules are joined in by ``bbox_backfill``


def block(starts: list[str], ends: list[str], source: str = LINES) -> Column:
    """Lines after the first start marker up to the first end marker behind it."""
    at = lambda marks: F.filter(F.transform(NORMS, lambda n, i: F.when(_has_any(n, marks), i)), lambda i: i.isNotNull())
    start = F.get(at(starts), F.lit(0)) + 1
    end = F.coalesce(F.array_min(F.filter(at(ends), lambda i: i >= start)), F.size(NORMS))
    empty = F.array().cast("array<string>")
    return F.when(start.isNull(), empty).otherwise(F.slice(source, start + 1, F.greatest(end - start, F.lit(0))))


def fields(docs: DataFrame, text: str = "raw_text", kind: str = "doc_type", templates: dict = TEMPLATES) -> DataFrame:
    """Adds ``fields`` (MAP field -> value): per field the first rule with a value."""
    rows = docs if LINES in docs.columns else prepare(docs, text)
    made = None
    for name in DOC_TYPES:
        positional = _positional(name)
        entries = []
        for field in dict.fromkeys([*templates[name]["rules"], *positional]):
            values = [rule_value(r, F.col(text)) for r in templates[name]["rules"].get(field, [])]
            values = [F.nullif(v, F.lit("")) for v in [*values, *([positional[field]] if field in positional else [])]]
            entries.append(F.struct(F.lit(field).alias("key"), F.coalesce(*values).alias("value")))
        made = (F if made is None else made).when(F.col(kind) == name, F.array(*entries))
    rows = rows.withColumn("_found", made)
    return rows.withColumn(
        "fields", F.map_from_entries(F.filter("_found", lambda e: e["value"].isNotNull()))
    ).drop("_found")


def _header_index(title: str) -> Column:
    """0-based position of the line that equals the title, -1 if none."""
    return (F.array_position(NORMS, F.lit(title)) - 1).cast("int")


def _positional(kind: str) -> dict[str, Column]:
    if kind == "invoice":
        return invoice_parties()
    if kind == "payment_receipt":
        return receipt_parties()
    if kind == "wire_transfer":
        return wire_names()
    return {}


def _line_at(title: str, offset: int) -> Column:
    at = _header_index(title)
    return F.when(at >= 0, F.get(LINES, at + offset))


def invoice_parties() -> dict[str, Column]:
    names = clean_value(_line_at("fournisseur client", 1))
    split = names.contains(" AU ")
    address = _line_at("fournisseur client", 2)
    parts = F.split(address, r"\s{2,}")
    usable = address.contains(" Maroc") & (F.size(parts) >= 2)
    return {
        "supplier_name": clean_value(F.when(split, F.substring_index(names, " AU ", 1)).otherwise(names)),
        "client_name": F.when(split, clean_value(F.regexp_extract(names, "^.*? (AU .*)$", 1))),
        "supplier_address": F.when(usable, clean_value(F.get(parts, F.lit(0)))),
        "client_address": F.when(usable, clean_value(F.element_at(parts, -1))),
    }


def receipt_parties() -> dict[str, Column]:
    """Accounts after the parties header. Names would need two blanks, which cleaning removes."""
    accounts = F.regexp_extract_all(
        clean_value(_line_at("payeur beneficiaire", 2)), F.lit(r"(?i)Compte\s*:\s*([0-9 ]{10,})"), F.lit(1))
    return {
        "payer_account": clean_value(F.get(accounts, F.lit(0))),
        "beneficiary_account": clean_value(F.get(accounts, F.lit(1))),
    }


def wire_names() -> dict[str, Column]:
    def name(start: str, ends: list[str]) -> Column:
        lines = F.filter(block([start], ends), lambda s: norm_text(s).startswith("nom:"))
        return clean_value(F.regexp_extract(F.get(lines, F.lit(0)), r"^[^:]*:(.*)$", 1))

    return {
        "sender_name": name("emetteur", ["beneficiaire"]),
        "beneficiary_name": name("beneficiaire", ["details virement", "execution"]),
    }


def invoice_items(docs: DataFrame) -> DataFrame:
    """One row per invoice line. Amounts are searched behind the quantity, so a quantity never
    becomes part of the unit price."""
    shape = r"(?i)^(.*?)\s(\d+)\s+(\d[\d\s]*[.,]\d{2}\s*MAD.*)$"
    rows = prepare(docs).select("doc_id", F.posexplode(F.transform(block(*ITEM_BLOCK), clean_value)).alias("pos", "row"))
    amounts = amount_tokens(F.regexp_extract("row", shape, 3))
    rows = rows.withColumn("a", amounts).filter(F.size("a") >= 2)
    rows = rows.select(
        "doc_id", "pos", clean_value(F.regexp_extract("row", shape, 1)).alias("designation"),
        F.regexp_extract("row", shape, 2).alias("quantity"),
        clean_value(F.element_at("a", -2)).alias("unit_price"), clean_value(F.element_at("a", -1)).alias("line_total"),
    )
    return rows.filter("designation <> ''")


def statement_transactions(docs: DataFrame) -> DataFrame:
    rows = prepare(docs).select(
        "doc_id", F.posexplode(F.transform(block(*STATEMENT_BLOCK), clean_value)).alias("pos", "line"))
    rows = rows.filter(F.col("line").rlike(r"^\d{2}/\d{2}/\d{4}\s+"))
    rows = rows.withColumn("rest", F.trim(F.substring("line", 11, 1 << 30))).withColumn("a", amount_tokens(F.col("rest")))
    rows = rows.filter(F.size("a") >= 2)
    last, second = F.element_at("a", -1), F.element_at("a", -2)
    third = F.get("a", F.size("a") - 3)
    explicit = F.size("a") >= 3
    # The label ends where the first of the amounts used begins; they stand last, so they are looked for from the end.
    before = lambda text, part: F.left(
        text, F.length(text) - F.call_function("locate", F.reverse(part), F.reverse(text)) - F.length(part) + 1)
    moved = before(before(F.col("rest"), last), second)
    rows = rows.withColumn("label", clean_value(F.when(explicit, before(moved, third)).otherwise(moved)))
    credit = _has_any(norm_text(F.col("label")), list(CREDIT_WORDS))
    move = clean_value(second)
    return rows.select(
        "doc_id", "pos", F.left("line", F.lit(10)).alias("date"), "label",
        F.when(explicit, clean_value(third)).when(credit, "").otherwise(move).alias("debit"),
        F.when(explicit | credit, move).otherwise("").alias("credit"), clean_value(last).alias("balance"),
    )


def completeness(extracted: DataFrame, kind: str = "doc_type", templates: dict = TEMPLATES) -> DataFrame:
    """Adds ``confidence`` (filled share of required fields) and ``missing``."""
    required = None
    for name in DOC_TYPES:
        names = F.array(*[F.lit(f) for f in templates[name]["required"]])
        required = F.when(F.col(kind) == name, names) if required is None else required.when(F.col(kind) == name, names)
    value = lambda f: F.coalesce(F.try_element_at("fields", f), F.lit(""))
    missing = F.filter(required, lambda f: F.trim(value(f)) == "")
    share = F.round((F.size(required) - F.size(missing)) / F.size(required), 4)
    return extracted.withColumn("missing", missing).withColumn("confidence", share)


def right_of_label(lines: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Value beside a label by boxes: ``(doc_id, field, value)``.

    A label line with ``label: value`` wins, in line order; otherwise the nearest line to the right
    on the same page within a height tolerance. Lines meet in bands of 16 units, so a page is not
    joined with itself pair by pair.
    """
    band = 16.0
    compact = norm_compact(F.col("text"))
    wanted = F.array(*[
        F.when(compact.contains(_plain(label).replace(" ", "")), F.lit(field)) for field, label in labels.items()
    ])
    marked = lines.withColumn("field", F.explode(F.array_compact(wanted)))
    right = clean_value(F.regexp_extract("text", r"^[^:]*:(.*)$", 1))
    inline = marked.filter(right != "").groupBy("doc_id", "field").agg(
        F.min(F.struct("page", "line_no", right.alias("value"))).getField("value").alias("inline"),
    )
    reach = F.greatest(F.lit(10.0), (F.col("y1") - F.col("y0")) * 1.6)
    probes = marked.filter(right == "").select(
        "doc_id", "page", "field", F.col("text").alias("label"), F.col("line_no").alias("l_no"), "y0", "x1", reach.alias("reach"),
    ).withColumn("band", F.explode(F.sequence(
        F.floor((F.col("y0") - F.col("reach")) / band), F.floor((F.col("y0") + F.col("reach")) / band))))
    sides = lines.select(
        "doc_id", "page", F.floor(F.col("y0") / band).alias("band"), clean_value(F.col("text")).alias("value"),
        F.col("line_no").alias("c_no"), F.col("x0").alias("cx0"), F.col("y0").alias("cy0"),
    ).filter("value <> ''")
    pairs = probes.join(sides, ["doc_id", "page", "band"]).filter(
        (F.col("value") != F.col("label")) & (F.col("cx0") > F.col("x1") - 2) & (F.abs(F.col("cy0") - F.col("y0")) <= F.col("reach"))
    )
    distance = F.abs(F.col("cy0") - F.col("y0")) + (F.col("cx0") - F.col("x1"))
    near = pairs.groupBy("doc_id", "field").agg(
        F.min(F.struct(distance.alias("d"), "page", "l_no", "c_no", "value")).getField("value").alias("near"))
    return inline.join(near, ["doc_id", "field"], "full_outer").select(
        "doc_id", "field", F.coalesce("inline", "near").alias("value"))


def bbox_backfill(extracted: DataFrame, lines: DataFrame) -> DataFrame:
    """Fills six key fields from boxes where the text rules found nothing."""
    found = right_of_label(lines, BBOX_LABELS).groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_boxes"))  # at most six entries
    rows = extracted.join(found, "doc_id", "left")
    empty = F.create_map().cast("map<string,string>")
    known = F.coalesce("fields", empty)
    extra = F.map_filter(F.coalesce("_boxes", empty), lambda k, v: ~F.map_contains_key(known, k))
    return rows.withColumn("fields", F.map_concat(known, extra)).drop("_boxes")


def right_of_label_in_rows(docs: DataFrame, labels: dict[str, str]) -> DataFrame:
    """``right_of_label`` where a row already holds the ``boxes`` of its document; adds ``found``, an array of (field, value).

    Nothing is joined or shuffled: the few boxes with a label look through the boxes of their document.
    """
    box = F.transform("boxes", lambda b: F.struct(
        *[b[c].alias(c) for c in ("page", "line_no", "text", "x0", "y0", "x1", "y1")],
        norm_compact(b["text"]).alias("compact"), clean_value(b["text"]).alias("value"),
        F.when(b["text"].contains(":"), clean_value(F.regexp_extract(b["text"], r"^[^:]*:(.*)$", 1))).otherwise("").alias("right")))
    rows = docs.withColumn("_boxes", box)
    wanted = {label: _plain(label).replace(" ", "") for label in labels.values()}
    some = lambda b: _has_any(b["compact"], list(wanted.values()))
    rows = rows.withColumn("_marked", F.filter("_boxes", some))
    sides = F.filter("_boxes", lambda b: b["value"] != "")
    rows = rows.withColumn("_sides", sides)

    def beside(p: Column) -> Column:
        reach = F.greatest(F.lit(10.0), (p["y1"] - p["y0"]) * 1.6)
        away = lambda b: F.abs(b["y0"] - p["y0"])
        near = F.filter("_sides", lambda b: (b["page"] == p["page"]) & (b["value"] != p["text"]) & (b["x0"] > p["x1"] - 2) & (away(b) <= reach))
        return F.array_min(F.transform(near, lambda b: F.struct(
            (away(b) + (b["x0"] - p["x1"])).alias("d"), p["page"].alias("page"), p["line_no"].alias("l_no"), b["line_no"].alias("c_no"), b["value"].alias("value"))))

    # Each labelled box looks once, whatever the number of its fields.
    rows = rows.withColumn("_marked", F.transform("_marked", lambda p: F.struct(
        p["compact"].alias("compact"), F.when(p["right"] != "", F.struct(p["page"], p["line_no"], p["right"].alias("value"))).alias("inline"),
        F.when(p["right"] == "", beside(p)).alias("near"))))

    def value(label: str) -> Column:
        hits = F.filter("_marked", lambda p: p["compact"].contains(wanted[label]))
        first = lambda c: F.array_min(F.transform(hits, lambda p: p[c]))["value"]
        return F.coalesce(first("inline"), first("near"))

    pairs = F.array(*[F.struct(F.lit(field).alias("field"), value(label).alias("value")) for field, label in labels.items()])
    rows = rows.withColumn("found", F.filter(pairs, lambda e: e["value"].isNotNull()))
    return rows.drop("_boxes", "_marked", "_sides")


def bbox_backfill_in_rows(extracted: DataFrame) -> DataFrame:
    """``bbox_backfill`` where a row already holds the ``boxes`` of its document."""
    rows = right_of_label_in_rows(extracted, BBOX_LABELS)
    empty = F.create_map().cast("map<string,string>")
    rows = rows.withColumn("_known", F.coalesce("fields", empty))
    extra = F.map_filter(F.map_from_entries("found"), lambda k, v: ~F.map_contains_key("_known", k))
    return rows.withColumn("fields", F.map_concat("_known", extra)).drop("_known", "found")
