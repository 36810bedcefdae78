"""Review state of extracted fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnstone.operators.matching import field_to_line, fuzzy_match
from turnstone.operators.payload import has_bbox, payload_value
from turnstone.operators.shuffled import grown_join

# Reference kind per field name.
FIELD_KINDS = {"supplier_name": "supplier", "supplier": "supplier", "fournisseur": "supplier", "city": "city", "ville": "city",
               "country": "country", "pays": "country"}
STATUSES = ("in_review", "validated")


def normalize_fields(fields: DataFrame, references: dict[str, DataFrame]) -> DataFrame:
    """Suggestion per ``(doc_id, field, value)`` with the applied value; unknown kinds keep theirs."""
    table = F.create_map(*[F.lit(x) for pair in FIELD_KINDS.items() for x in pair])
    rows = fields.withColumn("kind", F.try_element_at(table, F.lower(F.trim("field"))))
    out = None
    for kind, entities in references.items():
        wanted = rows.filter(F.col("kind") == kind)
        part = wanted.join(fuzzy_match(wanted, entities), "value", "left")
        out = part if out is None else out.unionByName(part)
    covered = F.coalesce(F.col("kind").isin(*references), F.lit(False))
    rest = rows.filter(~covered).select(
        "value", *[c for c in rows.columns if c != "value"], F.col("value").alias("canonical"), F.lit(0.0).alias("score"),
        F.lit(None).cast("bigint").alias("matched_id"), F.lit("keep").alias("action"))
    out = out.unionByName(rest)
    applied = F.when(F.col("action") == "replace", F.col("canonical")).otherwise(F.col("value"))
    return out.select("doc_id", "field", F.col("value").alias("original"), F.col("canonical").alias("suggested"), "score",
                      "matched_id", "action", applied.alias("applied"))


def _map(col: str) -> Column:
    return F.coalesce(F.from_json(col, "map<string,string>"), F.create_map().cast("map<string,string>"))


def review_state(documents: DataFrame, reviews: DataFrame) -> DataFrame:
    """Effective field maps per document; raw fields fall back to the document's own data."""
    rows = documents.select(F.col("doc_id").alias("document_id"), "data")
    rows = grown_join(rows, reviews, "document_id", "left")
    raw = _map("raw_extracted_fields")
    return rows.select(
        "document_id", F.when(F.size(raw) > 0, raw).otherwise(_map("data")).alias("raw"), _map("normalized_fields").alias("normalized"),
        _map("user_corrected_fields").alias("corrected"),
        F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("in_review").alias("status"))


def review_keys(state: DataFrame) -> DataFrame:
    keys = F.array_union(F.array_union(F.map_keys("raw"), F.map_keys("normalized")), F.map_keys("corrected"))
    return state.select("document_id", F.array_sort(keys).alias("keys"))


def review_values(state: DataFrame) -> DataFrame:
    """Current value per field: corrected, else normalised, else raw; and whether it has a box."""
    keys = F.array_union(F.array_union(F.map_keys("raw"), F.map_keys("normalized")), F.map_keys("corrected"))
    rows = state.select("*", F.explode(keys).alias("field"))
    get = lambda m: F.try_element_at(m, F.col("field"))
    return rows.select(F.col("document_id").alias("doc_id"), "field",
                       payload_value(F.coalesce(get("corrected"), get("normalized"), get("raw"))).alias("value"),
                       has_bbox(get("normalized")).alias("has_bbox"))


def bbox_merge(state: DataFrame, lines: DataFrame) -> DataFrame:
    """Boxes for fields that lack one, from the best matching line."""
    values = review_values(state)
    missing = values.filter(~F.col("has_bbox") & (F.trim(F.coalesce("value", F.lit(""))) != ""))
    # Lines of documents without an open field meet nothing; they go before they are cut into lines.
    lines = lines.join(missing.select("doc_id").distinct(), "doc_id", "left_semi")
    found = field_to_line(missing.select("doc_id", "field", "value"), lines)
    boxes = lines.select("doc_id", "page", "line_no", F.array("x0", "y0", "x1", "y1").alias("bbox"))
    return grown_join(grown_join(missing, found, ["doc_id", "field"]), boxes, ["doc_id", "page", "line_no"]).select(
        "doc_id", "field", "value", "page", "line_no", "bbox", "bbox_score")
