"""JSON payloads: leaves, first matching key, core fields, merges, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnstone.functions.binding import let
from turnstone.functions.numbers import to_number
from turnstone.functions.text import norm_match

# Core fields, their other names, values that count as empty.
CORE_FIELDS = ("nom", "prenom", "date", "montant", "adresse", "email", "numero_facture")
CORE_ALIASES = {
    "name": "nom", "full_name": "nom", "first_name": "prenom", "lastname": "nom", "surname": "nom",
    "amount": "montant", "total": "montant", "invoice_number": "numero_facture", "invoice_no": "numero_facture",
    "numero": "numero_facture", "numerofacture": "numero_facture", "n_facture": "numero_facture",
    "no_facture": "numero_facture", "address": "adresse", "mail": "email",
}
EMPTY_WORDS = ("null", "none", "n/a", "na", "inconnu", "unknown")
AMOUNT_KEYS = ("amount", "montant")


def _is_container(json: Column) -> Column:
    return F.substring(F.ltrim(json), 1, 1).isin("{", "[")


def _children(json: Column) -> Column:
    """Entries of an object or array as (step, sort key, key, value text); arrays keep their index.

    Objects are read in (length, text) order of their keys, the stored order of binary JSON.
    """
    is_object = F.substring(F.ltrim(json), 1, 1) == "{"
    as_map = F.map_entries(F.from_json(F.when(is_object, json), "map<string,string>"))
    keyed = F.transform(as_map, lambda e: F.struct(
        F.concat(F.lit("."), e["key"]).alias("step"),
        F.concat(F.lpad(F.length(e["key"]).cast("string"), 10, "0"), e["key"]).alias("sort"), e["key"].alias("key"), e["value"].alias("value")))
    as_list = F.from_json(F.when(~is_object, json), "array<string>")
    indexed = F.transform(as_list, lambda v, i: F.struct(
        F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("step"), F.lpad(i.cast("string"), 10, "0").alias("sort"),
        F.lit(None).cast("string").alias("key"), v.alias("value")))
    return F.when(is_object, keyed).otherwise(indexed)


def nesting(json: Column) -> Column:
    """How many objects and arrays lie inside each other at most: brackets outside quoted texts, counted as they open."""
    plain = F.regexp_replace(json, r'"(?:[^"\\]|\\.)*+"', "")
    turns = F.split(F.regexp_replace(plain, r"[^\[\]{}]", ""), "(?!^)")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at: Column, mark: Column) -> Column:
        now = at["now"] + F.when(mark.isin("{", "["), 1).when(mark.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.coalesce(F.aggregate(turns, start, step, lambda at: at["most"]), F.lit(0))


def leaves(docs: DataFrame, col: str = "data") -> DataFrame:
    """Scalar leaves ``(doc_id, path, sort, key, value)``; ``sort`` gives depth-first order.

    One narrow expression per level inside the row; nothing is shuffled. A first pass over the texts finds how many
    levels there are.
    """
    depth = docs.agg(F.max(nesting(F.col(col)))).first()[0] or 0
    kind = "array<struct<path:string,sort:string,key:string,value:string>>"
    level = F.array(F.struct(F.lit("data").alias("path"), F.lit("").alias("sort"), F.lit(None).cast("string").alias("key"), F.col(col).alias("value")))
    rows = docs.withColumn("_open", level.cast(kind)).withColumn("_done", F.array().cast(kind))
    for _ in range(depth):
        grown = F.flatten(F.transform(F.filter("_open", lambda n: _is_container(n["value"])), lambda n: F.coalesce(F.transform(
            _children(n["value"]), lambda c: F.struct(
                F.concat(n["path"], c["step"]).alias("path"), F.concat(n["sort"], F.lit("/"), c["sort"]).alias("sort"),
                F.coalesce(c["key"], n["key"]).alias("key"), c["value"].alias("value"))), F.array().cast(kind))))
        rows = rows.withColumn("_done", F.concat("_done", F.filter("_open", lambda n: ~_is_container(n["value"])))).withColumn("_open", grown)
    found = rows.select("doc_id", F.explode_outer(F.concat("_done", "_open")).alias("n")).select("doc_id", "n.*")
    scalar = F.col("value").isNotNull() & (F.trim("value") != "")
    key = F.replace(norm_match(F.col("key")), F.lit(" "), F.lit("_"))
    return found.filter(scalar).select("doc_id", "path", "sort", key.alias("key"), F.trim("value").alias("value"))


def find_key(tree: DataFrame, keys: list[str]) -> DataFrame:
    """First leaf in depth-first order whose key is one of the given ones."""
    hits = tree.filter(F.col("key").isin(*keys))
    return hits.groupBy("doc_id").agg(F.min_by(F.struct("path", "value"), "sort").alias("b")).select("doc_id", "b.*")


def _object(col: Column) -> Column:
    return F.from_json(F.when(F.substring(F.ltrim(col), 1, 1) == "{", col), "map<string,string>")


def hybrid(col: Column) -> Column:
    """STRUCT of the seven core fields and ``extra`` MAP; a ``data`` object inside is unwrapped."""
    return let(_object(col), lambda top: let(_object(F.try_element_at(top, F.lit("data"))), lambda inner: _hybrid(top, inner)))


def _hybrid(top: Column, inner: Column) -> Column:
    source = F.coalesce(inner, top)
    around = F.when(inner.isNotNull(), F.map_filter(top, lambda k, v: k != "data"))
    names = F.create_map(*[F.lit(x) for pair in CORE_ALIASES.items() for x in pair])
    core = lambda k: F.coalesce(F.try_element_at(names, F.lower(F.trim(k))), F.lower(F.trim(k)))
    entries = F.map_entries(F.map_filter(source, lambda k, v: k != "extra"))
    fields = []
    for field in CORE_FIELDS:
        same = F.filter(entries, lambda e: core(e["key"]) == field)
        fields.append(F.nullif(F.trim(F.element_at(F.when(F.size(same) > 0, same), -1)["value"]), F.lit("")).alias(field))
    empty = F.create_map().cast("map<string,string>")
    own = F.map_from_entries(F.filter(entries, lambda e: ~core(e["key"]).isin(*CORE_FIELDS)))
    given = F.coalesce(_object(F.try_element_at(source, F.lit("extra"))), empty)
    return F.when(top.isNotNull(), F.struct(*fields, merge_maps(merge_maps(given, own), F.coalesce(around, empty)).alias("extra")))


def merge_maps(base: Column, incoming: Column) -> Column:
    """Incoming entries win; independent of the session's map key policy."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(incoming, k)), incoming)


def patched(documents: DataFrame, patches: DataFrame) -> DataFrame:
    """Stored documents (doc_id, core fields, extra) with patches (doc_id, patch JSON, replace): merged, or replaced by them."""
    old = documents.select("doc_id", F.struct(*[c for c in documents.columns if c != "doc_id"]).alias("_old"))
    new = patches.select("doc_id", hybrid(F.col("patch")).alias("_new"), "replace")
    after = F.when(F.col("_new").isNull(), F.col("_old")).when(F.col("replace"), F.col("_new")).otherwise(merge_hybrid(F.col("_old"), F.col("_new")))
    return old.join(new, "doc_id", "left").select("doc_id", after.alias("_h")).select("doc_id", "_h.*").select(*documents.columns)


def is_empty_like(col: Column) -> Column:
    return col.isNull() | (F.trim(col) == "") | F.lower(F.trim(col)).isin(*EMPTY_WORDS)


def merge_hybrid(base: Column, incoming: Column) -> Column:
    """Incoming core values win unless empty-like; extras are merged, incoming wins."""
    return let(base, lambda a: let(incoming, lambda b: _merged(a, b)))


def _merged(base: Column, incoming: Column) -> Column:
    fields = [F.when(is_empty_like(incoming[f]), base[f]).otherwise(incoming[f]).alias(f) for f in CORE_FIELDS]
    empty = F.create_map().cast("map<string,string>")
    extra = merge_maps(F.coalesce(base["extra"], empty), F.coalesce(incoming["extra"], empty))
    return F.struct(*fields, extra.alias("extra"))


def numeric_amounts(tree: DataFrame) -> DataFrame:
    """Leaves with the number of every amount field beside the text."""
    return tree.withColumn("number", F.when(F.col("key").isin(*AMOUNT_KEYS), to_number(F.col("value"))))


def guarded_object(text: Column, required: list[str] = []) -> Column:
    """The JSON object in a text (whole, else between the outer braces) if it has the required keys."""
    block = F.regexp_extract(text, r"(?s)(\{.*\})", 1)

    def usable(t: Column) -> Column:
        t = F.trim(t)
        return F.when((F.substring(t, 1, 1) == "{") & F.try_parse_json(t).isNotNull(), t)

    found = F.coalesce(usable(text), usable(block))
    keys = F.json_object_keys(found)
    has = F.lit(True)
    for key in required:
        has = has & F.array_contains(keys, key)
    return F.when(has, found)


def payload_value(col: Column) -> Column:
    """``value`` of a field payload, else ``text``, else the payload itself."""
    m = _object(col)
    return F.when(m.isNull(), col).when(F.map_contains_key(m, F.lit("value")), F.try_element_at(m, F.lit("value"))).when(
        F.map_contains_key(m, F.lit("text")), F.try_element_at(m, F.lit("text"))).otherwise(col)


def has_bbox(col: Column) -> Column:
    box = F.from_json(F.try_element_at(_object(col), F.lit("bbox")), "array<double>")
    return F.coalesce(F.size(box) == 4, F.lit(False))
