"""Similarity, containment and nearest-time joins. Candidates come from equi-joins only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from turnstone.constants import ASSET_LINK_SECONDS, FUZZY_THRESHOLD
from turnstone.functions.text import norm_ascii, norm_question
from turnstone.operators.shuffled import grown_join
from turnstone.operators.slots import seconds_between, slot_of

# Lengths of anchor pieces, names that are few enough for a broadcast.
PIECE_SIZES = (512, 256, 128, 64, 32, 16, 8, 4, 2, 1)
FEW_NAMES = 10_000


def norm_name(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(col, F.lit("")))), r"(?U)\s+", " "))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio times 100."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(a=x, b=y).ratio() * 100.0 for x, y in zip(a, b)])


def reference_entities(rows: DataFrame) -> DataFrame:
    """``(id, canonical_name, aliases)`` with aliases as JSON text or array; blanks dropped."""
    aliases = F.col("aliases")
    if rows.schema["aliases"].dataType.simpleString() == "string":
        aliases = F.from_json(aliases, "array<string>")
    trimmed = F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.trim(a))
    return rows.select("id", F.trim("canonical_name").alias("canonical_name"),
                       F.filter(trimmed, lambda a: a != "").alias("aliases")).filter("canonical_name <> ''")


def _choices(entities: DataFrame) -> DataFrame:
    """One row per normalised alias; the last entity owns it, its first place decides ties."""
    names = entities.select("id", "canonical_name", F.posexplode(
        F.concat(F.array("canonical_name"), "aliases")).alias("pos", "alias"))
    keyed = names.select(norm_name(F.col("alias")).alias("alias"), "id", "canonical_name", F.struct("id", "pos").alias("ord"))
    return keyed.filter("alias <> ''").groupBy("alias").agg(
        F.min("ord").alias("ord"), F.max_by(F.struct("id", "canonical_name"), "ord").alias("owner"))


def _grams(df: DataFrame, key: str) -> DataFrame:
    """Numbered character pairs of each text, so that repeated pairs count."""
    text = F.col(key)
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    pairs = F.when(F.length(text) >= 2, pairs)
    numbered = df.select(key, pairs.alias("p")).select(key, F.posexplode("p").alias("i", "g"), "p").select(
        key, F.concat("g", F.size(F.filter(F.slice("p", 1, F.col("i") + 1), lambda x: x == F.col("g"))).cast("string")).alias("gram"))
    return numbered


def _prefix(grams: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """Rarest pairs of each text: enough that two texts at the threshold must share one.

    At ratio r = 0.85 with total length T, at most 0.15 T characters are unmatched, so at most
    0.15 T + 1 matching blocks hold at least 0.425 T characters and share 0.275 T - 1 pairs. The
    partner has at least 0.739 times the length n, which leaves 0.478 n - 1 shared pairs.
    """
    n = F.length(key)
    shared = F.greatest(F.lit(1), F.ceil(n * 0.478 - 1))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("df", F.lit(0)), "gram"))
    rows = grams.join(weights, "gram", "left").withColumn("rank", rank)
    return rows.filter(F.col("rank") <= n - 1 - shared + 1).select(key, "gram")


def fuzzy_match(values: DataFrame, entities: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """Best reference per distinct ``value``: ``(value, canonical, score, matched_id, action)``.

    Values without a reference at the threshold keep themselves; their score is null because weaker
    partners are never compared. ``threshold`` must be 85 or more for the pair bound to hold.
    """
    if threshold < 85:
        raise ValueError("the candidate bound needs a threshold of at least 85")
    choices = _choices(entities)
    wanted = values.select("value").distinct().withColumn("norm", norm_name(F.col("value")))
    texts = wanted.filter("norm <> ''").select("norm").distinct()
    exact = texts.join(choices.withColumnRenamed("alias", "norm"), "norm").select("norm", "owner", "ord", F.lit(100.0).alias("score"))
    open_texts = texts.join(choices.select(F.col("alias").alias("norm")), "norm", "left_anti")
    alias_grams = _grams(choices.select("alias"), "alias")
    weights = alias_grams.groupBy("gram").agg(F.count("*").alias("df"))
    left = _prefix(_grams(open_texts, "norm"), weights, "norm")
    right = _prefix(alias_grams, weights, "alias")
    la, lb = F.length("norm"), F.length("alias")
    pairs = left.join(right, "gram").filter(2 * F.least(la, lb) >= (la + lb) * (threshold / 100)).select("norm", "alias").distinct()
    scored = pairs.withColumn("score", similarity("norm", "alias")).filter(F.col("score") >= threshold)
    near = scored.join(choices, "alias").select("norm", "owner", "ord", "score")
    # Smallest (minus score, order) is the best score with the first alias on ties.
    best = near.unionByName(exact).groupBy("norm").agg(
        F.min_by(F.struct("owner", "score"), F.struct((-F.col("score")).alias("s"), "ord")).alias("b"))
    rows = wanted.join(best, "norm", "left")
    same = norm_name(F.col("b.owner.canonical_name")) == F.col("norm")
    return rows.select(
        "value", F.coalesce("b.owner.canonical_name", "value").alias("canonical"),
        F.col("b.score").alias("score"), F.col("b.owner.id").alias("matched_id"),
        F.when(F.col("b").isNull() | same, "keep").otherwise("replace").alias("action"))


def field_to_line(fields: DataFrame, lines: DataFrame, min_score: float = 55.0) -> DataFrame:
    """Best line per ``(doc_id, field, value)``.

    Every line travels once, to the fields of its document. Without a common word the score is at most 45.
    """
    words = lambda c: F.array_distinct(F.split(c, " "))
    left = fields.withColumn("v", norm_ascii(F.col("value"))).filter("v <> ''").select("doc_id", "field", "v")
    right = lines.withColumn("c", norm_ascii(F.col("text"))).filter("c <> ''").select("doc_id", "page", "line_no", "c")
    pairs = grown_join(right, left, "doc_id").withColumn("vw", words("v"))
    pairs = pairs.withColumn("common", F.size(F.array_intersect("vw", words("c")))).filter("common > 0").withColumn("n", F.size("vw"))
    bonus = F.when(F.contains("c", "v"), 0.25).when(F.contains("v", "c"), 0.2).otherwise(0.0)
    length = F.least(F.length("v"), F.length("c")) / F.greatest(F.length("v"), F.length("c"))
    score = F.least(F.lit(100.0), (F.col("common") / F.col("n") * 0.6 + bonus + length * 0.2) * 100)
    rows = pairs.withColumn("score", F.round(score, 6)).filter(F.col("score") >= min_score)
    best = rows.groupBy("doc_id", "field").agg(F.min(F.struct((-F.col("score")).alias("s"), "page", "line_no")).alias("b"))
    return best.select("doc_id", "field", F.col("b.page").alias("page"), F.col("b.line_no").alias("line_no"),
                       F.round(-F.col("b.s"), 2).alias("bbox_score"))


def nearest_file(docs: DataFrame, files: DataFrame, width_seconds: int = 3600) -> DataFrame:
    """Nearest file in time per document ``(doc_id, at)``; ``files`` has ``(name, mtime)``.

    Time is cut into slots. Inside a slot a window looks back and forth; what lies outside comes
    from one summary row per slot, so no task sees the whole time line.
    """
    stamp = F.struct(F.col("mtime").alias("at"), "name")
    points = files.select(F.lit(None).cast("bigint").alias("doc_id"), F.col("mtime").alias("at"), stamp.alias("f")).unionByName(
        docs.select("doc_id", "at", F.lit(None).cast(files.select(stamp.alias("f")).schema["f"].dataType).alias("f")))
    points = points.withColumn("slot", slot_of(F.col("at"), width_seconds))
    ends = points.groupBy("slot").agg(F.min("f").alias("lo"), F.max("f").alias("hi"))
    # Looking forth is looking back in falling order: a frame up to the last row is read anew for every row.
    seen = lambda c, window: F.last(c, True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    # One small row per slot of the covered time.
    ends = ends.select("slot", seen("hi", Window.orderBy("slot")).alias("before"),
                       seen("lo", Window.orderBy(F.desc("slot"))).alias("after"))
    # Files sort before documents at the same time, so an equal time is found looking back.
    order = [F.col("at"), F.col("doc_id").isNotNull(), F.col("f")]
    local = Window.partitionBy("slot")
    rows = points.withColumn("back", seen("f", local.orderBy(*order))).withColumn(
        "forth", seen("f", local.orderBy(*[c.desc() for c in order])))
    rows = rows.filter("doc_id IS NOT NULL").join(ends, "slot")
    back, forth = F.coalesce("back", "before"), F.coalesce("forth", "after")
    far = lambda f: F.abs(seconds_between(f["at"], F.col("at")))
    pick = F.when(forth.isNull() | (back.isNotNull() & (far(back) <= far(forth))), back).otherwise(forth)
    return rows.withColumn("p", pick).select("doc_id", F.col("p.name").alias("name"), F.abs(seconds_between(F.col("p.at"), F.col("at"))).alias("delta"))


def link_assets(docs: DataFrame, files: DataFrame, links: DataFrame, window_seconds: int = ASSET_LINK_SECONDS) -> DataFrame:
    """File per document: a stored link, else the nearest file, else (too far) the nearest unlinked one."""
    open_docs = docs.join(links, "doc_id", "left_anti")
    dated = open_docs.filter("at IS NOT NULL")
    near = nearest_file(dated, files)
    free = nearest_file(dated, files.join(links.select("name").distinct(), "name", "left_anti"))
    chosen = near.join(free.select("doc_id", F.col("name").alias("free_name")), "doc_id", "left").select(
        "doc_id", F.when(F.col("delta") > window_seconds, F.coalesce("free_name", "name")).otherwise(F.col("name")).alias("name"))
    oldest = files.agg(F.min(F.struct("mtime", "name")).getField("name").alias("name"))
    undated = open_docs.filter("at IS NULL").select("doc_id", oldest.scalar().alias("name"))
    stored = docs.join(links, "doc_id").select("doc_id", "name", F.lit("stored").alias("source"))
    guessed = chosen.unionByName(undated).withColumn("source", F.lit("heuristic"))
    return stored.unionByName(guessed)


def contained_names(texts: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Longest name contained in each text: ``(key, name)``; ``texts`` has ``(key, norm)``.

    Each name is anchored at its rarest piece, as long as the largest power of two that fits into it; a text meets only
    names whose anchor it contains. Long pieces keep the names of an anchor few, however many names there are.
    """
    n = names.select("name").filter("name <> ''").distinct().withColumn("n", norm_question(F.col("name"))).filter("n <> ''")
    size = F.coalesce(*[F.when(F.length("n") >= k, k) for k in PIECE_SIZES])
    used = {r.size: r["count"] for r in n.groupBy(size.alias("size")).count().collect()}
    # Pieces travel as fingerprints; the texts decide afterwards.
    cut = lambda text, k: F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.xxhash64(F.substring(text, i, k))))
    pieces = n.withColumn("piece", F.explode(cut(F.col("n"), size)))
    df = pieces.groupBy("piece").agg(F.count("*").alias("df"))
    anchors = grown_join(pieces, df, "piece").groupBy("name", "n").agg(F.min(F.struct("df", "piece")).getField("piece").alias("piece"))
    none = F.array().cast("array<bigint>")
    cuts = [F.when(F.length("norm") >= k, cut(F.col("norm"), F.lit(k))).otherwise(none) for k in sorted(used)]
    probes = texts.select(key, F.explode(F.array_distinct(F.concat(none, *cuts))).alias("piece"))
    few = sum(used.values()) <= FEW_NAMES
    met = (probes.join(F.broadcast(anchors), "piece") if few else grown_join(probes, anchors, "piece")).select(key, "name", "n")
    hits = grown_join(met, texts.select(key, "norm"), key).filter(F.contains("norm", "n"))
    return hits.groupBy(key).agg(F.min_by("name", F.struct((-F.length("name")).alias("l"), "name")).alias("name"))
