"""Token and line geometry: lines, headers, columns, table rows, blocks, quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from turnstone.constants import MIN_TOKEN_CONF
from turnstone.functions.binding import let
from turnstone.functions.numbers import cell_money, cell_quantity, clamp_confidence
from turnstone.functions.text import to_ascii
from turnstone.operators.shuffled import grown_join

PAGE = ["doc_id", "page"]
# Header words per column, in test order.
HEADER_WORDS = {
    "description": ("description", "designation", "libelle", "article"),
    "quantity": ("quantite", "qte", "qty", "quant"),
    "unit_price": ("prix", "pu", "unitaire", "unit"),
    "line_total": ("total", "montant", "ttc"),
}
SLOTS = tuple(HEADER_WORDS)
QUANTILES = (0.2, 0.45, 0.7, 0.9)


def reliable(tokens: DataFrame) -> DataFrame:
    return tokens.filter((F.trim("text") != "") & (F.col("conf") >= MIN_TOKEN_CONF))


def centre(low: str, high: str) -> Column:
    return (F.col(low) + F.col(high)) / 2.0


def line_ids(entries: DataFrame) -> DataFrame:
    """Numbers (block, paragraph, line) triples of a page by first appearance; blank entries drop out."""
    real = entries.filter(F.trim("text") != "")
    triples = real.groupBy(*PAGE, "block_num", "par_num", "line_num").agg(F.min("seq").alias("first"))
    ranked = triples.withColumn("line_id", F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("first")))
    return grown_join(real, ranked.drop("first"), PAGE + ["block_num", "par_num", "line_num"])


def lines_from_tokens(tokens: DataFrame, key: str = "line_id") -> DataFrame:
    """Lines by id: words in x order, union box, mean y centre."""
    words = F.array_sort(F.collect_list(F.struct("x0", "pos", "text")))
    return tokens.groupBy(*PAGE, key).agg(
        F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.avg(centre("y0", "y1")).alias("y_center"), F.avg("conf").alias("mean_conf"),
    )


def lines_on_pages(rows: DataFrame, key: str = "line_id") -> DataFrame:
    """``lines_from_tokens`` where a row already holds the ``words`` of its line: nothing is shuffled."""
    each = lambda c: F.transform("words", lambda w: w[c])
    total = F.aggregate("words", F.lit(0.0), lambda a, w: a + (w["y0"] + w["y1"]) / 2.0)
    sorted_words = rows.withColumn("words", F.array_sort("words"))  # x0 and pos come first
    return sorted_words.select(
        *PAGE, key, F.array_join(each("text"), " ").alias("text"), F.array_min(each("x0")).alias("x0"), F.array_min(each("y0")).alias("y0"),
        F.array_max(each("x1")).alias("x1"), F.array_max(each("y1")).alias("y1"), (total / F.size("words")).alias("y_center"))


def _parts(items: str, starts: str) -> Column:
    """Cuts an array at ascending 0-based places, the first of which is 0."""
    return F.transform(starts, lambda at, k: F.slice(items, at + 1, F.coalesce(F.get(starts, k + 1), F.size(items)) - at))


def _places(items: str, cond) -> Column:
    """0-based places of an array that meet ``cond(item, place)``."""
    return F.filter(F.transform(items, lambda x, i: F.when(cond(x, i), i)), lambda i: i.isNotNull())


def _bands(items: DataFrame, y: Column, gap: Column, order: list[str]) -> DataFrame:
    """Cuts a page where the next item is farther than any tolerance: no line crosses a cut.

    The window streams a page through one sort; only the items of one band are ever collected.
    """
    w = Window.partitionBy(*PAGE).orderBy("y", *order)
    rows = items.withColumn("y", y)
    rows = rows.withColumn("_new", F.coalesce((F.col("y") - F.lag("y").over(w) > gap).cast("int"), F.lit(1)))
    return rows.withColumn("band", F.sum("_new").over(w)).drop("_new")


def _cluster(items: DataFrame, tolerance: Column, running_mean: bool, order: list[str], out: list[str]) -> DataFrame:
    """Sequential clustering by y inside each band; returns items with ``cluster`` (per page order)."""
    listed = items.withColumn("tol", tolerance).groupBy(*PAGE, "band").agg(
        F.array_sort(F.collect_list(F.struct("y", *order, *out, "tol"))).alias("items"))
    placed = listed.withColumn("at", _placed(running_mean))
    zipped = placed.select(*PAGE, "band", F.explode(F.arrays_zip("items", "at")).alias("z"))
    return zipped.select(*PAGE, "band", F.col("z.at").alias("cluster"), *[F.col(f"z.items.{c}").alias(c) for c in ["y", *order, *out]])


def _placed(running_mean: bool) -> Column:
    """The cluster of each of a band's ``items``, in their order."""
    empty = F.from_json(F.lit('{"c":[],"at":[]}'), "struct<c:array<struct<y:double,n:int>>,at:array<int>>")

    def place(acc, item):
        hits = F.filter(F.sequence(F.lit(1), F.size(acc["c"])), lambda i: F.abs(item["y"] - F.element_at(acc["c"], i)["y"]) <= item["tol"])
        hit = F.when(F.size(acc["c"]) > 0, F.get(hits, F.lit(0)))
        moved = F.transform(acc["c"], lambda c, i: F.when(i + 1 == hit, F.struct(
            ((c["y"] * c["n"] + item["y"]) / (c["n"] + 1) if running_mean else (c["y"] + item["y"]) / 2.0).alias("y"),
            (c["n"] + 1).cast("int").alias("n"))).otherwise(c))
        fresh = F.array_append(acc["c"], F.struct(item["y"].cast("double").alias("y"), F.lit(1).alias("n")))
        return F.struct(
            F.when(hit.isNull(), fresh).otherwise(moved).alias("c"),
            F.array_append(acc["at"], F.coalesce(hit, F.size(acc["c"]) + 1).cast("int")).alias("at"))

    return F.aggregate("items", empty, place).getField("at")


def cluster_by_mean(tokens: DataFrame) -> DataFrame:
    """Lines by running mean of y centres; tolerance from the page's median token height."""
    # The median rides on the page's partition, which the bands need anyway.
    height = F.percentile(F.col("y1") - F.col("y0"), F.lit(0.5)).over(Window.partitionBy(*PAGE))
    rows = tokens.withColumn("h", height).withColumn("t", F.greatest(F.lit(10), F.least(F.lit(24), (F.col("h") * 0.8).cast("int"))))
    rows = _bands(rows, centre("y0", "y1"), F.col("t"), ["line_no", "pos"])
    return _cluster(rows, F.col("t").cast("double"), True, ["line_no", "pos"], ["text", "x0"])


def cluster_by_pairs(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Words to lines: tops within the tolerance, the line's top moving half way to each newcomer."""
    rows = _bands(words, F.col("y0").cast("double"), F.lit(tolerance), ["x0", "line_no", "pos"])
    return _cluster(rows, F.lit(tolerance), False, ["x0", "line_no", "pos"], ["text"])


def pair_lines_on_pages(pages: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Texts of the lines of ``cluster_by_pairs`` where a row already holds the ``words`` of its page: nothing is shuffled."""
    rows = pages.select(*PAGE, F.array_sort("words").alias("words"))  # y, x0, line_no, pos come first
    far = lambda w, i: (i == 0) | (w["y"] - F.get("words", i - 1)["y"] > tolerance)
    bands = rows.withColumn("starts", _places("words", far)).select(*PAGE, F.explode(_parts("words", "starts")).alias("items"))
    bands = bands.withColumn("items", F.transform("items", lambda w: w.withField("tol", F.lit(tolerance))))
    # A cluster's top stays among its words, so words no farther apart than the tolerance are one cluster.
    flat = F.element_at("items", -1)["y"] - F.get("items", F.lit(0))["y"] <= tolerance
    placed = bands.withColumn("at", F.when(flat, F.array_repeat(F.lit(1), F.size("items"))).otherwise(_placed(False)))
    # Clusters are few: they differ by more than the tolerance inside one band.
    members = lambda c: F.array_sort(F.transform(
        F.filter(F.arrays_zip("items", "at"), lambda z: z["at"] == c),
        lambda z: F.struct(z["items"]["x0"].alias("x0"), z["items"]["pos"].alias("pos"), z["items"]["text"].alias("text"))))
    texts = F.transform(F.array_distinct("at"), lambda c: F.array_join(F.transform(members(c), lambda w: w["text"]), " "))
    return placed.select(*PAGE, F.explode(texts).alias("text"))


def header_slot(text: Column) -> Column:
    def find(norm: Column) -> Column:
        slot = None
        for name, words in HEADER_WORDS.items():
            cond = F.lit(False)
            for word in words:
                cond = cond | norm.contains(word)
            slot = (F if slot is None else slot).when(cond, name)
        return F.when(norm != "", slot)

    return let(F.lower(F.regexp_replace(to_ascii(text), r"\s+", "")), find)


def header_lines(tokens: DataFrame) -> DataFrame:
    """Per page the first line with most distinct header slots (two or more) and its anchors."""
    hits = tokens.withColumn("slot", header_slot(F.col("text"))).filter("slot IS NOT NULL")
    first = hits.groupBy(*PAGE, "line_id", "slot").agg(F.min_by(centre("x0", "x1"), F.struct("x0", "pos")).alias("x"))
    lines = first.groupBy(*PAGE, "line_id").agg(
        F.count("*").alias("n"), F.map_from_entries(F.collect_list(F.struct("slot", "x"))).alias("anchors"))  # four slots at most
    order = tokens.groupBy(*PAGE, "line_id").agg(F.avg(centre("y0", "y1")).alias("y_center"))
    lines = grown_join(lines.filter("n >= 2"), order, PAGE + ["line_id"])
    best = F.min_by(F.struct("line_id", "y_center", "anchors"), F.struct((-F.col("n")).alias("n"), "y_center", "line_id"))
    return lines.groupBy(*PAGE).agg(best.alias("h")).select(
        *PAGE, F.col("h.line_id").alias("header_line"), F.col("h.y_center").alias("header_y"), F.col("h.anchors").alias("anchors"))


def _centres(pdf: pd.DataFrame) -> pd.DataFrame:
    """1-D k-means of one page from distinct positions with counts."""
    x, n = pdf["x"].to_numpy(float), pdf["n"].to_numpy(float)
    order = np.argsort(x)
    x, n = x[order], n[order]
    total = np.cumsum(n)

    def quantile(q: float) -> float:
        at = q * (total[-1] - 1)
        low, high = np.searchsorted(total, [np.floor(at), np.ceil(at)], side="right")
        return float(x[low] + (x[high] - x[low]) * (at - np.floor(at)))

    method = "kmeans"
    if len(x) < 4:
        centres, method = np.array([quantile(q) for q in QUANTILES]), "quantile"
    elif len(x) == 4:
        centres = x
    else:
        centres = np.array([quantile(q) for q in np.linspace(0, 1, 6)[1:-1]])
        for _ in range(40):
            near = np.abs(x[:, None] - centres[None, :]).argmin(axis=1)
            weight = np.bincount(near, n, 4)
            moved = np.where(weight > 0, np.bincount(near, n * x, 4) / np.maximum(weight, 1), centres)
            done = np.allclose(moved, centres, atol=0.1)
            centres = moved
            if done:
                break
        centres = np.sort(centres)
    out = pdf[PAGE].iloc[:1].copy()
    for i, value in enumerate(centres):
        out[f"c{i}"] = float(value)
    return out.assign(method=method)


def column_centres(tokens: DataFrame) -> DataFrame:
    """Four column centres per page, from the header where there is one, else by clustering; with the header's line and y."""
    heads = header_lines(tokens)
    spread = tokens.groupBy(*PAGE).agg(
        F.percentile(centre("x0", "x1"), F.array(*[F.lit(q) for q in QUANTILES])).alias("q"))
    rows = grown_join(heads, spread, PAGE)
    cols, last = [], None
    for i, slot in enumerate(SLOTS):
        x = F.coalesce(F.try_element_at("anchors", F.lit(slot)), F.get("q", F.lit(i)))
        rows = rows.withColumn(f"c{i}", x if i == 0 else F.when(x <= F.col(f"c{i - 1}"), F.col(f"c{i - 1}") + 20.0).otherwise(x))
        cols.append(f"c{i}")
    with_header = rows.select(*PAGE, *cols, F.lit("header").alias("method"), "header_line", "header_y")
    rest = grown_join(tokens, heads.select(*PAGE), PAGE, "left_anti")
    # Equal positions are counted first, so a page sends its distinct positions only.
    seen = rest.groupBy(*PAGE, centre("x0", "x1").alias("x")).agg(F.count("*").alias("n"))
    kinds = "doc_id bigint, page int, c0 double, c1 double, c2 double, c3 double, method string"
    return with_header.unionByName(seen.groupBy(*PAGE).applyInPandas(_centres, kinds), allowMissingColumns=True)


def table_rows(tokens: DataFrame) -> DataFrame:
    """Rows of the table below the header: text per column, repaired numbers, header-like rows out."""
    good = reliable(tokens)
    ranges = column_centres(good).select(
        *PAGE, "header_line", "header_y", *[((F.col(f"c{i}") + F.col(f"c{i + 1}")) / 2.0).alias(f"b{i}") for i in range(3)])
    x = centre("x0", "x1")
    col = F.when(x < F.col("b0"), 0).when(x < F.col("b1"), 1).when(x < F.col("b2"), 2).otherwise(3)
    rows = grown_join(good, ranges, PAGE).withColumn("col", col)
    text = lambda i: F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(F.col("col") == i, F.struct("x0", "pos", "text")))), lambda w: w["text"]), " ")
    lines = rows.groupBy(*PAGE, "line_id").agg(
        F.avg(centre("y0", "y1")).alias("y_center"), F.first("header_y").alias("header_y"), F.first("header_line").alias("header_line"),
        *[text(i).alias(f"t{i}") for i in range(4)])
    lines = lines.filter(
        F.col("header_y").isNull() | (F.col("y_center") > F.col("header_y"))
        | ((F.col("y_center") == F.col("header_y")) & (F.col("line_id") > F.col("header_line"))))
    # Blank tests on the raw cells: a cell is blank after repair exactly where its text is blank.
    filled = (F.col("t0") != "") | (F.trim("t2") != "") | (F.trim("t3") != "")
    lines = lines.filter(filled & header_slot(F.col("t0")).isNull())
    return lines.select(*PAGE, "line_id", F.col("t0").alias("description"), cell_quantity(F.col("t1")).alias("quantity"),
                        cell_money(F.col("t2")).alias("unit_price"), cell_money(F.col("t3")).alias("line_total"))


def line_offsets(tokens: DataFrame) -> DataFrame:
    """Line ids made unique across the pages of a document by a running offset."""
    pages = tokens.groupBy(*PAGE).agg(F.max("line_id").alias("m"))
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    # Offsets grow by (largest id + 1) per page, which is what taking the running maximum gives.
    offsets = pages.withColumn("offset", F.coalesce(F.sum(F.col("m") + 1).over(before), F.lit(0))).drop("m")
    return grown_join(tokens, offsets, PAGE).withColumn("line_id", F.col("line_id") + F.col("offset")).drop("offset")


def paragraph_blocks(lines: DataFrame) -> DataFrame:
    """Titles and paragraphs of a page from gaps between lines in (y, x) order."""
    w = Window.partitionBy(*PAGE).orderBy("y0", "x0", "line_no")
    # No neighbour counts as a wide gap; greatest() alone would skip the null.
    gap = lambda a, b: F.when((a - b).isNull(), 999.0).otherwise(F.greatest(F.lit(0.0), a - b))
    rows = lines.withColumn("_next", gap(F.lead("y0").over(w), F.col("y1")))
    rows = rows.withColumn("text", F.trim("text")).filter("text <> ''")
    rows = rows.withColumn("_prev", gap(F.col("y0"), F.lag("y1").over(w)))
    text = F.col("text")
    shouted = text.rlike(r"\p{L}") & (F.upper(text) == text)
    title = (F.length(text) <= 60) & (shouted | text.contains(":") | (F.col("_prev") >= 18) | (F.col("_next") >= 18))
    rows = rows.withColumn("title", title)
    starts = F.col("title") | (F.col("_prev") > 12) | F.coalesce(F.lag("title").over(w), F.lit(True))
    rows = rows.withColumn("block", F.sum(starts.cast("int")).over(w))
    body = F.array_sort(F.collect_list(F.struct("y0", "x0", "line_no", "text")))
    return rows.groupBy(*PAGE, "block").agg(
        F.when(F.bool_or("title"), "title").otherwise("paragraph").alias("kind"), F.min("y0").alias("y"),
        F.max("y1").alias("y_bottom"), F.array_join(F.transform(body, lambda b: b["text"]), " ").alias("text"))


def blocks_on_pages(pages: DataFrame) -> DataFrame:
    """``paragraph_blocks`` where a row already holds the ``lines`` of its page: nothing is shuffled."""
    # No neighbour counts as a wide gap; greatest() alone would skip the null.
    gap = lambda a, b: F.when((a - b).isNull(), 999.0).otherwise(F.greatest(F.lit(0.0), a - b))
    at = lambda i, c: F.get("lines", i)[c]
    fields = lambda l: [l[c].alias(c) for c in ("y0", "y1", "text")]
    rows = pages.select(*PAGE, F.array_sort("lines").alias("lines"))  # y0, x0, line_no come first
    rows = rows.withColumn("lines", F.transform("lines", lambda l, i: F.struct(
        l["y0"].alias("y0"), l["y1"].alias("y1"), F.trim(l["text"]).alias("text"), gap(at(i + 1, "y0"), l["y1"]).alias("next"))))
    rows = rows.withColumn("lines", F.filter("lines", lambda l: l["text"] != ""))
    rows = rows.withColumn("lines", F.transform("lines", lambda l, i: F.struct(*fields(l), l["next"].alias("next"), gap(l["y0"], at(i - 1, "y1")).alias("prev"))))

    def title(l: Column) -> Column:
        text = l["text"]
        shouted = text.rlike(r"\p{L}") & (F.upper(text) == text)
        return (F.length(text) <= 60) & (shouted | text.contains(":") | (l["prev"] >= 18) | (l["next"] >= 18))

    rows = rows.withColumn("lines", F.transform("lines", lambda l: F.struct(*fields(l), l["prev"].alias("prev"), title(l).alias("title"))))
    starts = _places("lines", lambda l, i: l["title"] | (l["prev"] > 12) | F.coalesce(at(i - 1, "title"), F.lit(True)))
    rows = rows.withColumn("starts", starts).select(*PAGE, F.posexplode(_parts("lines", "starts")).alias("block", "part"))
    each = lambda c: F.transform("part", lambda l: l[c])
    return rows.select(
        *PAGE, (F.col("block") + 1).cast("bigint").alias("block"),
        F.when(F.exists("part", lambda l: l["title"]), "title").otherwise("paragraph").alias("kind"),
        F.array_min(each("y0")).alias("y"), F.array_max(each("y1")).alias("y_bottom"), F.array_join(each("text"), " ").alias("text"))


def two_columns(lines: DataFrame) -> DataFrame:
    """Pages with text in two columns and the x that divides them."""
    counts = lines.groupBy(*PAGE, "x0").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*PAGE).orderBy("x0")
    rows = counts.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*PAGE)))
    half = F.floor(F.col("all") / 2)
    mid = F.min(F.when(F.col("upto") > half, F.struct("x0", "upto"))).alias("mid")
    pages = rows.groupBy(*PAGE).agg(F.first("all").alias("n"), F.min("x0").alias("lo"), F.max("x0").alias("hi"), mid)
    ok = (F.col("n") >= 8) & (F.col("hi") - F.col("lo") >= 180) & (F.col("mid.upto") >= 3) & (F.col("n") - F.col("mid.upto") >= 3)
    return pages.select(*PAGE, ok.alias("two_columns"), F.when(ok, F.col("mid.x0")).otherwise(F.lit(0.0)).alias("split_x"))


def pass_quality(entries: DataFrame) -> DataFrame:
    """Quality of each reading pass of a page."""
    real = F.trim("text") != ""
    conf = F.when(real, F.greatest(F.col("conf"), F.lit(0)))
    rows = entries.groupBy(*PAGE, "pass").agg(
        F.count_if(real).alias("token_count"), F.coalesce(F.avg(conf), F.lit(0.0)).alias("mean_conf"),
        F.coalesce(F.count_if(conf < 50) / F.count_if(real), F.lit(1.0)).alias("low_conf_ratio"),
        (F.count_if(~real) / F.count("*")).alias("empty_ratio"))
    return rows.withColumn("score", F.col("mean_conf") - F.col("empty_ratio") * 25 - F.col("low_conf_ratio") * 10)


def merge_quality(pages: DataFrame) -> DataFrame:
    """Document quality: token-weighted means, plain mean of the angle."""
    w = F.greatest(F.lit(1), F.col("token_count"))
    share = lambda c: F.sum(F.col(c) * w) / F.sum(w)
    return pages.groupBy("doc_id").agg(
        F.round(share("mean_conf"), 3).alias("mean_conf"), F.round(share("low_conf_ratio"), 4).alias("low_conf_ratio"),
        F.round(F.avg("deskew_angle"), 3).alias("deskew_angle"))


def best_candidate(candidates: DataFrame, keys: list[str], text: str, score: str, order: str) -> DataFrame:
    """Best-scored text per key; the first one wins ties."""
    best = F.max_by(F.struct(text, score, order), F.struct(F.col(score), (-F.col(order)).alias("o")))
    return candidates.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def text_kind(pages: DataFrame) -> DataFrame:
    """native where the first two pages hold 50 characters or more, else scan."""
    chars = F.sum(F.when(F.col("page") <= 2, F.length(F.trim("text"))).otherwise(0))
    return pages.groupBy("doc_id").agg(chars.alias("chars"), F.count("*").alias("page_count")).withColumn(
        "kind", F.when(F.col("chars") >= 50, "native").otherwise("scan"))


def normalize_lines(lines: DataFrame) -> DataFrame:
    """Untyped line rows to typed ones: trimmed text, four-number box or zeros, page 1, confidence in [0, 1]."""
    box = F.transform("bbox", lambda v: v.try_cast("double"))
    good = (F.size("bbox") == 4) & ~F.exists(box, lambda v: v.isNull())
    zeros = F.array(*[F.lit(0.0)] * 4)
    return lines.select(
        "doc_id", "line_no", F.trim(F.coalesce("text", F.lit(""))).alias("text"),
        F.when(good, box).otherwise(zeros).alias("bbox"), F.coalesce(F.col("page").try_cast("int"), F.lit(1)).alias("page"),
        clamp_confidence(F.col("confidence")).alias("confidence"))


def tables_with_html(tables: DataFrame) -> DataFrame:
    return tables.withColumn("html", F.trim(F.coalesce("html", F.lit("")))).filter("html <> ''")


def anchor_frequency(docs: DataFrame, share: float = 0.6) -> DataFrame:
    """Anchor labels that occur in at least the given share of a type's documents."""
    from turnstone.functions.text import anchor_name, looks_like_anchor, text_lines

    lines = docs.select("doc_type", "doc_id", F.explode(text_lines(F.col("raw_text"))).alias("line"))
    labels = lines.filter(looks_like_anchor(F.col("line"))).select("doc_type", "doc_id", anchor_name(F.col("line")).alias("label"))
    counts = labels.filter("label <> ''").distinct().groupBy("doc_type", "label").agg(F.count("*").alias("docs"))
    totals = docs.groupBy("doc_type").agg(F.greatest(F.lit(1), F.ceil(F.lit(share) * F.count("*"))).alias("need"))
    return counts.join(totals, "doc_type").filter("docs >= need").drop("need")
