"""Registered queries on tokens, lines, pages, frames, and on number and date texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone.catalog import query
from turnstone.functions import numbers as N, text as T
from turnstone.functions.plates import plate_vote_key
from turnstone.operators import docextract as X, layout as L, video as V
from turnstone.plans.access_sql import PLATE
from turnstone.plans.catalog_documents import ANCHOR, docs
from turnstone.plans.document_sql import sql
from turnstone.sources.access import AccessTables
from turnstone.sources.documents import DocumentTables

CX, CY = "(x0 + x1) / 2.0", "(y0 + y1) / 2.0"

# -- lines -------------------------------------------------------------------------------------------
docs("flt_token_conf", "SELECT * FROM tokens WHERE trim(text) <> '' AND conf >= 35")(lambda t: L.reliable(t.tokens))
ENTRIES = """entries AS (SELECT doc_id, page, line_no * 1000 + pos AS seq, CASE WHEN pos = 3 THEN ' ' ELSE text END AS text, block_num, par_num, line_num FROM tokens)"""


def entries(t):
    return t.tokens.select("doc_id", "page", (F.col("line_no") * 1000 + F.col("pos")).alias("seq"),
                           F.when(F.col("pos") == 3, " ").otherwise(F.col("text")).alias("text"), "block_num", "par_num", "line_num")


docs("win_line_ids", """SELECT e.doc_id, e.page, e.seq, e.text, dense_rank() OVER (PARTITION BY e.doc_id, e.page ORDER BY f.first) AS line_id
  FROM (SELECT * FROM entries WHERE trim(text) <> '') e JOIN (SELECT doc_id, page, block_num, par_num, line_num, min(seq) AS first FROM entries WHERE trim(text) <> '' GROUP BY ALL) f
  USING (doc_id, page, block_num, par_num, line_num)""", ENTRIES)(
    lambda t: L.line_ids(entries(t)).select("doc_id", "page", "seq", "text", "line_id"))
docs("win_group_tokens_line", f"""SELECT doc_id, page, line_id, string_agg(text, ' ' ORDER BY x0, pos) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
  round(avg({CY}), 6) AS y_center FROM tokens GROUP BY 1, 2, 3""")(
    lambda t: L.lines_on_pages(t.token_lines).withColumn("y_center", F.round("y_center", 6)))
WHOLE = "SELECT doc_id, page, text FROM lines WHERE kind = 'invoice'"


def _clustered(rows):
    words = F.array_sort(F.collect_list(F.struct("x0", "pos", "text")))
    return rows.groupBy("doc_id", "page", "band", "cluster").agg(
        F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("text")).select("doc_id", "page", "text")


docs("win_cluster_y_mean", WHOLE)(lambda t: _clustered(L.cluster_by_mean(t.tokens)))
docs("win_cluster_y_pair", WHOLE)(lambda t: L.pair_lines_on_pages(t.token_pages))
_N = "lower(regexp_replace(text, '\\s+', '', 'g'))"
SLOT = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains({_N}, '{w}')" for w in words) + f" THEN '{slot}'" for slot, words in L.HEADER_WORDS.items()) + " END"
HEADER = f"""tk AS (SELECT * REPLACE (CASE WHEN line_no = 7 THEN 90 ELSE conf END AS conf) FROM tokens),
good AS (SELECT * FROM tk WHERE conf >= 35 AND trim(text) <> ''),
sl AS (SELECT doc_id, page, line_id, slot, arg_min({CX}, x0 * 1000 + pos) AS x FROM (SELECT *, {SLOT} AS slot FROM good) WHERE slot IS NOT NULL GROUP BY ALL),
hl AS (SELECT doc_id, page, line_id, count(*) AS n, max(x) FILTER (slot = 'description') AS a0, max(x) FILTER (slot = 'quantity') AS a1,
  max(x) FILTER (slot = 'unit_price') AS a2, max(x) FILTER (slot = 'line_total') AS a3 FROM sl GROUP BY ALL HAVING count(*) >= 2),
head AS (SELECT * FROM hl QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, line_id) = 1),
qs AS (SELECT doc_id, page, quantile_cont({CX}, [0.2, 0.45, 0.7, 0.9]) AS q FROM good GROUP BY ALL),
c0 AS (SELECT h.doc_id, h.page, h.line_id, coalesce(a0, q[1]) AS c0, coalesce(a1, q[2]) AS r1, coalesce(a2, q[3]) AS r2, coalesce(a3, q[4]) AS r3 FROM head h JOIN qs USING (doc_id, page)),
c1 AS (SELECT *, CASE WHEN r1 <= c0 THEN c0 + 20 ELSE r1 END AS c1 FROM c0), c2 AS (SELECT *, CASE WHEN r2 <= c1 THEN c1 + 20 ELSE r2 END AS c2 FROM c1),
cols AS (SELECT doc_id, page, line_id, c0, c1, c2, CASE WHEN r3 <= c2 THEN c2 + 20 ELSE r3 END AS c3 FROM c2)"""


def good(t):
    return t.tokens.withColumn("conf", F.when(F.col("line_no") == 7, 90).otherwise(F.col("conf")))


docs("win_header_line", "SELECT doc_id, page, line_id AS header_line, a0, a1, a2, a3 FROM head", HEADER)(
    lambda t: L.header_lines(L.reliable(good(t))).select("doc_id", "page", "header_line", *[
        F.try_element_at("anchors", F.lit(s)).alias(f"a{i}") for i, s in enumerate(L.SLOTS)]))
docs("win_column_ranges", "SELECT doc_id, page, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2, round(c3, 6) AS c3, 'header' AS method FROM cols", HEADER)(
    lambda t: L.column_centres(L.reliable(good(t))).select("doc_id", "page", *[F.round(f"c{i}", 6).alias(f"c{i}") for i in range(4)], "method"))
_ONES = "translate({c}, 'Iil|', '1111')"
_ZERO = "CASE WHEN regexp_matches({c}, '\\d') THEN translate({c}, 'Oo', '00') ELSE {c} END"
CELLS = f"""cells AS (SELECT g.doc_id, g.page, g.line_id,
    {", ".join(f"coalesce(string_agg(text, ' ' ORDER BY x0, pos) FILTER (col = {i}), '') AS t{i}" for i in range(4))}
  FROM (SELECT g.*, c.line_id AS hline, CASE WHEN {CX} < (c0 + c1) / 2 THEN 0 WHEN {CX} < (c1 + c2) / 2 THEN 1 WHEN {CX} < (c2 + c3) / 2 THEN 2 ELSE 3 END AS col
    FROM good g JOIN cols c USING (doc_id, page)) g WHERE g.line_id > g.hline GROUP BY ALL),
fixed AS (SELECT *, {_ONES.format(c='(' + _ZERO.format(c='t1') + ')')} AS f1,
  {", ".join(f"CASE WHEN regexp_full_match(z{i}, '[0-9Iil|.,\\- ]+') THEN {_ONES.format(c=f'z{i}')} ELSE z{i} END AS f{i}" for i in (2, 3))}
  FROM (SELECT *, {", ".join(f"{_ZERO.format(c=f't{i}')} AS z{i}" for i in (2, 3))} FROM cells)),
money AS (SELECT *, {", ".join(f"regexp_replace(f{i}, '[^0-9,.\\-]', '', 'g') AS m{i}" for i in (2, 3))} FROM fixed),
trows AS (SELECT doc_id, page, line_id, t0 AS description,
  coalesce(nullif(regexp_extract(replace(f1, ' ', ''), '(-?\\d+)', 1), '')::BIGINT::VARCHAR, f1) AS quantity,
  {", ".join(f"CASE WHEN m{i} = '' THEN f{i} ELSE coalesce(printf('%.2f', try_cast(CASE WHEN len(string_split(m{i}, '.')) > 2 THEN replace(left(m{i}, length(m{i}) - strpos(reverse(m{i}), '.')), '.', '') || '.' || string_split(m{i}, '.')[-1] ELSE m{i} END AS DOUBLE)), f{i}) END AS {n}" for i, n in ((2, 'unit_price'), (3, 'line_total')))} FROM money)"""
docs("win_table_rows", f"SELECT * FROM trows WHERE (description <> '' OR unit_price <> '' OR line_total <> '') AND ({SLOT.replace('text', 'description')}) IS NULL", HEADER, CELLS)(
    lambda t: L.table_rows(good(t)))
docs("win_line_offset", """SELECT doc_id, line_no, pos, pg AS page, lid + coalesce(off, 0)::BIGINT AS line_id FROM (SELECT *, line_no // 8 + 1 AS pg, line_no % 8 + 1 AS lid FROM tokens) k
  LEFT JOIN (SELECT doc_id, pg, sum(m + 1) OVER (PARTITION BY doc_id ORDER BY pg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS off
    FROM (SELECT doc_id, line_no // 8 + 1 AS pg, max(line_no % 8 + 1) AS m FROM tokens GROUP BY ALL)) USING (doc_id, pg)""")(
    lambda t: L.line_offsets(t.tokens.withColumn("page", (F.col("line_no") / 8).cast("int") + 1).withColumn(
        "line_id", (F.col("line_no") % 8 + 1).cast("bigint"))).select("doc_id", "line_no", "pos", "page", "line_id"))
BLOCKS = """gaps AS (SELECT *, CASE WHEN lead(y0) OVER w IS NULL THEN 999 ELSE greatest(0, lead(y0) OVER w - y1) END AS nx, CASE WHEN lag(y1) OVER w IS NULL THEN 999 ELSE greatest(0, y0 - lag(y1) OVER w) END AS pv FROM lines WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0)),
ti AS (SELECT *, length(trim(text)) <= 60 AND ((regexp_matches(text, '\\pL') AND upper(trim(text)) = trim(text)) OR contains(text, ':') OR pv >= 18 OR nx >= 18) AS title FROM gaps),
bl AS (SELECT *, sum(CASE WHEN title OR pv > 12 OR coalesce(pt, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, x0)::BIGINT AS block
  FROM (SELECT *, lag(title) OVER (PARTITION BY doc_id, page ORDER BY y0, x0) AS pt FROM ti))"""
docs("win_paragraph_blocks", """SELECT doc_id, page, block, CASE WHEN bool_or(title) THEN 'title' ELSE 'paragraph' END AS kind, min(y0) AS y, max(y1) AS y_bottom,
  string_agg(trim(text), ' ' ORDER BY y0, x0) AS text FROM bl GROUP BY 1, 2, 3""", BLOCKS)(lambda t: L.blocks_on_pages(t.pages))
docs("win_two_columns", """SELECT doc_id, page, n >= 8 AND hi - lo >= 180 AND nl >= 3 AND n - nl >= 3 AS two_columns, CASE WHEN n >= 8 AND hi - lo >= 180 AND nl >= 3 AND n - nl >= 3 THEN m ELSE 0.0 END AS split_x
  FROM (SELECT doc_id, page, len(xs) AS n, xs[1] AS lo, xs[-1] AS hi, xs[len(xs) // 2 + 1] AS m, len(list_filter(xs, lambda x: x <= xs[len(xs) // 2 + 1])) AS nl
    FROM (SELECT doc_id, 1 AS page, list_sort(flatten(list([20.0, 200.0]))) AS xs FROM lines WHERE contains(text, ': ') GROUP BY 1))""")(
    lambda t: L.two_columns(t.split_lines))
docs("win_next_line", "SELECT doc_id, o_custkey || ' rue' AS after_label FROM inv")(
    lambda t: X.prepare(t.invoices).select("doc_id", F.regexp_extract(F.coalesce(X.next_line(["ATLAS FOURNITURES"]), F.lit("")), r"(\d+ rue)", 1).alias("after_label")))
docs("win_after_colon", "SELECT doc_id, value FROM (SELECT doc_id, reference AS value FROM inv UNION ALL SELECT doc_id, 'STM-2024-' || printf('%06d', k % 1000000) FROM stm UNION ALL SELECT doc_id, 'TXN-2024-' || printf('%06d', k % 1000000) FROM rec UNION ALL SELECT doc_id, 'TRF-2024-' || printf('%06d', k % 1000000) FROM wir)")(
    lambda t: X.prepare(t.ocr).select("doc_id", X.after_colon(["Reference"]).alias("value")))
docs("win_block_between", "SELECT doc_id, line_no - 8 AS pos, text AS line FROM lines WHERE kind = 'invoice' AND line_no BETWEEN 8 AND 9")(
    lambda t: X.prepare(t.invoices).select("doc_id", F.posexplode(X.block(*X.ITEM_BLOCK)).alias("pos", "line")))

# -- quality, pages ------------------------------------------------------------------------------------
PASSES = """passes AS (SELECT doc_id, page, 'psm6' AS pass, conf, CASE WHEN pos = 5 THEN '' ELSE text END AS text FROM tokens
  UNION ALL SELECT doc_id, page, 'psm4', (conf * 3) % 100, CASE WHEN pos = 2 THEN '' ELSE text END FROM tokens),
pq AS (SELECT doc_id, page, pass, count(*) FILTER (trim(text) <> '') AS token_count, avg(conf) FILTER (trim(text) <> '') AS mean_conf,
  count(*) FILTER (trim(text) <> '' AND conf < 50) / count(*) FILTER (trim(text) <> '') AS low_conf_ratio, count(*) FILTER (trim(text) = '') / count(*) AS empty_ratio FROM passes GROUP BY ALL)"""


def passes(t):
    k = t.tokens
    blank = lambda p: F.when(F.col("pos") == p, "").otherwise(F.col("text")).alias("text")
    return k.select("doc_id", "page", F.lit("psm6").alias("pass"), "conf", blank(5)).unionByName(
        k.select("doc_id", "page", F.lit("psm4").alias("pass"), ((F.col("conf") * 3) % 100).alias("conf"), blank(2)))


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


docs("agg_pass_quality", """SELECT doc_id, page, pass, token_count, round(mean_conf, 6) AS mean_conf, round(low_conf_ratio, 6) AS low_conf_ratio, round(empty_ratio, 6) AS empty_ratio,
  round(mean_conf - 25 * empty_ratio - 10 * low_conf_ratio, 6) AS score FROM pq""", PASSES)(
    lambda t: _r(L.pass_quality(passes(t)), "mean_conf", "low_conf_ratio", "empty_ratio", "score"))
docs("agg_merge_page_quality", """SELECT doc_id, round(sum(mean_conf * token_count) / sum(token_count), 3) AS mean_conf, round(sum(low_conf_ratio * token_count) / sum(token_count), 4) AS low_conf_ratio,
  round(avg(token_count / 100.0), 3) AS deskew_angle FROM pq GROUP BY 1""", PASSES)(
    lambda t: L.merge_quality(L.pass_quality(passes(t)).withColumn("deskew_angle", F.col("token_count") / 100)))
SCORE = """0.2 * length(regexp_replace(text, '[\\pC\\n\\t\\r]', '', 'g')) + 0.8 * length(regexp_replace(text, '[^\\pL\\pN]', '', 'g'))
  + 4 * len(regexp_extract_all(text, '[A-Za-z0-9]{2,}')) - 2 * len(regexp_extract_all(text, '[<>\\[\\]{}|\\\\^~`]'))"""
query("win_best_candidate", f"""SELECT conv_id, text, round(({SCORE})::DOUBLE, 4) AS score, turn FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY round(({SCORE})::DOUBLE, 4) DESC, turn) = 1""")(
    lambda spark, d: L.best_candidate(DocumentTables(spark, d).read("conversations").withColumn(
        "score", F.round(T.score_ocr_text(F.col("text")), 4)), ["conv_id"], "text", "score", "turn"))
query("doc_text_kind", """SELECT conv_id AS doc_id, sum(CASE WHEN turn < 2 THEN length(trim(text)) ELSE 0 END)::BIGINT AS chars, count(*) AS page_count,
  CASE WHEN sum(CASE WHEN turn < 2 THEN length(trim(text)) ELSE 0 END) >= 50 THEN 'native' ELSE 'scan' END AS kind FROM conversations GROUP BY 1""")(
    lambda spark, d: L.text_kind(DocumentTables(spark, d).read("conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), "text")))
docs("doc_lines_normalize", """SELECT doc_id, line_no, trim(text) AS text, CASE WHEN line_no = 3 THEN 0.0 ELSE y0 END AS y0, 1 AS page,
  CASE WHEN line_no % 3 = 0 THEN 1.0 ELSE least(1.0, line_no / 10.0) END::DOUBLE AS confidence FROM lines""")(
    lambda t: L.normalize_lines(t.lines.select(
        "doc_id", "line_no", F.concat(F.lit("  "), "text", F.lit(" ")).alias("text"),
        F.when(F.col("line_no") == 3, F.array(F.lit("1"))).otherwise(F.array(*[F.col(c).cast("string") for c in ("x0", "y0", "x1", "y1")])).alias("bbox"),
        F.when(F.col("line_no") == 4, "first").otherwise("1").alias("page"),
        F.when(F.col("line_no") % 3 == 0, "bad").otherwise((F.col("line_no") / 10).cast("string")).alias("confidence"))).select(
        "doc_id", "line_no", "text", F.get("bbox", F.lit(1)).alias("y0"), "page", "confidence"))
docs("agg_anchor_frequency", f"""SELECT kind AS doc_type, label, count(DISTINCT doc_id) AS docs FROM (
    SELECT kind, doc_id, trim(regexp_replace(string_split(line, ':')[1], '\\s+', ' ', 'g')) AS label FROM (SELECT kind, doc_id, text AS line FROM lines) WHERE {ANCHOR}) l
  JOIN (SELECT kind, ceil(0.6 * count(*)) AS need FROM ocr GROUP BY 1) n USING (kind) WHERE label <> '' GROUP BY 1, 2, need HAVING count(DISTINCT doc_id) >= need""")(
    lambda t: L.anchor_frequency(t.ocr.withColumnRenamed("kind", "doc_type")))

# -- video ---------------------------------------------------------------------------------------------
RAW = f"""CASE WHEN value < 1 THEN '' WHEN event_type = 'view' THEN lower({PLATE.format(k='user_id')}) WHEN event_type = 'click' THEN ' ' || replace({PLATE.format(k='user_id')}, '-', ' - ')
  WHEN event_type = 'error' THEN replace({PLATE.format(k='user_id')}, '-', '|') WHEN event_type = 'signup' THEN chr(8294) || replace({PLATE.format(k='user_id')}, '-', chr(8211)) ELSE {PLATE.format(k='user_id')} END"""
FRAMES = f"""frames AS (SELECT user_id AS video_id, event_id AS frame_index, trim({RAW}) AS plate_text, value / 100.0 AS conf FROM events),
fs AS (SELECT *, replace(replace(upper(plate_text), '|', '-'), ' ', '') AS vote_key, regexp_replace(plate_text, '[^0-9A-Za-z]+', '', 'g') AS cl FROM frames WHERE plate_text <> ''),
sc AS (SELECT *, least(1.0, 0.7 * (0.6 * least(length(cl) / 7.0, 1.0) + 0.4) + 0.3 * least(conf, 1.0)) AS score FROM fs),
run AS (SELECT *, count(*) OVER w AS n, avg(score) OVER w AS a FROM sc WINDOW w AS (PARTITION BY video_id, vote_key ORDER BY frame_index)),
stp AS (SELECT video_id, min(frame_index) AS stop FROM run WHERE n >= 2 AND a >= 0.72 GROUP BY 1),
kept AS (SELECT sc.* FROM sc LEFT JOIN stp USING (video_id) WHERE stop IS NULL OR frame_index <= stop),
vt AS (SELECT video_id, vote_key, count(*) AS votes, sum(score) AS total_score, max(score) AS best_score, arg_min(frame_index, (-score, frame_index)) AS best_frame, min(frame_index) AS first_frame FROM kept GROUP BY 1, 2)"""


def frames(t: AccessTables):
    return t.raw_detections.select("event_id", "plate_text").join(
        t.read("events").select("event_id", "user_id", "value"), "event_id").select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_index"), F.trim("plate_text").alias("plate_text"), (F.col("value") / 100).alias("detection_conf"))


def video(key: str, text: str, *more: str):
    return lambda fn: query(key, "WITH " + ", ".join([FRAMES, *more]) + text)(lambda spark, d: fn(AccessTables(spark, d)))


video("win_sample_frames", " SELECT video_id, frame_index % 720 AS frame_index FROM frames WHERE (frame_index % 720) % 12 = 0 AND frame_index % 720 < 360")(
    lambda t: V.sample_frames(frames(t).select("video_id", (F.col("frame_index") % 720).alias("frame_index"))))
video("win_video_early_stop", " SELECT video_id, frame_index, vote_key, round(score, 6) AS score FROM kept")(
    lambda t: V.votes(frames(t)).select("video_id", "frame_index", "vote_key", F.round("score", 6).alias("score")))
video("agg_video_votes", " SELECT video_id, vote_key, votes, round(total_score, 6) AS total_score, round(best_score, 6) AS best_score, best_frame FROM vt")(
    lambda t: _r(V.plate_votes(frames(t)), "total_score", "best_score").drop("first_frame"))
video("win_video_winner", """ SELECT video_id, vote_key, votes, round(total_score / votes, 6) AS avg_score, round(best_score, 6) AS best_score, best_frame FROM vt
  QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY votes DESC, total_score / votes DESC, best_score DESC, first_frame) = 1""")(
    lambda t: _r(V.winner(frames(t)), "avg_score", "best_score"))


@query("win_plate_from_glyphs", """SELECT event_id AS plate_id, printf('%05d', user_id) || CASE WHEN user_id % 8 = 7 THEN 'x' ELSE ' | ' || ['أ','ب','د','ه','و','و','ش'][(user_id % 8 + 1)::INT] || ' | ' END || (user_id % 9 + 1)::VARCHAR AS plate_text FROM events""")
def _glyphs(spark, folder):
    rows = AccessTables(spark, folder).read("events").select("event_id", "user_id")
    names = F.array(*[F.lit(v) for v in ("a", "b", "d", "h", "w", "waw", "ch", "x")])
    digits = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.substring(F.format_string("%05d", "user_id"), i, F.lit(1)))
    labels = F.concat(digits, F.array(F.get(names, (F.col("user_id") % 8).cast("int")), (F.col("user_id") % 9 + 1).cast("string")))
    glyphs = rows.select(F.col("event_id").alias("plate_id"), F.posexplode(labels).alias("pos", "label"))
    return V.plate_from_glyphs(glyphs.select("plate_id", "label", (F.col("pos") * 10).cast("int").alias("x")))


# -- numbers and periods ---------------------------------------------------------------------------------
MONEY_IN = """CASE o_custkey % 4 WHEN 0 THEN replace(printf('%.2f', o_totalprice), '.', ',') || ' EUR' WHEN 1 THEN format('{:,.2f}', o_totalprice)
  WHEN 2 THEN replace(replace(replace(format('{:,.2f}', o_totalprice), ',', '#'), '.', ','), '#', '.') ELSE 'n/a' END"""


def money_in():
    two = F.col("o_totalprice").cast("decimal(20,2)").cast("string")
    grouped = F.format_number("o_totalprice", 2)
    kind = F.col("o_custkey") % 4
    return F.when(kind == 0, F.concat(F.replace(two, F.lit("."), F.lit(",")), F.lit(" EUR"))).when(kind == 1, grouped).when(
        kind == 2, F.translate(grouped, ",.", ".,")).otherwise("n/a")


def orders(key: str, text: str):
    return lambda fn: query(key, text)(lambda spark, d: fn(DocumentTables(spark, d).read("orders")))


orders("fn_money", "SELECT o_orderkey, CASE WHEN o_custkey % 4 = 3 THEN '' ELSE printf('%.2f', o_totalprice) END AS money FROM orders")(
    lambda o: o.select("o_orderkey", N.money(money_in()).alias("money")))
orders("fn_to_number", "SELECT o_orderkey, o_totalprice AS number FROM orders")(
    lambda o: o.select("o_orderkey", N.to_number(F.concat(F.lit("Total : "), F.replace(F.col("o_totalprice").cast("decimal(20,2)").cast("string"), F.lit("."), F.lit(",")), F.lit(" MAD"))).alias("number")))
orders("fn_quantity", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 2 THEN '1' ELSE (o_orderkey % 100)::VARCHAR END AS quantity FROM orders")(
    lambda o: o.select("o_orderkey", N.quantity(F.when(F.col("o_custkey") % 3 == 2, "e").otherwise(
        F.translate((F.col("o_orderkey") % 100).cast("string"), "10", "lO"))).alias("quantity")))
orders("fn_clamp_conf", "SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 1.0 ELSE least(1.0, o_totalprice / 400000) END AS conf FROM orders")(
    lambda o: o.select("o_orderkey", N.clamp_confidence(F.when(F.col("o_custkey") % 5 == 0, "bad").otherwise(
        (F.col("o_totalprice") / 400000).cast("string"))).alias("conf")))
from turnstone.functions import dates as D  # noqa: E402

orders("fn_parse_date", "SELECT o_orderkey, CASE WHEN o_custkey % 3 < 2 THEN o_orderdate::DATE END AS day FROM orders")(
    lambda o: o.select("o_orderkey", D.parse_date(F.when(F.col("o_custkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(
        F.col("o_custkey") % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.lit("31/02/2024"))).alias("day")))
for _key, _fn, _a, _b in [
    ("fn_week_range", D.week_range, "date_trunc('week', o_orderdate)::DATE", "date_trunc('week', o_orderdate)::DATE + 6"),
    ("fn_month_range", D.month_range, "date_trunc('month', o_orderdate)::DATE", "last_day(o_orderdate)"),
    ("fn_year_range", D.year_range, "date_trunc('year', o_orderdate)::DATE", "make_date(year(o_orderdate), 12, 31)"),
]:
    orders(_key, f"SELECT o_orderkey, {_a} AS start_date, {_b} AS end_date FROM orders")(
        lambda o, fn=_fn: o.select("o_orderkey", fn(F.to_date("o_orderdate")).alias("r")).select("o_orderkey", "r.*"))
