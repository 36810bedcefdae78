"""Findings of round 3."""

import random
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tests.test_access import model
from turnstone.operators import answers as A, dedup, docextract as X, docroute as R, generic_fields as G, layout as L
from turnstone.operators.matching import nearest_file
from turnstone.operators.sessions import LOG_COLUMNS, pair_sessions
from turnstone.operators.templates import BBOX_LABELS
from turnstone.session import run_folder
from turnstone.sources import access
from turnstone.sources.paired_logs import PairedLogs

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_file_reads_a_slot_in_running_frames(spark):
    start = datetime(2024, 1, 1)
    docs = [(i, start + timedelta(seconds=7 * i)) for i in range(1500)]
    files = [(f"f{i}", start + timedelta(seconds=13 * i + 3000)) for i in range(300)]
    found = nearest_file(spark.createDataFrame(docs, "doc_id long, at timestamp_ntz"), spark.createDataFrame(files, "name string, mtime timestamp_ntz"))
    want = {i: min((abs(m - at), m, n) for n, m in files) for i, at in docs}
    assert {r.doc_id: (r.name, r.delta) for r in found.collect()} == {i: (w[2], w[0].total_seconds()) for i, w in want.items()}
    assert "unboundedfollowing" not in _plan(found)


def test_training_reads_texts_written_once_and_dealt_evenly(spark, monkeypatch):
    from turnstone.operators import doctype_model as ML

    seen = []
    monkeypatch.setattr(ML, "pipeline", lambda **limits: type("Seen", (), {"fit": staticmethod(seen.append)}))
    ML.fit(spark.range(4000).repartition(1).selectExpr("id AS doc_id", "'a b' AS text", "'x' AS label"))
    sizes = [r["count"] for r in seen[0].groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) > 4 and max(sizes) < 1000 and "repartition" not in _plan(seen[0]) and "Exchange" not in _plan(seen[0])


def test_votes_ride_on_their_documents(spark):
    from turnstone.operators import doctype_model as ML, docroute as R

    rows = spark.createDataFrame([(1, "facture", "facture total ht tva ttc", "invoice"), (2, "virement", "ordre de virement iban", "wire_transfer")] * 3,
                                 "doc_id long, raw_text string, text string, label string")
    model = ML.pipeline(max_features=50, max_iter=20).fit(rows)
    voted = ML.votes(model, rows.drop("label"))
    joined = R.scores(R.features(rows.limit(2).select("doc_id", "raw_text")), voted.select("doc_id", "ml_type", "ml_conf").distinct())
    assert {r.ml_type for r in voted.collect()} == {"invoice", "wire_transfer"}
    own = R.scores(R.features(voted)).select("doc_id", "score_invoice", "score_wire_transfer").distinct()
    assert sorted(own.collect()) == sorted(joined.select(*own.columns).distinct().collect())


@pytest.mark.parametrize("key", ["win_paragraph_blocks", "win_group_tokens_line", "win_cluster_y_pair"])
def test_pages_are_read_where_they_lie(spark, key):
    assert "Exchange" not in _plan(queries()[key](spark, SMALL))


def test_page_forms_equal_row_forms(spark):
    random.seed(5)
    texts = ["FACTURE", "", "  ", "Total: 5", "une ligne de texte", "x" * 70, "deux mots"]
    lines = [(d, p, n, random.choice(texts), random.choice([20.0, 200.0]), 12.0 * n + random.choice([0, 0, 9, 30]), 12.0 * n + 9)
             for d in range(40) for p in (1, 2) for n in range(random.randint(1, 12))]
    rows = spark.createDataFrame(lines, "doc_id long, page int, line_no int, text string, x0 double, y0 double, y1 double")
    pages = rows.groupBy("doc_id", "page").agg(F.collect_list(F.struct("y0", "x0", "line_no", "text", "y1")).alias("lines"))
    want = L.paragraph_blocks(rows)
    assert sorted(L.blocks_on_pages(pages).select(*want.columns).collect()) == sorted(want.collect())

    words = [(d, 1, n, k, f"w{k}", random.randint(0, 40), random.randint(0, 30)) for d in range(60) for n in range(3) for k in range(4)]
    rows = spark.createDataFrame(words, "doc_id long, page int, line_no int, pos int, text string, x0 int, y0 int")
    pages = rows.groupBy("doc_id", "page").agg(F.collect_list(F.struct(F.col("y0").cast("double").alias("y"), "x0", "line_no", "pos", "text")).alias("words"))
    listed = F.array_sort(F.collect_list(F.struct("x0", "pos", "text")))
    want = L.cluster_by_pairs(rows).groupBy("doc_id", "page", "band", "cluster").agg(F.array_join(F.transform(listed, lambda w: w["text"]), " ").alias("text"))
    assert sorted(L.pair_lines_on_pages(pages).collect()) == sorted(want.select("doc_id", "page", "text").collect())


@pytest.mark.parametrize("key", ["jn_right_of_label", "doc_bbox_backfill"])
def test_boxes_meet_in_their_document(spark, key):
    assert _plan(queries()[key](spark, SMALL)).count("Exchange") == 0


def test_label_forms_agree(spark):
    random.seed(8)
    texts = ["Reference", "Reference:", "Reference: A1", "Montant", "Total TTC", "77 MAD", "", "Solde fin : 5", " :- ", "x"]
    boxes = [(d, p, n, random.choice(texts), float(random.choice([20, 200, 300])), 10.0 * random.randint(0, 8), 150.0)
             for d in range(120) for p in (1, 2) for n in range(random.randint(1, 9))]
    rows = spark.createDataFrame(boxes, "doc_id long, page int, line_no int, text string, x0 double, y0 double, x1 double").withColumn("y1", F.col("y0") + 14)
    docs = rows.groupBy("doc_id").agg(F.collect_list(F.struct("page", "line_no", "text", "x0", "y0", "x1", "y1")).alias("boxes"))
    found = X.right_of_label_in_rows(docs, BBOX_LABELS).select("doc_id", F.inline("found"))
    want = X.right_of_label(rows, BBOX_LABELS)
    assert sorted(found.collect()) == sorted(want.filter("value IS NOT NULL").collect()) and want.count() > 100
    fields = F.create_map(F.lit("amount"), F.lit("given"))
    have = X.bbox_backfill_in_rows(docs.withColumn("fields", fields)).select("doc_id", "fields").collect()
    old = X.bbox_backfill(docs.select("doc_id", fields.alias("fields")), rows).select("doc_id", "fields").collect()
    assert {r.doc_id: r.fields for r in have} == {r.doc_id: r.fields for r in old}


def test_flat_bands_are_one_cluster(spark):
    assert L.pair_lines_on_pages(spark.createDataFrame([(1, 1, [(0.0, 9, 0, 0, "b"), (3.0, 1, 0, 1, "a"), (6.1, 2, 0, 2, "c"), (8.0, 3, 0, 3, "d"), (10.5, 4, 0, 4, "e")])], (
        "doc_id long, page int, words array<struct<y:double,x0:int,line_no:int,pos:int,text:string>>"))).select("text").collect() == [("a b",), ("c d",), ("e",)]


def test_items_are_decided_by_their_own_document(spark):
    docs = spark.createDataFrame([(1, "Description Prix Total\nAchat 5.00 MAD 10.00 MAD\nTotal 9", '{"extra":{"items":[{},{"libelle":"Vis","qte":"3"}]}}'),
                                  (2, "Description Prix Total\nAchat 5.00 MAD 10.00 MAD\nTotal 9", '{"extra":{"items":[{}]}}'), (3, "rien", None)], "doc_id long, raw_text string, data string")
    found = A.item_rows(docs)
    assert "Exchange" not in _plan(found)
    assert {(r.doc_id, r.pos, r.description, r.quantity) for r in found.collect()} == {(1, 1, "Vis", "3"), (2, 0, "Achat", "?")}


def test_unknown_detections_write_no_logs(spark, monkeypatch):
    monkeypatch.setattr(access, "_STORES", {})
    tables = access.AccessTables(spark, "/root/testdata/sf0.01")
    given = tables.unknown_between(date(2024, 1, 3), date(2024, 1, 9))
    rows = sorted(given.collect())
    assert access._STORES == {} and rows
    tables.store
    assert access._STORES and sorted(tables.unknown_between(date(2024, 1, 3), date(2024, 1, 9)).collect()) == rows


def test_a_plate_is_resolved_once(spark):
    plan = queries()["nlq_resolve_plate"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("question_id") > 0 and not [l for l in plan.splitlines() if "Generate" in l and "question_id" in l]


def test_dear_patterns_wait_for_a_plain_text(spark):
    texts = ["inv-2024-0001 ht, tva et ttc", "solde debit credit", "txn-2024-12345 auth code recu receipt authorization  code", "trf-2024-0001 virement ma64 0000 0000 0000 0000 00",
             "10/02/24 1 234.50 et 5,00", "1-2-2024 debit", "\t bord  ", "rien", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, raw_text string")
    found = R.features(docs)
    for r in found.collect():
        for kind, patterns in R.PATTERNS.items():
            assert list(r[f"rx_{kind}"]) == [len(re.findall(p, r.raw_text)) for p, _ in patterns]
    rows = {r.doc_id: r for r in found.collect()}
    assert (rows[4].date_line_count, rows[4].multi_amount_lines, rows[5].transaction_line_count, rows[6].line_count) == (1, 1, 1, 1)
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert all(f"case when contains(norm" in plan and f", {need})" in plan for needs in R.NEEDED.values() for need in needs)
    fields = G.generic_fields(docs)
    assert "_low" not in fields.columns and "case when contains" in fields._jdf.queryExecution().analyzed().toString().lower()


DET = "event_id long, plate_number string, detected_at timestamp_ntz, status string, image_path string"


@pytest.mark.parametrize("most", [0, 30, 4096])
def test_short_and_long_histories_pair_alike(spark, most):
    rnd = random.Random(most)
    rows = [(i, rnd.choice(["A", "B", "HOT", "HOT", "HOT"] + [f"P{k}" for k in range(9)]), datetime(2024, 1, 1) + timedelta(seconds=rnd.randint(0, 3 * 86400)),
             rnd.choice(["AUTHORIZED", "AUTHORIZED", "UNKNOWN", "BLACKLISTED"]), f"{i}.jpg") for i in range(500)]
    want = {(p, *log) for p in {r[1] for r in rows} for log in model([(r[0], r[2], r[3]) for r in rows if r[1] == p])}
    found = pair_sessions(spark.createDataFrame(rows, DET), 7200, most).collect()
    assert {(r.plate_number, r.id, r.entry_time, r.exit_time, r.status) for r in found} == want and len(found) == len(want)
    assert all(r.image_path == f"{r.id}.jpg" and r.manual_opened == (rows[r.id][3] == "AUTHORIZED") for r in found)


def test_given_tables_are_paired_once_and_kept_by_day(spark, monkeypatch):
    monkeypatch.setattr(access, "_STORES", {})
    tables = access.AccessTables(spark, SMALL)
    parts = {p for p, _, _ in tables.store.table.entries}
    assert parts == {"events", "logs"}  # no state, changes or marks that only a later batch would read
    whole = pair_sessions(tables.detections).select(*LOG_COLUMNS)
    assert sorted(map(repr, tables.logs.collect())) == sorted(map(repr, whole.collect()))
    day = date(2024, 1, 9)
    found = tables.logs_between(day, day)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, whole.filter(F.to_date("entry_time") == F.lit(day)).collect())) and found.count()
    assert "Exchange" not in _plan(found) and all("entry_date=2024-01-09" in f for f in found.inputFiles())


@pytest.mark.parametrize("minutes", [5, 2000])
def test_only_close_entries_are_walked(spark, monkeypatch, minutes):
    rnd, gap = random.Random(minutes), timedelta(minutes=minutes)
    T0 = datetime(1969, 12, 30)
    rows = [(i, f"P{i % 7}", T0 + timedelta(seconds=rnd.choice([rnd.randint(0, 4 * 86400), 86400 * rnd.randint(1, 3) + rnd.choice([-300, -1, 0, 1, 299, 300])])))
            for i in range(700)] + [(900, "P1", None), (901, None, T0)]
    rows += [(1000 + i, f"LONE{i}", T0 + timedelta(hours=6 + 12 * k, seconds=i)) for i, k in enumerate([0, 1, 2] * 20)]
    walked = []
    maps = dedup._maps
    monkeypatch.setattr(dedup, "_maps", lambda logs, *a: walked.append(logs) or maps(logs, *a))
    found = {r.id for r in dedup.duplicate_ids(spark.createDataFrame(rows, "id long, plate_number string, entry_time timestamp_ntz"), minutes).collect()}
    want, kept = set(), {}
    for i, plate, at in sorted((r for r in rows if r[1] and r[2]), key=lambda r: (r[2], r[0])):
        if plate in kept and at - kept[plate] <= gap:
            want.add(i)
        else:
            kept[plate] = at
    assert found == want and want
    assert minutes > 1440 or walked[0].filter("plate_number like 'LONE%'").count() == 0 and walked[0].count() < 600


def test_rows_without_a_time_stay(spark):
    store = PairedLogs(spark, run_folder(spark, "paired"))
    rows = [(1, "A", None, "AUTHORIZED", None), (2, "B", datetime(2024, 1, 5), "AUTHORIZED", None), (3, "", None, "NO_PLATE", None)]
    assert store.write(spark.createDataFrame(rows, DET)) and not store.write(spark.createDataFrame(rows, DET))
    assert {(r.id, r.entry_time) for r in store.logs().collect()} == {(1, None), (2, datetime(2024, 1, 5)), (3, None)}
    assert [r.id for r in store.logs(date(2024, 1, 5), None).collect()] == [2]


def test_a_family_of_lines_writes_few_pairs(spark, monkeypatch):
    from tests.llm.test_dedup import brute_lines
    from turnstone.llm import line_dedup as D

    rnd, rows = random.Random(11), []
    first = [f"w{k}" for k in range(60)]
    for i in range(240):  # most resemble the first one, few each other
        line = list(first)
        for k in rnd.sample(range(60), rnd.randint(3, 8)):
            line[k] = f"v{rnd.randint(0, 400)}"
        rows.append((i, " ".join(line if i else first) + "\n" + f"own{i} line{i} of{i} text{i}"))
    seen, real = {}, D._verified
    monkeypatch.setattr(D, "_verified", lambda pairs, docs, s, name: seen.update({name: pairs}) or real(pairs, docs, s, name))
    found = D.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line_no) for r in found} == {(i, k) for i, lines in brute_lines(rows).items() for k in lines} and len(found) > 120
    late = seen["late"]
    assert late.count() < 2 * late.distinct().count() + 10 and late.count() < 8 * len(rows)


def test_lines_of_all_lengths_keep_their_links_in_narrow_rows(spark, monkeypatch):
    """Lines of up to 300 words, whose words flip bits by quarters, against brute force; the self-join shuffles eight columns at most."""
    from tests.llm.test_dedup import brute_lines
    from turnstone.llm import line_dedup as D

    rnd, rows = random.Random(3), []
    for i in range(90):
        n = rnd.choice([5, 12, 40, 64, 65, 100, 128, 129, 200, 300])
        line = [f"w{rnd.randint(0, 3000)}" for _ in range(n)]
        other = [w for w in line if rnd.random() > 0.06] + [f"x{i}y{k}" for k in range(int(n * rnd.choice([0, 0.05, 0.12])))]
        rows.append((i, " ".join(line) + "\n" + " ".join(rnd.sample(other, len(other)))))
    met, real = [], D._prefix_pairs
    monkeypatch.setattr(D, "_prefix_pairs", lambda *a: met.append(real(*a)) or met[0])
    found = D.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {(i, k) for i, lines in brute_lines(rows).items() for k in lines}
    assert {(r.doc_id, r.line_no) for r in found} == want and 10 < len(want) < 90
    join = met[0]._jdf.queryExecution().optimizedPlan().children().head()
    while join.children().size() == 1:
        join = join.children().head()
    assert join.children().size() == 2 and all(join.children().apply(k).output().size() <= 8 for k in (0, 1))
