"""State machines against plain models, on fixtures and on skewed random histories."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from turnstone.functions import plates as P
from turnstone.operators import presence, sessions
from turnstone.operators.dedup import duplicate_ids
from turnstone.operators.reports import PresenceReport, report_period

T0 = datetime(2024, 1, 1)
DET = "event_id long, plate_number string, detected_at timestamp_ntz, status string, image_path string"
LOG = ("id long, plate_number string, entry_time timestamp_ntz, exit_time timestamp_ntz, status string, image_path string, "
       "manual_opened boolean, manual_exit_opened boolean")


def at(clock, day=1):
    h, m, *s = [int(x) for x in clock.split(":")]
    return datetime(2024, 1, day, h, m, s[0] if s else 0)


def model(events):
    """Entry/exit rule, one event after the other."""
    open_log, logs = None, []
    for eid, ts, status in sorted(events, key=lambda e: (e[1], e[0])):
        if open_log is None:
            open_log = [eid, ts, None, status]
        elif open_log[3] in ("UNKNOWN", "BLACKLISTED") and status in ("UNKNOWN", "BLACKLISTED"):
            continue
        else:
            open_log[2] = ts
            if open_log[3] in ("UNKNOWN", "BLACKLISTED"):
                open_log[3] = status
            logs.append(tuple(open_log))
            open_log = None
    return logs + ([tuple(open_log)] if open_log else [])


@pytest.mark.parametrize("width", [600, 3600, 86400])
def test_sessions_equal_model_with_hot_plate(spark, width):
    rnd = random.Random(width)
    rows, eid = [], 0
    for plate in [f"P{i}" for i in range(12)] + ["HOT"]:
        for _ in range(400 if plate == "HOT" else rnd.randint(1, 30)):
            eid += 1
            status = rnd.choices(["AUTHORIZED", "UNKNOWN", "BLACKLISTED"], [3, 2, 2])[0]
            rows.append((eid, plate, T0 + timedelta(seconds=rnd.randint(0, 4 * 86400)), status, None))
    got = sessions.pair_sessions(spark.createDataFrame(rows, DET), width).collect()
    want = {(p, *log) for p in {r[1] for r in rows} for log in model([(r[0], r[2], r[3]) for r in rows if r[1] == p])}
    assert {(r.plate_number, r.id, r.entry_time, r.exit_time, r.status) for r in got} == want


def test_fixture_rows(spark):
    A, U, B = "AUTHORIZED", "UNKNOWN", "BLACKLISTED"
    rows = [("P1", "09:00", A), ("P1", "17:00", A), ("P1", "17:30", A), ("P2", "09:00", U), ("P2", "09:10", U),
            ("P3", "09:00", U), ("P3", "10:00", A), ("P4", "09:00", A), ("P4", "10:00", B), ("", "09:00", "NO_PLATE")]
    det = spark.createDataFrame([(i, p, at(c), s, None) for i, (p, c, s) in enumerate(rows)], DET)
    logs = {(r.plate_number, r.entry_time.hour, r.exit_time and r.exit_time.hour, r.status) for r in sessions.pair_sessions(det).collect()}
    assert logs == {("P1", 9, 17, A), ("P1", 17, None, A), ("P2", 9, None, U), ("P3", 9, 10, A), ("P4", 9, 10, A),
                    ("NO_PLATE_20240101090000000000", 9, None, "NO_PLATE")}


def _logs(spark, rows):
    return spark.createDataFrame([(i, p, e, x, s, None, False, False) for i, (p, e, x, s) in enumerate(rows)], LOG)


def test_dedup_and_chain_fixture(spark):
    times = {"D1": ["09:00", "09:04", "09:08", "09:20"], "D2": ["09:00", "09:05"], "D3": ["09:00", "09:05:01"]}
    logs = _logs(spark, [(p, at(t), None, "AUTHORIZED") for p, ts in times.items() for t in ts])
    dups = logs.join(duplicate_ids(logs, 5), "id").collect()
    assert {(r.plate_number, r.entry_time) for r in dups} == {("D1", at("09:04")), ("D2", at("09:05"))}
    chains = {r.plate_number: r["count"] for r in sessions.multi_scans(logs, 5).collect()}
    assert chains == {"D1": 3, "D2": 2}


@pytest.mark.parametrize("rows_per_slot", [1, 7, 4096])
def test_dedup_equals_model_at_all_widths(spark, rows_per_slot):
    rnd = random.Random(rows_per_slot)
    rows = [(p, T0 + timedelta(seconds=20 * rnd.randint(0, span // 20)), None, "AUTHORIZED")
            for p, n, span in (("HOT", 500, 20000), ("A", 40, 20000), ("B", 3, 900), ("DAYS", 60, 400_000)) for _ in range(n)]
    logs = _logs(spark, rows)
    want = set()
    for plate in ("HOT", "A", "B", "DAYS"):
        kept = None
        for i, ts in sorted(((i, r[1]) for i, r in enumerate(rows) if r[0] == plate), key=lambda x: (x[1], x[0])):
            if kept is not None and ts - kept <= timedelta(minutes=5):
                want.add(i)
            else:
                kept = ts
    got = {r.id for r in duplicate_ids(logs, 5, rows_per_slot=rows_per_slot).collect()}
    assert got == want


def test_manual_open_twice(spark):
    logs = _logs(spark, [("P6", at("09:00"), None, "BLACKLISTED")])
    cmds = spark.createDataFrame([("p6", at("09:30")), ("P6", at("09:05"))], "plate_number string, opened_at timestamp_ntz")
    row = presence.manual_open(logs, cmds.withColumn("plate_number", F.upper("plate_number"))).first()
    assert (row.entry_time, row.exit_time, row.manual_opened, row.manual_exit_opened) == (at("09:05"), at("09:30"), True, True)


def test_manual_open_of_several_logs(spark):
    rnd = random.Random(8)
    rows, cmds = [], []
    for g in range(60):
        letters = "AB" if g % 2 else "A"
        for _ in range(rnd.randint(1, 5)):
            rows.append((f"{10000 + g}-{rnd.choice(letters)}-7", T0 + timedelta(hours=rnd.randint(0, 60)), None, "UNKNOWN"))
        for _ in range(rnd.randint(0, 12)):
            cmds.append((f"{10000 + g}-{rnd.choice(letters)}-7", T0 + timedelta(hours=rnd.randint(0, 60) + (g % 3) * 40)))
    rows += [("5-A-5", T0, None, "UNKNOWN"), ("5-A-5", T0 + timedelta(hours=1), None, "UNKNOWN")]
    cmds += [("5-A-5", T0 + timedelta(hours=9))] * 3  # equal times are commands of their own
    logs = _logs(spark, rows).withColumn("manual_opened", F.col("id") % 5 == 0)
    state = {i: [p, e, None, i % 5 == 0, False] for i, (p, e, *_) in enumerate(rows)}
    for plate, t in sorted(cmds, key=lambda c: c[1]):
        a, _, b = plate.split("-")
        match = [(v[1], i) for i, v in state.items() if v[2] is None and v[0].split("-")[::2] == [a, b]]
        if match:
            v = state[max(match)[1]]
            v[1:] = [v[1], t, True, True] if v[3] else [t, None, True, True]
    want = {i: (v[1], v[2]) for i, v in state.items() if v[4]}
    got = presence.manual_open(logs, spark.createDataFrame(cmds, "plate_number string, opened_at timestamp_ntz")).collect()
    assert {r.id: (r.entry_time, r.exit_time) for r in got} == want and len(got) == len(want) > 60
    assert all(r.manual_exit_opened == (r.exit_time is not None) for r in got)


def test_week_report(spark):
    people = [(1, "Ann", "12345-A-9", "Finance"), (2, "Bob", "56789-B-2", "IT"), (3, "Cid", "24680-C-7", "HR")]
    emp = spark.createDataFrame([(*p, f"E{p[0]}", True) for p in people],
                                "id long, full_name string, plate_number string, department string, employee_code string, is_active boolean")
    veh = spark.createDataFrame([], "id long, plate_number string, owner_name string, vehicle_type string, status string")
    rows = []
    for d in range(7):
        for k, (_, _, plate, _) in enumerate(people):
            entry = datetime(2026, 3, 20 + d, 8 + k, 30)
            leave = None if (k, d) == (2, 3) else datetime(2026, 3, 20 + d, 17, 30)
            rows.append((plate, entry, leave, "AUTHORIZED"))
    unknown = spark.createDataFrame([(1, "99999-Z-1", None, datetime(2026, 3, 20, 11, 12))], "id long, plate_number string, image_path string, detected_at timestamp_ntz")
    report = PresenceReport(_logs(spark, rows), unknown, emp, veh, date(2026, 3, 20), date(2026, 3, 26))
    got = {r.full_name: r for r in report.employee_period().collect()}
    assert [got[n].late_count for n in ("Ann", "Bob", "Cid")] == [0, 7, 7]
    assert got["Ann"].total_minutes == 3780.0 and got["Cid"].status == "anomalie"
    counts = {r.kind: r.n for r in report.anomaly_counts().collect()}
    assert counts == {"entry_without_exit": 1, "unknown_plates": 1}


def test_orphan_exits_of_the_period(spark):
    logs = _logs(spark, [("A", None, at("10:00", 2), "AUTHORIZED"), ("A", None, at("11:00", 2), "AUTHORIZED"), ("A", None, at("10:00", 9), "AUTHORIZED"), ("B", at("09:00", 2), None, "AUTHORIZED")])
    people = spark.createDataFrame([(1, "Ann", "A", "IT", "E1", True), (2, "Bob", "B", "IT", "E2", True)],
                                   "id long, full_name string, plate_number string, department string, employee_code string, is_active boolean")
    none = spark.createDataFrame([], "id long, plate_number string, image_path string, detected_at timestamp_ntz")
    cars = spark.createDataFrame([], "id long, plate_number string, owner_name string, vehicle_type string, status string")
    report = PresenceReport(logs, none, people, cars, date(2024, 1, 1), date(2024, 1, 5))
    assert {r.kind: r.n for r in report.anomaly_counts().collect()} == {"orphan_exit": 2, "entry_without_exit": 1}
    labels = {(r.plate_number, r.day, r.label): (r.n, r.first_at) for r in report.day_labels().collect()}
    assert labels[("A", date(2024, 1, 2), "orphan_exit")] == (2, at("10:00", 2)) and len(labels) == 2


def test_report_period_errors():
    assert report_period("weekly", year=2024, week=3) == (date(2024, 1, 15), date(2024, 1, 21))
    for kind, given in (("daily", {}), ("custom", dict(start_date=date(2024, 2, 1), end_date=date(2024, 1, 1))), ("other", {})):
        with pytest.raises(ValueError):
            report_period(kind, **given)


def test_plate_texts(spark):
    raw = "⁦38119⁩ - ⁧ﻭ⁩ - ⁦1⁩"
    row = spark.createDataFrame([(raw,)], "p string").select(
        P.normalize_plate(F.col("p")).alias("n"), P.loose_key(F.col("p")).alias("l"),
        P.normalize_plate(F.lit("٣٤ | a |—۶")).alias("d"), P.reorder_plate(F.lit("12-3-B")).alias("r")).first()
    assert tuple(row) == ("38119-و-1", "38119-*-1", "34-A-6", "12-B-3")
