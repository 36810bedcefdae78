"""Findings of round 4."""

import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

from __spark_entry__ import queries
from check_oracles import compare, connect
from tests.test_access import LOG
from turnstone.operators.reports import PresenceReport

SMALL = "/root/testdata/sf0.001"
PERSON = "id long, full_name string, plate_number string, department string, employee_code string, is_active boolean"
CAR = "id long, plate_number string, owner_name string, vehicle_type string, status string"


def _report(spark, logs, plates):
    people = spark.createDataFrame([(i, f"N{i}", p, "IT", f"E{i}", True) for i, p in enumerate(plates)], PERSON)
    unknown = spark.createDataFrame([], "id long, plate_number string, image_path string, detected_at timestamp_ntz")
    return PresenceReport(spark.createDataFrame(logs, LOG), unknown, people, spark.createDataFrame([], CAR), date(2024, 1, 1), date(2024, 1, 5))


def _lists(logs, known):
    """Plate and day to labels, one log after the other."""
    last, found = {}, defaultdict(list)
    for _, plate, entry, leave, status, *_ in sorted(logs, key=lambda r: (r[2] or datetime.min, r[0])):
        if not plate or (entry is None and leave is None):
            continue
        if entry is None:
            found[plate, leave.date()].append("orphan_exit")
            continue
        labels = found[plate, entry.date()]
        if plate not in known:
            labels.append("unknown")
        if status == "BLACKLISTED":
            labels.append("blacklisted")
        if plate in last and entry - last[plate] <= timedelta(minutes=5):
            labels.append("duplicate")
            continue
        last[plate] = entry
        if leave is None:
            labels.append("entry_without_exit")
        elif leave < entry:
            labels.append("incoherent")
    return {k: v for k, v in found.items() if v}


def test_day_labels_are_lists_in_event_order(spark):
    t = lambda clock, day=2: datetime(2024, 1, day, *[int(x) for x in clock.split(":")])
    log = lambda i, plate, entry, leave, status="AUTHORIZED": (i, plate, entry, leave, status, None, False, False)
    logs = [
        log(9, "A", t("08:00"), None), log(3, "A", t("08:04"), t("09:00")), log(5, "A", t("12:00"), t("11:00")), log(1, "A", t("15:00"), None),
        log(2, "A", None, t("20:00")), log(4, "A", t("23:58"), t("23:59")), log(6, "A", t("00:02", 3), None),
        log(7, "X", t("10:00"), None, "blacklisted"), log(8, "X", t("10:01"), None, "BLACKLISTED"), log(10, "", t("10:00"), None), log(11, None, t("10:00"), None),
        log(12, "", None, t("10:00")),
    ]
    got = {(r.plate_number, r.day): r.labels for r in _report(spark, logs, ["A"]).day_label_lists().collect()}
    assert got == {
        ("A", date(2024, 1, 2)): ["orphan_exit", "entry_without_exit", "duplicate", "incoherent", "entry_without_exit"],
        ("A", date(2024, 1, 3)): ["duplicate"],
        ("X", date(2024, 1, 2)): ["unknown", "blacklisted", "entry_without_exit", "unknown", "blacklisted", "duplicate"],
    }


def test_day_label_lists_equal_model(spark):
    rnd, known = random.Random(4), ["P0", "P1", "P2"]
    logs = []
    for i in rnd.sample(range(4000), 1500):
        entry = datetime(2024, 1, 1) + timedelta(seconds=rnd.randrange(5 * 86400))
        leave = rnd.choice([None, entry + timedelta(minutes=rnd.randrange(-30, 60))])
        if rnd.random() < 0.1:
            entry, leave = None, entry
        logs.append((i, f"P{min(rnd.randrange(9), 4)}", entry, leave, rnd.choice(["AUTHORIZED", "BLACKLISTED", None]), None, False, False))
    report = _report(spark, logs, known)
    got = {(r.plate_number, r.day): r.labels for r in report.day_label_lists().collect()}
    assert got == _lists(logs, known) and max(map(len, got.values())) > 150
    counted = {(r.plate_number, r.day, r.label): r.n for r in report.day_labels().collect()}
    assert counted == {(*k, label): n for k, v in got.items() for label, n in Counter(v).items()}


def test_day_label_query_returns_lists(spark):
    assert queries()["agg_day_anomaly_labels"](spark, SMALL).columns == ["plate_number", "day", "labels"]
    state, rows, detail = compare(spark, connect(SMALL), "agg_day_anomaly_labels", SMALL)
    assert state == "ok" and rows, detail
