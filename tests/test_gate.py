"""Histories of plates with gate commands against a plain model, event by event."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from turnstone.operators import gate

T0 = datetime(2024, 1, 1)
EVENTS = "event_id long, plate_number string, detected_at timestamp_ntz, status string, image_path string, kind string"
BAD = ("UNKNOWN", "BLACKLISTED")


def model(events):
    """(changes, logs) of one plate: events (event_id, at, status, kind), one after the other."""
    log, changes, logs = None, [], []
    for eid, at, status, kind in sorted(events, key=lambda e: (e[1], e[0])):
        action, ends = None, False
        if kind == "manual_open":
            if log is None or log["status"] not in BAD:
                continue
            if log["by_hand"]:
                action, ends = "manual_exit", True
            else:
                log.update(entry=at, by_hand=True)
                action = "manual_entry"
        elif kind == "exit":
            if log is None:
                continue
            action, ends = "exit", True
        elif log is None:
            log = {"id": eid, "entry": at, "status": status, "by_hand": False, "exit": None}
            logs.append(log)
            action = "entry"
        elif log["status"] in BAD and status in BAD:
            action = "exit_pending"
        else:
            log["status"] = status if log["status"] in BAD else log["status"]
            action, ends = "exit", True
        if ends:
            log["exit"] = at
        changes.append((eid, log["id"], action, log["entry"], log["exit"], log["status"]))
        if ends:
            log = None
    return changes, [(x["id"], x["entry"], x["exit"], x["status"]) for x in logs]


def history(seed, hot=500, plates=10, days=3, commands=True):
    rnd = random.Random(seed)
    rows = []
    for plate in [f"P{i}" for i in range(plates)] + ["HOT"]:
        for _ in range(hot if plate == "HOT" else rnd.randint(1, 30)):
            kind = rnd.choices(["detect", "manual_open", "exit"], [6, 2, 1] if commands else [1, 0, 0])[0]
            status = rnd.choices(["AUTHORIZED", "UNKNOWN", "BLACKLISTED"], [3, 2, 2])[0]
            # few different times, so that ties are met
            rows.append((len(rows) + 1, plate, T0 + timedelta(minutes=10 * rnd.randint(0, days * 144)), status, f"{len(rows)}.jpg", kind))
    return rows


def by_plate(rows):
    plates = {}
    for eid, plate, at, status, _, kind in rows:
        plates.setdefault(plate, []).append((eid, at, status, kind))
    return {p: model(e) for p, e in plates.items()}


@pytest.mark.parametrize("most", [3, 64, 4096])
def test_changes_and_logs_equal_the_model(spark, most):
    rows = history(most)
    acted = gate.with_actions(spark.createDataFrame(rows, EVENTS), most)
    logs = gate.sessions(acted)
    want = by_plate(rows)
    got = {(r.plate_number, r.id, r.entry_time, r.exit_time, r.status) for r in logs.collect()}
    assert got == {(p, *x) for p, (_, own) in want.items() for x in own}
    got = {(r.plate_number, r.event_id, r.log_id, r.action, r.entry_time, r.exit_time, r.status) for r in gate.changes(acted, logs).collect()}
    assert got == {(p, *x) for p, (own, _) in want.items() for x in own}


def test_flags_of_logs(spark):
    rows = [(1, "A", T0, "UNKNOWN", "a", "detect"), (2, "A", T0 + timedelta(hours=1), None, None, "manual_open"), (3, "A", T0 + timedelta(hours=2), None, None, "manual_open"),
            (4, "B", T0, "AUTHORIZED", "b", "detect"), (5, "B", T0 + timedelta(hours=1), None, None, "manual_open"), (6, "C", T0, None, None, "exit")]
    logs = {r.plate_number: r for r in gate.sessions(gate.with_actions(spark.createDataFrame(rows, EVENTS))).collect()}
    assert logs.keys() == {"A", "B"}
    assert (logs["A"].manual_opened, logs["A"].manual_exit_opened, logs["A"].seen_at, logs["A"].image_path) == (True, True, T0, "a")
    assert (logs["B"].manual_opened, logs["B"].manual_exit_opened, logs["B"].exit_time) == (True, False, None)
    assert gate.with_actions(spark.createDataFrame([], EVENTS)).count() == 0


def test_hot_plate_is_spread(spark):
    """A day with many events is cut into many slots, and no plan step needs Python."""
    from turnstone.operators.slots import add_slots

    rows = spark.range(20_000).select(F.lit("HOT").alias("plate_number"), (F.lit(T0) + F.make_interval(secs=F.col("id") * 4)).cast("timestamp_ntz").alias("at"))
    sizes = [r["count"] for r in add_slots(rows, "plate_number", "at", 500).groupBy("slot").count().collect()]
    assert len(sizes) >= 40 and max(sizes) <= 1000 and sum(sizes) == 20_000
