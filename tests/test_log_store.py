"""Stored logs: however events are split into batches, late ones too, the table equals a plain model of the whole."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_gate import EVENTS, T0, by_plate, history
from turnstone.operators.sessions import LOG_COLUMNS, pair_sessions
from turnstone.session import run_folder
from turnstone.sources.log_store import LogStore


def duplicates(rows):
    out = set()
    for plate, (_, logs) in by_plate(rows).items():
        seen = {r[0]: r[2] for r in rows if r[1] == plate}
        kept = None
        for i in sorted((x[0] for x in logs), key=lambda i: (seen[i], i)):
            if kept is not None and seen[i] - kept <= timedelta(minutes=5):
                out.add(i)
            else:
                kept = seen[i]
    return out


def check(spark, store, rows):
    want = by_plate(rows)
    got = {(r.plate_number, r.id, r.entry_time, r.exit_time, r.status) for r in store.logs().collect()}
    assert got == {(p, *x) for p, (_, own) in want.items() for x in own}
    got = {(r.plate_number, r.event_id, r.log_id, r.action, r.entry_time, r.exit_time, r.status) for r in store.changes().collect()}
    assert got == {(p, *x) for p, (own, _) in want.items() for x in own}
    assert {r.id for r in store.duplicates().collect()} == duplicates(rows)


def close_history(seed):
    """Events minutes apart, so that entries repeat within the window."""
    rnd = random.Random(seed)
    return [(i + 1, f"P{rnd.randint(0, 3)}", T0 + timedelta(seconds=60 * rnd.randint(0, 400)), rnd.choice(["AUTHORIZED", "UNKNOWN"]),
             None, rnd.choices(["detect", "manual_open", "exit"], [5, 1, 3])[0]) for i in range(160)]


@pytest.mark.parametrize(("seed", "late"), [(2, True), (3, False)])
def test_any_split_equals_the_whole(spark, seed, late):
    rows = history(seed, hot=120, plates=5) if seed < 3 else close_history(seed)
    rnd = random.Random(seed)
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    if late:  # a fifth of the events comes batches later
        order = [r for _, r in sorted(((k + (rnd.randint(20, 120) if rnd.random() < 0.2 else 0), r) for k, r in enumerate(order)), key=lambda x: x[0])]
    cuts = sorted(rnd.sample(range(1, len(order)), 2))
    path = run_folder(spark, "store")
    done = []
    for number, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(order)], strict=True)):
        store = LogStore(spark, path, rows_per_slot=50)  # opened anew: all state is in the table
        batch = spark.createDataFrame(order[a:b], EVENTS)
        assert store.apply(batch, number)
        assert not store.apply(batch, number)  # a repeated batch changes nothing
        done += order[a:b]
    check(spark, store, done)
    assert (store.late().count() > 0) == late


def test_days_are_read_apart(spark):
    rows = history(4, hot=60, plates=3, commands=False)
    store = LogStore(spark, run_folder(spark, "store"))
    blank = (9_001, "", T0 + timedelta(hours=30), "NO_PLATE", "n.jpg", "detect")
    store.apply(spark.createDataFrame([*rows, blank], EVENTS), 0)
    whole = pair_sessions(spark.createDataFrame([*rows, blank], EVENTS).drop("kind")).select(*LOG_COLUMNS)
    assert sorted(map(repr, store.logs().collect())) == sorted(map(repr, whole.collect()))
    day = date(2024, 1, 2)
    got = store.logs(day, day)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.filter(F.to_date("entry_time") == F.lit(day)).collect()))
    assert got.filter("status = 'NO_PLATE'").count() == 1
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "Exchange" not in text
    assert all("entry_date=2024-01-02" in f for f in store.ended(day, day).inputFiles())


def test_empty_batches_and_tables(spark):
    store = LogStore(spark, run_folder(spark, "store"))
    assert store.logs().count() == 0 and store.changes().count() == 0 and store.late().count() == 0
    assert store.apply(spark.createDataFrame([], EVENTS), 0)
    assert store.logs().count() == 0
    store.apply(spark.createDataFrame([(1, "A", datetime(2024, 5, 1), "AUTHORIZED", None, "detect")], EVENTS), 1)
    store.apply(spark.createDataFrame([], EVENTS), 2)
    assert [tuple(r)[:4] for r in store.logs().collect()] == [(1, "A", datetime(2024, 5, 1), None)]
