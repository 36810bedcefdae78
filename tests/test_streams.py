"""Streams over several files and batches, some late, against the same events as one batch."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_gate import EVENTS, T0, history
from tests.test_log_store import check
from turnstone.session import run_folder
from turnstone.sources.log_store import LogStore
from turnstone.streaming.access import run_available
from turnstone.streaming.tables import Chains, DailyCounts


@pytest.fixture(scope="module")
def files(spark):
    """(rows, folder): events in four files, the order of arrival; a tenth comes a file later than its time."""
    rnd = random.Random(11)
    rows = sorted(history(11, hot=120, plates=5), key=lambda r: r[2])
    part = {r[0]: min(3, 4 * k // len(rows) + (rnd.random() < 0.1)) for k, r in enumerate(rows)}
    folder = run_folder(spark, "stream-files")
    for p in range(4):
        spark.createDataFrame([r for r in rows if part[r[0]] == p], EVENTS).coalesce(1).write.mode("append").parquet(folder)
    return rows, folder, part


def stream(spark, folder):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)


def test_log_store_over_batches(spark, files):
    rows, folder, _ = files
    path = run_folder(spark, "stream-logs")
    store = LogStore(spark, path, rows_per_slot=64, retention=timedelta(hours=3))
    run_available(stream(spark, folder), store.sink(), "stream-logs-run")
    assert store.table.number == 3 and store.late().count() > 0
    check(spark, LogStore(spark, path), rows)
    # plates that have been idle and closed are forgotten, but for those of the last batch
    state = {r.plate_number: r for r in store.state().collect()}
    assert all(r.log is not None or r.last.at >= max(x[2] for x in rows) - timedelta(days=2) for r in state.values())


def test_daily_counts_over_batches(spark, files):
    rows, folder, part = files
    counts = DailyCounts(spark, run_folder(spark, "stream-days"))
    run_available(stream(spark, folder), counts.sink(), "stream-days-run")
    want = {}
    for _, _, at, status, *_ in rows:
        a, b = want.get(at.date(), (0, 0))
        want[at.date()] = (a + 1, b + (status == "UNKNOWN"))
    assert {r.day: (r.detections, r.unknown) for r in counts.read().collect()} == want
    late, newest = set(), None
    for p in range(4):
        own = [r for r in rows if part[r[0]] == p]
        late |= {r[0] for r in own if newest and r[2] < newest - timedelta(hours=1)}
        newest = max([r[2] for r in own] + ([newest] if newest else []))
    assert {r.event_id for r in counts.late().collect()} == late and late
    assert not counts.apply(spark.createDataFrame(rows, EVENTS), 3)


def test_chains_over_batches(spark, files):
    rows, folder, _ = files
    chains = Chains(spark, run_folder(spark, "stream-chains"), 30)
    run_available(stream(spark, folder), chains.sink(), "stream-chains-run")
    want, plates = set(), {}
    for _, plate, at, *_ in rows:
        plates.setdefault(plate, []).append(at)
    for plate, times in plates.items():
        run = []
        for at in [*sorted(times), None]:
            if run and (at is None or at - run[-1] > timedelta(minutes=30)):
                want |= {(plate, run[0], len(run))} if len(run) > 1 else set()
                run = []
            run.append(at)
    assert {(r.plate_number, r.started, r["count"]) for r in chains.read().collect()} == want
