"""Stored logs: every batch of events is paired once, and questions read days.

Parts of the table:

* ``logs``: logs that have ended, by the day of their entry;
* ``open``: one row per plate: its last event, and its open log if it has one;
* ``events``: the events themselves, by day, for repairs;
* ``changes``: what each event did, as rows per batch;
* ``late``: events that came behind their plate's last one, with the batch that brought them.

A batch continues the open logs: the event that opened a log (and the command that moved it) stands in for the whole
history before, for the rule looks back no further. So a batch costs what it holds, whatever is stored. Where a plate's
events come late, its logs from that point on are taken back and its stored events from that point are paired again;
only the days that they touch are written anew. The result equals pairing all events at once, however they were split.

A plate without an open log leaves ``open`` once its last event is older than the retention. Events before that time are
taken as late for plates without a row, and their stored events tell.

A batch has a number. The same number again changes nothing, so a stream that repeats a batch does no harm.
"""

from __future__ import annotations

from collections import Counter
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from turnstone import constants as K
from turnstone.operators import gate
from turnstone.operators.dedup import duplicate_ids
from turnstone.operators.reports import in_period
from turnstone.operators.sessions import LOG_COLUMNS, no_plate_logs
from turnstone.session import materialize
from turnstone.sources.versions import VersionedTable

EVENT = "event_id long, plate_number string, detected_at timestamp_ntz, status string, image_path string, kind string"
LOG = ("id long, plate_number string, entry_time timestamp_ntz, exit_time timestamp_ntz, status string, image_path string, "
       "manual_opened boolean, manual_exit_opened boolean, seen_at timestamp_ntz, seen_status string, opened_by long, left_by long, is_duplicate boolean")
STATE = f"plate_number string, last struct<at:timestamp_ntz,event_id:long>, log struct<{LOG.replace(' ', ':').replace(',:', ',')}>"
CHANGE = ("event_id long, plate_number string, log_id long, action string, entry_time timestamp_ntz, exit_time timestamp_ntz, "
          "status string, batch long")
EVENT_COLUMNS = [c.split()[0] for c in EVENT.split(", ")]
LOG_FIELDS = [c.split()[0] for c in LOG.split(", ")]
#: A day in more pieces than this is written anew with the next batch that adds to it.
PIECES = 16
RETENTION = timedelta(days=7)


class LogStore:
    """A stored log table below a folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str, dedup_minutes: int = K.DEDUP_MINUTES, rows_per_slot: int = 4096, retention: timedelta = RETENTION):
        self.retention = retention
        self.spark, self.table = spark, VersionedTable(spark, path)
        self.minutes, self.rows_per_slot = dedup_minutes, rows_per_slot

    # -- reading -----------------------------------------------------------------------------
    def ended(self, start: date | None = None, end: date | None = None) -> DataFrame:
        return self.table.read("logs", f"{LOG}, entry_date date", "entry_date", start, end)

    def state(self) -> DataFrame:
        return self.table.read("open", STATE)

    def logs(self, start: date | None = None, end: date | None = None) -> DataFrame:
        """Logs with an entry from the first to the last of the given days; all without them. No other day is opened."""
        still = self.state().filter("log is not null").select("log.*")
        if start or end:
            still = still.filter(in_period(F.col("entry_time"), start or date.min, end or date(9998, 12, 31)))
        return self.ended(start, end).drop("entry_date").unionByName(still).select(*LOG_COLUMNS)

    def events(self, start: date | None = None, end: date | None = None) -> DataFrame:
        """The stored events of these days."""
        return self.table.read("events", f"{EVENT}, day date", "day", start, end).drop("day")

    def duplicates(self) -> DataFrame:
        """Ids of logs that repeat the last kept one of their plate."""
        marked = self.ended().select("id", "is_duplicate").unionByName(self.state().select("log.id", "log.is_duplicate"))
        return marked.filter("is_duplicate").select("id")

    def changes(self) -> DataFrame:
        """What each event did to the logs, by its last pairing; events that did nothing have no row."""
        rows = self.table.read("changes", CHANGE)
        newest = rows.groupBy("event_id").agg(F.max_by(F.struct(*rows.drop("event_id").columns), "batch").alias("c"))
        return newest.select("event_id", "c.*").filter("action is not null").drop("batch")

    def late(self) -> DataFrame:
        return self.table.read("late", f"{EVENT}, batch long")

    # -- writing -----------------------------------------------------------------------------
    def apply(self, events: DataFrame, number: int) -> bool:
        """Adds a batch of events (each event_id once); False where the number is done already."""
        if number <= self.table.number:
            return False
        day = F.to_date("detected_at").alias("day")
        fresh = events.select(*[F.col(c).cast(t) for c, t in (x.split() for x in EVENT.split(", "))], day)
        kept = [e for e in self.table.entries if e[0] not in ("open", "logs")]
        kept += self.table.write(fresh, "events", number, "day")
        batch = self.spark.read.schema(f"{EVENT}, day date").parquet(self.table.folder("events", number))
        seen = batch.filter("plate_number <> ''").select(*EVENT_COLUMNS)
        state = self.state()
        starts = seen.groupBy("plate_number").agg(
            F.min(F.struct(F.col("detected_at").alias("at"), "event_id")).alias("start"), F.max(F.struct(F.col("detected_at").alias("at"), "event_id")).alias("end"))
        newest = state.agg(F.max("last.at")).first()[0]
        forgotten = F.lit(None if newest is None else newest - self.retention).cast("timestamp_ntz")
        # every plate of the batch with its state; late ones start before their last event, or before what is remembered
        late = F.coalesce(F.col("start") < F.col("last"), F.col("start.at") < forgotten, F.lit(False))
        plates = materialize(starts.join(state, "plate_number", "left").withColumn("late", late), "batch-plates")
        first_late = plates.filter("late").agg(F.min("start.at")).first()[0]
        again, back = (None, None) if first_late is None else self._taken_back(plates, seen, first_late)

        seeds = plates.filter("not late and log is not null").select("log.*")
        kept_before = plates.filter("not late and log is not null").select("log.*").unionByName(
            self._recent(plates.filter("not late"), first=None))
        history = seen
        if again is not None:
            history = seen.unionByName(again)
            seeds = seeds.unionByName(back["seeds"])
            kept_before = kept_before.unionByName(back["kept"])
            kept += self.table.write(seen.join(plates.filter("late").select("plate_number"), "plate_number").select(*EVENT_COLUMNS, F.lit(number).cast("long").alias("batch")), "late", number)
        history = materialize(history.unionByName(self._seed_events(seeds)), "batch-history")
        acted = materialize(gate.with_actions(history, self.rows_per_slot), "batch-actions")
        logs = materialize(gate.sessions(acted), "batch-logs")
        marked = self._marked(logs, seeds, kept_before)
        kept += self._write_changes(acted, logs, number, seeds, again)
        kept += self._write_logs(marked, batch, back, number)
        self._write_open(marked, plates, state.filter(F.col("log").isNotNull() | F.coalesce(F.col("last.at") >= forgotten, F.lit(True))), number)
        self.table.commit(number, [*kept, ("open", None, number)])
        return True

    def _seed_events(self, seeds: DataFrame) -> DataFrame:
        """The events that make a plate's state what it was: the one that opened the log, and the command that moved it."""
        none = F.lit(None).cast("string")
        came = seeds.select(F.col("id").alias("event_id"), "plate_number", F.col("seen_at").alias("detected_at"),
                            F.col("seen_status").alias("status"), "image_path", F.lit(gate.DETECT).alias("kind"))
        moved = seeds.filter("opened_by is not null").select(
            F.col("opened_by").alias("event_id"), "plate_number", F.col("entry_time").alias("detected_at"), none.alias("status"),
            none.alias("image_path"), F.lit(gate.MANUAL).alias("kind"))
        return came.unionByName(moved)

    def _recent(self, plates: DataFrame, first) -> DataFrame:
        """Kept logs that have ended and may still make entries of the batch duplicates: those within the window before
        a plate's start."""
        window = timedelta(minutes=self.minutes)
        if first is None:
            first = plates.agg(F.min("start.at")).first()[0]
            if first is None:
                return self.spark.createDataFrame([], LOG)
        # a log that was moved by a command stands under a later day than it was seen
        rows = self.ended((first - window).date()).filter(F.col("seen_at") >= F.lit(first - window)).filter("not is_duplicate").drop("entry_date")
        near = rows.join(plates.select("plate_number", "start"), "plate_number")
        return near.filter((F.struct("seen_at", "id") < F.col("start")) & (F.col("seen_at") >= F.col("start.at") - F.make_interval(mins=F.lit(self.minutes)))).select(*LOG_FIELDS)

    def _taken_back(self, plates: DataFrame, seen: DataFrame, first) -> tuple[DataFrame, dict[str, DataFrame]]:
        """(stored events of late plates from their late event on, what becomes of their logs)."""
        late = plates.filter("late").select("plate_number", "start")
        stored = self.table.read("events", f"{EVENT}, day date", "day", first.date())
        again = stored.join(late, "plate_number").filter(F.struct("detected_at", "event_id") > F.col("start")).select(*EVENT_COLUMNS)
        # the logs that reach behind a plate's start: of them all days may hold one, but the end is checked at the scan
        ended = self.ended().filter(F.col("exit_time") >= F.lit(first)).join(late, "plate_number").filter(
            F.struct("exit_time", "left_by") > F.col("start"))
        ended = materialize(ended, "logs-taken-back")
        still = plates.filter("late and log is not null").select("log.*", "start")
        reached = ended.drop("entry_date").unionByName(still.select(*LOG_FIELDS, "start"))
        # those that began before it are open there, as they were seen, and by hand if that came before it, too
        before = reached.filter(F.struct("seen_at", "id") < F.col("start"))
        by_hand = F.col("opened_by").isNotNull() & (F.struct("entry_time", "opened_by") < F.col("start"))
        seeds = before.withColumns({
            "opened_by": F.when(by_hand, F.col("opened_by")), "exit_time": F.lit(None).cast("timestamp_ntz"), "status": F.col("seen_status"),
            "left_by": F.lit(None).cast("long")}).select(*LOG_FIELDS)
        return again, {"ended": ended, "seeds": seeds, "kept": self._recent(late, first).unionByName(seeds)}

    def _marked(self, logs: DataFrame, seeds: DataFrame, kept: DataFrame) -> DataFrame:
        """The batch's logs with the duplicate flag: entries are measured from the last kept one of the plate."""
        entries = logs.select("id", "plate_number", F.col("seen_at").alias("entry_time"))
        old = seeds.select("id", F.col("is_duplicate").alias("was"))
        known = kept.filter("not is_duplicate").select("id", "plate_number", F.col("seen_at").alias("entry_time")).distinct()
        measured = entries.join(old, "id", "left_anti").unionByName(known)
        again = duplicate_ids(measured, self.minutes, rows_per_slot=self.rows_per_slot).withColumn("again", F.lit(True))
        rows = logs.join(old, "id", "left").join(again, "id", "left")
        return materialize(rows.withColumn("is_duplicate", F.coalesce("was", "again", F.lit(False))).select(*LOG_FIELDS), "batch-marked")

    def _write_changes(self, acted: DataFrame, logs: DataFrame, number: int, seeds: DataFrame, again: DataFrame | None) -> list:
        seeded = self._seed_events(seeds).select("event_id")
        rows = gate.changes(acted, logs)
        if again is not None:  # events that do nothing any more say so
            idle = acted.filter("action is null").select("event_id", "plate_number")
            rows = rows.unionByName(idle, allowMissingColumns=True)
        rows = rows.join(seeded, "event_id", "left_anti").withColumn("batch", F.lit(number).cast("long"))
        return self.table.write(rows, "changes", number)

    def _write_logs(self, marked: DataFrame, batch: DataFrame, back: dict | None, number: int) -> list:
        """Appends what has ended to its days; days with logs taken back, or in many pieces, are written anew."""
        entries = [e for e in self.table.entries if e[0] == "logs"]
        blank = no_plate_logs(batch).withColumns({
            "seen_at": F.col("entry_time"), "seen_status": F.col("status"), "opened_by": F.lit(None).cast("long"),
            "left_by": F.lit(None).cast("long"), "is_duplicate": F.lit(False)}).select(*LOG_FIELDS)
        ended = marked.filter("exit_time is not null").unionByName(blank).withColumn("entry_date", F.to_date("entry_time"))
        anew = set()
        if back is not None:
            anew = {r[0] for r in back["ended"].select("entry_date").distinct().collect()}
        anew |= {d for d, n in Counter(d for _, d, _ in entries).items() if n >= PIECES}
        if anew:
            old = self.ended().filter(F.col("entry_date").isin(sorted(anew)))
            if back is not None:
                old = old.join(back["ended"].select("id"), "id", "left_anti")
            ended = ended.unionByName(old)
        written = self.table.write(ended, "logs", number, "entry_date")
        return [e for e in entries if e[1] not in anew] + written

    def _write_open(self, marked: DataFrame, plates: DataFrame, state: DataFrame, number: int) -> None:
        still = marked.filter("exit_time is null").select("plate_number", F.struct(*LOG_FIELDS).alias("log"))
        touched = plates.select("plate_number", F.greatest("end", F.coalesce("last", "end")).alias("last")).join(still, "plate_number", "left")
        others = state.join(plates.select("plate_number"), "plate_number", "left_anti")
        self.table.write(others.unionByName(touched), "open", number)

    def sink(self, prepare=lambda batch: batch):
        """A foreachBatch function: prepares the rows of a micro-batch as events and adds them under its number."""
        return lambda batch, number: self.apply(prepare(batch), number)

