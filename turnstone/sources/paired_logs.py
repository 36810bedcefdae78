"""Logs of tables that are given whole: paired in one pass, kept by the day of their entry.

``LogStore`` takes batch after batch, so it keeps what a later batch may have to continue or repair: a state per plate, what
every event did, duplicate marks. Where no batch follows, questions need none of it.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnstone.operators.reports import in_period
from turnstone.operators.sessions import LOG_COLUMNS, pair_sessions
from turnstone.sources.versions import VersionedTable

EVENT = "event_id long, plate_number string, detected_at timestamp_ntz, status string, image_path string"
LOG = ("id long, plate_number string, entry_time timestamp_ntz, exit_time timestamp_ntz, status string, image_path string, "
       "manual_opened boolean, manual_exit_opened boolean, entry_date date")


class PairedLogs:
    """A table below a folder of the shared store: ``events`` as they came, ``logs`` by the day of their entry."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, VersionedTable(spark, path)

    def write(self, events: DataFrame) -> bool:
        """Writes the events and their logs; False where that is done already."""
        if self.table.number >= 0:
            return False
        kept = self.table.write(events.select(*[F.col(c).cast(t) for c, t in (x.split() for x in EVENT.split(", "))]), "events", 0)
        written = self.spark.read.schema(EVENT).parquet(self.table.folder("events", 0))
        logs = pair_sessions(written).select(*LOG_COLUMNS, F.to_date("entry_time").alias("entry_date"))
        self.table.commit(0, kept + self.table.write(logs, "logs", 0, "entry_date"))
        return True

    def logs(self, start: date | None = None, end: date | None = None) -> DataFrame:
        """Logs with an entry from the first to the last of the given days; all without them. No other day is opened."""
        return self.table.read("logs", LOG, "entry_date", start, end).drop("entry_date")

    def events(self, start: date | None = None, end: date | None = None) -> DataFrame:
        """The events of these days."""
        rows = self.table.read("events", EVENT)
        if not (start or end):
            return rows
        return rows.filter(in_period(F.col("detected_at"), start or date.min, end or date(9998, 12, 31)))
