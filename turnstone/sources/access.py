"""Access-domain tables derived from the given event and customer tables."""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnstone.constants import AUTHORIZED, BLACKLISTED, NO_PLATE, UNKNOWN
from turnstone.functions.plates import normalize_plate
from turnstone.operators.reports import in_period
from turnstone.session import run_folder
from turnstone.sources.files import read_table
from turnstone.sources.paired_logs import PairedLogs

#: Folders of the stored logs, by application and folder of the given tables.
_STORES: dict[tuple[str, str], str] = {}


def plate_of(key: Column) -> Column:
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    letter = F.substring(letters, (key % 26 + 1).cast("int"), F.lit(1))
    return F.concat(
        F.format_string("%05d", key), F.lit("-"), letter, F.lit("-"), (key % 9 + 1).cast("string")
    )


def raw_plate_of(plate: Column, kind: Column, value: Column) -> Column:
    """Plate text as different readers would write it; tiny values stand for no reading."""
    spaced = F.concat(F.lit(" "), F.replace(plate, F.lit("-"), F.lit(" - ")))
    return (
        F.when(value < 1, "")
        .when(kind == "view", F.lower(plate))
        .when(kind == "click", spaced)
        .when(kind == "error", F.replace(plate, F.lit("-"), F.lit("|")))
        .when(kind == "signup", F.concat(F.lit("\u2066"), F.replace(plate, F.lit("-"), F.lit("\u2013"))))
        .otherwise(plate)
    )


class AccessTables:
    """Lazy views; nothing is read before an action, but for the stored logs, which the first question on logs writes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @cached_property
    def employees(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.read("customer").filter("c_mktsegment <> 'HOUSEHOLD'").select(
            key.alias("id"),
            F.col("c_name").alias("full_name"),
            plate_of(key).alias("plate_number"),
            F.col("c_mktsegment").alias("department"),
            F.concat(F.lit("EMP-"), key.cast("string")).alias("employee_code"),
            (F.col("c_acctbal") < 9000).alias("is_active"),
        )

    @cached_property
    def vehicles(self) -> DataFrame:
        key = F.col("c_custkey")
        black = F.col("c_acctbal") < 0
        minute = F.make_interval(mins=(key % 1440).cast("int"))
        return self.read("customer").filter("c_acctbal < 9200").select(
            key.alias("id"),
            plate_of(key).alias("plate_number"),
            F.col("c_name").alias("owner_name"),
            F.lower("c_mktsegment").alias("vehicle_type"),
            F.when(black, BLACKLISTED).otherwise(AUTHORIZED).alias("status"),
            F.when(black & (F.col("c_acctbal") < -500), "unpaid").alias("blacklist_reason"),
            F.when(black, F.lit("2024-01-12").cast("timestamp_ntz") + minute).alias("blacklisted_at"),
            (F.lit("2023-06-01").cast("timestamp_ntz") + minute).alias("created_at"),
        )

    @cached_property
    def raw_detections(self) -> DataFrame:
        plate = plate_of(F.col("user_id"))
        return self.read("events").select(
            "event_id",
            raw_plate_of(plate, F.col("event_type"), F.col("value")).alias("plate_text"),
            F.col("ts").alias("detected_at"),
            F.concat(F.lit("captures/"), F.col("event_id").cast("string"), F.lit(".jpg")).alias(
                "image_path"
            ),
        )

    @cached_property
    def detections(self) -> DataFrame:
        """Detections with the status that held at their time."""
        seen = self.raw_detections.withColumn("plate_number", normalize_plate(F.col("plate_text")))
        known = self.vehicles.select("plate_number", F.col("status").alias("s"), "blacklisted_at")
        status = (
            F.when(F.col("plate_number") == "", NO_PLATE)
            .when(F.col("s").isNull(), UNKNOWN)
            .when((F.col("s") == BLACKLISTED) & (F.col("detected_at") >= F.col("blacklisted_at")), BLACKLISTED)
            .otherwise(AUTHORIZED)
        )
        return seen.join(known, "plate_number", "left").select(
            "event_id", "plate_number", "detected_at", status.alias("status"), "image_path"
        )

    @cached_property
    def store(self) -> PairedLogs:
        """The stored logs of these tables: written by the first question of an application, read by all."""
        place = (self.spark.sparkContext.applicationId, self.folder)
        path = _STORES.setdefault(place, run_folder(self.spark, "access-logs"))
        store = PairedLogs(self.spark, path)
        if store.table.number < 0:
            store.write(self.detections)
        return store

    @cached_property
    def logs(self) -> DataFrame:
        return self.store.logs()

    def logs_between(self, start: date | None, end: date | None) -> DataFrame:
        """Logs with an entry on these days, from the folders of these days."""
        return self.store.logs(start, end)

    @cached_property
    def unknown(self) -> DataFrame:
        return self.unknown_between(None, None)

    def unknown_between(self, start: date | None, end: date | None) -> DataFrame:
        """Unknown detections of these days: from the stored events where a question on logs has written them, else as given.

        The status of a detection needs no pairing, so they are no reason to write the logs.
        """
        return self._events_between(start, end).filter(F.col("status") == UNKNOWN).select(
            F.col("event_id").alias("id"), "plate_number", "image_path", "detected_at"
        )

    def _events_between(self, start: date | None, end: date | None) -> DataFrame:
        if (self.spark.sparkContext.applicationId, self.folder) in _STORES:
            return self.store.events(start, end)
        if not (start or end):
            return self.detections
        return self.detections.filter(in_period(F.col("detected_at"), start or date.min, end or date(9998, 12, 31)))

    @cached_property
    def access_logs(self) -> DataFrame:
        return self.accesses_between(None, None)

    def accesses_between(self, start: date | None, end: date | None) -> DataFrame:
        lower = F.when(F.col("status") == AUTHORIZED, "authorized").otherwise("denied")
        return self.logs_between(start, end).select("plate_number", F.col("entry_time").alias("access_time"), lower.alias("status"))
