"""Table changes as joins; ``sources.stored`` writes them as versions, never over their input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnstone import constants as K
from turnstone.functions.plates import normalize_plate
from turnstone.session import materialize

RANGES = 64


def assign_ids(table: DataFrame, key: str, id_column: str = "id") -> DataFrame:
    """Gives rows without an id the numbers after the largest one, in order of their key (which names a row).

    Two levels: new rows are written in ranges of the key, counted by range, and numbered inside their range; no window
    holds more than one range or one row per range.
    """
    fresh = table.filter(F.col(id_column).isNull()).repartitionByRange(RANGES, key).withColumn("_range", F.spark_partition_id())
    fresh = materialize(fresh, "new-rows")
    counts = fresh.groupBy("_range").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    largest = table.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("m"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    numbered = fresh.join(F.broadcast(starts), "_range").withColumn(id_column, F.col("_start") + number + largest.scalar())
    return table.filter(F.col(id_column).isNotNull()).unionByName(numbered.select(*table.columns))


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows.select(*table.columns))


def latest_changes(changes: DataFrame, key: str, order: str) -> DataFrame:
    """Last change per key; a max of structs combines before the shuffle."""
    rest = [c for c in changes.columns if c not in (key, order)]
    last = F.max(F.struct(order, *rest)).alias("c")
    return changes.groupBy(key).agg(last).select(key, *[F.col(f"c.{c}").alias(c) for c in (order, *rest)])


def _target(changes: DataFrame, table: DataFrame) -> DataFrame:
    """Adds ``target``: the stored plate equal to the given text, else to its normalised form."""
    stored = table.select(F.col("plate_number").alias("target"))
    rows = changes.withColumn("norm", normalize_plate(F.col("plate_number")))
    exact = rows.join(stored.withColumn("exact", F.lit(True)), F.col("plate_number") == F.col("target"), "left").drop("target")
    return exact.withColumn("target", F.when(F.col("exact"), F.col("plate_number")).otherwise(
        F.coalesce(F.nullif("norm", F.lit("")), "plate_number"))).drop("exact", "norm")


def upsert_authorized(vehicles: DataFrame, employees: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registrations ``(seq, plate_number, full_name, department, is_authorized, employee_code)``; the last one wins.

    New rows get no id here: ``assign_ids`` gives it when the change is stored. Stored blacklist reasons stay.
    """
    def last(table: DataFrame) -> DataFrame:
        rows = latest_changes(_target(changes, table).drop("plate_number").withColumnRenamed("target", "plate_number"), "plate_number", "seq")
        return rows.select("plate_number", F.struct("full_name", "department", "is_authorized", "employee_code").alias("n"))

    status = F.when(F.col("n.is_authorized"), K.AUTHORIZED).otherwise(K.BLACKLISTED)
    on = F.col("n").isNotNull()
    new_vehicles = vehicles.join(last(vehicles), "plate_number", "full_outer").withColumns({
        "owner_name": F.when(on, F.col("n.full_name")).otherwise(F.col("owner_name")),
        "vehicle_type": F.when(on, F.col("n.department")).otherwise(F.col("vehicle_type")),
        "status": F.when(on, status).otherwise(F.col("status")),
    }).select(*vehicles.columns)
    new_employees = employees.join(last(employees), "plate_number", "full_outer").withColumns({
        "full_name": F.when(on, F.col("n.full_name")).otherwise(F.col("full_name")),
        "department": F.when(on, F.col("n.department")).otherwise(F.col("department")),
        "is_active": F.when(on, F.col("n.is_authorized")).otherwise(F.col("is_active")),
        "employee_code": F.when(on, F.col("n.employee_code")).otherwise(F.col("employee_code")),
    }).select(*employees.columns)
    return new_vehicles, new_employees


def upsert_blacklist(vehicles: DataFrame, changes: DataFrame) -> DataFrame:
    """Blacklistings ``(seq, plate_number, reason, at, owner_name, vehicle_type)``."""
    rows = latest_changes(_target(changes, vehicles).drop("plate_number").withColumnRenamed("target", "plate_number"), "plate_number", "seq")
    rows = rows.select("plate_number", F.struct("reason", "at", "owner_name", "vehicle_type").alias("n"))
    on = F.col("n").isNotNull()
    keep = lambda new, old, default: F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old), F.when(on, F.lit(default)))
    return vehicles.join(rows, "plate_number", "full_outer").withColumns({
        "status": F.when(on, K.BLACKLISTED).otherwise(F.col("status")),
        "blacklist_reason": F.when(on, F.col("n.reason")).otherwise(F.col("blacklist_reason")),
        "blacklisted_at": F.when(on, F.col("n.at")).otherwise(F.col("blacklisted_at")),
        "owner_name": keep("n.owner_name", "owner_name", "Unknown"),
        "vehicle_type": keep("n.vehicle_type", "vehicle_type", "unknown"),
    }).select(*vehicles.columns)


def delete_unknown(unknown: DataFrame, plates: DataFrame) -> DataFrame:
    """Unknown detections without the rows of the given plates, raw or normalised."""
    raw = plates.select("plate_number")
    gone = raw.union(raw.select(normalize_plate(F.col("plate_number")))).filter("plate_number <> ''").distinct()
    return unknown.join(gone, "plate_number", "left_anti")


def upsert_by_key(table: DataFrame, rows: DataFrame, key: str, stamp: Column, kept: tuple[str, ...] = ("created_at",), touched: str | None = "updated_at") -> DataFrame:
    """Insert or replace by key: ``kept`` columns survive an update, ``touched`` gets the stamp."""
    new = rows.select(key, F.struct(*[c for c in rows.columns if c != key]).alias("n"))
    joined = table.join(new, key, "full_outer")
    on = F.col("n").isNotNull()
    cols = []
    for c in table.columns:
        if c == key:
            cols.append(F.col(c))
        elif c == touched:
            cols.append(F.when(on, stamp).otherwise(F.col(c)).alias(c))
        elif c in kept:
            cols.append(F.coalesce(F.col(c), F.when(on, stamp)).alias(c))
        elif c in rows.columns:
            cols.append(F.when(on, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return joined.select(*cols)


def batch_summary(items: DataFrame) -> DataFrame:
    """Totals per batch; a batch with any failure is ``completed_with_errors``."""
    failed = F.count_if(F.col("status") != "success")
    return items.groupBy("batch_id").agg(
        F.count("*").alias("total_files"), F.count_if(F.col("status") == "success").alias("success_count"), failed.alias("failed_count"),
    ).withColumn("status", F.when(F.col("failed_count") > 0, "completed_with_errors").otherwise("completed"))


def report_row(summary: DataFrame, kind: str, start, end, generated_at) -> DataFrame:
    """History row of a report: summary as JSON with ISO times, settings as metadata."""
    stamp = F.lit(str(generated_at)).cast("timestamp_ntz")
    name = F.concat(F.lit(f"presence_report_{kind}_{start:%Y%m%d}_{end:%Y%m%d}_"), F.date_format(stamp, "yyyyMMdd_HHmmss"), F.lit(".pdf"))
    options = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
    meta = F.to_json(F.struct(F.lit("09:00").alias("attendance_start"), F.lit(K.LATE_MINUTES).alias("late_minutes"), F.lit(K.DEDUP_MINUTES).alias("dedup_minutes")))
    return summary.select(
        F.lit(kind).alias("report_type"), F.lit(start).alias("start_date"), F.lit(end).alias("end_date"), stamp.alias("generated_at"),
        name.alias("file_name"), F.to_json(F.struct(*summary.columns), options).alias("summary"), meta.alias("metadata"))
