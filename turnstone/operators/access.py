"""Ready-made access questions as functions from frames to a frame.

Columns: ``_HEAD`` for the enriched log questions. Orders get ``id`` as last key so that top rows are
stable. Day filters compare ``to_date(column)`` with a date; Catalyst turns that into a time range.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from turnstone import constants as K
from turnstone.operators.joins import enrich, latest_rows
from turnstone.operators.slots import seconds_between

_HEAD = ("id", "plate_number", "entry_time", "exit_time", "status", "employee_name", "department",
         "owner_name", "vehicle_type")
_SHORT = tuple(c for c in _HEAD if c != "exit_time")


def on_day(ts: str, day: date) -> Column:
    return F.to_date(ts) == F.lit(day)


def between_days(ts: str, start: date, end: date) -> Column:
    return F.to_date(ts).between(F.lit(start), F.lit(end))


def second_of_day(ts: Column) -> Column:
    """Seconds since midnight with microseconds."""
    midnight = F.to_date(ts).cast("timestamp_ntz")
    return seconds_between(midnight, ts.cast("timestamp_ntz"))


def seconds(clock: str) -> int:
    parts = [int(p) for p in clock.split(":")] + [0, 0]
    return parts[0] * 3600 + parts[1] * 60 + parts[2]


def newest(df: DataFrame, limit: int | None = None, ts: str = "entry_time") -> DataFrame:
    out = df.orderBy(F.desc(ts), "id")
    return out.limit(limit) if limit is not None else out


def week_of(day: date) -> tuple[date, date]:
    start = day - timedelta(days=day.weekday())
    return start, start + timedelta(days=6)


def plate_history(logs, employees, vehicles, plate, day=None, span=None) -> DataFrame:
    rows = logs.filter(F.col("plate_number") == plate)
    if day:
        rows = rows.filter(on_day("entry_time", day))
    if span:
        rows = rows.filter(between_days("entry_time", *span))
    return newest(enrich(rows, employees, vehicles).select(*_HEAD))


def plate_last_entry(logs, employees, vehicles, plate) -> DataFrame:
    rows = newest(logs.filter(F.col("plate_number") == plate), 1)
    return enrich(rows, employees, vehicles).select(*_HEAD)


def present_on(logs, employees, vehicles, day, currently=False) -> DataFrame:
    rows = logs.filter(on_day("entry_time", day) & (F.col("status") == K.AUTHORIZED))
    if currently:
        rows = rows.filter(F.col("exit_time").isNull())
    return newest(enrich(rows, employees, vehicles).select(*_HEAD))


def absent_on(logs, employees, day) -> DataFrame:
    seen = logs.filter(on_day("entry_time", day)).select("plate_number")
    people = employees.filter("is_active").select("full_name", "department", "plate_number")
    return people.join(seen, "plate_number", "left_anti").select("full_name", "department", "plate_number").orderBy("full_name")


def late_on(logs, employees, day, cutoff="09:15:00") -> DataFrame:
    late = second_of_day(F.col("entry_time")) > seconds(cutoff)
    rows = logs.filter(on_day("entry_time", day) & (F.col("status") == K.AUTHORIZED) & late)
    return newest(enrich(rows, employees).select("id", "employee_name", "department", "plate_number", "entry_time"))


def access_between_times(logs, employees, vehicles, day, start, end) -> DataFrame:
    at = second_of_day(F.col("entry_time"))
    rows = logs.filter(on_day("entry_time", day) & at.between(seconds(start), seconds(end)))
    return enrich(rows, employees, vehicles).select(*_HEAD).orderBy("entry_time", "id")


def access_at_time(logs, employees, vehicles, day, clock) -> DataFrame:
    rows = logs.filter(on_day("entry_time", day) & (second_of_day(F.col("entry_time")) == seconds(clock)))
    return enrich(rows, employees, vehicles).select(*_HEAD).orderBy("entry_time", "id")


def _denied(logs, day) -> DataFrame:
    return logs.filter(on_day("entry_time", day) & F.col("status").isin(K.BLACKLISTED, K.DENIED))


def denied_on(logs, employees, vehicles, day) -> DataFrame:
    return newest(enrich(_denied(logs, day), employees, vehicles).select(*_SHORT))


def denied_count(logs, day) -> DataFrame:
    return _denied(logs, day).agg(F.count("*").alias("denied_count"))


def unknown_on(unknown, day) -> DataFrame:
    rows = unknown.filter(on_day("detected_at", day))
    return newest(rows.select("id", "plate_number", "detected_at", "image_path"), ts="detected_at")


def entry_without_exit(logs, employees, vehicles, day=None) -> DataFrame:
    rows = logs.filter(F.col("exit_time").isNull())
    if day:
        rows = rows.filter(on_day("entry_time", day))
    return newest(enrich(rows, employees, vehicles).select(*_SHORT))


def most_detected(logs, start, end, limit=5) -> DataFrame:
    rows = logs.filter(between_days("entry_time", start, end)).groupBy("plate_number").agg(
        F.count("*").alias("detections")
    )
    return rows.orderBy(F.desc("detections"), "plate_number").limit(limit)


def last_access(logs, employees, vehicles, limit=10) -> DataFrame:
    return enrich(newest(logs, limit), employees, vehicles).select(*_HEAD)


def department_present(logs, employees, day, department) -> DataFrame:
    people = employees.filter(F.col("department") == department).select(
        "plate_number", F.col("full_name").alias("employee_name"), "department"
    )
    rows = logs.filter(on_day("entry_time", day)).join(people, "plate_number")
    return rows.select("employee_name", "department", "plate_number", "entry_time").distinct().orderBy(
        F.desc("entry_time"), "plate_number"
    )


def top_presence(logs, employees, start, end, as_of: datetime, limit=5) -> DataFrame:
    """Total minutes per plate; open stays count until ``as_of``. Aggregates before the join."""
    now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    minutes = seconds_between(F.col("entry_time"), F.coalesce("exit_time", now)) / 60
    rows = logs.filter(between_days("entry_time", start, end) & (F.col("status") == K.AUTHORIZED))
    totals = rows.groupBy("plate_number").agg(F.sum(minutes).alias("total_minutes"))
    people = employees.select("plate_number", F.col("full_name").alias("employee_name"), "department")
    return totals.join(people, "plate_number", "left").orderBy(F.desc("total_minutes"), "plate_number").limit(limit)


def employee_history(logs, employees, name, day=None) -> DataFrame:
    people = employees.filter(F.lower("full_name") == name.lower()).select(
        "plate_number", F.col("full_name").alias("employee_name"), "department"
    )
    rows = logs.filter(on_day("entry_time", day)) if day else logs
    rows = rows.join(people, "plate_number")
    return newest(rows.select("id", "plate_number", "entry_time", "exit_time", "status", "employee_name", "department"))


def employee_info(employees, name) -> DataFrame:
    rows = employees.filter(F.lower("full_name") == name.lower())
    return rows.select("full_name", "department", "plate_number", "employee_code", "is_active")


def plate_owner(people, plate) -> DataFrame:
    """Works on employees and on vehicles."""
    cols = ["full_name", "department", "plate_number", "employee_code", "is_active"]
    if "owner_name" in people.columns:
        cols = ["owner_name", "vehicle_type", "plate_number", "status"]
    return people.filter(F.col("plate_number") == plate).select(*cols)


def plate_status(vehicles, plate) -> DataFrame:
    return vehicles.filter(F.col("plate_number") == plate).select("plate_number", "status", "owner_name", "vehicle_type")


# -- the older access-log shape -------------------------------------------------------------------
def _people(employees) -> DataFrame:
    return employees.select("plate_number", F.col("full_name").alias("name"), "department")


def _log_rows(access, employees) -> DataFrame:
    return access.join(_people(employees), "plate_number", "left").select(
        "plate_number", "access_time", "status", "name", "department"
    )


def _log_top(access, employees, limit) -> DataFrame:
    top = access.orderBy(F.desc("access_time"), "plate_number").limit(limit)
    return _log_rows(top, employees)


def access_last(access, employees, limit=10) -> DataFrame:
    return _log_top(access, employees, limit)


def access_denied(access, employees, limit=20) -> DataFrame:
    return _log_top(access.filter("status = 'denied'"), employees, limit)


def access_entered(access, employees, day) -> DataFrame:
    rows = access.filter(on_day("access_time", day) & (F.col("status") == "authorized"))
    return _log_rows(rows, employees).drop("status").orderBy("access_time", "plate_number")


def access_since(access, employees, since: datetime) -> DataFrame:
    rows = access.filter(
        (F.col("access_time") >= F.lit(since.isoformat(sep=" ")).cast("timestamp_ntz"))
        & (F.col("status") == "authorized")
    )
    return _log_rows(rows, employees).drop("status").orderBy("access_time", "plate_number")


def access_present(access, employees, day) -> DataFrame:
    """Newest access per plate (ties stay) if it is authorised and of that day."""
    rows = latest_rows(access, "plate_number", "access_time")
    rows = rows.filter(on_day("access_time", day) & (F.col("status") == "authorized"))
    return _log_rows(rows, employees).orderBy(F.desc("access_time"), "plate_number")


def access_authorised_list(employees) -> DataFrame:
    return employees.select(F.col("full_name").alias("name"), "plate_number", "department").orderBy("name")


def access_late_top(access, employees, cutoff="09:00:00", limit=10) -> DataFrame:
    late = (F.col("status") == "authorized") & (second_of_day(F.col("access_time")) > seconds(cutoff))
    counts = access.filter(late).groupBy("plate_number").agg(F.count("*").alias("late_count"))
    # Plates without an employee form one group with null name, plate and department.
    rows = counts.join(_people(employees).withColumnRenamed("plate_number", "p"), F.col("plate_number") == F.col("p"), "left")
    rows = rows.groupBy("name", F.col("p").alias("plate_number"), "department").agg(F.sum("late_count").alias("late_count"))
    return rows.orderBy(F.desc("late_count"), "plate_number").limit(limit)


def access_ever_authorised(access, employees) -> DataFrame:
    """Last access per plate that was authorised at least once."""
    rows = access.groupBy("plate_number").agg(
        F.max("access_time").alias("last_access"), F.bool_or(F.col("status") == "authorized").alias("ok")
    )
    return rows.filter("ok").join(_people(employees), "plate_number", "left").select(
        "name", "plate_number", "last_access", "department"
    ).orderBy(F.desc("last_access"), "plate_number")
