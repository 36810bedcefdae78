"""Presence reports for a period: anomalies, days, people, totals."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from turnstone import constants as K
from turnstone.operators.dedup import mark_duplicates
from turnstone.operators.joins import directory, known_plates, match_plates, merge_scalars
from turnstone.operators.slots import seconds_between
from turnstone.session import materialize


@dataclass(frozen=True)
class PresenceRules:
    start_minutes: int = K.DAY_START_MINUTES
    late_minutes: int = K.LATE_MINUTES
    dedup_minutes: int = K.DEDUP_MINUTES

    @property
    def cutoff_minutes(self) -> int:
        return self.start_minutes + self.late_minutes


def in_period(ts: Column, start: date, end: date) -> Column:
    """Half-open range over whole days, as plain comparisons that reach the scan."""
    low = datetime.combine(start, time.min)
    high = datetime.combine(end + timedelta(days=1), time.min)
    as_ntz = lambda v: F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")
    return (ts >= as_ntz(low)) & (ts < as_ntz(high))


def is_late(first_entry: Column, cutoff_minutes: int) -> Column:
    midnight = F.to_date(first_entry).cast("timestamp_ntz")
    return seconds_between(midnight, first_entry.cast("timestamp_ntz")) > cutoff_minutes * 60


def _day_label(kind: Column) -> Column:
    """Label of each kind in the daily lists."""
    return F.when(kind == "unknown_plates", "unknown").when(kind == "duplicates", "duplicate").otherwise(kind)


class PresenceReport:
    """One report; each property is one flat table of the nested report.

    The period's logs are written when the report is made, and again with their duplicate marks; the rest is lazy.
    """

    def __init__(
        self,
        logs: DataFrame,
        unknown: DataFrame,
        employees: DataFrame,
        vehicles: DataFrame,
        start: date,
        end: date,
        rules: PresenceRules = PresenceRules(),
    ):
        self.start, self.end, self.rules = start, end, rules
        self.people = directory(employees, vehicles)
        inside = logs.filter(in_period(F.col("entry_time"), start, end)).select(
            "id", "plate_number", "entry_time", "exit_time", "status")
        # Several branches read the period's logs; pairing detections again for each would be waste.
        inside = materialize(inside, "period-logs")
        self.unknown = unknown.filter(in_period(F.col("detected_at"), start, end))
        self.marked = materialize(mark_duplicates(inside, rules.dedup_minutes), "marked-logs")
        self.kept = self.marked.filter(~F.col("is_duplicate"))
        self.orphans = logs.filter(F.col("entry_time").isNull() & in_period(F.col("exit_time"), start, end))

    # -- anomalies ---------------------------------------------------------------------------
    def _checked(self) -> DataFrame:
        """The period's logs with the anomaly kinds of each, in the order of the checks."""
        known = known_plates(self.marked, self.people).withColumn("known", F.lit(True))
        logs = self.marked.join(known, "plate_number", "left")
        open_log = F.col("exit_time").isNull()
        kept = ~F.col("is_duplicate")
        kinds = F.array_compact(F.array(
            F.when(F.col("known").isNull(), "unknown_plates"),
            F.when(F.upper("status") == K.BLACKLISTED, "blacklisted"),
            F.when(F.col("is_duplicate"), "duplicates"),
            F.when(kept & open_log, "entry_without_exit"),
            F.when(kept & (F.col("exit_time") < F.col("entry_time")), "incoherent"),
        ))
        return logs.select(kinds.alias("kinds"), "id", "plate_number", "entry_time", "exit_time", "status")

    def flagged(self) -> DataFrame:
        """One row per (log, anomaly kind)."""
        return self._checked().select(
            F.explode("kinds").alias("kind"), "id", "plate_number", "entry_time", "exit_time", "status"
        )

    def anomalies(self) -> DataFrame:
        """The six-kind feed plus stored unknown detections."""
        none = F.lit(None)
        stamp = "timestamp_ntz"
        orphan = self.orphans.select(
            F.lit("orphan_exit").alias("kind"), "id", "plate_number",
            "entry_time", "exit_time", "status", none.cast(stamp).alias("detected_at"),
        )
        seen = self.unknown.select(
            F.lit("unknown_plates").alias("kind"), "id", "plate_number",
            none.cast(stamp).alias("entry_time"), none.cast(stamp).alias("exit_time"),
            none.cast("string").alias("status"), "detected_at",
        )
        logs = self.flagged().withColumn("detected_at", none.cast(stamp))
        return logs.unionByName(orphan).unionByName(seen)

    def anomaly_counts(self) -> DataFrame:
        return self.anomalies().groupBy("kind").agg(F.count("*").alias("n"))

    def day_labels(self) -> DataFrame:
        """Per plate, day and kind: how often and first when; ``day_label_lists`` has the labels themselves."""
        seen = self.flagged().select("plate_number", _day_label(F.col("kind")).alias("label"), F.col("entry_time").alias("at"))
        left = self.orphans.filter("plate_number <> ''").select("plate_number", F.lit("orphan_exit").alias("label"), F.col("exit_time").alias("at"))
        return seen.unionByName(left).groupBy("plate_number", F.to_date("at").alias("day"), "label").agg(
            F.count("*").alias("n"), F.min("at").alias("first_at")
        )

    def day_label_lists(self) -> DataFrame:
        """Per plate and day: the list of all its labels, by entry time and id, those of one entry in the order of the checks."""
        seen = self._checked().filter(F.size("kinds") > 0).select(
            "plate_number", F.to_date("entry_time").alias("day"), "entry_time", "id", F.transform("kinds", _day_label).alias("labels"))
        # Exits without an entry have no entry time and sort before all entries.
        left = self.orphans.select(
            "plate_number", F.to_date("exit_time").alias("day"), "entry_time", "id", F.array(F.lit("orphan_exit")).alias("labels"))
        events = F.sort_array(F.collect_list(F.struct("entry_time", "id", "labels")))
        return seen.unionByName(left).filter("plate_number <> ''").groupBy("plate_number", "day").agg(
            F.flatten(F.transform(events, lambda e: e["labels"])).alias("labels")
        )

    # -- people ------------------------------------------------------------------------------
    def daily(self) -> DataFrame:
        """Per plate and entry day over kept logs; only aggregates that combine on map sides."""
        closed = F.col("exit_time") >= F.col("entry_time")
        minutes = seconds_between(F.col("entry_time"), F.col("exit_time")) / 60
        days = self.kept.groupBy("plate_number", F.to_date("entry_time").alias("day")).agg(
            F.min("entry_time").alias("first_entry"),
            F.max(F.when(closed, F.col("exit_time"))).alias("last_exit"),
            F.coalesce(F.sum(F.when(closed, minutes)), F.lit(0.0)).alias("total_minutes"),
            F.bool_or(F.col("exit_time").isNull()).alias("incomplete"),
        )
        return days.withColumn("late", is_late(F.col("first_entry"), self.rules.cutoff_minutes))

    def _judged_days(self) -> DataFrame:
        labels = self.day_labels().groupBy("plate_number", "day").agg(
            F.array_sort(F.collect_set("label")).alias("labels")
        )
        days = self.daily().join(labels, ["plate_number", "day"], "left")
        labels_all = F.array_sort(F.array_distinct(F.concat(
            F.coalesce("labels", F.array().cast("array<string>")),
            F.when(F.col("incomplete"), F.array(F.lit("incomplete"))).otherwise(F.array().cast("array<string>")),
        )))
        days = days.withColumn("labels", labels_all)
        status = (
            F.when(F.col("incomplete"), "incomplete")
            .when(F.size("labels") > 0, "anomalie")
            .when(F.col("late"), "late")
            .otherwise("present")
        )
        return days.withColumn("status", status)

    def employee_days(self) -> DataFrame:
        """Dense calendar: one row per person and day of the period."""
        calendar = self.people.select("full_name", "plate_number", F.explode(
            F.sequence(F.lit(self.start), F.lit(self.end))).alias("day"))
        days = calendar.join(self._judged_days(), ["plate_number", "day"], "left")
        return days.select(
            "full_name", "plate_number", "day", "first_entry", "last_exit",
            F.coalesce("total_minutes", F.lit(0.0)).alias("total_minutes"),
            F.coalesce("late", F.lit(False)).alias("late"),
            F.coalesce("status", F.lit("absent")).alias("status"),
            F.coalesce(F.array_join("labels", ","), F.lit("")).alias("anomalies"),
        )

    def employee_period(self) -> DataFrame:
        """One row per person. Works on days with data only; absence is the rest of the span."""
        span = (self.end - self.start).days + 1
        per_plate = self._judged_days().groupBy("plate_number").agg(
            F.count("*").alias("days_present"),
            F.count_if("late").alias("late_count"),
            F.sum("total_minutes").alias("minutes"),
            F.count_if(F.col("status").isin("incomplete", "anomalie")).alias("anomalies_count"),
            F.min("first_entry").alias("first_arrival"),
            F.max("last_exit").alias("last_exit"),
        )
        rows = self.people.join(per_plate, "plate_number", "left")
        present = F.coalesce("days_present", F.lit(0))
        late, odd = F.coalesce("late_count", F.lit(0)), F.coalesce("anomalies_count", F.lit(0))
        status = (
            F.when(~F.col("is_active"), "inactive").when(odd > 0, "anomalie")
            .when(late > 0, "retard").when(present > 0, "present").otherwise("absent")
        )
        minutes = F.coalesce("minutes", F.lit(0.0))
        return rows.select(
            "full_name", "plate_number", "department", "employee_code", "is_active",
            present.alias("days_present"), (F.lit(span) - present).alias("days_absent"),
            late.alias("late_count"), F.round(minutes, 2).alias("total_minutes"),
            F.when(present > 0, F.round(minutes / present, 2)).otherwise(F.lit(0.0)).alias("avg_minutes"),
            odd.alias("anomalies_count"), status.alias("status"), "first_arrival", "last_exit",
        )

    def summary(self) -> DataFrame:
        name_rank = F.struct(F.lower(F.coalesce("full_name", F.lit(""))).alias("n"), F.col("plate_number").alias("p"))
        people = self.employee_period()
        present = F.sum("days_present")
        minutes = F.sum("total_minutes")
        totals = people.agg(
            F.count("*").alias("total_employees"),
            F.count_if(F.col("days_present") > 0).alias("employees_present"),
            F.count_if(F.col("days_present") <= 0).alias("employees_absent"),
            F.coalesce(present, F.lit(0)).alias("total_presences"),
            F.coalesce(F.sum("late_count"), F.lit(0)).alias("total_late"),
            F.round(F.coalesce(minutes, F.lit(0.0)), 2).alias("total_presence_minutes"),
            F.when(present > 0, F.round(minutes / present, 2)).otherwise(F.lit(0.0)).alias("avg_presence_minutes"),
            F.min("first_arrival").alias("first_arrival"),
            F.min(F.when(F.col("first_arrival").isNotNull(), F.struct("first_arrival", name_rank.alias("r"), "full_name"))).getField("full_name").alias("first_arrival_name"),
            F.max("last_exit").alias("last_exit"),
            F.min(F.when(F.col("last_exit").isNotNull(), F.struct(
                (-F.unix_micros(F.col("last_exit").cast("timestamp"))).alias("late"), name_rank.alias("r"), "full_name"
            ))).getField("full_name").alias("last_exit_name"),
        )
        odd = self.anomalies().agg(F.count("*").alias("total_anomalies"))
        return merge_scalars(totals, odd)

    def accesses(self) -> DataFrame:
        """Kept logs with the resolved person, newest first."""
        match = match_plates(self.kept, self.people.withColumn("_n", F.lower(F.coalesce("full_name", F.lit("")))), ["_n"])
        names = self.people.select(F.col("plate_number").alias("matched_plate"), F.col("full_name").alias("employee_name"))
        who = match.join(names, "matched_plate").select("plate_number", "employee_name")
        rows = self.kept.join(who, "plate_number", "left").select(
            "id", "employee_name", "plate_number", "entry_time", "exit_time",
            F.coalesce("status", F.lit("-")).alias("status"),
        )
        return rows.orderBy(F.desc("entry_time"), "id")


def report_period(kind: str, **given) -> tuple[date, date]:
    """First and last day of a report request; raises on missing or inverted limits."""
    if kind == "daily":
        if not given.get("date"):
            raise ValueError("a daily report needs a date")
        return given["date"], given["date"]
    start, end = given.get("start_date"), given.get("end_date")
    year, month, week = given.get("year"), given.get("month"), given.get("week")
    if kind in ("weekly", "custom") and start and end:
        if start > end:
            raise ValueError("the period ends before it starts")
        return start, end
    if kind == "weekly" and year and week:
        first = date.fromisocalendar(year, week, 1)
        return first, first + timedelta(days=6)
    if kind == "monthly" and year and month:
        first = date(year, month, 1)
        following = (first + timedelta(days=31)).replace(day=1)
        return first, following - timedelta(days=1)
    if kind == "yearly" and year:
        return date(year, 1, 1), date(year, 12, 31)
    raise ValueError(f"report request {kind!r} is incomplete or unknown")


def request_periods(requests: DataFrame) -> DataFrame:
    """``report_period`` for a table of requests; invalid ones get null limits and an ``error``."""
    monday = lambda y: F.date_trunc("week", F.make_date(y, F.lit(1), F.lit(4))).cast("date")
    iso_start = F.date_add(monday(F.col("year")), ((F.col("week") - 1) * 7).cast("int"))
    given = F.col("start_date").isNotNull() & F.col("end_date").isNotNull()
    kind = F.col("report_type")
    month_start = F.make_date("year", "month", F.lit(1))
    limits = lambda a, b: F.struct(a.alias("period_start"), b.alias("period_end"))
    period = (
        F.when(kind == "daily", limits(F.col("date"), F.col("date")))
        .when(kind.isin("weekly", "custom") & given, limits(F.col("start_date"), F.col("end_date")))
        .when(kind == "weekly", limits(iso_start, F.date_add(iso_start, 6)))
        .when(kind == "monthly", limits(month_start, F.last_day(month_start)))
        .when(kind == "yearly", limits(F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31))))
    )
    rows = requests.withColumn("_p", period)
    a, b = F.col("_p.period_start"), F.col("_p.period_end")
    error = F.when(a.isNull() | b.isNull(), "incomplete").when(a > b, "inverted")
    ok = error.isNull()
    return rows.withColumn("error", error).withColumn("period_start", F.when(ok, a)).withColumn(
        "period_end", F.when(ok, b)
    ).drop("_p")
