"""Dashboard, statistics, alerts and log edits."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnstone import constants as K
from turnstone.functions.plates import display_plate, loose_key, normalize_plate, plate_query_key
from turnstone.operators.joins import active_directory, known_plates, match_plates, merge_scalars
from turnstone.operators.reports import PresenceRules, in_period, is_late
from turnstone.operators.sessions import latest_open
from turnstone.operators.slots import seconds_between, slot_of
from turnstone.session import materialize


class PresenceOverview:
    """One day's dashboard; the directory holds active employees only."""

    def __init__(self, logs, unknown, employees, day: date, rules: PresenceRules = PresenceRules()):
        self.rules = rules
        self.people = active_directory(employees).join(employees.select("plate_number", "id"), "plate_number")
        self.logs = materialize(logs.filter(in_period(F.col("entry_time"), day, day)), "day-logs")
        self.unknown = unknown.filter(in_period(F.col("detected_at"), day, day))

    def matched(self) -> DataFrame:
        match = match_plates(self.logs, self.people, ["id"], one_index=True)
        return self.logs.join(match, "plate_number").withColumnRenamed("matched_plate", "canonical")

    def accesses(self) -> DataFrame:
        """Directory logs; of restricted ones only the newest per person, shown as authorised."""
        rows = self.matched()
        legacy = F.col("status").isin(*K.RESTRICTED)
        newest = rows.filter(legacy).groupBy("canonical").agg(
            F.max(F.struct("entry_time", "id")).getField("id").alias("id")
        ).select("id", F.lit(True).alias("newest"))
        kept = rows.join(newest, "id", "left").filter(~legacy | F.col("newest"))
        names = self.people.select(
            F.col("plate_number").alias("canonical"), F.col("full_name").alias("employee_name"), "department"
        )
        return kept.withColumn("status", F.when(legacy, K.AUTHORIZED).otherwise(F.col("status"))).join(
            names, "canonical"
        ).drop("newest")

    def first_entries(self) -> DataFrame:
        first = self.accesses().groupBy("canonical").agg(F.min("entry_time").alias("first_entry"))
        return first.withColumn("late", is_late(F.col("first_entry"), self.rules.cutoff_minutes))

    def unknown_outside(self) -> DataFrame:
        return self.unknown.join(known_plates(self.unknown, self.people), "plate_number", "left_anti")

    def summary(self) -> DataFrame:
        merged = merge_scalars(
            self.people.agg(F.count("*").alias("total_employees")),
            self.first_entries().agg(
                F.count("*").alias("employees_present"), F.count_if("late").alias("total_late")
            ),
            self.unknown_outside().agg(F.count("*").alias("unknown_plates")),
        )
        gap = F.col("total_employees") - F.col("employees_present")
        return merged.withColumn("employees_absent", F.greatest(gap, F.lit(0)))


def stats_snapshot(logs: DataFrame, unknown: DataFrame, vehicles: DataFrame, day: date) -> DataFrame:
    """Seven dashboard numbers from one pass per table."""
    today = in_period(F.col("entry_time"), day, day)
    stay = seconds_between(F.col("entry_time"), F.col("exit_time")) / 60
    merged = merge_scalars(
        vehicles.agg(
            F.count("*").alias("total_vehicles"),
            F.count_if(F.col("status") == K.AUTHORIZED).alias("authorized"),
            F.count_if(F.col("status") == K.BLACKLISTED).alias("blacklisted"),
        ),
        unknown.agg(F.count_if(in_period(F.col("detected_at"), day, day)).alias("unknown_today")),
        logs.agg(
            F.count_if(today).alias("entries_today"),
            F.coalesce(F.avg(F.when(today, stay)), F.lit(0.0)).alias("average_parking_minutes_today"),
            F.count_if(F.col("exit_time").isNull() & (F.col("status") == K.AUTHORIZED)).alias("currently_inside"),
        ),
    )
    return merged


def blacklisted_recent(vehicles: DataFrame, limit: int) -> DataFrame:
    since = F.coalesce("blacklisted_at", "created_at")
    return vehicles.filter(F.col("status") == K.BLACKLISTED).orderBy(since.desc(), "id").limit(limit)


def alerts(vehicles: DataFrame, unknown: DataFrame, limit: int) -> DataFrame:
    bad = blacklisted_recent(vehicles, limit).select(
        F.lit("blacklisted").alias("kind"), "plate_number", F.coalesce("blacklisted_at", "created_at").alias("seen_at")
    )
    new = unknown.orderBy(F.desc("detected_at"), "id").limit(limit).select(
        F.lit("unknown").alias("kind"), "plate_number", F.col("detected_at").alias("seen_at")
    )
    return bad.unionByName(new)


def close_sessions(logs: DataFrame, commands: DataFrame) -> DataFrame:
    """Explicit exits ``(plate_number, exit_time)``: result per command.

    The first command of a plate closes its newest open log; with none left it is "not found".
    """
    first = commands.groupBy("plate_number").agg(F.min("exit_time").alias("exit_time"), F.count("*").alias("n"))
    target = latest_open(logs).select("plate_number", F.col("id").alias("log_id"))
    hit = first.join(target, "plate_number", "left")
    return hit.select(
        "plate_number", "exit_time", F.col("log_id").isNotNull().alias("closed"), "log_id",
        (F.col("n") - F.col("log_id").isNotNull().cast("int")).cast("long").alias("not_found"),
    )


def _by_number(commands: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, j, at): the first commands of each key, numbered by time from 1; `wanted` says how many (key, most)."""
    rows = commands.withColumn("slot", slot_of(F.col("at")))
    earlier = Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("key", "slot").count().select("key", "slot", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start"))
    useful = starts.join(wanted, "key").filter("start < most")
    number = F.col("start") + F.row_number().over(Window.partitionBy("key", "slot").orderBy("at"))
    return rows.join(useful, ["key", "slot"]).select("key", number.alias("j"), "at", "most").filter("j <= most").drop("most")


def manual_open(logs: DataFrame, commands: DataFrame) -> DataFrame:
    """Manual gate commands ``(plate_number, opened_at)`` on open restricted logs.

    A command, in order of time, finds the newest open restricted log whose plate equals its own exactly, normalised
    or loosely. The first command of a log sets its entry, which is then the log's time, the second its exit; later
    ones go to the next open log.

    Equal plates have equal loose keys, so a key is a group of its own. Its k-th newest log takes command k as long as
    no log opened before is newer than the next one. From then on whatever is opened is the newest and closed next, so
    that the rest, opened logs (one command) and others (two), follow newest first: running sums give the numbers.
    """
    def key(df: DataFrame) -> DataFrame:
        plate = F.coalesce("plate_number", F.lit(""))
        loose = loose_key(plate)
        return df.withColumn("key", F.when(loose != "", F.concat(F.lit("l"), loose)).otherwise(F.concat(F.lit("e"), plate)))

    pending = key(logs.filter(F.col("exit_time").isNull() & F.col("status").isin(*K.RESTRICTED)))
    newest = Window.partitionBy("key").orderBy(F.desc("entry_time"), F.desc("id"))
    numbered = pending.select("key", "id", "entry_time", F.coalesce("manual_opened", F.lit(False)).alias("was"),
                              F.row_number().over(newest).alias("k"))
    asked = key(commands.filter("plate_number is not null and opened_at is not null")).select(
        "key", F.col("opened_at").cast(logs.schema["entry_time"].dataType).alias("at"))
    times = materialize(_by_number(asked, numbered.groupBy("key").agg((2 * F.count("*")).alias("most"))), "commands")

    met = numbered.join(times.withColumnRenamed("j", "k"), ["key", "k"], "left")
    opened = F.when(~F.col("was") & F.col("at").isNotNull(), F.struct("at", "id"))
    still = F.struct(F.col("entry_time").alias("at"), "id")
    turn = F.when(F.lead(still).over(newest).isNull() | (F.max(opened).over(newest) > F.lead(still).over(newest)), F.col("k"))
    first = F.col("k") <= F.col("m")
    rest = met.withColumn("turn", turn).withColumn("m", F.min("turn").over(Window.partitionBy("key"))).withColumn(
        "rank", F.when(first, opened).otherwise(still)).withColumn(
        "cost", F.when(first, (~F.col("was")).cast("int")).otherwise(2 - F.col("was").cast("int")))
    order = Window.partitionBy("key").orderBy(F.desc_nulls_last("rank"), F.col("k")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("m") + F.sum("cost").over(order)
    placed = rest.select(
        "key", "id", F.when(~F.col("was"), F.when(first, F.col("k")).otherwise(last - 1)).alias("one"),
        F.when(first & F.col("was"), F.col("k")).otherwise(last).alias("two"))
    acts = placed.join(times.toDF("key", "one", "first_at"), ["key", "one"], "left").join(
        times.toDF("key", "two", "second_at"), ["key", "two"], "left").filter("first_at is not null or second_at is not null")
    return pending.join(acts.select("id", "first_at", "second_at"), "id").select(
        "id", "plate_number", "status", F.coalesce("first_at", "entry_time").alias("entry_time"),
        F.col("second_at").alias("exit_time"), F.lit(True).alias("manual_opened"),
        F.col("second_at").isNotNull().alias("manual_exit_opened"),
    )


def access_search(rows: DataFrame, text: str = "", at: str = "", mode: str = "entry") -> DataFrame:
    """Dashboard filter: name contains or plate equals; time ``HH:MM`` exact or ``HH`` and later."""
    import re

    text, at = text.strip(), at.strip()
    exact = re.fullmatch(r"([01]?\d|2[0-3]):([0-5]\d)", at)
    hour = re.fullmatch(r"([01]?\d|2[0-3]):?", at)
    if at and not exact and not hour:
        return rows.limit(0)
    if text:
        wanted = plate_query_key(F.lit(text))
        plate = F.col("plate_number")
        rows = rows.filter(
            F.lower(F.coalesce("employee_name", F.lit(""))).contains(text.lower())
            | (plate_query_key(plate) == wanted)
            | (plate_query_key(display_plate(plate)) == wanted)
        )
    if at:
        ts = F.col("exit_time" if mode == "exit" else "entry_time")
        if exact:
            rows = rows.filter((F.hour(ts) == int(exact[1])) & (F.minute(ts) == int(exact[2])))
        else:
            rows = rows.filter(F.hour(ts) >= int(hour[1]))
    return rows


def log_signature(logs: DataFrame) -> DataFrame:
    """Signature of the newest log; a change tells a viewer to refresh."""
    text = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(""))
    newest = logs.agg(F.max(F.struct("entry_time", "id", "exit_time")).alias("l"))
    return newest.select(
        F.concat_ws("|", F.col("l.id").cast("string"), text("l.entry_time"), text("l.exit_time")).alias("signature")
    )


def evaluate(detections: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Access decision per detection ``(event_id, plate_text, detected_at)``."""
    from turnstone.functions.plates import arabic_placeholder, has_arabic
    from turnstone.operators.joins import lookup_vehicle

    rows = detections.withColumn("normalized", normalize_plate(F.trim("plate_text")))
    rows = rows.withColumn("fallback", arabic_placeholder(F.col("normalized")))
    wanted = rows.select(F.col("normalized").alias("plate_number")).union(rows.select("fallback")).distinct()
    found = lookup_vehicle(wanted, vehicles)
    fields = [c for c in found.columns if c != "plate_number"]

    def side(name: str) -> DataFrame:
        return found.select(F.col("plate_number").alias(name), F.struct(*fields).alias(f"_{name}"))

    rows = rows.join(side("normalized"), "normalized", "left")
    # The placeholder form is tried only where the plate itself is not registered.
    rows = rows.withColumn("fallback", F.when(
        F.col("_normalized").isNull() & (F.col("fallback") != F.col("normalized")), F.col("fallback")))
    rows = rows.join(side("fallback"), "fallback", "left").withColumn("v", F.coalesce("_normalized", "_fallback"))
    blank = F.col("normalized") == ""
    vs = F.col("v.vehicle_status")
    status = F.when(blank, K.NO_PLATE).when(vs.isin(K.AUTHORIZED, K.BLACKLISTED), vs).otherwise(K.UNKNOWN)
    rows = rows.withColumn("status", status)
    known = F.col("status").isin(K.AUTHORIZED, K.BLACKLISTED)
    # Action texts per status.
    action = (
        F.when(F.col("status") == K.NO_PLATE, "No plate detected")
        .when(F.col("status") == K.AUTHORIZED, "Gate Opened")
        .when(F.col("status") == K.BLACKLISTED, "SECURITY ALERT")
        .otherwise("Capture stored")
    )
    log_plate = F.when(~known | has_arabic(F.col("normalized")), F.col("normalized")).otherwise(
        F.coalesce("fallback", "normalized")
    )
    return rows.select(
        "event_id", "detected_at", "status", action.alias("action"),
        F.when(F.col("status") == K.AUTHORIZED, "OPEN").otherwise("CLOSED").alias("gate"),
        F.when(known, F.col("v.owner_name")).alias("owner_name"),
        F.when(known, F.col("v.vehicle_type")).alias("vehicle_type"),
        F.when(F.col("status") == K.BLACKLISTED, F.coalesce("v.blacklist_reason", F.lit(K.SUSPICIOUS))).alias("reason"),
        F.when(known, F.col("v.matched_plate")).alias("matched_plate"),
        F.when(blank, "").otherwise(log_plate).alias("plate_number"),
    )
