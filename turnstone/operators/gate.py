"""Detections and gate commands of each plate as one history: what every event does, and the logs that come of it.

Kinds of events ``(event_id, plate_number, detected_at, status, image_path, kind)``:

* ``detect`` opens a log, or closes the open one; a restricted status leaves an open restricted log open.
* ``manual_open`` sets the entry of an open restricted log to its own time; the next one closes the log.
* ``exit`` closes whatever is open.

A plate is closed, open, open and restricted, or that and opened by hand: a machine of four states, run as a parallel
scan over slots whose widths come from counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from turnstone import constants as K
from turnstone.operators.automaton import add_state, after, moves
from turnstone.operators.slots import add_slots

CLOSED, OPEN, RESTRICTED, BY_HAND = range(4)
DETECT, MANUAL, EXIT = "detect", "manual_open", "exit"
# What an event makes of the states closed, open, restricted and opened by hand.
SEEN = moves(OPEN, CLOSED, CLOSED, CLOSED)
SEEN_RESTRICTED = moves(RESTRICTED, CLOSED, RESTRICTED, BY_HAND)
OPENED_BY_HAND = moves(CLOSED, OPEN, BY_HAND, CLOSED)
LEFT = moves(CLOSED, CLOSED, CLOSED, CLOSED)
ORDER = ["detected_at", "event_id"]


def with_actions(events: DataFrame, rows_per_slot: int = 4096) -> DataFrame:
    """Adds ``action`` (null where an event does nothing) and ``session_no``, the plate's entries so far."""
    restricted = F.col("status").isin(*K.RESTRICTED)
    function = F.when(F.col("kind") == MANUAL, OPENED_BY_HAND).when(F.col("kind") == EXIT, LEFT).when(
        restricted, SEEN_RESTRICTED).otherwise(SEEN)
    slotted = add_slots(events, "plate_number", "detected_at", rows_per_slot).withColumn("_move", function)
    rows = add_state(slotted, "plate_number", "slot", ORDER, "_move").withColumn("_then", after("_move", "before"))
    detect, before, then = F.col("kind") == DETECT, F.col("before"), F.col("_then")
    action = (
        F.when(detect & (before == CLOSED), "entry")
        .when((before == CLOSED) | (F.col("kind") == MANUAL) & (before == OPEN), None)
        .when(then == CLOSED, F.when(F.col("kind") == MANUAL, "manual_exit").otherwise("exit"))
        .when(detect, "exit_pending").otherwise("manual_entry")
    )
    rows = rows.withColumn("action", action).withColumn("_entry", F.coalesce((F.col("action") == "entry").cast("long"), F.lit(0)))
    counts = rows.groupBy("plate_number", "slot").agg(F.sum("_entry").alias("_n"))
    earlier = Window.partitionBy("plate_number").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("plate_number", "slot", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    run = Window.partitionBy("plate_number", "slot").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("_own", F.sum("_entry").over(run)).join(starts, ["plate_number", "slot"])
    return numbered.select(*events.columns, "before", "action", (F.col("_start") + F.col("_own")).alias("session_no"))


def sessions(acted: DataFrame) -> DataFrame:
    """One row per log: its first event, the command that opened it, its last event; groups combine on map sides."""
    when = lambda *actions: F.col("action").isin(*actions)
    event = F.struct("detected_at", "event_id", "status", "image_path", (F.col("kind") == DETECT).alias("seen"),
                     (F.col("action") == "manual_exit").alias("by_hand"), "before")
    rows = acted.filter("action is not null").groupBy("plate_number", "session_no").agg(
        F.max(F.when(when("entry"), event)).alias("came"), F.max(F.when(when("manual_entry"), event)).alias("opened"),
        F.max(F.when(when("exit", "manual_exit"), event)).alias("left"))
    took_over = F.col("left.seen") & (F.col("left.before") != OPEN)
    return rows.select(
        F.col("came.event_id").alias("id"), "plate_number",
        F.coalesce("opened.detected_at", "came.detected_at").alias("entry_time"), F.col("left.detected_at").alias("exit_time"),
        F.when(took_over, F.col("left.status")).otherwise(F.col("came.status")).alias("status"), F.col("came.image_path").alias("image_path"),
        (~F.col("came.status").isin(*K.RESTRICTED, K.NO_PLATE) | F.col("opened").isNotNull()).alias("manual_opened"),
        F.coalesce(F.col("left.by_hand"), F.lit(False)).alias("manual_exit_opened"),
        F.col("came.detected_at").alias("seen_at"), F.col("came.status").alias("seen_status"),
        F.col("opened.event_id").alias("opened_by"), F.col("left.event_id").alias("left_by"), "session_no")


def changes(acted: DataFrame, logs: DataFrame) -> DataFrame:
    """One row per event that does something: the log as it stands after it."""
    of = logs.select("plate_number", "session_no", F.col("id").alias("log_id"), F.struct("seen_at", "entry_time", "exit_time", "status", "seen_status", "opened_by").alias("l"))
    rows = acted.filter("action is not null").join(of, ["plate_number", "session_no"])
    moved = (F.col("before") == BY_HAND) | (F.col("action") == "manual_entry")
    ends = F.col("action").isin("exit", "manual_exit")
    return rows.select(
        "event_id", "plate_number", "log_id", "action", F.when(moved, F.col("l.entry_time")).otherwise(F.col("l.seen_at")).alias("entry_time"),
        F.when(ends, F.col("l.exit_time")).alias("exit_time"), F.when(ends, F.col("l.status")).otherwise(F.col("l.seen_status")).alias("status"))
