"""Entry/exit sessions from detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnstone.constants import NO_PLATE, RESTRICTED
from turnstone.operators.slots import DAY_SECONDS, slot_of

LOG_COLUMNS = (
    "id",
    "plate_number",
    "entry_time",
    "exit_time",
    "status",
    "image_path",
    "manual_opened",
    "manual_exit_opened",
)


def no_plate_name(ts: Column) -> Column:
    return F.concat(F.lit("NO_PLATE_"), F.date_format(ts, "yyyyMMddHHmmssSSSSSS"))


def with_actions(detections: DataFrame, width_seconds: int = DAY_SECONDS) -> DataFrame:
    """Adds ``action`` (entry / exit / exit_pending) and ``session_no`` to each detection.

    The rule is a two-state machine (open or not). A detection toggles the state, except that a
    restricted status (unknown or blacklisted) leaves an open restricted session open. After two
    restricted detections in a row a session is open whatever happened before, so the state is
    "1 + toggles since the last such repeat, modulo 2". That is a prefix sum, and prefix sums
    combine over time slots: see ``slots``.
    """
    local = Window.partitionBy("plate_number", "slot").orderBy("detected_at", "event_id")
    run = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        detections.withColumn("slot", slot_of(F.col("detected_at"), width_seconds))
        .withColumn("_restricted", F.col("status").isin(*RESTRICTED))
        .withColumn("_rn", F.row_number().over(local))
        .withColumn(
            "_repeat",
            F.coalesce(F.col("_restricted") & F.lag("_restricted").over(local), F.lit(False)),
        )
        .withColumn("_toggle", ((F.col("_rn") > 1) & ~F.col("_repeat")).cast("int"))
        .withColumn("_toggles", F.sum("_toggle").over(run))
        .withColumn(
            "_at_repeat",
            F.last(F.when(F.col("_repeat"), F.col("_toggles")), ignorenulls=True).over(run),
        )
    )
    since = F.col("_toggles") - F.coalesce("_at_repeat", F.lit(0))
    for start in (0, 1):  # state after the slot's first row, not known yet
        base = F.when(F.col("_at_repeat").isNotNull(), F.lit(1)).otherwise(F.lit(start))
        rows = (
            rows.withColumn(f"_state{start}", (base + since) % 2)
            .withColumn(f"_before{start}", F.lag(f"_state{start}").over(local))
            .withColumn(
                f"_entries{start}",
                F.sum(F.when(F.col(f"_before{start}") == 0, 1).otherwise(0)).over(run),
            )
        )

    tails = rows.groupBy("plate_number", "slot").agg(
        F.min_by("_restricted", "_rn").alias("_first_r"),
        F.max_by("_restricted", "_rn").alias("_last_r"),
        F.max_by(since, "_rn").alias("_tail"),
        F.max(F.col("_at_repeat").isNotNull()).alias("_reset"),
        F.max("_entries0").alias("_n0"),
        F.max("_entries1").alias("_n1"),
    )
    across = Window.partitionBy("plate_number").orderBy("slot")
    upto = across.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tails = (
        tails.withColumn(
            "_rep1", F.coalesce(F.col("_first_r") & F.lag("_last_r").over(across), F.lit(False))
        )
        .withColumn("_resets", F.col("_reset") | F.col("_rep1"))
        .withColumn("_add", F.col("_tail") + F.when(F.col("_resets"), 0).otherwise(1))
        .withColumn("_sum", F.sum("_add").over(upto))
        .withColumn(
            "_base",
            F.last(F.when(F.col("_resets"), F.col("_sum") - F.col("_add") - 1), True).over(upto),
        )
        .withColumn("_end", (F.col("_sum") - F.coalesce("_base", F.lit(0))) % 2)
        .withColumn("_in", F.coalesce(F.lag("_end").over(across), F.lit(0)))
        .withColumn("_after1", F.when(F.col("_rep1"), 1).otherwise(1 - F.col("_in")))
        .withColumn("_enter1", (F.col("_in") == 0).cast("int"))
        .withColumn(
            "_n",
            F.col("_enter1") + F.when(F.col("_after1") == 0, F.col("_n0")).otherwise(F.col("_n1")),
        )
        .withColumn("_offset", F.sum("_n").over(upto) - F.col("_n"))
        .select("plate_number", "slot", "_rep1", "_in", "_after1", "_enter1", "_offset")
    )

    first = F.col("_rn") == 1
    zero = F.col("_after1") == 0
    before = F.when(first, F.col("_in")).otherwise(
        F.when(zero, F.col("_before0")).otherwise(F.col("_before1"))
    )
    repeat = F.when(first, F.col("_rep1")).otherwise(F.col("_repeat"))
    action = (
        F.when(before == 0, "entry").when(repeat, "exit_pending").otherwise("exit")
    )
    number = F.col("_offset") + F.col("_enter1") + F.when(zero, F.col("_entries0")).otherwise(
        F.col("_entries1")
    )
    return rows.join(tails, ["plate_number", "slot"]).select(
        *detections.columns, action.alias("action"), number.cast("long").alias("session_no")
    )


def pair_sessions(detections: DataFrame, width_seconds: int = DAY_SECONDS, most: int = 4096) -> DataFrame:
    """Parking logs from ``(event_id, plate_number, detected_at, status, image_path)``.

    Rows without a plate become logs of their own that are never closed. Plates with at most ``most`` detections are
    paired in one sorted pass each; the histories of the others, one in ``most`` rows at the utmost, are cut into time
    slots. Detections are read four times, so dear ones are written first.
    """
    seen = detections.filter(F.col("plate_number") != "")
    hot = F.broadcast(seen.groupBy("plate_number").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("plate_number"))
    few = _paired_at_once(seen.join(hot, "plate_number", "left_anti"))
    many = _paired_over_slots(seen.join(hot, "plate_number", "left_semi"), width_seconds)
    logs = few.unionByName(many)
    took_over = F.col("came.status").isin(*RESTRICTED) & F.col("left").isNotNull()
    paired = logs.select(
        F.col("came.event_id").alias("id"),
        "plate_number",
        F.col("came.detected_at").alias("entry_time"),
        F.col("left.detected_at").alias("exit_time"),
        F.when(took_over, F.col("left.status")).otherwise(F.col("came.status")).alias("status"),
        F.col("came.image_path").alias("image_path"),
        (~F.col("came.status").isin(*RESTRICTED, NO_PLATE)).alias("manual_opened"),
        F.lit(False).alias("manual_exit_opened"),
    )
    return paired.unionByName(no_plate_logs(detections))


CAME, LEFT = ("detected_at", "event_id", "status", "image_path"), ("detected_at", "status")


def _paired_at_once(seen: DataFrame) -> DataFrame:
    """(plate, came, left) by running frames over one sort of a plate's whole history; the rule of ``with_actions``."""
    history = Window.partitionBy("plate_number").orderBy("detected_at", "event_id")
    run = history.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    restricted = F.col("status").isin(*RESTRICTED)
    rows = seen.withColumn("_repeat", F.coalesce(restricted & F.lag(restricted).over(history), F.lit(False))).withColumn(
        "_first", F.row_number().over(history) == 1)
    rows = rows.withColumn("_toggles", F.sum((~F.col("_first") & ~F.col("_repeat")).cast("int")).over(run))
    rows = rows.withColumn("_at_repeat", F.last(F.when(F.col("_repeat"), F.col("_toggles")), ignorenulls=True).over(run))
    rows = rows.withColumn("_open", (1 + F.col("_toggles") - F.coalesce("_at_repeat", F.lit(0))) % 2)
    rows = rows.withColumn("_entry", F.coalesce(F.lag("_open").over(history), F.lit(0)) == 0)
    # what is left are entries and, right behind each, its exit
    rows = rows.filter("_entry or not _repeat").withColumn("left", F.lead(F.struct(*LEFT)).over(history))
    return rows.filter("_entry").select("plate_number", F.struct(*CAME).alias("came"), "left")


def _paired_over_slots(seen: DataFrame, width_seconds: int) -> DataFrame:
    """(plate, came, left) of plates with long histories."""
    steps = with_actions(seen, width_seconds).filter(F.col("action") != "exit_pending")
    came = F.when(F.col("action") == "entry", F.struct(*CAME))
    left = F.when(F.col("action") == "exit", F.struct(*LEFT))
    # One entry and at most one exit per number: groups of two, whatever the plate's share.
    pairs = steps.groupBy("plate_number", "session_no").agg(F.max(came).alias("came"), F.max(left).alias("left"))
    return pairs.drop("session_no")


def no_plate_logs(detections: DataFrame) -> DataFrame:
    blank = detections.filter(F.coalesce("plate_number", F.lit("")) == "")
    return blank.select(
        F.col("event_id").alias("id"),
        no_plate_name(F.col("detected_at")).alias("plate_number"),
        F.col("detected_at").alias("entry_time"),
        F.lit(None).cast(blank.schema["detected_at"].dataType).alias("exit_time"),
        F.lit(NO_PLATE).alias("status"),
        "image_path",
        F.lit(False).alias("manual_opened"),
        F.lit(False).alias("manual_exit_opened"),
    )


def latest_open(logs: DataFrame) -> DataFrame:
    """Newest open log of each plate; an aggregate, so map sides combine before the shuffle."""
    rest = [c for c in logs.columns if c not in ("plate_number", "entry_time", "id")]
    newest = F.max(F.struct("entry_time", "id", *rest)).alias("log")
    return logs.filter(F.col("exit_time").isNull()).groupBy("plate_number").agg(newest).select(
        "plate_number", *[F.col(f"log.{c}").alias(c) for c in logs.columns if c != "plate_number"]
    ).select(*logs.columns)


def multi_scans(logs: DataFrame, minutes: int, width_seconds: int = DAY_SECONDS) -> DataFrame:
    """Longest run of entries with consecutive gaps within ``minutes``, per plate, two or more."""
    from turnstone.operators.slots import add_chains

    chains = add_chains(
        logs.select("plate_number", "entry_time", "id"),
        "plate_number", "entry_time", "id", minutes * 60, width_seconds,
    )
    sizes = chains.groupBy("plate_number", "chain_start").agg(F.count("*").alias("count"))
    return (
        sizes.groupBy("plate_number").agg(F.max("count").alias("count")).filter("count >= 2")
    )
