"""Ordered scans over long histories without putting one key into one task.

A key's history is cut into time slots. Ordered work runs per (key, slot); each slot leaves one
summary row; a window over the summary rows of a key (one row per slot, however many events the
slot holds) gives what the slot needs to know about its past. A key that holds a third of all
events is thus spread over as many tasks as it has slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DAY_SECONDS = 86400


def slot_of(ts: Column, width_seconds: int = DAY_SECONDS) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / F.lit(width_seconds))


def seconds_between(start: Column, end: Column) -> Column:
    """Exact difference in seconds (microsecond resolution) for both timestamp flavours."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def add_chains(
    df: DataFrame,
    key: str,
    ts: str,
    order_id: str,
    gap_seconds: float,
    width_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Adds ``chain_start``: first time of the run whose consecutive gaps stay within the limit."""
    local = Window.partitionBy(key, "slot").orderBy(ts, order_id)
    rows = df.withColumn("slot", slot_of(F.col(ts), width_seconds))
    rows = rows.withColumn("_prev", F.lag(ts).over(local))
    rows = rows.withColumn(
        "_start",
        F.when(seconds_between(F.col("_prev"), F.col(ts)) > gap_seconds, F.col(ts)),
    ).withColumn("_start", F.max("_start").over(local))

    tails = rows.groupBy(key, "slot").agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.max("_start").alias("_own")
    )
    across = Window.partitionBy(key).orderBy("slot")
    gap = seconds_between(F.lag("_last").over(across), F.col("_first"))
    tails = tails.withColumn("_fresh", gap.isNull() | (gap > gap_seconds))
    # Starts grow with time, so the running maximum is the last start seen.
    tails = tails.withColumn(
        "_carry", F.max(F.coalesce("_own", F.when(F.col("_fresh"), F.col("_first")))).over(across)
    )
    tails = tails.withColumn("_before", F.lag("_carry").over(across))
    head = F.when(F.col("_fresh"), F.col("_first")).otherwise(F.col("_before"))
    tails = tails.select(key, "slot", head.alias("_head"))
    return (
        rows.join(tails, [key, "slot"])
        .withColumn("chain_start", F.coalesce("_start", "_head"))
        .drop("slot", "_prev", "_start", "_head")
    )


DAY_MICROS = DAY_SECONDS * 1_000_000


def add_slots(df: DataFrame, key: str, ts: str, most: int = 4096, name: str = "slot") -> DataFrame:
    """Adds a slot (its start in microseconds) to each row: a day, or a binary part of it where a key's day holds more.

    The widths come from counts, so that a hot key is cut finely and all others keep one slot a day. Equal times share a
    slot whatever their number.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumn("_at", micros).withColumn("_day", F.expr(f"_at - pmod(_at, {DAY_MICROS}L)"))
    cuts = cuts_of(rows, key, "_day", most)
    return rows.join(cuts, [key, "_day"], "left").withColumn(name, slot_start("_at", "_day", "_cuts")).drop("_at", "_day", "_cuts")


def cuts_of(rows: DataFrame, key: str, day: str, most: int) -> DataFrame:
    """(key, day, _cuts): into how many halves of halves the heavy days of a key are cut; other days have no row."""
    heavy = rows.groupBy(key, day).agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    return heavy.select(key, day, F.least(F.ceil(F.log2(F.col("_n") / F.lit(most))), F.lit(24)).cast("int").alias("_cuts"))


def slot_start(at: str, day: str, cuts: str) -> Column:
    width = f"({DAY_MICROS}L div shiftleft(1L, coalesce({cuts}, 0)))"
    return F.expr(f"{day} + ({at} - {day}) div {width} * {width}")
