"""Repeated scans measured from the last *kept* entry.

Entry j follows entry i if it is the first one more than the window after i. The kept entries are the chain of followers
from each plate's first entry. Chains are found without walking them:

* entries that stand alone, farther than the window from both neighbours, are kept and change nothing for others: one sorted
  pass leaves them out, and only the rest takes the way below;
* the follower of every entry comes from one sorted pass over entries and probes (entry time plus window) per slot;
* in a slot, pointers are doubled inside one array of numbers, which gives the last entry that a chain from any entry
  reaches, and so where it enters a later slot: the slot's map;
* an entry after a gap longer than the window is kept whatever came before. Only slots without one need the entry of the
  slot before; there the slot maps are composed, again by doubling, as joins.

Slots have widths from counts, so that a run of any length is spread over many tasks; the number of join rounds is the
logarithm of the longest streak of slots without a gap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnstone.operators.slots import DAY_MICROS, cuts_of, slot_start
from turnstone.session import materialize

ROWS_PER_SLOT = 4096
SLOT = ["plate_number", "slot"]


def _doubled(pointers: Column) -> Column:
    """Where each position's pointers end up: p becomes p after p, as often as the length needs."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(pointers), F.lit(1)).cast("double"))).cast("int"))
    return F.aggregate(rounds, pointers, lambda p, _: F.transform(p, lambda x: F.get(p, x)))


def _reached(pointers: Column, starts: Column) -> Column:
    """All positions on the pointers' ways from the starts: the set doubles with the pointers."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(pointers), F.lit(1)).cast("double"))).cast("int"))
    first = F.struct(pointers.alias("p"), starts.alias("s"))

    def step(acc, _):
        more = F.array_distinct(F.concat(acc["s"], F.transform(acc["s"], lambda x: F.get(acc["p"], x))))
        return F.struct(F.transform(acc["p"], lambda x: F.get(acc["p"], x)).alias("p"), more.alias("s"))

    return F.aggregate(rounds, first, step, lambda acc: acc["s"])


def _followers(logs: DataFrame, gap: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(entries with their followers' slots and positions, slots with the last time before them)."""
    epoch = F.lit("1970-01-01").cast(logs.schema["entry_time"].dataType)
    day = lambda c: F.expr(f"{c} - pmod({c}, {DAY_MICROS}L)")
    rows = logs.filter("entry_time is not null and plate_number is not null").select(
        "plate_number", "id", F.timestamp_diff("MICROSECOND", epoch, F.col("entry_time")).alias("at")).withColumn("_day", day("at"))
    cuts = cuts_of(rows, "plate_number", "_day", most)
    slotted = rows.join(cuts, ["plate_number", "_day"], "left").withColumn("own", slot_start("at", "_day", "_cuts")).drop("_day", "_cuts")
    entries = slotted.select("plate_number", "id", "at", "own", F.lit(0).alias("probe"), F.col("at").alias("place"), F.col("own").alias("slot"))
    asked = slotted.withColumn("place", F.col("at") + gap).withColumn("_day", day("place")).join(cuts, ["plate_number", "_day"], "left")
    probes = asked.select("plate_number", "id", "at", "own", F.lit(1).alias("probe"), "place", slot_start("place", "_day", "_cuts").alias("slot"))
    # Entries at the very end of a window are no followers: they sort before its probe.
    up = Window.partitionBy(*SLOT).orderBy("place", "probe", "id")
    down = Window.partitionBy(*SLOT).orderBy(F.desc("place"), F.desc("probe"), F.desc("id"))
    entry = F.col("probe") == 0
    both = entries.unionByName(probes).withColumn("pos", F.sum((1 - F.col("probe")).cast("long")).over(up) - 1)
    both = both.withColumn("next", F.last(F.when(entry, F.col("pos")), True).over(down.rowsBetween(Window.unboundedPreceding, 0)))

    sizes = both.groupBy(*SLOT).agg(F.max(F.when(entry, F.col("place"))).alias("last"))
    earlier = Window.partitionBy("plate_number").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("plate_number").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    slots = sizes.select(*SLOT, F.max("last").over(earlier).alias("before"),
                         F.last(F.when(F.col("last").isNotNull(), F.col("slot")), True).over(later).alias("then"))
    found = both.filter(~entry).join(slots.select(*SLOT, "then"), SLOT)
    here = F.col("next").isNotNull()
    followed = found.select("plate_number", F.col("own").alias("slot"), "at", "id", F.when(here, F.col("slot")).otherwise(F.col("then")).alias("to"),
                            F.when(here, F.col("next")).otherwise(F.lit(0)).alias("pos"))
    return followed, slots.select(*SLOT, "before")


def _maps(logs: DataFrame, gap: int, most: int) -> DataFrame:
    """One row per slot with entries: ids, pointers inside the slot, where each entry's chain leaves it, sure starts."""
    followed, slots = _followers(logs, gap, most)
    listed = followed.groupBy(*SLOT).agg(F.array_sort(F.collect_list(F.struct("at", "id", "to", "pos"))).alias("e")).join(slots, SLOT)
    inside = F.transform("e", lambda x, i: F.when(x["to"] == F.col("slot"), x["pos"]).otherwise(i.cast("long")).cast("int"))
    gaps = F.transform("e", lambda x, i: x["at"] - F.when(i > 0, F.get(F.col("e"), i - 1)["at"]).otherwise(F.col("before")))
    sure = F.filter(F.transform("gap", lambda g, i: F.when(g.isNull() | (g > gap), i)), lambda i: i.isNotNull())
    rows = listed.withColumn("p", inside).withColumn("gap", gaps).withColumn("sure", sure).withColumn("end", _doubled(F.col("p")))
    leaves = F.transform("end", lambda i: F.struct(F.get(F.col("e"), i)["to"].alias("to"), F.get(F.col("e"), i)["pos"].cast("int").alias("pos")))
    return rows.select(*SLOT, F.col("e.id").alias("ids"), "p", "sure", leaves.alias("leaves"))


def _entered(maps: DataFrame) -> DataFrame:
    """(plate, slot, pos): where the chain of kept entries comes into each slot."""
    target = [F.col("l.to").alias("slot"), F.col("l.pos").alias("pos")]
    known = maps.filter("size(sure) > 0").select("plate_number", F.element_at("leaves", F.element_at("sure", -1) + 1).alias("l"))
    known = known.select("plate_number", *target).filter("slot is not null")
    # Slots without a sure start: streaks of them are crossed by composed maps.
    marked = maps.select(*SLOT, F.when(F.size("sure") > 0, F.col("slot")).alias("_sure"))
    run = Window.partitionBy("plate_number").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    streaks = marked.withColumn("_since", F.last("_sure", True).over(run)).filter("_sure is null").groupBy("plate_number", "_since").count()
    longest = streaks.agg(F.max("count")).first()[0]
    if not longest:
        return known
    one = maps.filter("size(sure) = 0").select(*SLOT, F.posexplode("leaves").alias("pos", "l")).select(
        *SLOT, "pos", F.col("l.to").alias("to"), F.col("l.pos").alias("to_pos")).filter("to is not null")
    key = ["plate_number", "slot", "pos"]
    ends = ["plate_number", F.col("to").alias("slot"), F.col("to_pos").alias("pos")]
    # only positions at which a chain can come in
    one = materialize(one.join(one.select(*ends).union(known).distinct(), key, "left_semi"), "slot-steps")
    met, jump = known, one
    for k in range(max(1, math.ceil(math.log2(longest + 1)))):
        met = materialize(met.unionByName(met.join(jump, key).select(*ends)).distinct(), f"slot-entries-{k}")
        onward = jump.toDF("plate_number", "slot", "pos", "to2", "to_pos2")
        jump = jump.select("plate_number", F.col("slot").alias("s"), F.col("pos").alias("q"), F.col("to").alias("slot"), F.col("to_pos").alias("pos")).join(
            onward, key).select("plate_number", F.col("s").alias("slot"), F.col("q").alias("pos"), F.col("to2").alias("to"), F.col("to_pos2").alias("to_pos"))
        jump = materialize(jump, f"slot-jumps-{k}")
    return met


def _close(logs: DataFrame, gap: int) -> DataFrame:
    """Entries without those that stand alone: farther than the window from the entry before and the one behind.

    Such an entry is kept, and so is the one behind it, with or without it. Entries near the edge of a day stay.
    """
    epoch = F.lit("1970-01-01").cast(logs.schema["entry_time"].dataType)
    rows = logs.filter("entry_time is not null and plate_number is not null").select("plate_number", "id", "entry_time")
    rows = rows.withColumn("_at", F.timestamp_diff("MICROSECOND", epoch, F.col("entry_time"))).withColumn("_day", F.expr(f"_at - pmod(_at, {DAY_MICROS}L)"))
    day = Window.partitionBy("plate_number", "_day").orderBy("_at", "id")
    into = F.expr(f"pmod(_at, {DAY_MICROS}L)")
    near = (F.col("_at") - F.lag("_at").over(day) <= gap) | (F.lead("_at").over(day) - F.col("_at") <= gap)
    rows = rows.withColumn("_near", F.coalesce(near, F.lit(False)) | (into <= gap) | (into >= DAY_MICROS - gap))
    return rows.filter("_near").select("plate_number", "id", "entry_time")


def duplicate_ids(logs: DataFrame, minutes: int, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Ids of entries at most ``minutes`` after the last kept entry of their plate; entries without a time are none.

    Runs jobs: entries that do not stand alone and the slot maps are written once, and once more for each doubling where
    streaks of slots have no gap.
    """
    gap = minutes * 60_000_000
    maps = materialize(_maps(materialize(_close(logs, gap), "close-entries"), gap, rows_per_slot), "slot-maps")
    entered = _entered(maps).groupBy(*SLOT).agg(F.collect_set("pos").alias("entered"))
    rows = maps.join(entered, SLOT, "left")
    starts = F.concat("sure", F.coalesce("entered", F.array().cast("array<int>")))
    every = F.transform("ids", lambda _, i: i)
    again = F.array_except(every, _reached(F.col("p"), starts))
    return rows.select(F.explode(F.transform(again, lambda i: F.get(F.col("ids"), i))).alias("id"))


def mark_duplicates(logs: DataFrame, minutes: int, **options) -> DataFrame:
    dups = duplicate_ids(logs, minutes, **options).withColumn("is_duplicate", F.lit(True))
    return logs.join(dups, "id", "left").withColumn(
        "is_duplicate", F.coalesce("is_duplicate", F.lit(False))
    )
