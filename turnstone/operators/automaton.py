"""State machines over ordered rows as a parallel scan.

Every row is a function from state to state. Functions compose, and composition is associative, so the state before a
row is a prefix composition: inside a slot by doubling (step k looks 2^k rows back over one sort order), across slots by
the same doubling over one summary row per slot. A key that holds a third of all rows is spread over its slots; no list of
rows is collected and no row waits for the one before it.

A machine has up to four states. A function is one number: two bits per state say where it leads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

STATES = 4
IDENTITY = sum(s << (2 * s) for s in range(STATES))


def moves(*targets: int) -> int:
    """The function that leads state s to targets[s]."""
    return sum(t << (2 * s) for s, t in enumerate(targets))


def after(function: str, state: str) -> Column:
    """The state that the function (a column) leads a state (a column or number) to."""
    return F.expr(f"shiftright({function}, 2 * ({state})) & 3")


def composed(first: str, second: str) -> Column:
    """first, then second."""
    parts = [f"shiftleft(shiftright({second}, 2 * (shiftright({first}, {2 * s}) & 3)) & 3, {2 * s})" for s in range(STATES)]
    return F.expr(" | ".join(parts))


def _prefixes(rows: DataFrame, window, most: int) -> DataFrame:
    """Replaces `_f` by the composition of all functions of the window up to the row; `most` rows a window at most."""
    reach = 1
    while reach < most:
        rows = rows.withColumn("_back", F.lag("_f", reach, IDENTITY).over(window)).withColumn("_f", composed("_back", "_f"))
        reach *= 2
    return rows.drop("_back")


def add_state(rows: DataFrame, key: str, slot: str, order: list[str], function: str, start: int = 0) -> DataFrame:
    """Adds `before`, the state in which each row finds its key's machine; `slot` cuts a key's rows in order.

    Two small jobs count rows by slot and slots by key: they say how many doublings are needed.
    """
    sizes = rows.groupBy(key, slot).agg(F.count("*").alias("n"))
    longest, slots = sizes.groupBy(key).agg(F.max("n").alias("n"), F.count("*").alias("s")).agg(F.max("n"), F.max("s")).first()
    local = Window.partitionBy(key, slot).orderBy(*order)
    scanned = _prefixes(rows.withColumn("_f", F.col(function)), local, longest or 0)
    scanned = scanned.withColumn("_upto", F.lag("_f", 1, IDENTITY).over(local))
    whole = scanned.groupBy(key, slot).agg(F.max_by("_f", F.struct(*order)).alias("_f"))
    across = Window.partitionBy(key).orderBy(slot)
    heads = _prefixes(whole, across, slots or 0).withColumn("_head", F.lag("_f", 1, IDENTITY).over(across))
    heads = heads.select(key, slot, after("_head", str(start)).alias("_head"))
    return scanned.join(heads, [key, slot]).withColumn("before", after("_upto", "_head")).drop("_f", "_upto", "_head")
