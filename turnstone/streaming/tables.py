"""Results of streams as tables that every micro-batch updates.

The table is the state: a batch is aggregated by itself and merged into the rows that it touches, so that the newest day
and open chains are there after each batch, late rows still count, and nothing is kept in memory between batches. A batch
number that is done already changes nothing.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from turnstone import constants as K
from turnstone.operators.slots import add_chains, seconds_between
from turnstone.session import materialize
from turnstone.sources.versions import VersionedTable

DAYS = "day date, detections long, unknown long"
CHAINS = "plate_number string, started timestamp_ntz, ended timestamp_ntz, count long"
ROWS = "event_id long, plate_number string, detected_at timestamp_ntz, status string"
DELAY = timedelta(hours=1)


class DailyCounts:
    """Detections and unknown ones per day; rows more than the delay behind the newest are also noted as late."""

    def __init__(self, spark: SparkSession, path: str, delay: timedelta = DELAY):
        self.spark, self.table, self.delay = spark, VersionedTable(spark, path), delay

    def read(self) -> DataFrame:
        return self.table.read("days", DAYS)

    def late(self) -> DataFrame:
        return self.table.read("late", f"{ROWS}, batch long")

    def apply(self, rows: DataFrame, number: int) -> bool:
        if number <= self.table.number:
            return False
        batch = materialize(rows.select(*[F.col(c).cast(t) for c, t in (x.split() for x in ROWS.split(", "))]), "day-rows")
        newest = self.table.read("newest", "newest timestamp_ntz").first()
        kept = [e for e in self.table.entries if e[0] == "late"]
        if newest and newest[0]:
            late = batch.filter(F.col("detected_at") < F.lit(newest[0] - self.delay))
            kept += self.table.write(late.withColumn("batch", F.lit(number).cast("long")), "late", number)
        counts = batch.groupBy(F.to_date("detected_at").alias("day")).agg(
            F.count("*").alias("detections"), F.count_if(F.col("status") == K.UNKNOWN).alias("unknown"))
        merged = self.read().unionByName(counts).groupBy("day").agg(F.sum("detections").alias("detections"), F.sum("unknown").alias("unknown"))
        kept += self.table.write(merged, "days", number)
        last = batch.agg(F.max("detected_at").alias("newest"))
        known = self.table.read("newest", "newest timestamp_ntz").unionByName(last).agg(F.max("newest").alias("newest"))
        self.table.commit(number, [*kept, *self.table.write(known, "newest", number)])
        return True

    def sink(self):
        return lambda batch, number: self.apply(batch, number)


def merged_chains(chains: DataFrame, minutes: int) -> DataFrame:
    """Chains whose gaps are within the limit become one: their counts add up."""
    order = Window.partitionBy("plate_number").orderBy("started", "ended")
    reached = F.max("ended").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((seconds_between(reached, F.col("started")) > 60 * minutes).cast("long"), F.lit(1))
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = chains.withColumn("_fresh", fresh).withColumn("_chain", F.sum("_fresh").over(run))
    return rows.groupBy("plate_number", "_chain").agg(
        F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("count").alias("count")).drop("_chain")


class Chains:
    """Runs of close detections per plate, kept by the day they start on; only touched days are written anew."""

    def __init__(self, spark: SparkSession, path: str, minutes: int):
        self.spark, self.table, self.minutes = spark, VersionedTable(spark, path), minutes

    def stored(self) -> DataFrame:
        return self.table.read("chains", f"{CHAINS}, day date", "day")

    def read(self, least: int = 2) -> DataFrame:
        return self.stored().filter(F.col("count") >= least).select("plate_number", "started", "count")

    def apply(self, rows: DataFrame, number: int) -> bool:
        if number <= self.table.number:
            return False
        seen = rows.filter("plate_number <> ''").select("plate_number", F.col("detected_at").cast("timestamp_ntz").alias("at"), "event_id")
        runs = add_chains(materialize(seen, "chain-rows"), "plate_number", "at", "event_id", 60 * self.minutes)
        fresh = materialize(runs.groupBy("plate_number", F.col("chain_start").alias("started")).agg(
            F.max("at").alias("ended"), F.count("*").alias("count")).select("plate_number", "started", "ended", "count"), "batch-chains")
        first, last = fresh.agg(F.min("started"), F.max("ended")).first()
        entries = self.table.entries
        if first is not None:
            gap = timedelta(minutes=self.minutes)
            near = self.stored().filter((F.col("ended") >= F.lit(first - gap)) & (F.col("started") <= F.lit(last + gap)))
            near = materialize(near.join(fresh.select("plate_number").distinct(), "plate_number"), "near-chains")
            days = {r[0] for r in near.select("day").distinct().collect()}
            days |= {r[0] for r in fresh.select(F.to_date("started")).distinct().collect()}
            others = self.stored().filter(F.col("day").isin(sorted(days))).join(near.select("plate_number", "started"), ["plate_number", "started"], "left_anti")
            merged = merged_chains(fresh.unionByName(near.drop("day")), self.minutes).withColumn("day", F.to_date("started"))
            written = self.table.write(merged.unionByName(others), "chains", number, "day")
            entries = [e for e in entries if e[1] not in days] + written
        self.table.commit(number, entries)
        return True

    def sink(self):
        return lambda batch, number: self.apply(batch, number)
