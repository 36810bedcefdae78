"""Minimum-cost-flow resharding: which bytes of each old shard go to which new shard, and the rows that carry them.

The flow network has an arc from every old to every new shard; a byte that stays costs nothing, one that moves costs 1
(or what a cost matrix says). Supplies are the old shards' bytes, demands the new capacities. The solved transfers are
byte ranges of each old shard. Its rows, in a fixed order, fall into these ranges by running sums: sums of blocks
first, then inside each block, so that a shard with a third of all rows is many small windows. A row goes where its
middle byte lies, so every new shard is within one row per transfer of its capacity.

Rules: a null text has no bytes; each row counts one byte more. Null shard keys and those outside the old
shards are together one more old shard, all of whose bytes move; rows keep their own key. Equal rows are rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.llm.common import stored

BLOCK_ROWS = 20_000


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]] | None = None) -> list[list[int]]:
    """Whole-number flows from supplies to demands of the same total at the least cost, by shortest augmenting paths."""
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    rows, columns = len(supply), len(demand)
    cost = cost or [[int(i != j) for j in range(columns)] for i in range(rows)]
    flow = [[0] * columns for _ in range(rows)]
    left, open_ = list(supply), list(demand)
    while any(left):
        # Bellman-Ford over old shards (0..rows-1) and new shards (rows..): forward arcs, and backward ones with flow
        far = [0 if left[i] else None for i in range(rows)] + [None] * columns
        back: list[int | None] = [None] * (rows + columns)
        changed = True
        while changed:
            changed = False
            for i in range(rows):
                for j in range(columns):
                    a, b = far[i], far[rows + j]
                    if a is not None and (b is None or a + cost[i][j] < b):
                        far[rows + j], back[rows + j], changed = a + cost[i][j], i, True
                    elif b is not None and flow[i][j] and (a is None or b - cost[i][j] < a):
                        far[i], back[i], changed = b - cost[i][j], rows + j, True
        end = min((j for j in range(columns) if open_[j]), key=lambda j: far[rows + j])
        path, node = [], rows + end
        while back[node] is not None:
            path.append((back[node], node))
            node = back[node]
        amount = min([left[node], open_[end], *(flow[y][x - rows] for x, y in path if x >= rows)])
        for x, y in path:
            if x < rows:
                flow[x][y - rows] += amount
            else:
                flow[y][x - rows] -= amount
        left[node] -= amount
        open_[end] -= amount
    return flow


def capacities(total: int, shards: int) -> list[int]:
    """Near-equal whole bytes per shard."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def transfers(flow: list[list[int]]) -> list[tuple[int, int, int, int]]:
    """(old, new, from byte, to byte) of every old shard; the bytes that stay come first."""
    found = []
    for old, row in enumerate(flow):
        at = 0
        for new in sorted(range(len(row)), key=lambda j: (j != old, j)):
            if row[new]:
                found.append((old, new, at, at + row[new]))
                at += row[new]
    return found


def reshard(docs: DataFrame, old_shard: Column, old_shards: int, new_shards: int, demand: list[int] | None = None,
            carried: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text) with an old shard number each -> doc_id, size, text_crc32, old_shard, shard, slot.

    slot numbers the rows of a new shard from 0 without gaps. demand gives the new capacities, near-equal otherwise.
    carried names more columns of docs for the result, as rewrite() needs the text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    more = [F.struct(*carried).alias("carried")] if carried else []
    rows = stored(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        old_shard.cast("int").alias("old_shard"), F.monotonically_increasing_id().alias("row"), *more), "rows")
    inner = F.col("old_shard").between(0, old_shards - 1)
    rows = rows.withColumn("lane", F.when(inner, F.col("old_shard")).otherwise(old_shards))
    known = {r.lane: (r.bytes, r.n) for r in rows.groupBy("lane").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}  # one row per old shard
    supply = [known.get(k, (0, 0))[0] for k in range(old_shards + 1)]
    cost = [[int(i != j or i == old_shards) for j in range(new_shards)] for i in range(old_shards + 1)]
    flow = min_cost_flow(supply, demand or capacities(sum(supply), new_shards), cost)
    cuts = rows.sparkSession.createDataFrame(transfers(flow) or [(0, 0, 0, 0)], "cut_old int, shard int, low long, high long")
    blocks = max(1, sum(n for _, n in known.values()) // BLOCK_ROWS)
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    by_block = blocked.groupBy("lane", "block").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("lane").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = by_block.select("lane", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("lane", "block").orderBy("row")
    placed = blocked.join(base, ["lane", "block"]).withColumn(
        "middle", F.col("base") + F.sum("size").over(inside) - F.ceil(F.col("size") / 2))
    # at most one row per pair of an old and a new shard
    there = placed.join(F.broadcast(cuts), (F.col("lane") == F.col("cut_old")) & (F.col("middle") >= F.col("low"))
                        & (F.col("middle") < F.col("high")))
    there = stored(there.select("doc_id", "size", "text_crc32", "old_shard", "lane", "shard", "block", "row", *(["carried"] if carried else [])), "placed")
    counts = there.groupBy("shard", "lane", "block").count()
    ahead = Window.partitionBy("shard").orderBy("lane", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "lane", "block", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "lane", "block").orderBy("row")
    return there.join(starts, ["shard", "lane", "block"]).select(
        "doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("start") + F.row_number().over(own) - 1).alias("slot"), *(["carried.*"] if carried else []))


def rewrite(docs: DataFrame, path: str, affected: list[int]) -> None:
    """Rewrites the folders of the affected shards, docs carrying a `shard` column; other shards' files stay.

    An affected shard that has no rows any more is left with an empty file.
    """
    mine = docs.where(F.col("shard").isin(affected))
    mine.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    filled = {r.shard for r in mine.select("shard").distinct().collect()}  # at most one row per affected shard
    for shard in sorted(set(affected) - filled):
        mine.where(F.lit(False)).drop("shard").write.mode("overwrite").parquet(f"{path}/shard={shard}")
