"""Helpers shared by the operators: reading, stored intermediate tables, words and hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.session import materialize

#: ASCII white space of the token contracts, as a pattern.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WORD_CACHE = 1 << 18
_word_hashes: dict[bytes, int] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a parquet table in the shared folder: read by several branches, safe from lost executors."""
    return materialize(df, name)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def bucket(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n: the folds of the contracts."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; recent words are remembered, the memory for them is bounded."""
    if len(_word_hashes) > WORD_CACHE:
        _word_hashes.clear()
    get, digest, out = _word_hashes.get, xxhash.xxh3_64_intdigest, []
    for w in words:
        h = get(w)
        if h is None:
            h = digest(w)
            if len(_word_hashes) <= WORD_CACHE:
                _word_hashes[w] = h
        out.append(h)
    return np.array(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of all runs of `width` words; fewer words make one shingle, none none."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(width, n)
    total = np.full(n - size + 1, np.uint64(size), dtype=np.uint64)
    for k in range(size):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - size + 1 + k])
    return np.unique(total)


def key_runs(batches, keys: list[str]):
    """Record batches sorted by keys -> (table, starts): whole runs of equal keys, starts with the end appended.

    Only one batch and the run that crosses its end are held.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        starts = _starts(held, keys)
        if len(starts) > 2:
            last = int(starts[-2])
            yield held.slice(0, last), starts[:-1]
            held = held.slice(last)
    if held is not None:
        yield held, _starts(held, keys)


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    changed = np.zeros(rows.num_rows, dtype=bool)
    changed[:1] = True
    for k in keys:
        values = rows.column(k).to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(changed), rows.num_rows)


def grid_parts(size: Column, ident: Column, block: int) -> tuple[Column, Column]:
    """(parts, own): into how many parts a group of `size` rows is split, `block` rows each, and the part of a row."""
    parts = F.ceil(size / F.lit(block)).cast("int")
    return parts, F.pmod(F.xxhash64(ident), parts).cast("int")


def slot_bytes(marks: DataFrame, slots: int) -> bytes:
    """marks (slot, level 1 to 127) with one row per marked slot -> one byte per slot, 1 where none is marked.

    A table of fixed size, whatever the data: it may travel as a literal. Look it up with slot_level().
    """
    every = marks.sparkSession.range(slots, numPartitions=8).select(F.col("id").alias("slot"))
    filled = every.join(marks, "slot", "left").select("slot", F.chr(F.coalesce("level", F.lit(1)).cast("int")).alias("level"))
    blocks = filled.groupBy(F.shiftright("slot", 12).alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slot", "level"))), lambda x: x["level"]), "").alias("part")
    )
    rows = blocks.collect()  # slots / 4096 strings of 4096 characters
    return "".join(r.part for r in sorted(rows, key=lambda r: r.block)).encode("latin-1")


def slot_level(table_bytes: bytes, slot: Column) -> Column:
    return F.ascii(F.substring(F.lit(table_bytes), (slot + 1).cast("int"), F.lit(1)).cast("string"))


def slot_bits(marked: DataFrame, slots: int, name: str) -> Column:
    """marked (slot) -> an array of longs with a bit per slot, set where it is marked: ask has_slot().

    One row of fixed size (slots / 8 bytes), written once and brought to the tasks as a scalar subquery, so that plans hold
    no data. A lambda takes no subquery: there, bring it into a column first, which is copied with rows.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))
    words = marked.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    every = marked.sparkSession.range(slots // 64, numPartitions=8).select(F.col("id").alias("word")).join(words, "word", "left")
    filled = every.select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    whole = filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits"))
    return stored(whole, name).scalar()


def has_slot(bits: Column, slot: Column) -> Column:
    word = F.get(bits, F.shiftright(slot, 6).cast("int"))
    return F.call_function("shiftrightunsigned", word, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
