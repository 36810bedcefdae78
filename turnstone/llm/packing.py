"""Packing of tokenised documents into near-equal windows by Karmarkar-Karp multiway differencing.

Each document is its token ids and one end id. Runs of `capacity` ids are windows of their own; what is left of a
document is cut into pieces of at most `capacity // 4` ids. A block gathers such pieces, in the order of the rows of
its task, until they fill `block` windows. Differencing then splits the block into as many windows as its ids need:
every piece starts as a partial partition with all its ids on one side, and the two partial partitions with the
largest imbalances are merged with their sides opposed, until one is left. If a window of the result exceeds the
capacity, the number of windows rises by one and the block is partitioned again; with one piece per window it always
fits, so that this ends.

A task packs its own rows as they stream by and holds one batch and one block: nothing is shuffled, at most one
window of padding per task is added, and a lost task repeats the same work, since the rows of a scan keep their
order. Sequence ids number the windows of a task, above the task's partition number.

Rules: a null text is empty; an empty document is its end id alone. Null doc_ids stay null; repeated rows are packed
once each; an empty table gives no rows. The words `<|endoftext|>` in a text are ordinary text. Other columns aren't
read.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, BLOCK, END = 2048, 128, 1
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)
# Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose kind every Unicode table agrees on.
PLAIN = r"\t\n\r\x20-\x7E\u00A1-\u024F\u2010-\u2027"
OTHER, CONTROL = re.compile(f"[^{PLAIN}]"), re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")


def _merged(one: list[tuple], two: list[tuple], ways: int) -> list[tuple]:
    """Two partial partitions as one: the fullest sides of each meet the emptiest of the other.

    A partial partition lists its sides that hold something, as (sum above its emptiest side, pieces), ascending; the
    sides not listed are empty.
    """
    shared = len(one) + len(two) - ways
    if shared <= 0:
        return sorted(one + two, key=itemgetter(0))
    met = [(a[0] + b[0], (a[1], b[1])) for a, b in zip(one[:shared], reversed(two[:shared]), strict=True)]
    sides = sorted(met + one[shared:] + two[shared:], key=itemgetter(0))
    low = sides[0][0]
    return [(size - low, pieces) for size, pieces in sides] if low else sides


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Indices of sizes in up to `ways` groups of near-equal sums, by the largest-differencing method."""
    heap = [(-size, k, [(size, k)]) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    fresh = len(sizes)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        sides = _merged(one, heap[0][2], ways)
        spread = sides[-1][0] - (sides[0][0] if len(sides) == ways else 0)
        heapq.heapreplace(heap, (-spread, fresh, sides))
        fresh += 1
    return [_pieces(pieces) for _, pieces in heap[0][2]] if heap else []


def _pieces(tree) -> list[int]:
    found, open_ = [], [tree]
    while open_:
        x = open_.pop()
        if isinstance(x, tuple):
            open_.extend(x)
        else:
            found.append(x)
    return found


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of indices whose sizes, none above the capacity, sum to the capacity at most."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differencing(sizes, ways)
        if all(sum(sizes[k] for k in g) <= capacity for g in groups):
            return groups
        ways += 1


#: White space in one run from which on `tiktoken` is not asked; shorter runs are far below what its stack holds.
LONG_BLANK = 50_000
BLANKS = re.compile(r"\s{1000,}+")


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes.

    The vocabulary file is read twice: by `tokenizers`, and as merge ranks by the faster `tiktoken`. The two differ at
    most where their tables of letters and white space do, so texts with characters other than those of `PLAIN` go to
    `tokenizers`, all others to `tiktoken`; the tests hold both against each other. The pattern of `tiktoken` looks ahead
    behind white space and keeps a stack for it, so texts with a very long run of white space go to `tokenizers` too.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        back = _byte_of_letter()
        ranks = {bytes(back[c] for c in t): k for t, k in self.tokenizer.get_vocab().items() if t not in special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not _long_blank(text) and (text.isascii() and not CONTROL.search(text) or not OTHER.search(text)):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()


def _long_blank(text: str) -> bool:
    return len(text) >= LONG_BLANK and any(len(run) >= LONG_BLANK for run in BLANKS.findall(text))


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class _Out:
    """Rows of one task on their way out."""

    def __init__(self, with_ids: bool):
        self.rows: list[tuple] = []
        self.sequence = TaskContext.get().partitionId() << 40
        self.with_ids = with_ids

    def window(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, length, crc, total, ids in pieces:
            self.rows.append((doc, start, length, crc, total, self.sequence, at, ids))
            at += length
        self.sequence += 1

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        kinds = [pa.int64()] * 7 + [pa.binary()]
        columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
        n = len(names) if self.with_ids else len(names) - 1
        return pa.RecordBatch.from_arrays(arrays[:n], names=names[:n])


def _packed(path: str, capacity: int, block: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, held, size = _encoder(path), _Out(with_ids), [], 0
        tail, piece_size = np.array([end], dtype="<u4").tobytes(), max(1, capacity // 4)

        def flush() -> None:
            nonlocal held, size
            for group in windows([p[2] for p in held], capacity):
                out.window([held[k] for k in sorted(group)])
            held, size = [], 0

        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for doc, text in zip(docs, texts, strict=True):
                ids = encoder.encode(text) + tail
                total, start = len(ids) // 4, 0
                while start < total:
                    full = total - start >= capacity
                    length = capacity if full else min(piece_size, total - start)
                    own = ids[4 * start : 4 * (start + length)]
                    piece = (doc, start, length, zlib.crc32(own), total, own if with_ids else None)
                    start += length
                    if full:
                        out.window([piece])
                        continue
                    held.append(piece)
                    size += length
                    if size >= block * capacity:
                        flush()
                if len(out.rows) >= 4096:
                    yield out.take()
        flush()
        yield out.take()

    return run


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, block: int = BLOCK, end: int = END, with_ids: bool = True
) -> DataFrame:
    """docs (doc_id, text) -> one row per piece: where it starts in its document, its window and its offset there.

    `ids` holds the piece's token ids as little-endian unsigned 32-bit values; leave it out with with_ids=False.
    """
    schema = SCHEMA if with_ids else SCHEMA.rpartition(",")[0]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_packed(tokenizer, capacity, block, end, with_ids), schema)
