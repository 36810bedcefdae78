"""Near duplicates by many universal hash minima: bands, signature check, full sets, star components.

Rules
-----
Words are lower-cased (A-Z) and split at ASCII white space; a document's set holds its distinct shingles of `width`
words, with fewer words the whole sequence as one shingle. Documents with 100 * |A and B| >= 80 * |A or B| (for
similarity 0.8) are linked; a document without words links with nothing. A doc_id names one document: rows that repeat
an id are the same document. Documents without an id keep a null id, and groups with ids never take it as their name.
An empty table gives an empty result; other columns are not read.

Method
------
1. Documents with the same word sequence form one class, named by its smallest id.
2. `bands * rows` minima per class; every band of `rows` minima is a bucket key. At similarity 0.8 a pair misses all
   36 bands of 5 with a probability of about 6e-7.
3. In each bucket, members meet its smallest, its largest and its best connected member. Signatures drop pairs far below the bound, the
   most similar partner of each class is verified on full sets first, and then all pairs that still lie between
   components.
4. Buckets that still hold several components give the exact rest: each member outside the bucket's largest component
   meets all members of other components, by longer signatures in cells of a bucket, and full sets decide. No partner or bucket is capped, and a group that is one component never
   emits its pairs.
Links between documents of one component decide nothing more, so they are not all listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import grid_parts, key_runs, shingle_set, stored, word_hashes, words_of
from turnstone.llm.components import components

BANDS, ROWS, SEED = 36, 5, 20240115
#: The estimate from 180 one-byte minima has a standard deviation of 0.03 at 0.8; four of them are allowed.
SLACK = 0.125
PIECE = 4096
#: Minima of the signatures for the exact rest: four standard deviations are 0.06. Rows per side of a cell.
LONG, LONG_SLACK, CELL = 720, 0.06, 2048
SKETCH = "row long, doc_id long, class_high long, class_low long, n_shingles long, bands array<long>, signature binary"


def _family(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    odd = draw.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return odd, draw.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32)


def minima(shingles: np.ndarray, odd: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The minimum of (odd * x + shift) mod 2^32 over all shingles, for each function of the family."""
    low = np.full(len(odd), 0xFFFFFFFF, dtype=np.uint32)
    keys = (shingles >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(keys), PIECE):
        part = keys[start : start + PIECE]
        np.minimum(low, (odd[:, None] * part[None, :] + shift[:, None]).min(axis=1), out=low)
    return low


def _sketches(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd, shift = _family(bands * rows)
        for batch in batches:
            ids, high, low, sizes, keys, signatures = batch.column("doc_id"), [], [], [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                if not words:
                    high.append(0), low.append(0), sizes.append(0), keys.append(None), signatures.append(None)
                    continue
                shingles = shingle_set(word_hashes(words), width)
                least = minima(shingles, odd, shift)
                digest = xxhash.xxh3_128_digest(b" ".join(words))
                one, two = np.frombuffer(digest, dtype="<i8").tolist()
                high.append(one), low.append(two), sizes.append(len(shingles))
                table = least.reshape(bands, rows)
                keys.append([xxhash.xxh3_64_intdigest(table[k].tobytes(), seed=k) - (1 << 63) for k in range(bands)])
                signatures.append((least & np.uint32(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), ids, pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                names=["row", "doc_id", "class_high", "class_low", "n_shingles", "bands", "signature"],
            )

    return run


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            one = np.frombuffer(b"".join(batch.column("sig_a").to_pylist()), dtype=np.uint8)
            two = np.frombuffer(b"".join(batch.column("sig_b").to_pylist()), dtype=np.uint8)
            same = (one == two).reshape(batch.num_rows, -1).mean(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(same)], names=["a", "b", "estimate"]
            )


def _verified(width: int, least: Fraction):
    up, down = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y, one, two in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "text_a", "text_b")), strict=True):
                p, q = (shingle_set(word_hashes(words_of(t)), width) for t in (one, two))
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both and down * both >= up * (len(p) + len(q) - both):
                    a.append(x), b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


class _Search:
    """The stored tables of one run and the checks of pairs of nodes."""

    def __init__(self, docs: DataFrame, width: int, similarity: float, bands: int, rows: int):
        self.least, self.width = Fraction(similarity).limit_denominator(1000), width
        read = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
        self.texts = docs.select(*read)
        row = (F.col("_row") if "_row" in docs.columns else F.lit(None)).cast("long").alias("row")
        self.sketches = stored(docs.select(row, *read).mapInArrow(_sketches(width, bands, rows), SKETCH), "sketches")
        whole = self.sketches.where("n_shingles > 0")
        by_class = whole.groupBy("class_high", "class_low").agg(F.min("doc_id").alias("first"))
        named = F.coalesce("first", -1 - F.abs(F.shiftright("class_high", 1)))
        self.classes = stored(by_class.select("class_high", "class_low", "first", named.alias("node")), "classes")
        # one row per class: the row of its smallest id; rows that repeat it say the same
        heads = whole.join(self.classes, ["class_high", "class_low"]).where("doc_id <=> first")
        self.nodes = stored(heads.select("node", "class_high", "class_low", "n_shingles", "bands", "signature")
                            .dropDuplicates(["node"]), "nodes")

    def crowds(self) -> DataFrame:
        """(band, node, n_shingles, low, high, hub) of all buckets with two members or more."""
        rows = self.nodes.select(F.explode("bands").alias("band"), "node", "n_shingles")
        ends = rows.groupBy("band").agg(
            F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("size")
        ).where("low < high")
        members = stored(rows.join(ends, "band"), "members")
        # the origin of a family of variants shares most buckets with most of them: it has the most neighbours in all
        weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
        known = members.join(weight, "node")
        hubs = known.groupBy("band").agg(F.max(F.struct("weight", "node")).alias("top"))
        return stored(members.join(hubs.select("band", F.col("top.node").alias("hub")), "band"), "crowds")

    def checked(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and signatures allow the similarity, with the estimate."""
        node = self.nodes.select("node", "n_shingles", "signature")
        one, two = (node.toDF(k, f"n_{k}", f"sig_{k}") for k in "ab")
        s = float(self.least)
        sized = pairs.join(one, "a").join(two, "b").where(
            F.least("n_a", "n_b") * self.least.denominator >= F.greatest("n_a", "n_b") * self.least.numerator
        )
        close = sized.select("a", "b", "sig_a", "sig_b").mapInArrow(_estimates, "a long, b long, estimate double")
        return close.where(F.col("estimate") >= s - SLACK)

    def keep_texts(self, crowds: DataFrame) -> None:
        """Stores the texts of nodes that have a partner, one per node."""
        wanted = crowds.select("node").distinct().join(self.classes, "node").select("node", "first", "class_high", "class_low")
        by_id = self.texts.join(wanted.where("first is not null").select("node", F.col("first").alias("doc_id")), "doc_id")
        self.bodies = by_id.select("node", "text")
        if self.classes.where("first is null").limit(1).count():
            digest = self.texts.where("doc_id is null").mapInArrow(_bodies_without_id, "class_high long, class_low long, text string")
            self.bodies = self.bodies.unionByName(digest.join(wanted.where("first is null"), ["class_high", "class_low"]).select("node", "text"))
        self.bodies = stored(self.bodies, "bodies").dropDuplicates(["node"])

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        one, two = (self.bodies.toDF(k, f"text_{k}") for k in "ab")
        full = pairs.select("a", "b").join(one, "a").join(two, "b")
        return stored(full.mapInArrow(_verified(self.width, self.least), "a long, b long"), name)


def _bodies_without_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        high, low, texts = [], [], []
        for text in batch.column("text").to_pylist():
            if words := words_of(text):
                one, two = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), dtype="<i8").tolist()
                high.append(one), low.append(two), texts.append(text)
        yield pa.RecordBatch.from_arrays(
            [pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(texts, pa.string())],
            names=["class_high", "class_low", "text"],
        )


def _between(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components; nodes without a link are components of their own."""
    one, two = (found.toDF(k, f"c_{k}") for k in "ab")
    joined = pairs.join(one, "a", "left").join(two, "b", "left")
    return joined.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select(*pairs.columns)


def _long_signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd, shift = _family(BANDS * ROWS + LONG)
        odd, shift = odd[-LONG:], shift[-LONG:]
        for batch in batches:
            signs = [(minima(shingle_set(word_hashes(words_of(t)), width), odd, shift) & np.uint32(255)).astype(np.uint8).tobytes()
                     for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(signs, pa.binary())], names=["node", "sign"])

    return run


def _met_in_cells(least: Fraction):
    """Pairs of rows outside and inside of each cell that sizes, components and long signatures allow."""
    bound = float(least) - LONG_SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in key_runs(batches, ["band", "i", "j"]):
            node, size, part, main, outer = (rows.column(k).to_numpy() for k in ("node", "n_shingles", "c", "main", "outer"))
            sign = np.frombuffer(b"".join(rows.column("sign").to_pylist()), dtype=np.uint8).reshape(-1, LONG)
            bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
            band, a, b = rows.column("band").to_numpy(), [], []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                cell = np.arange(lo, hi)
                inside = cell[outer[lo:hi] == 0]
                for x in cell[outer[lo:hi] == 1]:
                    fit = inside[(part[inside] != part[x]) & ((part[inside] == main[x]) | (node[inside] > node[x]))
                                 & (np.minimum(size[inside], size[x]) * least.denominator
                                    >= np.maximum(size[inside], size[x]) * least.numerator)]
                    near = fit[(sign[fit] == sign[x]).mean(axis=1) >= bound] if len(fit) else fit
                    shared = bands[near] == bands[x]  # a pair is reported in its first bucket alone
                    near = near[bands[x][shared.argmax(axis=1)] == band[x]]
                    a.append(np.minimum(node[near], node[x])), b.append(np.maximum(node[near], node[x]))
            none = np.zeros(0, dtype=np.int64)
            pairs = np.unique(np.stack([np.concatenate([none, *a]), np.concatenate([none, *b])]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return run


def _rest(run: _Search, crowds: DataFrame, found: DataFrame) -> DataFrame:
    """All pairs of one bucket in different components that may be similar: members outside its largest component
    against the others, compared within cells of a bucket, so that only what passes becomes a row."""
    named = crowds.join(found.toDF("node", "c"), "node", "left").select(
        "band", "node", "n_shingles", "size", F.coalesce("c", "node").alias("c")
    )
    sizes = named.groupBy("band", "c").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("band").agg(F.max(F.struct("n", "c")).alias("most"), F.count(F.lit(1)).alias("parts"))
    split = stored(named.join(mixed.where("parts > 1").select("band", F.col("most.c").alias("main")), "band"), "split")
    wanted = split.select("node").distinct()
    signs = run.bodies.join(wanted, "node").mapInArrow(_long_signatures(run.width), "node long, sign binary")
    signs = stored(signs.join(run.nodes.select("node", "bands"), "node"), "signs")
    parts, own = grid_parts(F.col("size"), F.col("node"), CELL)
    cells = split.withColumn("parts", parts).withColumn("own", own)
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    columns = ["band", "i", "j", "node", "n_shingles", "c", "main", "outer"]
    outside = cells.where("c <> main").withColumn("j", every).withColumn("i", F.col("own")).withColumn("outer", F.lit(1))
    inside = cells.withColumn("i", every).withColumn("j", F.col("own")).withColumn("outer", F.lit(0))
    rows = outside.select(columns).unionByName(inside.select(columns)).join(signs, "node")
    spread = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return spread.mapInArrow(_met_in_cells(run.least), "a long, b long").distinct()


def _grouped(run: _Search) -> DataFrame:
    """(class_high, class_low, first, component) of all classes with words."""
    crowds = run.crowds()
    run.keep_texts(crowds)
    ends = crowds.select(F.col("low").alias("a"), F.col("node").alias("b")).unionByName(
        crowds.select(F.col("node").alias("a"), F.col("high").alias("b"))
    ).unionByName(crowds.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")))
    pairs = stored(run.checked(ends.where("a < b").distinct()), "pairs")
    partners = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "estimate"))
    best = partners.groupBy("a").agg(F.max(F.struct("estimate", "b")).alias("top"))
    first = run.verified(best.select(F.least("a", "top.b").alias("a"), F.greatest("a", "top.b").alias("b")).distinct(), "links")
    second = run.verified(_between(pairs, components(first)), "links")
    links = first.unionByName(second)
    left = _rest(run, crowds, components(links)).join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    third = run.verified(left, "links")
    found = components(links.unionByName(third)).toDF("node", "component")
    return run.classes.join(found, "node", "left").select(
        "class_high", "class_low", "first", F.coalesce("component", "node").alias("component")
    )


def near_duplicates(
    docs: DataFrame, width: int = 5, similarity: float = 0.8, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id, kept), one row per row of docs.

    component_id is the smallest id of the component, kept says that a row bears it.
    """
    run = _Search(docs.select("doc_id", "text"), width, similarity, bands, rows)
    named = _grouped(run)
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = named.join(names, "component").select("class_high", "class_low", "component_id")
    lone = run.sketches.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    grouped = run.sketches.where("n_shingles > 0").select("doc_id", "n_shingles", "class_high", "class_low").join(
        by_class, ["class_high", "class_low"]
    )
    return grouped.select("doc_id", "n_shingles", "component_id").unionByName(lone).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def keep_one(
    docs: DataFrame, width: int = 5, similarity: float = 0.8, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row of each component, with all columns of docs: that of the smallest id, rows without an id last.

    Of rows that repeat an id, or have none, the first stored one stays. Rows without words all stay.
    """
    numbered = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    run = _Search(numbered.select("_row", "doc_id", "text"), width, similarity, bands, rows)
    one = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("one")
    heads = run.sketches.where("n_shingles > 0").groupBy("class_high", "class_low").agg(one)
    kept = heads.join(_grouped(run), ["class_high", "class_low"]).groupBy("component").agg(F.min("one").alias("one"))
    stay = kept.select(F.col("one.row").alias("_row")).unionByName(
        run.sketches.where("n_shingles = 0").select(F.col("row").alias("_row")))
    return numbered.join(stay, "_row", "left_semi").select(docs.columns)
