"""Log-bilinear language model, trained in numpy with noise-contrastive estimation over all training documents.

Tokens: A-Z lower-cased words between ASCII white space, then one end for each text. Words are known by 64-bit hashes.

* Counts. Word counts of all training documents are summed by Spark. Words with at least 1 / 65,536 of all tokens (so at
  most 65,536 of them) travel to every task; counts of rarer words stay in a table and are joined.
* Model. The end, the `vocabulary - 2` most frequent words and one class for all other words. The class of a token has
  the score (C2 r[w-2] + C1 r[w-1]) . q[w] + b[w] from the two tokens before it, normalised over all classes; a word of
  the last class then has the probability (c + 1) / (N_u + V_u + 1) of its count c within that class (N_u tokens, V_u
  words, one place for words never seen). All probabilities of a context sum to one.
* Training. Each round reads its share of the training documents; every task runs noise-contrastive estimation with
  Adagrad over its rows, from the same start, and the tasks' parameters are averaged, weighted by their tokens. Only
  sums of parameters reach the driver, a fixed number of rows. What is gathered from the corpus, counts and
  parameters per task, grows with it.
* Scores. The logarithms of the normalisers of all pairs of context classes come from batched matrix products, once per
  model. Rare words leave a document as (row, hash, times) and come back as one sum per row.

Rules: null and empty texts are one end; null ids and repeated rows are rows like any other; with no training
documents all counts are 0 and the classes are equally likely. Other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import stored, word_hashes, words_of

FREQUENT, VOCABULARY, WIDTH = 1 << 16, 1024, 16
NOISE, DRAWN, BATCH, RATE, SEED = 8, 16, 1024, 0.2, 7
END, OTHER = 0, 1
HELD_WORDS = 400_000


@dataclass(frozen=True)
class Counts:
    """What all tasks know of the training tokens: totals, and the frequent words (sorted hashes) with counts, classes."""

    tokens: int
    ends: int
    distinct: int
    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    other_tokens: int
    other_distinct: int
    chance: np.ndarray  # of the classes, smoothed by one


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        words = list(counts)
        hashes = word_hashes(words).view(np.int64)
        batch = pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
        counts.clear()
        return batch

    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts.update(words_of(text))
            if len(counts) > HELD_WORDS:
                yield rows()
    yield rows()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): hash and count of every word of the texts."""
    return docs.select("text").mapInArrow(_counted, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def summary(counts: DataFrame, ends: int, vocabulary: int = VOCABULARY) -> Counts:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    tokens = total + ends
    bound = max(1, -(-tokens // FREQUENT))
    rows = sorted(counts.where(F.col("c") >= bound).collect(), key=lambda r: (-r.c, r.word))  # FREQUENT rows at most
    classes = {r.word: k + 2 for k, r in enumerate(rows[: vocabulary - 2])}
    in_classes = sum(r.c for r in rows[: len(classes)])
    rows.sort(key=lambda r: np.uint64(r.word & 0xFFFFFFFFFFFFFFFF))
    other_tokens, other_distinct = total - in_classes, distinct - len(classes)
    chance = np.ones(len(classes) + 2)
    chance[END] += ends
    chance[OTHER] += other_tokens
    for r in rows:
        if r.word in classes:
            chance[classes[r.word]] += r.c
    return Counts(
        tokens, ends, distinct + (ends > 0), np.array([r.word for r in rows], dtype=np.int64).view(np.uint64),
        np.array([r.c for r in rows], dtype=np.int64), np.array([classes.get(r.word, OTHER) for r in rows], dtype=np.int64),
        other_tokens, other_distinct, chance / chance.sum())


def _looked_up(known: Counts, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes, counts) of words; count -1: not among the frequent ones."""
    if not len(known.hashes):
        return np.full(len(hashes), OTHER), np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(known.hashes, hashes), len(known.hashes) - 1)
    there = known.hashes[at] == hashes
    return np.where(there, known.classes[at], OTHER), np.where(there, known.counts[at], -1)


def _shapes(classes: int) -> list[tuple[int, ...]]:
    return [(classes, WIDTH), (classes, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH), (classes,)]


def unpacked(flat: np.ndarray, classes: int) -> list[np.ndarray]:
    """r, q, C1, C2, b of one flat vector."""
    parts, at = [], 0
    for shape in _shapes(classes):
        size = int(np.prod(shape))
        parts.append(flat[at : at + size].reshape(shape))
        at += size
    return parts


def start(chance: np.ndarray) -> np.ndarray:
    draw, n = np.random.default_rng(SEED), len(chance)
    r, q = draw.normal(0, 0.1, (n, WIDTH)), draw.normal(0, 0.1, (n, WIDTH))
    return np.concatenate([r.ravel(), q.ravel(), np.eye(WIDTH).ravel(), 0.3 * np.eye(WIDTH).ravel(), np.log(chance)])


def _scattered(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    flat = (index[:, None] * rows.shape[1] + np.arange(rows.shape[1])).ravel()
    return np.bincount(flat, weights=rows.ravel(), minlength=n * rows.shape[1]).reshape(n, -1)


class Trainer:
    """Noise-contrastive steps on batches of (w-2, w-1, w)."""

    def __init__(self, flat: np.ndarray, chance: np.ndarray, seed: int):
        self.params = [p.astype(np.float32) for p in unpacked(flat, len(chance))]
        self.squares = [np.full_like(p, 1e-3) for p in self.params]
        self.draw, self.sums = np.random.default_rng(seed), np.cumsum(chance)
        self.noise = np.log(NOISE * chance).astype(np.float32)
        self.tokens = 0

    def step(self, two: np.ndarray, one: np.ndarray, word: np.ndarray) -> None:
        r, q, c1, c2, b = self.params
        n, size = len(b), len(word)
        before, near, own = r[two], r[one], q[word]
        hidden = near @ c1 + before @ c2
        drawn = np.minimum(np.searchsorted(self.sums, self.draw.random(DRAWN)), n - 1)
        fake = q[drawn]
        pull = 1 / (1 + np.exp(np.einsum("nd,nd->n", hidden, own) + (b - self.noise)[word]))
        push = np.float32(-NOISE / DRAWN) / (1 + np.exp(-(hidden @ fake.T + (b - self.noise)[drawn])))
        d_hidden = pull[:, None] * own + push @ fake
        d_q = _scattered(word, pull[:, None] * hidden, n)
        np.add.at(d_q, drawn, push.T @ hidden)
        d_b = np.bincount(word, weights=pull, minlength=n)
        np.add.at(d_b, drawn, push.sum(axis=0))
        d_r = _scattered(one, d_hidden @ c1.T, n) + _scattered(two, d_hidden @ c2.T, n)
        for p, g2, g in zip(self.params, self.squares, (d_r, d_q, near.T @ d_hidden, before.T @ d_hidden, d_b), strict=True):
            g = (g / size).astype(np.float32)
            g2 += g * g
            p += np.float32(RATE) * g / np.sqrt(g2)
        self.tokens += size


def _contexts(known: Counts, texts: list[str | None]):
    """(two, one, word) classes of all tokens, word hashes, their counts (-1: rare), tokens per text; ends have no hash."""
    words = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    hashes = word_hashes([w for ws in words for w in ws])
    classes, counts = _looked_up(known, hashes)
    at = np.arange(len(hashes)) + 2 * np.repeat(np.arange(len(words)), sizes) + 2
    whole = np.zeros(len(hashes) + 2 * len(words) + 2, dtype=np.int64)  # two ends before each text; its own end is the next's
    whole[at] = classes
    stops = np.cumsum(sizes) + 2 * np.arange(1, len(words) + 1)
    place = np.sort(np.concatenate([at, stops]))
    return whole[place - 2], whole[place - 1], whole[place], hashes, counts, sizes


def _texts(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = 256):
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            yield part, part.column(column).to_pylist()


def _trained(flat: np.ndarray, known: Counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(flat, known.chance, SEED + TaskContext.get().partitionId())
        held: list[tuple] = []
        size = 0

        def learn() -> None:
            two, one, word = (np.concatenate([h[k] for h in held]) for k in range(3))
            order = trainer.draw.permutation(len(word))
            for k in range(0, len(word), BATCH):
                part = order[k : k + BATCH]
                trainer.step(two[part], one[part], word[part])

        for _, texts in _texts(batches):
            held.append(_contexts(known, texts)[:3])
            size += len(held[-1][2])
            if size >= 128 * BATCH:
                learn()
                held, size = [], 0
        if size:
            learn()
        if trainer.tokens:
            whole = np.concatenate([p.ravel() for p in trainer.params]) * trainer.tokens
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(whole) + 1)), pa.array(np.append(whole, trainer.tokens))], names=["pos", "value"])

    return run


def train(rounds: list[DataFrame], known: Counts) -> np.ndarray:
    """Parameters after one pass over each frame of documents in turn."""
    flat = start(known.chance)
    for docs in rounds:
        sums = docs.select("text").mapInArrow(_trained(flat, known), "pos long, value double").groupBy("pos").agg(F.sum("value").alias("value"))
        got = {r.pos: r.value for r in sums.collect()}  # one row per parameter
        if got:
            flat = np.array([got[k] for k in range(len(flat))]) / got[len(flat)]
    return flat


def _normalisers(flat: np.ndarray, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, q, c1, c2, b = unpacked(flat, classes)
        near, before = r @ c1, r @ c2
        for batch in batches:
            ids = batch.column("id").to_numpy()
            logs = []
            for two in ids:
                scores = (near + before[two]) @ q.T + b
                top = scores.max(axis=1)
                logs.append((top + np.log(np.exp(scores - top[:, None]).sum(axis=1))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(logs, pa.binary())], names=["id", "logs"])

    return run


def normalisers(spark, flat: np.ndarray, classes: int) -> np.ndarray:
    """log Z of every context (w-2, w-1): classes x classes numbers."""
    rows = spark.range(classes, numPartitions=16).mapInArrow(_normalisers(flat, classes), "id long, logs binary").collect()
    return np.stack([np.frombuffer(r.logs) for r in sorted(rows, key=lambda r: r.id)])


SCORED = ("row long, doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, model double, "
          "n_other long, other_counts double, rare array<long>, times array<int>")


def _scored(shared, known: Counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, logs = shared.value
        r, q, c1, c2, b = unpacked(flat, len(known.chance))
        near, before, row = r @ c1, r @ c2, TaskContext.get().partitionId() << 40
        for part, texts in _texts(batches):
            two, one, word, hashes, counts, sizes = _contexts(known, texts)
            token = ((near[one] + before[two]) * q[word]).sum(axis=1) + b[word] - logs[two, one]
            doc = np.repeat(np.arange(len(texts)), sizes)
            n = len(texts)
            ends = np.cumsum(sizes + 1)
            model = np.add.reduceat(token, ends - sizes - 1) / np.log(10)
            seen, in_class = counts >= 0, _looked_up(known, hashes)[0] == OTHER
            log_counts = np.where(seen, np.log10(np.maximum(counts, 0) + 1.0), 0.0)
            rare, times = [], []
            lost = np.flatnonzero(~seen)
            for k, group in enumerate(np.split(hashes[lost], np.searchsorted(doc[lost], np.arange(1, n)))):
                values, number = np.unique(group, return_counts=True)
                rare.append(values.view(np.int64)), times.append(number.astype(np.int32))
            per = lambda weights: np.bincount(doc, weights=weights, minlength=n).astype(np.float64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + n)), part.column("doc_id"), part.column("held_out"), pa.array(sizes + 1),
                pa.array(per(seen & (counts > 0)).astype(np.int64) + int(known.ends > 0)), pa.array(per(log_counts) + np.log10(known.ends + 1.0)),
                pa.array(model), pa.array(per(in_class).astype(np.int64)), pa.array(per(np.where(in_class, log_counts, 0.0))),
                pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))],
                names=[x.split()[0] for x in SCORED.split(", ")])
            row += n

    return run


def score(docs: DataFrame, held_out: Column, rounds: list[Column], vocabulary: int = VOCABULARY) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    held_out marks documents that nothing is learned from; rounds split the others into the passes of the training.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    learn = docs.where(~held_out)
    counts = stored(word_counts(learn), "counts")
    known = summary(counts, learn.count(), vocabulary)
    flat = train([learn.where(r) for r in rounds], known)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((flat, normalisers(spark, flat, len(known.chance))))  # vocabulary^2 numbers
    scored = stored(rows.mapInArrow(_scored(shared, known), SCORED), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    found = rare.join(counts, "word").select("row", "times", (F.log10(F.col("c") + F.lit(1.0)) * F.col("times")).alias("logs"))
    sums = found.groupBy("row").agg(F.sum("times").alias("more_known"), F.sum("logs").alias("more_logs"))
    whole = scored.drop("rare", "times").join(sums, "row", "left")
    more, logs = F.coalesce("more_known", F.lit(0)), F.coalesce("more_logs", F.lit(0.0))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") + logs - F.col("n_tokens") * float(np.log10(known.tokens + known.distinct + 1))).alias("base_score"),
        (F.col("model") + F.col("other_counts") + logs - F.col("n_other") * float(np.log10(known.other_tokens + known.other_distinct + 1))).alias("score"))
