"""Quality scores from a regularised quadratic discriminant over transformed document statistics.

Model
-----
Each text gives a vector of transformed statistics (`FEATURES`), read from all its bytes and words. Both classes of
the labelled documents get a Gaussian: mean, and a covariance shrunk towards the pooled covariance and towards its
own mean variance, so that it is regular for any number of rows, also one. The Cholesky factors are worked out once
and kept in the model; a score is the logistic of the difference of the two log densities (Mahalanobis terms by
triangular inverses, log determinants from the factors' diagonals) plus the log odds of the classes.

The sums for the fit (counts, sums, products) are added up on the executors over all labelled rows; only matrices of
the number of features reach the driver.

Rules
-----
Null and empty texts have statistics too (all zero shares) and get a score like any other. Labels other than 0 and 1,
null labels and labels without a document are no evidence; a document that is labelled or listed more than once
counts once for each joined row. With no rows of one class, nothing separates them: every score is the smoothed share
(n1 + 1) / (n0 + n1 + 2) and `separates` is false. Columns besides doc_id and text are not read for scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

FEATURES = (
    "log_word_length", "word_length_spread", "letter_share", "digit_share", "stop_comma_share",
    "symbol_share", "capital_share", "log_line_words", "distinct_word_share", "top_word_share", "distinct_line_share",
    "byte_entropy", "symbol_word_share",
)
#: Shares of the pooled covariance and of the mean variance in each class covariance.
POOLED, ROUND = 0.1, 0.05


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, 5, dtype=np.int64)  # 5: symbols and control characters
    for k in range(256):
        c = chr(k)
        if k >= 128 or "a" <= c <= "z":
            kinds[k] = 0
        elif "A" <= c <= "Z":
            kinds[k] = 1
        elif "0" <= c <= "9":
            kinds[k] = 2
        elif c in ".,":
            kinds[k] = 3
        elif c in " \t\n\r\x0b\x0c":
            kinds[k] = 4
    return kinds


KINDS = _byte_classes()
SYMBOLS = bytes(k for k in range(128) if KINDS[k] == 5)


def features(text: str | None) -> np.ndarray:
    """The transformed statistics of one whole text: shares under arcsin(sqrt), sizes under log1p."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    histogram = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    letters, capitals, digits, stops, _, symbols = np.bincount(KINDS, weights=histogram, minlength=6)
    solid = max(1.0, letters + capitals + digits + stops + symbols)
    words = raw.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chance = histogram[histogram > 0] / max(1, len(raw))
    odd_words = sum(c for w, c in counts.items() if len(w.strip(SYMBOLS)) < len(w))
    # a few added words, bytes and lines keep short texts from looking extreme
    share = np.arcsin(np.sqrt(np.clip([
        (letters + capitals + 50) / (solid + 50), digits / (solid + 50), (stops + 1) / (solid + 50),
        symbols / (solid + 50), (capitals + 1) / (solid + 50), (len(counts) + 20) / (n + 20), top / (n + 20),
        (len(set(lines)) + 4) / (len(lines) + 4), odd_words / (n + 5),
    ], 0, 1)))
    entropy = -(chance * np.log2(chance)).sum() + (len(chance) - 1) / (2 * np.log(2) * max(1, len(raw)))
    return np.array([
        np.log1p((lengths.sum() + 40) / (n + 8)), np.log1p(lengths.std() * n / (n + 8)), share[0], share[1], share[2], share[3],
        share[4], np.log1p(n / (len(lines) + 1)), share[5], share[6], share[7], float(entropy), share[8],
    ])


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and constants of both classes; `share` where they can't be told apart."""

    means: np.ndarray
    inverses: np.ndarray
    constants: np.ndarray
    share: float
    separates: bool

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.separates:
            return np.full(len(x), self.share)
        logs = [self.constants[k] - 0.5 * (((x - self.means[k]) @ self.inverses[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def _vectors(texts) -> np.ndarray:
    return np.array([features(t) for t in texts]) if len(texts) else np.zeros((0, len(FEATURES)))


@pandas_udf(ArrayType(DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series(list(_vectors(texts)))


def with_features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every text; small rows that may be stored and joined instead of the texts."""
    return docs.select("doc_id", _features(F.col("text").cast("string")).alias("x"))


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per class for each task: count, sums and products of the vectors."""
    size = len(FEATURES)
    total = np.zeros((2, 1 + size + size * size))
    for batch in batches:
        if len(batch):
            x, y = np.stack(batch["x"].to_numpy()), batch["quality"].to_numpy()
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    yield pd.DataFrame({"quality": [0, 1], "sums": list(total)})


def fit(vectors: DataFrame, labels: DataFrame) -> Model:
    """vectors (doc_id, x), labels (doc_id, quality) of the rows to learn from."""
    marked = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = vectors.join(marked, "doc_id").select("x", "quality")
    parts = known.mapInPandas(_moments, "quality int, sums array<double>").select("quality", F.posexplode("sums"))
    size = len(FEATURES)
    total = np.zeros((2, 1 + size + size * size))
    for row in parts.groupBy("quality", "pos").agg(F.sum("col").alias("total")).collect():  # a fixed number of rows
        total[row.quality, row.pos] = row.total
    n = total[:, 0]
    share = float((n[1] + 1) / (n.sum() + 2))
    if n.min() < 1:
        return Model(np.zeros((2, size)), np.zeros((2, size, size)), np.zeros(2), share, False)
    means = total[:, 1 : 1 + size] / n[:, None]
    scatter = total[:, 1 + size :].reshape(2, size, size) - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / n.sum()
    spread = np.sqrt(np.clip(np.diag(pooled), 1e-6, None))  # shrinkage is to the correlations, not to the units
    inverses, constants = [], []
    for k in (0, 1):
        own = (1 - POOLED) * scatter[k] / n[k] + POOLED * pooled
        unit = own / spread[:, None] / spread[None, :]
        unit = (1 - ROUND) * unit + ROUND * max(np.trace(unit) / size, 1e-3) * np.eye(size)
        factor = np.linalg.cholesky(unit)
        inverses.append(np.linalg.inv(factor) / spread[None, :])
        constants.append(np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum())
    return Model(means, np.array(inverses), np.array(constants), share, True)


def score_column(model: Model, column: str, from_text: bool) -> Column:
    """0 to 1, higher where label 1 is likelier; of a text column, or of a column of vectors."""

    @pandas_udf(DoubleType())
    def score(values: pd.Series) -> pd.Series:
        x = _vectors(values) if from_text else np.stack(values.to_numpy()) if len(values) else np.zeros((0, len(FEATURES)))
        return pd.Series(model.scores(x))

    return score(F.col(column).cast("string") if from_text else F.col(column))
