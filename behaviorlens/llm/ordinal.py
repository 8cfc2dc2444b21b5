"""Quality by ordinal regression on graded ratings.

A cumulative-link (proportional odds) model: one weight vector over hashed
text features is shared by all grades, and ordered thresholds cut its score,
``P(grade <= k) = sigmoid(threshold_k - w.x)``.  That gives an expected grade
and the probability of the top grade, by which documents are selected.

The fit takes a sample of ``max_labelled`` labelled documents at most (those
with the smallest hash of their id), so its cost on the driver is bounded;
every document is scored, in one pass over its whole text.

Features: tokens (lower-cased words, and runs of other symbols) hashed to
``2**bits`` buckets with value ``1 + ln(count)``, divided by the fourth root
of their sum of squares, so a long text neither drowns nor outweighs; and a
few of the text's shape (share of distinct tokens, of the most frequent one,
of symbols and digits, mean length, length).

Defined results: NULL and empty texts have the shape features of an empty
text and are scored; rows whose rating is NULL are not used for the fit; a
document with several ratings counts once for each; documents with equal ids
are scored separately; without any rated document every score is NULL and
nothing is selected; an empty table gives an empty one; texts are scored whole,
of any length; a probability equal to the least one selects.  Extra columns pass
through whatever their names, but for those named like an added one, which it
replaces.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rated documents that a fit takes at most.
MAX_LABELLED = 12_000
BITS = 18
EPOCHS, RATE, RIDGE = 200, 0.1, 3e-5
#: Probability of the top grade from which a document is selected.
MIN_TOP = 0.6
SHAPE = 7
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Entries of a task's token table.
REMEMBERED = 500_000


class Features:
    """Hashed features of texts: (indices, values)."""

    def __init__(self, bits: int = BITS) -> None:
        self.size = 1 << bits
        self.known: dict[str, int] = {}

    def _index(self, token: str) -> int:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        at = self.known[token] = zlib.crc32(token.encode()) % self.size
        return at

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        counts = Counter(TOKEN.findall(text.lower()))
        known = self.known
        index = np.fromiter((known[t] if t in known else self._index(t) for t in counts), np.int64, len(counts))
        count = np.fromiter(counts.values(), np.float64, len(counts))
        value = 1 + np.log(count)
        value /= max(1.0, float(value @ value)) ** 0.25
        n = max(1.0, count.sum())
        first = "".join([t[0] for t in counts])
        symbol = np.fromiter((not c.isalnum() for c in first), bool, len(first))
        digit = np.fromiter((c.isdigit() for c in first), bool, len(first))
        shape = [len(counts) / n, count.max(initial=0) / n, min(len(text) / n, 20) / 20, count[symbol].sum() / n, count[digit].sum() / n, min(n, 1000) / 1000, math.log1p(n) / 12]
        return np.concatenate((index, self.size + np.arange(SHAPE))), np.concatenate((value, shape))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(index: np.ndarray, value: np.ndarray, begins: np.ndarray, grades: np.ndarray, n_grades: int, size: int, epochs: int = EPOCHS, rate: float = RATE, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by full-batch Adam on the negative log
    likelihood; row ``i`` has the features ``begins[i]:begins[i + 1]``."""
    n = len(grades)
    row = np.repeat(np.arange(n), np.diff(begins))
    theta = np.concatenate((np.zeros(size), np.linspace(-1.0, 1.0, n_grades - 1) if n_grades > 2 else np.zeros(1)))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    top, bottom = grades == n_grades - 1, grades == 0
    for epoch in range(1, epochs + 1):
        w, cuts = theta[:size], theta[size:]
        score = np.add.reduceat(value * w[index], begins[:-1])
        upper = np.where(top, 1.0, _sigmoid(cuts[np.minimum(grades, n_grades - 2)] - score))
        lower = np.where(bottom, 0.0, _sigmoid(cuts[np.maximum(grades - 1, 0)] - score))
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        grad = np.concatenate((np.bincount(index, value * (du - dl)[row], size) / n + ridge * w, np.zeros(n_grades - 1)))
        for k in range(n_grades - 1):
            grad[size + k] = (dl[grades == k + 1].sum() - du[grades == k].sum()) / n
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
        theta[size:].sort()
    return theta[:size], theta[size:]


def _featured(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in batches:
            each = [features.of(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in each], pa.list_(pa.int32())), pa.array([x for _, x in each], pa.list_(pa.float32()))], ["grade", "index", "value"])

    return run


def train(docs: DataFrame, rated: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, bits: int = BITS) -> Model | None:
    """Model of ``rated`` (id, grade) documents; None if there are none."""
    sample = rated.select(F.col(id_col).alias("id"), F.col("grade").cast("int").alias("grade")).dropna()
    sample = sample.orderBy(F.xxhash64("id"), "id", "grade").limit(max_labelled)
    # bounded by max_labelled rows of two numbers
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    rows = texts.select("grade", "text").mapInArrow(_featured(bits), "grade int, index array<int>, value array<float>").toArrow()
    if not rows.num_rows:
        return None
    index, value = (rows.column(c).combine_chunks() for c in ("index", "value"))
    lengths = np.array([len(x) for x in index], np.int64)
    begins = np.concatenate(([0], np.cumsum(lengths)))
    flat = index.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy().astype(np.float64)
    # rows in an order that does not depend on the partitions
    order = np.lexsort((np.add.reduceat(flat[1], begins[:-1]), np.add.reduceat(flat[0], begins[:-1]), lengths))
    pick = np.concatenate([np.arange(begins[i], begins[i + 1]) for i in order])
    grades = rows.column("grade").to_numpy()[order].astype(np.int64)
    size = (1 << bits) + SHAPE
    weights, thresholds = fit(flat[0][pick], flat[1][pick], np.concatenate(([0], np.cumsum(lengths[order]))), grades, n_grades, size)
    return Model(weights.astype(np.float32), thresholds, bits)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.bits)
        for batch in batches:
            scores = []
            for text in batch.column(batch.num_columns - 1):
                index, value = features.of(text.as_py() or "")
                scores.append(float(model.weights[index] @ value))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return run


def grade(docs: DataFrame, model: Model | None, n_grades: int, text_col: str = "text", min_top: float = MIN_TOP) -> DataFrame:
    """``docs`` plus (expected_grade, p_top, selected): the mean of the grade's
    distribution, the probability of the top grade, and whether that is
    ``min_top`` or more."""
    added = ("expected_grade", "p_top", "selected")
    kept = [f for f in docs.schema.fields if f.name.lower() not in added]
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select(*[F.col(f"`{f.name}`") for f in kept], none.alias("expected_grade"), none.alias("p_top"), F.lit(False).alias("selected"))
    own = [f for f in kept if f.name != text_col]
    plain = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(own)], F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(own)] + [T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType())])
    scored = plain.mapInArrow(_scored(model), schema)

    def above(k: int) -> Column:
        return 1 / (1 + F.exp(F.lit(float(model.thresholds[k])) - F.col("score")))

    expected = F.lit(0.0)
    for k in range(n_grades - 1):
        expected = expected + above(k)
    back = {f.name: F.col(f"c{i}") for i, f in enumerate(own)} | {text_col: F.col("text")}
    top = above(n_grades - 2)
    return scored.select(*[back[f.name].alias(f.name) for f in kept], expected.alias("expected_grade"), top.alias("p_top"), (top >= min_top).alias("selected"))
