"""Quality by ordinal regression: one set of hashed-text weights, ordered thresholds between graded ratings.

P(grade > k) = sigmoid(w.x - theta_k) with theta_0 < theta_1. A text's features are the hashed words, the
hashed word shapes (letter cases, digits and symbols, runs shortened to two) and a mark for each word
that repeats the one before; their counts' square roots are scaled to unit length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, short_batches

DIM = 1 << 14
#: Labelled rows that the fit reads, for each grade.
PER_GRADE = 3000
CACHE = 150_000
_RUN = re.compile(r"(.)\1+")


def _shape(word: str) -> str:
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUN.sub(r"\1\1", kinds)


class Hashed(dict):
    """Word to its two feature numbers in one: word bucket * DIM + shape bucket; forgets all when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        bare = word.lower().strip("\"'.,;:!?()[]{}<>*#$%&|")
        h = xxhash.xxh64_intdigest
        one = h(b"w" + bare.encode(errors="replace")) % (DIM // 2) + DIM // 2
        two = h(b"s" + _shape(word).encode(errors="replace")) % (DIM // 2 - 1) + 1
        out = self[word] = one * DIM + two
        return out


def vector(text: str | None, known: Hashed) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a whole text; a text without words has none."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    both = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    again = np.count_nonzero(both[1:] == both[:-1])
    ids, n = np.unique(np.concatenate([both // DIM, both % DIM, np.zeros(again, np.int64)]), return_counts=True)
    value = np.sqrt(n)
    return ids, value / np.sqrt(n.sum())


def grades(labels: DataFrame) -> DataFrame:
    """doc_id and rating: 0 poor, 1 good but toxic, 2 good. Rows without a quality have none."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("rating"))


def likelihood(s: np.ndarray, y: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log P(grade = y) of each row under the cumulative links, and its derivatives by the row's score s and by the two thresholds.

    P(grade = y) = a - b with a = P(grade > y - 1), b = P(grade > y), where P(grade > -1) = 1 and P(grade > 2) = 0.
    """
    q = 1 / (1 + np.exp(-np.clip(s[:, None] - theta, -30, 30)))
    a = np.where(y == 0, 1.0, q[:, 0] * (y == 1) + q[:, 1] * (y == 2))
    b = np.where(y == 2, 0.0, q[:, 0] * (y == 0) + q[:, 1] * (y == 1))
    p = np.maximum(a - b, 1e-12)
    by_a, by_b = a * (1 - a) / p, b * (1 - b) / p
    by_theta = np.stack([by_b * (y == 0) - by_a * (y == 1), by_b * (y == 1) - by_a * (y == 2)], axis=1)
    return np.log(p), 1 - a - b, by_theta


def _train(vectors: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, steps: int = 200, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the largest cumulative likelihood, by Adam on the whole (bounded) sample; grades weigh alike."""
    row = np.repeat(np.arange(len(y)), [len(i) for i, _ in vectors])
    ids, val = np.concatenate([i for i, _ in vectors]), np.concatenate([v for _, v in vectors])
    share = np.bincount(y, minlength=3)
    weight = (1 / np.maximum(share, 1))[y]
    weight /= weight.sum()
    p = np.zeros(DIM + 2)  # weights, theta_0, log(theta_1 - theta_0)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        s = np.bincount(row, val * p[ids], minlength=len(y))
        gap = np.exp(p[-1])
        _, by_s, by_theta = likelihood(s, y, np.array([p[-2], p[-2] + gap]))
        by_s, by_theta = by_s * weight, (by_theta * weight[:, None]).sum(0)
        grad = np.zeros_like(p)
        grad[:DIM] = l2 * p[:DIM] - np.bincount(ids, val * by_s[row], minlength=DIM)
        grad[-2], grad[-1] = -by_theta.sum(), -by_theta[1] * gap
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return p[:DIM], np.array([p[-2], p[-2] + np.exp(p[-1])])


def fit(docs: DataFrame, labels: DataFrame, per_grade: int = PER_GRADE, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Fits on at most ``per_grade`` rows of each grade: their vectors are made where the texts are, and one task gets these alone.

    Rows of equal hash order come by doc_id. Without any rows all weights are zero.
    """
    sample = labelled_sample(docs, grades(labels), "rating", per_grade, seed)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashed()
        for batch in batches:
            made = [vector(t.as_py(), known) for t in batch.column(0)]
            ids, values = ([x[k].astype(kind).tobytes() for x in made] for k, kind in ((0, np.int32), (1, np.float32)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(values, pa.binary()), batch.column(1)], ["ids", "vals", "grade"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        y: list[int] = []
        for batch in batches:
            held += [(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(float)) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            y += batch.column(2).to_pylist()
        if y:
            w, theta = _train(held, np.array(y))
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([theta.tobytes()])], ["w", "theta"])

    rows = sample.select("text", "grade").mapInArrow(vectors, "ids binary, vals binary, grade int")
    got = rows.repartition(1).sortWithinPartitions("grade", "ids", "vals").mapInArrow(train, "w binary, theta binary").collect()  # one row
    if not got:
        return np.zeros(DIM), np.array([0.0, 1.0])
    return np.frombuffer(bytes(got[0].w)), np.frombuffer(bytes(got[0].theta))


def graded(docs: DataFrame, fitted: tuple[np.ndarray, np.ndarray], keep: list[str]) -> DataFrame:
    """k0, k1, ... (the columns ``keep``, so that no name of theirs clashes) with expected_grade and tail_prob = P(grade >= 1) of each whole text."""
    w, theta = fitted
    kinds, names = dict(docs.dtypes), [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashed()
        for batch in batches:
            s = np.array([float(val @ w[ids]) for ids, val in (vector(t.as_py(), known) for t in batch.column(0))])
            over = 1 / (1 + np.exp(-np.clip(s[:, None] - theta, -30, 30))).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(batch.column(i + 1) for i in range(len(keep))), pa.array(over.sum(1)), pa.array(over[:, 0])], [*names, "expected_grade", "tail_prob"])

    schema = ", ".join([f"{n} {kinds[k]}" for n, k in zip(names, keep, strict=True)] + ["expected_grade double", "tail_prob double"])
    return short_batches(docs).select("text", *keep).mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, least: float = 0.5, per_grade: int = PER_GRADE) -> DataFrame:
    """doc_id, expected_grade (0..2), tail_prob, kept (tail_prob >= ``least``, ties included) for each row.

    Null and empty texts have no features: their score is zero. Null ids stay, repeated rows give repeated results, an empty table
    gives no rows; without labels all get the same grade. Very long texts are read whole.
    """
    return graded(docs, fit(docs, labels, per_grade), ["doc_id"]).withColumnRenamed("k0", "doc_id").withColumn("kept", F.col("tail_prob") >= least)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose tail probability is at least ``least``, with all their columns, whatever these are called."""
    return graded(docs, fit(docs, labels), docs.columns).where(F.col("tail_prob") >= least).drop("expected_grade", "tail_prob").toDF(*docs.columns)
