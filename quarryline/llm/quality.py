"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's features are its words, word shapes and repeats, hashed to FEATURES weights that all grades share. A grade's tail
probability is P(grade >= k) = sigmoid(f - threshold[k]), with thresholds in ascending order. Expected grade is the sum of the tails; documents are selected
by a tail probability.

The model is fitted on a bounded sample: the at most SAMPLE_ROWS rated documents with the smallest hash of their id, whatever the size of the tables.
Their features, all of them, are gathered at the driver: at most SAMPLE_ROWS times those of a document. Every document is then scored in one pass
without a shuffle. Graded ratings may be made of ordered evidence: in the sample query quality and the absence of abuse each lift a document by a
grade, so that the middle grade holds both kinds of middling documents, and only the top grade (which is selected) asks for both.

Defined cases: a null or empty text has no features and gets the thresholds' probabilities, but is never selected; a very long text counts whole; of
rated rows with equal hashes of their ids the smaller id and grade comes first into the sample; ratings with a null id or grade, or
without a document, are not used; several ratings of a document each count; without any rating the model predicts grade 0; a null doc_id stays null; repeated rows each get
their row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import operator
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

FEATURES = 1 << 18
SAMPLE_ROWS = 12_000
#: Features of the shares of words that occur again, and that occur twice running.
REPEATS = (0, 1)
KEPT_WORDS = 400_000
STEPS, RATE, RIDGE = 200, 0.1, 1e-4
LEAST_TAIL = 0.5
#: How far from chance, in standard deviations, a feature must go with the grade in the sample.
LEAST_Z = 3.5
#: Lengths of word beginnings that are features.
BEGINNINGS = (4, 5, 6, 8)
SIGNS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_spaces = bytes.maketrans(SIGNS, b" " * len(SIGNS))


class WordFeatures(dict):
    """Feature indices (u4) of a lower-case word and its beginnings; words seen are kept, up to KEPT_WORDS."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        names = [word, *(word[:n] + b"-" for n in BEGINNINGS if len(word) > n)]
        got = self[word] = struct.pack(f"<{len(names)}I", *(xxhash.xxh3_64_intdigest(x) % FEATURES for x in names))
        return got


class Shapes(dict):
    """Number of a word's shape: its last two signs if it ends in one, whether it is in capitals."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        tail = word[-2:] if word[-1] < 128 and not word[-1:].isalnum() else b"letter"
        got = self[word] = xxhash.xxh3_64_intdigest(b"shape " + tail + b" capitals" * word.isupper()) % FEATURES
        return got


@functools.cache
def kept_words() -> tuple[WordFeatures, Shapes]:
    return WordFeatures(), Shapes()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices in ascending order and values. Words and their beginnings count once; shapes and repeats count by their share."""
    raw = (text or "").encode("utf-8", "surrogatepass").split()
    if not raw:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    of_word, of_shape = kept_words()
    words = set((text or "").lower().encode("utf-8", "surrogatepass").translate(_spaces).split())
    once = np.frombuffer(b"".join(map(of_word.__getitem__, words)), "<u4")
    shapes, counts = np.unique(np.fromiter(map(of_shape.__getitem__, raw), np.int64, len(raw)), return_counts=True)
    index = np.concatenate([once, shapes, REPEATS]).astype(np.int64)
    value = np.concatenate([np.ones(len(once)), 4 * counts / len(raw), [4 * (1 - len(set(raw)) / len(raw)) ** 2, 4 * sum(map(operator.eq, raw, raw[1:])) / len(raw)]])
    order = np.argsort(index, kind="stable")
    index, value = index[order], value[order]
    new = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
    # a word or beginning counts once, however many words share it
    return index[new], np.minimum(np.add.reduceat(value, new), np.maximum(1, np.maximum.reduceat(value, new))).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., a column each."""
        return sigmoid(score[:, None] - self.thresholds[None, :])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int) -> Model:
    """Adam on the mean negative log likelihood, all rows a step. Thresholds: a first one and steps exp(d) to the next ones."""
    size = np.array([len(i) for i, _ in rows])
    keep = np.flatnonzero(size)
    index, value = np.concatenate([rows[k][0] for k in keep]), np.concatenate([rows[k][1] for k in keep])
    y, owner = grades[keep], np.repeat(np.arange(len(keep)), size[keep])
    # a feature whose documents' grades can't be told from chance gets no weight
    n = len(y)
    spread = np.sqrt(np.maximum(np.bincount(index, value.astype(np.float64) ** 2, FEATURES) / n - (np.bincount(index, value, FEATURES) / n) ** 2, 1e-12))
    above = np.bincount(index, value * (y - y.mean())[owner], FEATURES) / (max(y.std(), 1e-6) * np.sqrt(n) * spread)
    told = (np.abs(above) >= LEAST_Z)[index]
    index, value, owner = index[told], value[told], owner[told]
    share = np.array([(y >= k).mean() for k in range(1, levels)]).clip(1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(FEATURES), first[:1], np.log(np.maximum(1e-3, np.diff(first)))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        _, grad = loss_and_gradient(theta, index, value, owner, y, levels)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(theta[:FEATURES].astype(np.float32), thresholds(theta))


def thresholds(theta: np.ndarray) -> np.ndarray:
    """A first one, and steps exp(d) to the next ones: always in ascending order."""
    return np.cumsum(np.concatenate([theta[FEATURES : FEATURES + 1], np.exp(theta[FEATURES + 1 :])]))


def loss_and_gradient(theta: np.ndarray, index: np.ndarray, value: np.ndarray, owner: np.ndarray, y: np.ndarray, levels: int) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood of the grades y with a ridge penalty, and its gradient; value[k] is feature index[k] of row owner[k]."""
    w, t, n = theta[:FEATURES], thresholds(theta), len(y)
    f = np.bincount(owner, w[index] * value, n)
    # tails with P(grade >= 0) = 1 and P(grade >= levels) = 0 around them
    edge = np.concatenate([np.ones((n, 1)), sigmoid(f[:, None] - t[None, :]), np.zeros((n, 1))], 1)
    slope, rows_at = edge * (1 - edge), np.arange(n)
    p = np.maximum(edge[rows_at, y] - edge[rows_at, y + 1], 1e-12)
    df = -(slope[rows_at, y] - slope[rows_at, y + 1]) / p / n
    dt = np.zeros(levels + 1)
    np.add.at(dt, y, slope[rows_at, y] / p / n)
    np.add.at(dt, y + 1, -slope[rows_at, y + 1] / p / n)
    dt = dt[1:levels]
    grad = np.concatenate([np.bincount(index, value * df[owner], FEATURES) + RIDGE * w, [dt.sum()], [dt[k:].sum() * np.exp(theta[FEATURES + k]) for k in range(1, levels - 1)]])
    return float(-np.log(p).mean() + RIDGE / 2 * (w @ w)), grad


def learn(docs: DataFrame, ratings: DataFrame, levels: int, sample_rows: int = SAMPLE_ROWS) -> Model:
    """docs: doc_id, text; ratings: doc_id, grade (0 to levels - 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.astype("<i4").tobytes() for i, _ in got], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in got], pa.binary())], ["grade", "index", "value"])

    rated = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, levels - 1))
    # one rating per id, the lowest, and one text, so that repeated rows neither weigh more nor make the sample larger
    rated = rated.groupBy("doc_id").agg(F.min(F.col("grade").cast("int")).alias("grade"))
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # the sample's size is bounded, so it may be broadcast
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = texts.select("grade", "text").mapInArrow(run, "grade int, index binary, value binary").toArrow().to_pylist()
    if not any(r["index"] for r in rows):
        return Model(np.zeros(FEATURES, np.float32), np.full(levels - 1, 30.0))
    rows.sort(key=lambda r: (r["grade"], r["index"], r["value"]))
    return fit([(np.frombuffer(r["index"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4")) for r in rows], np.array([r["grade"] for r in rows]), levels)


def graded(docs: DataFrame, model: Model, select_grade: int, least: float = LEAST_TAIL) -> DataFrame:
    """doc_id, expected_grade, tails (P(grade >= 1), P(grade >= 2), ...), selected: P(grade >= select_grade) is at least `least`."""

    def run(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t.as_py()) for t in batch.column(1)]
            tails = np.round(model.tails(np.array([float(model.weights[i] @ x) if len(i) else 0.0 for i, x in got], np.float64)), 6)
            chosen = (tails[:, select_grade - 1] >= least) & np.array([len(i) > 0 for i, _ in got], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(1)), pa.array(list(tails), pa.list_(pa.float64())), pa.array(chosen)], ["doc_id", "expected_grade", "tails", "selected"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(functools.partial(run, model), "doc_id long, expected_grade double, tails array<double>, selected boolean")


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades 0 to 2: a point for good quality, one for the absence of abuse. Selected are documents that earn both."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade")), 3)
    return graded(docs, model, 2).select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.col("tails")[0].alias("p_grade_1"), F.col("tails")[1].alias("p_grade_2"), "selected")
