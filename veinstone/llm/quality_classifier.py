"""Ordinal cumulative-link regression on graded ratings.

One score s = w . x is shared by all grades; ordered thresholds cut it: P(grade <= k) = logistic(threshold_k - s).
x holds hashed distinct words of the text (A-Z lower-cased, punctuation dropped) and a few shares that describe its
shape. Training minimises the negative log likelihood with an L1 penalty on the word weights (proximal AdaGrad), so that
the thousands of words that say nothing weigh exactly zero and long texts gather no noise.

Grades: 0 for toxic, 1 for poor, 2 for good and clean text, from the two label columns. The fit uses a bounded sample
of labelled rows, ``SAMPLE_ROWS`` by seeded hash of doc_id; scoring covers all rows in the scan (no shuffle), with the
weights sent to the executors (``2 ** BITS`` floats, a fixed size).

Defined results: a null or empty text has no words and gets the score of its shape alone. Labels that are null, or of
documents that aren't there, take no part; of conflicting labels of a doc_id the lowest grade counts, of its texts the one
with the smallest hash. A null doc_id is scored and never rated. Without labels, or with one grade only, every text gets that grade (or the
best grade) with probability 1. Repeated rows are scored alike. Other columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sealed, table

BITS = 18
GRADES = 3
SAMPLE_ROWS = 12_000
#: The penalty is L1 over the root of the number of rows.
STEPS, RATE, L1 = 300, 0.3, 0.022
#: Words in fewer rows of the sample than this weigh nothing.
LEAST_ROWS = 3
#: A document stays if the probability of the best grade is at least this.
LEAST_TAIL = 0.5

_PUNCTUATION = b".,;:!?\"'()[]"
_MARKS = b"#*$%&|<>!"
SHAPE = 6


def shape(text: bytes, words: list[bytes], distinct: int) -> list[float]:
    n = max(1, len(words))
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = len(text) - len(text.translate(None, _MARKS))
    return [1.0, min(1.0, upper * 3 / max(1, len(text))), min(1.0, marks / n), 1 - distinct / n if n < 200 else max(0.0, 1 - distinct * 2 / n), min(1.0, n / 20), min(1.0, text.count(b"|") * 4 / n)]


def parts(text: bytes | None) -> tuple[set[bytes], list[float]]:
    text = text or b""
    words = text.translate(None, _PUNCTUATION).lower().split()
    distinct = set(words)
    return distinct, shape(text, words, len(distinct))


def place(word: bytes) -> int:
    return zlib.crc32(word) & ((1 << BITS) - 1)


def _logistic(x):
    return 0.5 * (1 + np.tanh(x / 2))


class Model:
    def __init__(self, weights: np.ndarray, shape_weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.shape_weights, self.thresholds = weights, shape_weights, thresholds

    def grades(self, scores: np.ndarray) -> np.ndarray:
        """Probabilities of the grades, a row for each score."""
        up = _logistic(self.thresholds[None, :] - scores[:, None])
        edges = np.concatenate([np.zeros((len(scores), 1)), up, np.ones((len(scores), 1))], axis=1)
        return np.diff(edges, axis=1)


def loss(scores: np.ndarray, thresholds: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of the grades, and its slopes by score and by threshold."""
    n = len(grades)
    low = np.where(grades == 0, -np.inf, thresholds[np.maximum(grades - 1, 0)]) - scores
    high = np.where(grades == GRADES - 1, np.inf, thresholds[np.minimum(grades, GRADES - 2)]) - scores
    a, b = np.where(np.isinf(low), 0.0, _logistic(low)), np.where(np.isinf(high), 1.0, _logistic(high))
    inside = np.maximum(b - a, 1e-9)
    slope_a, slope_b = a * (1 - a) / inside, b * (1 - b) / inside
    by_cut = np.array([(np.where(grades == k + 1, slope_a, 0) - np.where(grades == k, slope_b, 0)).sum() for k in range(GRADES - 1)]) / n
    return float(-np.log(inside).mean()), (slope_b - slope_a) / n, by_cut


def fit(places: list[np.ndarray], shapes: np.ndarray, grades: np.ndarray, steps: int = STEPS, rate: float = RATE, l1: float = L1) -> Model:
    """The model of the rated texts: places of their words, their shapes and grades."""
    thresholds = np.arange(1, GRADES) * 2.0 - GRADES
    weights, shape_weights = np.zeros(1 << BITS), np.zeros(SHAPE)
    if len(set(grades.tolist())) < 2:
        only = int(grades[0]) if len(grades) else GRADES - 1
        return Model(weights, shape_weights, np.where(np.arange(1, GRADES) <= only, -50.0, 50.0))
    sizes = np.array([len(p) for p in places])
    row, flat = np.repeat(np.arange(len(places)), sizes), np.concatenate(places).astype(np.int64)
    often = np.bincount(flat, minlength=1 << BITS)[flat] >= LEAST_ROWS
    row, flat = row[often], flat[often]
    used, flat = np.unique(flat, return_inverse=True)
    w, seen, seen_s, seen_t = np.zeros(len(used)), np.full(len(used), 1e-8), np.full(SHAPE, 1e-8), np.full(GRADES - 1, 1e-8)
    n = len(places)
    for _ in range(steps):
        _, by_score, by_cut = loss(np.bincount(row, w[flat], minlength=n) + shapes @ shape_weights, thresholds, grades)
        by_word, by_shape = np.bincount(flat, by_score[row], minlength=len(used)), shapes.T @ by_score
        seen += by_word**2
        seen_s += by_shape**2
        seen_t += by_cut**2
        step = rate / np.sqrt(seen)
        w = w - step * by_word
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1 / np.sqrt(n), 0)
        shape_weights = shape_weights - rate / np.sqrt(seen_s) * by_shape
        thresholds = np.sort(thresholds - rate / np.sqrt(seen_t) * by_cut)
    weights[used] = w
    return Model(weights, shape_weights, thresholds)


def _sampled(batches):
    for batch in batches:
        found = [parts(x) for x in batch.column(1).cast(pa.binary()).to_pylist()]
        places = [np.unique(np.fromiter(map(place, words), np.int32, len(words))) for words, _ in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(places, pa.list_(pa.int32())), pa.array([s for _, s in found], pa.list_(pa.float64()))], ["doc_id", "grade", "places", "shape"])


def narrow(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs``, whatever their other columns are called."""
    sealed = Sealed(docs)
    return sealed.df.select(sealed.of("doc_id").cast("long").alias("doc_id"), sealed.of("text").alias("text"))


def sample(docs: DataFrame, rated: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 6) -> DataFrame:
    """(doc_id, text, grade) of up to ``sample_rows`` of the rated (doc_id, grade) that are in ``docs`` (doc_id, text), one row for a doc_id.

    Of conflicting grades of a doc_id the lowest counts, of different texts the one with the smallest hash, so reruns agree.
    """
    chosen = rated.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample_rows)
    # At most sample_rows rows; repeated rows are cut to one each before the shuffle.
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade")
    return rows.agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("t"))).alias("m")).select("doc_id", F.col("m.t").alias("text"), "grade")


def trained(docs: DataFrame, rated: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 6) -> Model:
    """The model of the sample; ``sample_rows`` bounds what reaches the driver."""
    rows = sample(narrow(docs), rated, sample_rows, seed).mapInArrow(_sampled, "doc_id long, grade int, places array<int>, shape array<double>").toArrow().sort_by("doc_id")
    places = [np.asarray(x.values, np.int64) for x in rows["places"]]
    shapes = np.array(rows["shape"].to_pylist(), np.float64).reshape(-1, SHAPE)
    return fit(places, shapes, rows["grade"].to_numpy())


def graded(docs: DataFrame, model: Model, least_tail: float = LEAST_TAIL) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, expected_grade, p_best, kept."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.shape_weights, model.thresholds))

    def run(batches):
        weights, shape_weights, thresholds = sent.value
        own = Model(weights, shape_weights, thresholds)
        known: dict[bytes, float] = {}
        for batch in batches:
            scores = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words, shaped = parts(text)
                for word in (w for w in words if w not in known):
                    known[word] = float(weights[place(word)])
                scores.append(math.fsum(map(known.__getitem__, words)) + float(np.dot(shaped, shape_weights)))
                if len(known) > 500_000:
                    known.clear()
            p = own.grades(np.array(scores, np.float64))
            tail = p[:, -1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((p * np.arange(GRADES)).sum(axis=1).round(6)), pa.array(tail.round(6)), pa.array(tail >= least_tail)], ["doc_id", "expected_grade", "p_best", "kept"])

    return narrow(docs).mapInArrow(run, "doc_id long, expected_grade double, p_best double, kept boolean")


def rating(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels (doc_id, quality, toxic); null where either is."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("toxic").isNotNull(), F.col("quality") + 1).alias("grade"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return graded(docs, trained(docs, rating(table(spark, sf_dir, "labels"))))
