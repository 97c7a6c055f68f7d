"""Quality classifier: cumulative-link regression of graded ratings on hashed words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import held_out, text_bytes, words_of

BUCKETS = 1 << 14
STYLE = 5
LABELLED_ROWS = 8_192
STEPS = 300
PENALTY = 1e-4


def features(text: bytes, memo: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights: damped word counts of unit length, and a few measures of style."""
    words = words_of(text)
    counts: dict[int, int] = {}
    for w in words:
        b = memo.get(w)
        if b is None:
            if len(memo) > 500_000:
                memo.clear()
            b = memo[w] = xxhash.xxh64_intdigest(w) % BUCKETS
        counts[b] = counts.get(b, 0) + 1
    index = np.fromiter(counts, np.int64, len(counts))
    value = np.log1p(np.fromiter(counts.values(), float, len(counts)))
    value /= max(1e-9, math.sqrt(float(value @ value)))
    n = len(words)
    kinds = np.bincount(np.array([5, 0, 1, 2, 3])[np.digitize(np.frombuffer(text, "u1"), [33, 48, 58, 97])], minlength=6) / max(1, len(text))
    style = [math.log1p(n) / 10, len(set(words)) / max(1, n), kinds[0] * 5, kinds[1] * 5, kinds[2] * 5]
    return np.concatenate([index, BUCKETS + np.arange(STYLE)]), np.concatenate([value, style])


class Ordinal:
    """Weights shared by all grades and rising thresholds: P(grade <= k) = logistic(threshold k - weights . x)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @staticmethod
    def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, steps: int = STEPS, penalty: float = PENALTY) -> Ordinal:
        size = BUCKETS + STYLE
        index, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        w, n = np.zeros(size), len(rows)
        share = np.clip([(grades <= k).mean() for k in range(levels - 1)], 0.001, 0.999)
        logit = np.log(share / (1 - share))
        cuts = np.concatenate([logit[:1], np.log(np.maximum(np.diff(logit), 0.05))])  # first threshold, logs of the gaps
        m, v = np.zeros(size + len(cuts)), np.zeros(size + len(cuts))
        for step in range(1, steps + 1):
            gaps = np.exp(cuts[1:])
            theta = np.concatenate([[-np.inf], np.cumsum(np.concatenate([cuts[:1], gaps])), [np.inf]])
            x = np.bincount(owner, value * w[index], n)
            high, low = _logistic(theta[grades + 1] - x), _logistic(theta[grades] - x)
            p = np.maximum(high - low, 1e-9)
            up, down = high * (1 - high) / p, low * (1 - low) / p  # d log p by its two thresholds
            by_x = down - up
            g = np.bincount(index, value * by_x[owner], size) / n - penalty * w
            by_theta = np.array([up[grades == k].sum() - down[grades == k + 1].sum() for k in range(levels - 1)]) / n
            tail = np.cumsum(by_theta[::-1])[::-1]
            g = np.concatenate([g, tail[:1], tail[1:] * gaps])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
            w, cuts = w + move[:size], cuts + move[size:]
        return Ordinal(w, np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])])))

    def tails(self, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 - _logistic(self.thresholds - float(value @ self.weights[index]))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def grades(docs: DataFrame, ratings: DataFrame, grade: Column, levels: int, *, bound: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, held_out, expected_grade, tail_probability, predicted, kept) of every row of ``docs``.

    ``grade`` is a column of ``ratings`` (0 to levels - 1). The fit reads at most ``bound`` rated rows in hash order, none with
    crc32(id) mod 3 = 1; its gradient runs over those rows only, every document is scored. tail_probability is that of the
    highest grade, predicted the likeliest grade, kept whether a grade above 0 is likelier than not. A null or empty text
    is scored by its style alone; null ids are scored and not held out; repeated rows are scored alike; without ratings
    every grade is as likely; an empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    known = ratings.select(F.col("doc_id").cast("long"), grade.cast("int").alias("grade")).filter("doc_id is not null and grade is not null")
    known = known.groupBy("doc_id").agg(F.min("grade").alias("grade")).filter(~held_out("doc_id", 3, 1))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).collect()
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    got = []
    if sample:
        few = spark.createDataFrame(sample, "doc_id long, grade int")

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo: dict[bytes, int] = {}
            for batch in batches:
                made = [features(t, memo) for t in text_bytes(batch.column(0))]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([i.astype("<i4").tobytes() for i, _ in made], pa.binary()),
                                                  pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary())], names=["grade", "i", "v"])

        rated = rows.join(F.broadcast(few), "doc_id").select("text", "grade")  # at most ``bound`` rows
        got = rated.mapInArrow(measure, "grade int, i binary, v binary").collect()
        got.sort(key=lambda r: (r["grade"], r["i"], r["v"]))
    if got:
        model = Ordinal.fit([(np.frombuffer(r["i"], "<i4"), np.frombuffer(r["v"], "<f4").astype(float)) for r in got], np.array([r["grade"] for r in got]), levels)
    else:
        model = Ordinal(np.zeros(BUCKETS + STYLE), -np.log(levels / np.arange(1, levels) - 1))
    weights, thresholds = model.weights, model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, memo = Ordinal(weights, thresholds), {}
        for batch in batches:
            tails = np.array([fitted.tails(*features(t, memo)) for t in text_bytes(batch.column(1))]).reshape(-1, levels - 1)
            single = -np.diff(np.concatenate([np.ones((len(tails), 1)), tails, np.zeros((len(tails), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(single.argmax(axis=1).astype("i4")),
                                              pa.array(tails[:, 0] > 0.5)], names=["doc_id", "expected_grade", "tail_probability", "predicted", "kept"])

    found = rows.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, predicted int, kept boolean")
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "expected_grade", "tail_probability", "predicted", "kept")
