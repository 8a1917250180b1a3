"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade < k) = logistic(threshold_k - score): one score for all grades, from one
weight per hashed feature, and ordered thresholds. Features are the distinct
words of the whole text with their first four and five letters, and how large a
share of the words has each shape (capitals, signs at the end, repetition of the
word before, ...). Only words that go with the grade in the sample get a weight.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.worker_table import drop_table

BITS = 20
SAMPLE = 12_000  # rated documents that the model is fitted on, at most
LEAST_DOCS = 4  # a word needs so many documents of the sample to get a weight,
LEAST_Z = 4.0  # and a mean grade so many standard errors from the mean of all
EPOCHS, BATCH, RATE, DECAY = 30, 128, 0.08, 2e-4
_SHAPES = 1 << 10  # buckets of shapes, above those of words
_SHAPE_SCALE = 8.0
_WORDS_KEPT = 400_000
_EDGE = re.compile(r"^\W+|\W+$")
_TAIL = re.compile(r"\W*$")


class _Words(dict):
    """Raw word -> row of ``table``: buckets of the bare word, of its first four and five letters, and of its shape."""

    def __init__(self) -> None:
        self.table = np.empty((_WORDS_KEPT, 4), np.int32)

    def learn(self, raw: list[str]) -> None:
        """Enters the words of a text; starts anew when there is no room for them."""
        new = {w for w in set(raw) if w not in self}
        if len(self) + len(new) > len(self.table):
            self.clear()
            new = set(raw)
            self.table = np.empty((max(_WORDS_KEPT, len(new)), 4), np.int32)
        if new:
            here = slice(len(self), len(self) + len(new))
            self.table[here] = [_buckets(w) for w in new]
            self.update(zip(new, range(here.start, here.stop)))


def _bucket(part: str) -> int:
    return xxhash.xxh64_intdigest(part) >> (64 - BITS)


def _buckets(word: str) -> tuple[int, int, int, int]:
    bare = word if word.isalpha() else _EDGE.sub("", word)
    tail = _TAIL.search(word)[0][:4]
    low = bare.lower()
    case = "none" if not bare else "other" if not bare.isalpha() else "lower" if bare == low else \
        "upper" if len(bare) > 1 and bare.isupper() else "title"
    return (_bucket(low) if low else -1, _bucket(low[:4] + "-") if len(low) > 4 else -1,
            _bucket(low[:5] + "-") if len(low) > 5 else -1, xxhash.xxh64_intdigest(case + tail) % (_SHAPES - 1))


def features(text: str | None, words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of the distinct words and word beginnings, shape buckets, share of each)."""
    raw = (text or "").split()
    if not raw:
        return np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.float32)
    words.learn(raw)
    numbers = np.fromiter(map(words.__getitem__, raw), np.int64, len(raw))
    own = words.table[numbers]
    parts = np.unique(own[:, :3])
    shape, n = np.unique(own[:, 3], return_counts=True)
    again = np.count_nonzero(numbers[1:] == numbers[:-1])
    return (parts[parts >= 0], np.append(shape, _SHAPES - 1).astype(np.int32),
            (np.append(n, again) / len(raw)).astype(np.float32))


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_table()
    words = _Words()
    for batch in batches:
        rows = [features(t, words) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("grade"), *(pa.array([r[k] for r in rows], pa.list_(t)) for k, t in (
                (0, pa.int32()), (1, pa.int32()), (2, pa.float32())))], names=["doc_id", "grade", "words", "shapes", "shares"])


@dataclass
class Model:
    """Weights of words and shapes, and the ordered thresholds between the grades."""

    words: np.ndarray
    shapes: np.ndarray
    thresholds: np.ndarray
    rated: bool = True  # whether there was any rating to fit on

    def score(self, bare: np.ndarray, shape: np.ndarray, share: np.ndarray) -> float:
        return float(self.words[bare].sum() + _SHAPE_SCALE * (self.shapes[shape] * share).sum())

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - np.asarray(scores)[:, None], -40, 40)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], grades: int) -> Model:
    """Fits (grade, words, shapes, shares) rows by AdaGrad on the likelihood; the same rows give the same model."""
    n_words = 1 << BITS
    total = n_words + _SHAPES
    grade = np.array([r[0] for r in rows], np.int64)
    seen, summed = np.zeros((2, n_words))
    middle, spread = (grade.mean(), grade.std()) if rows else (0, 0)
    for y, bare, _, _ in rows:
        seen[bare] += 1
        summed[bare] += y - middle
    telling = (seen >= LEAST_DOCS) & (np.abs(summed) >= LEAST_Z * np.sqrt(seen) * spread)
    columns, values = [], []
    for _, bare, shape, share in rows:
        bare = bare[telling[bare]]
        columns.append(np.concatenate([bare, shape + n_words]).astype(np.int64))
        values.append(np.concatenate([np.ones(len(bare)), _SHAPE_SCALE * share]))
    weights, squares = np.zeros(total), np.full(total, 1e-3)
    # The thresholds start at the logits of the grades' shares; gaps stay positive as exponentials.
    share = np.array([np.mean(grade < k) if len(grade) else k / grades for k in range(1, grades)])
    share = np.clip(share, 0.02, 0.98) + np.arange(grades - 1) * 1e-3
    start = np.log(share / (1 - share))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    free_squares = np.full(len(free), 1e-3)
    rng = np.random.default_rng(7)

    def thresholds() -> np.ndarray:
        return free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))])

    for epoch in range(EPOCHS if rows else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            chosen = order[at:at + BATCH]
            sizes = np.array([len(columns[k]) for k in chosen])
            col = np.concatenate([columns[k] for k in chosen])
            val = np.concatenate([values[k] for k in chosen])
            row = np.repeat(np.arange(len(chosen)), sizes)
            score = np.bincount(row, weights[col] * val, len(chosen))
            edges = np.concatenate([[-np.inf], thresholds(), [np.inf]])
            y = grade[chosen]
            high, low = _sigmoid(edges[y + 1] - score), _sigmoid(edges[y] - score)
            slope_high, slope_low = high * (1 - high), low * (1 - low)
            p = np.maximum(high - low, 1e-9)
            by_score = (slope_high - slope_low) / p / len(chosen)
            slope = np.bincount(col, by_score[row] * val, total)
            hit = np.unique(col)
            g = slope[hit] + DECAY * weights[hit]
            squares[hit] += g * g
            weights[hit] -= RATE * g / np.sqrt(squares[hit])
            by_edge = np.bincount(y, -slope_high / p, grades)[:grades - 1] + np.bincount(y, slope_low / p, grades)[1:]
            g = np.array([by_edge.sum()] + [by_edge[k:].sum() * np.exp(free[k]) for k in range(1, grades - 1)]) / len(chosen)
            free_squares += g * g
            free -= RATE * g / np.sqrt(free_squares)
    return Model(weights[:n_words].astype(np.float32), weights[n_words:].astype(np.float32), thresholds(), bool(rows))


def train(docs: DataFrame, ratings: DataFrame, grades: int, sample: int = SAMPLE,
          id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on at most ``sample`` rated documents, those with the smallest hash of the id.

    ``ratings`` has ``doc_id`` and ``grade`` (0 to grades - 1); rows with a null
    in either are left out, and of several ratings of one id the lowest counts, and
    of several rows of one id the one with the largest text.
    Without any rating every score is 0.
    """
    rated = ratings.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(chosen, "doc_id") \
        .groupBy("doc_id", "grade").agg(F.max("text").alias("text"))
    found = texts.select("doc_id", F.col("grade").cast("long"), "text").mapInArrow(
        _featurised, "doc_id long, grade long, words array<int>, shapes array<int>, shares array<float>")
    rows = sorted(((r.doc_id, r.grade, np.array(r.words, np.int32), np.array(r.shapes, np.int32), np.array(r.shares, np.float32))
                   for r in found.toLocalIterator()), key=lambda r: (r[0], r[1], r[2].tobytes()))
    return fit([r[1:] for r in rows], grades)


def classify(docs: DataFrame, model: Model, cut: int, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_probability`` = P(grade >= ``cut``) and ``kept``.

    A row is kept if its tail probability is ``least`` or more; a model without
    ratings rejects nothing. Null and empty texts have the score 0. All rows and
    columns stay; columns with the three names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        drop_table()
        own, words = sent.value, _Words()
        for batch in texts:
            tails = own.tails(np.array([own.score(*features(t, words)) for t in batch], np.float64))
            yield pd.DataFrame({"grade": tails.sum(axis=1), "tail": tails[:, cut - 1]})

    rated = docs.withColumn("__rated", F.pandas_udf(scored, "grade double, tail double")(text_col))
    kept = F.col("__rated.tail") >= least if model.rated else F.lit(True)
    return rated.withColumns({"expected_grade": F.col("__rated.grade"), "tail_probability": F.col("__rated.tail"),
                              "kept": kept}).drop("__rated")


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from the two labels: 0 toxic, 1 of low quality, 2 good. A null label leaves the row without a grade."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1)
                         .when((F.col("toxic") == 0) & (F.col("quality") == 1), 2).alias("grade"))


GRADES, GOOD = 3, 2
