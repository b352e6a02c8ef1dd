"""Severity of toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sample_ids, stored

# Bounds of the training sample (labelled ids of each class) and of the model.
SAMPLE = 4_000
MAX_FEATURES = 5_000
MIN_TEXTS = 3
# Chi-square with one degree of freedom at p = 1e-5.
CHI_SQUARE = 19.51
# Numbers of marked words from which a toxic text has the second and the third grade.
GRADES = (3, 6)
REJECT = 0.5
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5)


def features(word: str) -> list[str]:
    """A word (lower case) and its prefixes: compounds and endings vary, stems less."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def counts(text: str | None) -> Counter:
    """Occurrences of every word of a whole text."""
    return Counter(WORD.findall((text or "").lower()))


@dataclass(frozen=True)
class OrdinalModel:
    """``P(grade <= k) = logistic(thresholds[k] - x . weights)``, weights shared by all k."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def score(self, words: Counter) -> float:
        found: dict[str, int] = defaultdict(int)
        known = self.weights
        for word, n in words.items():
            for name in (word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)):
                if name in known:
                    found[name] += n
        return sum(known[name] * math.log1p(n) for name, n in found.items())

    def at_most(self, score: float) -> list[float]:
        return [1 / (1 + math.exp(min(60.0, max(-60.0, score - t)))) for t in self.thresholds]

    def severity(self, score: float) -> float:
        """Expected grade: the sum over k of the chance to be above k."""
        return sum(1 - p for p in self.at_most(score))

    def grade(self, score: float) -> int:
        bounds = [0.0, *self.at_most(score), 1.0]
        return int(np.argmax(np.diff(bounds)))


def fit_ordinal(grades: np.ndarray, rows: list[dict[int, int]], names: list[str], rounds: int = 400, ridge: float = 0.02) -> OrdinalModel:
    """Maximum penalised likelihood by gradient steps with momentum (all rows at once).

    ``rows`` hold counts by position in ``names``.  Weights stay at 0 or above: a text can't make up for abuse
    by other words.
    """
    at_row = np.array([r for r, row in enumerate(rows) for _ in row], dtype=np.int64)
    at_col = np.array([f for row in rows for f in row], dtype=np.int64)
    value = np.log1p(np.array([n for row in rows for n in row.values()], dtype=float))
    levels = int(grades.max()) if len(grades) else 0
    share = [np.mean(grades <= k) for k in range(levels)]
    theta = np.array([math.log((p + 1e-3) / (1 - p + 1e-3)) for p in share])
    w, n = np.zeros(len(names)), max(1, len(grades))
    state_w, state_t = [np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(theta), np.zeros_like(theta)]

    def move(x: np.ndarray, gradient: np.ndarray, state: list[np.ndarray], step: int) -> np.ndarray:
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.99 * state[1] + 0.01 * gradient**2
        return x - 0.05 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)

    rows_of = np.arange(len(grades))
    for step in range(1, rounds + 1 if levels else 1):
        score = np.bincount(at_row, weights=w[at_col] * value, minlength=len(grades))
        cdf = 1 / (1 + np.exp(np.clip(score[:, None] - theta[None, :], -60, 60)))
        full = np.hstack((np.zeros((len(grades), 1)), cdf, np.ones((len(grades), 1))))
        slope = np.hstack((np.zeros((len(grades), 1)), cdf * (1 - cdf), np.zeros((len(grades), 1))))
        likely = np.maximum(full[rows_of, grades + 1] - full[rows_of, grades], 1e-12)
        upper, lower = slope[rows_of, grades + 1] / likely, slope[rows_of, grades] / likely
        by_score = (upper - lower) / n
        gw = np.bincount(at_col, weights=by_score[at_row] * value, minlength=len(names)) + ridge * w / n
        gt = np.bincount(grades, weights=-upper / n, minlength=levels + 1)[:levels]
        gt += np.bincount(grades, weights=lower / n, minlength=levels + 1)[1:]
        w, theta = np.maximum(move(w, gw, state_w, step), 0.0), np.sort(move(theta, gt, state_t, step))
    kept = {name: float(x) for name, x in zip(names, w) if abs(x) > 1e-4}
    return OrdinalModel(kept, tuple(float(t) for t in theta))


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``x_toxic, text``: distinct texts of at most ``sample`` labelled ids of either class."""
    known = (
        labels.where("toxic in (0, 1) and doc_id is not null")
        .groupBy(F.col("doc_id").alias("x_id"))
        .agg(F.max("toxic").alias("x_toxic"))
    )
    parts = [sample_ids(known.where(F.col("x_toxic") == k), "x_id", sample).withColumn("x_toxic", F.lit(k)) for k in (0, 1)]
    chosen = stored(parts[0].union(parts[1]), "chosen")
    texts = docs.join(chosen, docs["doc_id"] == chosen["x_id"]).where(F.col("text").isNotNull())
    distinct = texts.groupBy(F.xxhash64("text").alias("x_hash")).agg(
        F.max("x_toxic").alias("x_toxic"), F.min("text").alias("text")
    )
    return stored(distinct.select("x_toxic", "text"), "sample")


def _marks(texts: DataFrame, most: int) -> list[str]:
    """Features that toxic texts have more often than chance allows, strongest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                names = list({f for word in counts(text.as_py()) for f in features(word)})
                yield pa.record_batch([pa.array([toxic] * len(names), type=pa.int32()), pa.array(names, type=pa.string())], names=["toxic", "name"])

    size = {r["x_toxic"]: r["count"] for r in texts.groupBy("x_toxic").count().collect()}
    na, nb = F.lit(float(size.get(1, 0))), F.lit(float(size.get(0, 0)))
    if len(size) < 2:
        return []
    seen = texts.select(F.col("x_toxic").cast("int"), "text").mapInArrow(run, "toxic int, name string")
    both = seen.groupBy("name").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    n = na + nb
    chi = n * F.pow(a * (nb - b) - b * (na - a), F.lit(2)) / (na * nb * (a + b) * F.greatest(n - a - b, F.lit(0.5)))
    rated = both.withColumn("chi", chi).where(
        (a + b >= MIN_TEXTS) & (F.col("chi") > CHI_SQUARE) & (a * nb > b * na)
    )
    return [r["name"] for r in rated.orderBy(F.desc("chi"), "name").limit(most).select("name").collect()]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_features: int = MAX_FEATURES) -> OrdinalModel:
    """Fit on the texts of at most ``sample`` labelled ids of either class, chosen by hash.

    Labels hold toxic 0/1.  Grade 0 is a text labelled 0; texts labelled 1 get grade 1, 2 or 3 by their
    number of marked words: words with a feature that is significantly more frequent in toxic texts.  Copies count
    once.  Labels with a null and null texts are left out.  Without labelled texts of both classes every
    severity is 0.  The driver gets the chosen features and, for each sampled text, their counts.
    """
    texts = _sample(docs, labels, sample)
    names = _marks(texts, max_features)
    if not names:
        return OrdinalModel({}, ())
    place = {name: i for i, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grades, sparse = [], []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = counts(text.as_py())
                found: Counter = Counter()
                marked = 0
                for word, k in words.items():
                    known = [f for f in features(word) if f in place]
                    marked += k * bool(known)
                    for f in known:
                        found[place[f]] += k
                grades.append(toxic and 1 + sum(marked >= g for g in GRADES))
                sparse.append(list(found.items()))
            yield pa.record_batch(
                [pa.array(grades, type=pa.int32()), pa.array(sparse, type=pa.map_(pa.int32(), pa.int32()))], names=["grade", "row"]
            )

    rows = texts.select(F.col("x_toxic").cast("int"), "text").mapInArrow(run, "grade int, row map<int, int>").collect()
    rows.sort(key=lambda r: (r["grade"], sorted(r["row"].items())))
    return fit_ordinal(np.array([r["grade"] for r in rows], dtype=np.int64), [r["row"] for r in rows], names)


def rate(docs: DataFrame, model: OrdinalModel, reject: float = REJECT) -> DataFrame:
    """``doc_id, severity, grade, toxic`` of every row, from its whole text.

    ``severity`` is the expected grade; ``toxic`` is true from ``reject`` on, a tie included.  Null and empty texts
    have the severity of a text without any feature; very long texts are read whole.  Null ids are kept, repeated rows
    get equal rows, an empty table gives none.  Columns besides ``doc_id`` and ``text`` are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(counts(t.as_py())) for t in batch.column(1)]
            severity = [model.severity(s) for s in scores]
            columns = [
                batch.column(0),
                pa.array(severity, type=pa.float64()),
                pa.array([model.grade(s) for s in scores], type=pa.int32()),
                pa.array([s >= reject for s in severity], type=pa.bool_()),
            ]
            yield pa.record_batch(columns, names=["doc_id", "severity", "grade", "toxic"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel, reject: float = REJECT) -> DataFrame:
    """``docs`` without the rows that ``rate`` rejects; no shuffle.

    All columns are kept, whatever their names.  Rows with a null id are judged by their text like others, repeated rows
    stay or go together; rows with a null or empty text stay unless ``reject`` is below what such a text has.
    """
    text, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [model.severity(model.score(counts(t.as_py()))) < reject for t in batch.column(text)]
            yield batch.filter(pa.array(kept, type=pa.bool_()))

    return docs.mapInArrow(run, schema)
