"""Toxicity grades (operator 6): cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - score), where the score is a sum of weights of the
features that a text has; the weights are shared by all thresholds. The features are the
lower-cased letter runs of a text and their first four and five letters, and in scripts
without spaces their pairs of letters, each present or absent. Weights are not negative, so words of a clean text cannot hide toxic ones, and a
lasso penalty leaves few of them, so long clean texts gather no score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import cut

#: Labelled rows that the model is fitted on, at most: those with the least hashes of their id.
MAX_TRAINING_ROWS = 6000
#: Features that fewer labelled texts have, or fewer than this share of them, are left out,
MIN_TEXTS, MIN_SHARE = 3, 0.001
#: and so are those of more than this share of the texts: they only slow the fit.
MAX_SHARE = 0.5
PENALTY = 0.0001
STEPS = 300

_LETTERS = re.compile(r"[^\W\d_]+").findall
#: Letters of scripts that write words without spaces between them.
_WIDE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7ff\uf900-\ufaff]").search


def _pairs(text: str, words: set[str]) -> set[str]:
    """Pairs of neighbouring letters, and single ones, of words in such scripts."""
    if not _WIDE(text):
        return set()
    return {f"{w[k : k + 2]}~2" for w in words if _WIDE(w) for k in range(len(w))}


def features(text: str | None) -> set[str]:
    """Feature names; a word and its prefixes never share a name."""
    text = (text or "").lower()
    words = set(_LETTERS(text))
    return words | {f"{w[:4]}~4" for w in words if len(w) > 4} | {f"{w[:5]}~5" for w in words if len(w) > 5} | _pairs(text, words)


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by feature, ascending thresholds between grades 0, 1, ..., and the score above which texts are rejected."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]
    reject_above: float

    def score(self, text: str | None) -> float:
        get = self.weights.get
        text = (text or "").lower()
        words = set(_LETTERS(text))
        found = {w for w in words if w in self.weights}
        found |= {p for w in words if len(w) > 4 and (p := f"{w[:4]}~4") in self.weights}
        found |= {p for w in words if len(w) > 5 and (p := f"{w[:5]}~5") in self.weights}
        found |= {p for p in _pairs(text, words) if p in self.weights}
        return float(sum(sorted(get(x) for x in found)))

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each threshold."""
        return 1 / (1 + np.exp(np.clip(np.asarray(self.thresholds)[None, :] - score[:, None], -60, 60)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_features: int, n_grades: int,
                penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of at least 0 and thresholds of least mean log loss plus penalty * sum of weights.

    rows: the feature numbers of each text. Accelerated proximal gradient for the weights,
    damped Newton steps for the thresholds. Each threshold also sees half a text of score
    0 on either side, so that a grade without a label gets a finite one.
    """
    sizes = np.array([len(r) for r in rows], np.int64)
    feature = np.concatenate(rows).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
    n, k = len(rows), n_grades - 1
    row = np.repeat(np.arange(n), sizes)
    at_most = np.array([((grades <= j).sum() + 0.5) / (n + 1) for j in range(k)])
    cuts = np.log(at_most / (1 - at_most)) + 1e-3 * np.arange(k)
    # Each feature has a step of its own: X'X is at most the diagonal of X'X1 (X has no negative
    # entries), and the loss bends by half at most.
    reach = np.bincount(feature, sizes[row].astype(float), n_features)
    rate = 2 * max(n, 1) / np.maximum(reach, 1.0)
    weights = look = np.zeros(n_features)
    momentum = 1.0
    for _ in range(steps):
        score = np.bincount(row, look[feature], n)
        ends = np.concatenate(([-60.0], cuts, [60.0]))
        upper, lower = _sigmoid(ends[grades + 1] - score), _sigmoid(ends[grades] - score)
        slope = (1 - upper - lower) / max(n, 1)
        moved = look - rate * np.bincount(feature, slope[row], n_features)
        moved = np.maximum(moved - rate * penalty, 0)
        later = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look, weights, momentum = moved + (momentum - 1) / later * (moved - weights), moved, later
        share = np.maximum(upper - lower, 1e-9)
        for j in range(k):
            p = _sigmoid(cuts[j] - score)
            bend = p * (1 - p)
            pull = (bend / share)[grades == j].sum() - (bend / share)[grades == j + 1].sum() + 0.5 - _sigmoid(cuts[j])
            cuts[j] += np.clip(0.5 * pull / (bend.sum() + 0.25), -0.5, 0.5)
        cuts = np.maximum.accumulate(cuts + 1e-6 * np.arange(k))
    return weights, cuts


def best_cut(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The score that parts toxic from other texts with the best F1, in the middle of a gap; of equals the one in the widest gap."""
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], toxic[order]
    if not y.any() or y.all() or s[0] == s[-1]:
        return float(s[-1]) + 1.0 if not y.any() else float(s[0]) - 1.0 if y.all() else float(s[-1])
    caught = y.sum() - np.cumsum(y)[:-1]
    f1 = 2 * caught / (np.arange(len(s) - 1, 0, -1) + y.sum())
    gap = np.diff(s)
    f1[gap == 0] = -1
    best = max(np.flatnonzero(f1 >= f1.max() - 1e-12), key=lambda i: gap[i])
    return float((s[best] + s[best + 1]) / 2)


def _hashes(text: str | None) -> np.ndarray:
    import xxhash

    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(f) for f in features(text)), np.uint64))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade",
        max_rows: int = MAX_TRAINING_ROWS, min_texts: int = MIN_TEXTS) -> OrdinalModel:
    """Fit on at most max_rows labelled texts, whole.

    labels: ids and grades 0, 1, ...; a label with a null grade or without a document, or
    a null id, is left out; of several grades of an id the highest counts, of several
    texts the least. Without any label left, the model gives each text even odds of grade
    0 and no weight. What comes to the driver are the feature hashes of the sample.
    """
    graded = labels.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(grade_col).cast("int").alias("_grade"))
    sample = graded.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # The sample is bounded by max_rows, so it goes to the scan of the documents.
    texts = texts.join(F.broadcast(sample), "_id").select("_id", "_grade", "_text")

    # One row for each labelled id; the few texts are kept, so that the passes below don't scan the documents again.
    texts = cut(texts.groupBy("_id", "_grade").agg(F.min("_text").alias("_text")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_hashes(text.as_py()).view(np.int64))], ["hash"])

    n_texts = texts.count()
    if not n_texts:
        return OrdinalModel({}, (0.0,), 0.0)
    low, high = max(min_texts, MIN_SHARE * n_texts), max(MAX_SHARE * n_texts, min_texts)
    spread = texts.select("_text").mapInArrow(hashed, "hash long").groupBy("hash").count().where(F.col("count").between(low, high))
    # Only what enough texts have leaves the executors: at most texts * words / least count.
    names = np.sort(np.array([r["hash"] for r in spread.select("hash").toLocalIterator()], np.int64).view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            packed = []
            for text in batch.column(2):
                own = _hashes(text.as_py())
                at = np.searchsorted(known, own).clip(0, max(len(known) - 1, 0))
                packed.append((at[known[at] == own] if len(known) else at[:0]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["_id", "_grade", "numbers"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = sorted(map(tuple, texts.select("_id", "_grade", "_text").mapInArrow(numbers, f"_id {kind}, _grade int, numbers binary").collect()))
    numbered = [np.frombuffer(x, np.int32) for _, _, x in found]
    grades = np.array([g for _, g, _ in found], np.int64).clip(0)
    weights, cuts = fit_ordinal(numbered, grades, len(names), max(2, int(grades.max()) + 1))
    cutoff = best_cut(np.array([weights[r].sum() for r in numbered]), grades > 0)
    kept = {int(h): float(w) for h, w in zip(names, weights) if w}

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen = set()
        for batch in batches:
            for text in batch.column(0):
                seen |= {f for f in features(text.as_py()) if xxhash.xxh3_64_intdigest(f) in kept}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], ["feature"])

    import xxhash

    spellings = [r["feature"] for r in texts.select("_text").mapInArrow(spelled, "feature string").distinct().collect()] if kept else []
    return OrdinalModel({f: kept[xxhash.xxh3_64_intdigest(f)] for f in sorted(spellings)}, tuple(float(c) for c in cuts), cutoff)


def probabilities(model: OrdinalModel, text: Column) -> Column:
    """Array of P(grade > k), k = 0, 1, ..., of a text column; null counts as empty."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def above(texts: pd.Series) -> pd.Series:
        score = np.fromiter(map(shared.value.score, texts), float, len(texts))
        return pd.Series(list(shared.value.above(score)))

    return above(text.cast("string"))


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, severity, p_toxic, rejected), one row for each input row, in the map stage of the scan.

    severity is the expected grade, the sum of P(grade > k); p_toxic is P(grade > 0);
    rejected is whether the score exceeds the model's cut. Null and empty texts have no
    features; rows with the same id stay rows of their own; a null id stays null. Other
    columns are ignored.
    """
    above = docs.select(F.col(id_col), probabilities(model, F.col(text_col)).alias("_above"))
    return above.select(
        id_col,
        F.aggregate("_above", F.lit(0.0), lambda a, x: a + x).alias("severity"),
        F.col("_above")[0].alias("p_toxic"),
        rejects(model, F.col("_above")).alias("rejected"),
    )


def rejects(model: OrdinalModel, above: Column) -> Column:
    """The cut of the score, as one of P(grade > 0)."""
    return above[0] > F.lit(float(model.above(np.array([model.reject_above]))[0, 0]))


def grades_of(labels: DataFrame) -> DataFrame:
    """Grades from labels (doc_id, quality, toxic): 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    return labels.select(
        "doc_id", F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).alias("grade"))
