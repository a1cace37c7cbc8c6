"""Quality classifier: ridge regression on random Fourier features of document statistics.

A document is described by statistics of its text alone. Random Fourier features approximate a
Gaussian kernel over the standardised statistics; each partition sums its share of the normal
equations, so the driver solves a system whose size is the number of features. The ridge score is
turned into a probability by isotonic regression on scores of rows that the scoring model has not
seen (each fold is scored by the equations of the other folds).

Defined cases: a null text counts as empty; an empty text has all-zero statistics and is scored like
any other; repeated rows get equal scores; without labelled rows every score is 0.5. Extra columns
of the input are never read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailcast.llm.calibration import CELLS, Isotonic, cell, isotonic
from retailcast.llm.common import fold, labelled, partition_sums, stored

N_STATISTICS = 26
RANGE = (-1.0, 2.0)  # of ridge scores on the calibration grid

_CLASSES = np.zeros((256, 9))
for _i, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,;:?", b" \t", b"\n\r", range(128, 256), b"!", b"|")):
    _CLASSES[list(_chars), _i] = 1


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text; the length of the list is ``N_STATISTICS``."""
    if not text:
        return [0.0] * N_STATISTICS
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = counts.sum()
    share = counts @ _CLASSES / size
    p = counts[counts > 0] / size
    words = text.split()
    n = max(len(words), 1)
    tally = Counter(words)
    top = max(tally.values(), default=0)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(len(lines), 1)
    ended = sum(x.rstrip()[-1] in ".!?:;\"'" for x in lines)
    odd = sum(c for w, c in tally.items() if not w.strip(".,;:?!'\"()").isalpha())
    return [
        math.log1p(len(text)),
        math.log1p(len(words)),
        *share.tolist(),
        float(1 - share.sum()),
        float(-(p * np.log2(p)).sum()),
        float(p.max()),
        float(lengths.mean()),
        float(lengths.std()),
        math.log1p(float(lengths.max())),
        len(tally) / n,
        top / n,
        pairs / max(len(words) - 1, 1),
        odd / n,
        math.log1p(len(lines)),
        math.log1p(len(words) / m),
        len(set(lines)) / m,
        ended / m,
        float((lengths <= 2).mean()),
    ]


def statistics_of(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(statistics)

    return run(text)


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    calibrate: Isotonic

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = fourier(x, self.mean, self.scale, self.directions, self.phases)
        return np.clip(self.calibrate(z @ self.weights), 0.0, 1.0)

    def score(self, text: Column) -> Column:
        """Probability of label 1 for each whole text."""

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                x = np.array([statistics(t) for t in texts]).reshape(-1, N_STATISTICS)
                yield pd.Series(self.probability(x))

        return score(text)


def fourier(x, mean, scale, directions, phases) -> np.ndarray:
    """Random Fourier features with a constant column in front."""
    z = np.clip((x - mean) / scale, -5, 5) @ directions + phases
    return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / directions.shape[1]) * np.cos(z)])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    features: int = 384,
    bandwidth: float = 4.0,
    ridge: float = 1e-4,
    seed: int = 7,
) -> QualityModel:
    """Fit on every labelled row outside fold 0."""
    rows = docs.select(
        "doc_id", fold(F.col("doc_id")).alias("fold"), statistics_of(F.col("text")).alias("x")
    ).where("fold > 0")
    train = stored(
        rows.join(labelled(labels, "quality"), F.col("doc_id") == F.col("label_id")).select("fold", "label", "x"), "quality"
    )

    def batch(pdf):
        x = np.array(pdf["x"].tolist(), np.float64).reshape(-1, N_STATISTICS)
        return x, pdf["label"].to_numpy(np.float64), pdf["fold"].to_numpy()

    def moments(batches):
        acc = np.zeros((3, N_STATISTICS))
        for pdf in batches:
            x, _, _ = batch(pdf)
            acc += np.array([np.full(N_STATISTICS, len(x)), x.sum(0), (x * x).sum(0)])
        return {"moments": acc}

    n, total, squares = partition_sums(train, moments).get("moments", np.zeros((3, N_STATISTICS)))
    n = np.maximum(n, 1)
    mean = total / n
    scale = np.sqrt(np.maximum(squares / n - mean**2, 0))
    scale = np.where(scale < 1e-9, 1.0, scale)
    rng = np.random.default_rng(seed)
    directions = rng.normal(0, 1 / bandwidth, (N_STATISTICS, features))
    phases = rng.uniform(0, 2 * np.pi, features)
    width = features + 1

    def equations(batches):
        acc = {f"fold{k}": np.zeros((width, width + 1)) for k in range(1, 5)}
        for pdf in batches:
            x, y, k = batch(pdf)
            z = fourier(x, mean, scale, directions, phases)
            for i in range(1, 5):
                part = z[k == i]
                acc[f"fold{i}"] += np.hstack([part.T @ part, part.T @ y[k == i, None]])
        return acc

    sums = partition_sums(train, equations)
    folds = {k: sums.get(f"fold{k}", np.zeros((width, width + 1))) for k in range(1, 5)}

    def solve(system):
        rows_in = max(system[0, 0], 1.0)
        return np.linalg.solve(system[:, :-1] + ridge * rows_in * np.eye(width), system[:, -1])

    whole = sum(folds.values())
    weights = solve(whole)
    others = {k: solve(whole - folds[k]) for k in folds}

    def grid(batches):
        acc = np.zeros((2, CELLS))
        for pdf in batches:
            x, y, k = batch(pdf)
            z = fourier(x, mean, scale, directions, phases)
            for i, w in others.items():
                at = cell(z[k == i] @ w, *RANGE)
                acc += np.array([np.bincount(at, y[k == i], CELLS), np.bincount(at, minlength=CELLS)])
        return {"grid": acc}

    ones, rows_at = partition_sums(train, grid).get("grid", np.zeros((2, CELLS)))
    return QualityModel(mean, scale, directions, phases, weights, isotonic(ones, rows_at, *RANGE))


def score_documents(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    return docs.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), model.score(F.col("text")).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_documents(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The rows whose score reaches the threshold, all columns as they were."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    scored = docs.select(row.alias("row"), model.score(F.col("text")).alias("score"))
    return scored.where(F.col("score") >= threshold).select("row.*")
