"""Toxicity: linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is the set of the hashed character n-grams of its words. Log-count ratios between toxic and other
documents scale the presence features, and a logistic regression is fitted on the scaled values.
N-grams are kept by their likelihood-ratio statistic, so the regression has a fixed width.

Labels come from rows outside fold 0. The classifier is fitted on a sample bounded by ``max_train``
labelled rows, drawn by a hash of the id; every document is scored on its whole text.

Memory does not grow with a batch of texts: words are held for runs of a bounded number of characters, also inside a long
text, which is scored whole, and a task remembers a bounded number of words.

Defined cases: a null text counts as empty; an empty text has no n-gram and gets the base score;
repeated rows get equal scores, n-grams of equal gain are chosen by bucket; very long texts are read in runs; without labelled rows of both classes every score is the (smoothed)
share of toxic labels, 0 without any label. Extra columns of the input are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailcast.llm.common import fold, labelled, partition_sums, stored

BITS = 20
LENGTHS = (4, 5, 6)
PIECE = 1 << 20  # characters hashed together
KNOWN = 100_000  # words whose features a task remembers
READ = 1 << 18  # characters whose words are held together


def word_set(text: str | None) -> set[str]:
    return set(text.lower().split()) if text else set()


def runs_of(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """Texts with their numbers, in runs of about ``READ`` characters; a longer text is cut at blanks into several runs."""
    run, size = [], 0
    for i, text in enumerate(texts):
        text, at = text or "", 0
        while len(text) - at > READ:
            to = at + READ
            while to < len(text) and not text[to].isspace():
                to += 1
            yield [(i, text[at:to])]
            at = to
        if size + len(text) - at > READ:
            yield run
            run, size = [], 0
        run.append((i, text[at:]))
        size += len(text) - at
    yield run


def pieces(words: list[str]) -> Iterator[list[str]]:
    """Runs of words of about ``PIECE`` characters."""
    run, size = [], 0
    for w in words:
        run.append(w)
        size += len(w)
        if size >= PIECE:
            yield run
            run, size = [], 0
    if run:
        yield run


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the word and bucket of every n-gram inside the words, one blank around each word."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = codes == 32
    word = np.cumsum(blank) - 1
    inner = np.concatenate([[0], np.cumsum(blank)])
    rolled, owners, buckets = codes, [], []
    for n in range(2, max(LENGTHS) + 1):
        rolled = rolled[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in LENGTHS and len(rolled):
            whole = inner[n - 1 : len(codes)] == inner[1 : len(codes) - n + 2]  # no blank but at the ends
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            owners.append(word[: len(rolled)][whole])
            buckets.append((mixed >> np.uint32(32 - BITS))[whole])
    return np.concatenate(owners or [np.zeros(0, int)]), np.concatenate(buckets or [np.zeros(0, np.uint32)])


class Features:
    """Selected features of words, remembered for the words seen last."""

    def __init__(self, place: np.ndarray):
        self.place, self.known = place, {}

    def of(self, texts: list[str | None]) -> list[set[int]]:
        found: list[set[int]] = [set() for _ in texts]
        for run in runs_of(texts):
            sets = [word_set(t) for _, t in run]
            new = {w for s in sets for w in s if w not in self.known}
            if len(self.known) + len(new) > KNOWN:
                self.known.clear()
                new = {w for s in sets for w in s}
            self.learn(sorted(new))
            for (i, _), words in zip(run, sets, strict=True):
                for w in words:
                    found[i].update(self.known[w])
        return found

    def learn(self, words: list[str]) -> None:
        self.known.update(dict.fromkeys(words, ()))
        for run in pieces(words):
            owner, bucket = ngrams(run)
            at = self.place[bucket]
            for i, f in zip(owner[at >= 0].tolist(), at[at >= 0].tolist(), strict=True):
                self.known[run[i]] += (f,)


@dataclass(frozen=True)
class ToxicityModel:
    place: np.ndarray  # of a bucket among the features, -1 outside
    weights: np.ndarray  # by feature, ratio and coefficient multiplied
    intercept: float

    def score(self, text: Column) -> Column:
        """Probability of label 1 for each whole text."""

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            features = Features(self.place)
            for texts in batches:
                margin = [self.weights[sorted(f)].sum() if f else 0.0 for f in features.of(list(texts))]
                yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(margin, np.float64) + self.intercept, -500, 500))))

        return score(text)


def log_likelihood_ratio(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """G statistic of each n-gram against the label, over n-gram occurrences in word sets."""
    n_pos, n_neg = pos.sum(), neg.sum()
    n, seen = n_pos + n_neg, pos + neg

    def part(observed, expected):
        return np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-12) / np.maximum(expected, 1e-12)), 0)

    return 2 * (
        part(pos, seen * n_pos / n)
        + part(neg, seen * n_neg / n)
        + part(n_pos - pos, (n - seen) * n_pos / n)
        + part(n_neg - neg, (n - seen) * n_neg / n)
    )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_train: int = 20_000,
    features: int = 512,
    smoothing: float = 1.0,
    ridge: float = 2e-3,
) -> ToxicityModel:
    """Fit on labelled rows outside fold 0, about ``max_train`` of them at most."""
    marked = labelled(labels, "toxic").where(fold(F.col("label_id")) > 0)
    n = marked.count()
    keep = min(1.0, max_train / max(n, 1)) * (1 << 20)
    marked = marked.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < int(np.ceil(keep)))
    train = stored(
        docs.select("doc_id", "text").join(marked, F.col("doc_id") == F.col("label_id")).select("label", "text"), "toxic"
    )

    def count(batches):
        acc, rows = np.zeros((2, 1 << BITS), np.float32), np.zeros(2, np.float32)
        tally = [Counter(), Counter()]

        def flush():
            for label, words in enumerate(tally):
                for run in pieces(list(words)):
                    owner, bucket = ngrams(run)
                    times = np.array([words[w] for w in run], np.float32)
                    acc[label] += np.bincount(bucket, times[owner], 1 << BITS)
                words.clear()

        for pdf in batches:
            for label, text in zip(pdf["label"], pdf["text"], strict=True):
                tally[label].update(word_set(text))
                rows[label] += 1
                if len(tally[label]) > KNOWN:
                    flush()
        flush()
        return {"counts": acc, "rows": rows}

    sums = partition_sums(train.repartition(8), count, block=1 << 17)
    n_neg, n_pos = sums.get("rows", np.zeros(2))
    place = np.full(1 << BITS, -1, np.int32)
    if not n_pos or not n_neg:
        rate = (n_pos + 0.01) / (n_pos + n_neg + 1) if n_pos + n_neg else 1e-6
        return ToxicityModel(place, np.zeros(1), float(np.log(rate / (1 - rate))))
    neg, pos = sums["counts"]
    gain = log_likelihood_ratio(pos, neg)
    chosen = np.sort(np.argsort(-gain, kind="stable")[:features])
    p, q = pos + smoothing, neg + smoothing
    ratio = (np.log(p / p.sum()) - np.log(q / q.sum()))[chosen]
    place[chosen] = np.arange(len(chosen))

    @F.pandas_udf("array<double>")
    def scaled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = Features(place)
        for texts in batches:
            out = []
            for f in found.of(list(texts)):
                x, at = np.zeros(len(chosen)), sorted(f)
                x[at] = ratio[at]
                out.append(x)
            yield pd.Series(out)

    matrix = stored(train.select("label", scaled("text").alias("x")), "toxic-x")
    model = LogisticRegression(featuresCol="v", labelCol="label", regParam=ridge, standardization=False, maxIter=60).fit(
        matrix.select("label", array_to_vector("x").alias("v"))
    )
    return ToxicityModel(place, model.coefficients.toArray() * ratio, float(model.intercept))


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    return docs.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), model.score(F.col("text")).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
