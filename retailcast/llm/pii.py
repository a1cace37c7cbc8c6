"""Personal data: rules, and boosted trees over candidate spans.

The base spans are those of the fixed patterns with their checks. Generators of high recall propose further
spans that may overlap: loose address forms and runs of digits with separators. Gradient-boosted
trees score each candidate by its format and its context; they learn from all candidates of all documents, where
a candidate that is a base span counts as personal data. Candidates with equal features are one row with their number as its
weight. For the thresholds every candidate is scored by trees that have not seen its document (``FOLDS`` folds by doc_id), and
a kind's threshold is the lowest score whose probability, calibrated on all of them, reaches ``precision``. Candidates
above it are added, best first, where they touch no base span and no better one.

Defined cases: a null text counts as empty; texts without candidates have the base spans alone (none);
without both classes in the table nothing is added, and a fold outside of which a class is missing sets no threshold; repeated rows get equal results. Positions count code
points, ends are exclusive. Extra columns are never read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailcast.llm.calibration import CELLS, cell, isotonic
from retailcast.llm.common import stored

#: fixed values: kinds in the order of the result, and the base patterns
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # no start inside a run of digits: same matches, linear time
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SPAN = "struct<kind:int,start:int,end:int>"
LOOSE_EMAIL = re.compile(r"[^\s@]{1,64}(?:@|\s?[\[(]at[\])]\s?)[^\s@]{1,64}(?:(?:\.|\s?[\[(]dot[\])]\s?)[A-Za-z]{2,24})")
LOOSE_DIGITS = re.compile(r"\+?\(?[0-9](?:[ ().\-/]{0,2}[0-9]){6,24}")
CONTEXT = (
    re.compile(r"mail|contact|@", re.I),
    re.compile(r"\bip\b|addr|host|server", re.I),
    re.compile(r"card|visa|credit|account|iban", re.I),
    re.compile(r"phone|tel|call|fax|mobile", re.I),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """kind, start and end of every match that passes its check, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = only_digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(only_digits(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def proposals(text: str) -> set[tuple[int, int, int]]:
    """Candidates of all generators; spans may overlap and a span may be proposed for several kinds."""
    out = set()
    if "@" in text or "[at]" in text or "(at)" in text:
        out |= {(0, m.start(), m.end()) for m in LOOSE_EMAIL.finditer(text)}
    for m in LOOSE_DIGITS.finditer(text):
        start, end = m.start(), m.end()
        n, dots = len(only_digits(m[0])), m[0].count(".")
        if dots == 3:
            out.add((1, start, end))
        if n >= 12 and dots == 0:
            first = next(i for i in range(start, end) if "0" <= text[i] <= "9")
            out.add((2, first, end))
        if 7 <= n <= 15 and dots != 3:
            out.add((3, start, end))
    return out


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Numbers on the format of a span and on the text around it."""
    span, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 16]
    digits = only_digits(span)
    runs = [len(r) for r in re.findall(r"[0-9]+", span)]
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        float(end - start),
        float(len(digits)),
        float(len(runs)),
        float(max(runs, default=0)),
        float(min(runs, default=0)),
        float(span.count(".")),
        float(span.count("-")),
        float(span.count(" ")),
        float("(" in span),
        float(span.startswith("+")),
        float("@" in span),
        float(int(digits[0]) if digits else -1),
        len(set(digits)) / max(len(digits), 1),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        *(float(bool(c.search(before))) for c in CONTEXT),
    ]


FEATURES = 23
FOLDS = 3
BINS = 2048  # no feature has as many values; Spark looks for split points in all of up to BINS^2 distinct rows
FOUND = f"struct<base:array<{SPAN}>,candidates:array<struct<kind:int,start:int,end:int,label:int,free:boolean,x:array<double>>>>"


class Taken:
    """Disjoint stretches of a text in order; a span is looked up by binary search."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in sorted(spans, key=lambda s: s[1]):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def touches(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end) - 1
        return before >= 0 and self.ends[before] > start

    def add(self, start: int, end: int) -> None:
        """Take a stretch that touches none."""
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


def find(text: str | None) -> tuple[list, list]:
    """Base spans of a whole text, and its candidates with label and features."""
    if not text:
        return [], []
    base = base_spans(text)
    known, taken = set(base), Taken(base)
    candidates = []
    for kind, start, end in sorted(known | proposals(text)):
        label = int((kind, start, end) in known)
        candidates.append((kind, start, end, label, not taken.touches(start, end), features(text, kind, start, end)))
    return base, candidates


def found_in(text: Column) -> Column:
    @F.pandas_udf(FOUND)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([find(t) for t in texts], columns=["base", "candidates"])

    return run(text)


def joined(spans: Column) -> Column:
    """kind:start:end of spans that are in order, separated by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def best_first(base: Column, added: Column) -> Column:
    """Base spans and those added spans that touch no better one, by kind, then start."""

    @F.pandas_udf(f"array<{SPAN}>")
    def run(bases: pd.Series, extras: pd.Series) -> pd.Series:
        out = []
        for rows, more in zip(bases, extras, strict=True):
            kept = [(s["kind"], s["start"], s["end"]) for s in rows]
            taken = Taken(kept)
            for s in sorted(more if more is not None else (), key=lambda s: (-s["score"], s["start"], -s["end"], s["kind"])):
                if not taken.touches(s["start"], s["end"]):
                    taken.add(s["start"], s["end"])
                    kept.append((s["kind"], s["start"], s["end"]))
            out.append(sorted(kept))
        return pd.Series(out)

    return run(base, added)


def thresholds(scored: DataFrame, precision: float) -> dict[int, float]:
    """Lowest score of each kind whose calibrated probability reaches ``precision``; no entry if none does. ``scored`` has
    kind, label, weight and score."""
    at = F.least(F.floor(F.col("score") * CELLS), F.lit(CELLS - 1)).cast("int")
    rows = scored.groupBy("kind", at.alias("cell")).agg(F.sum(F.col("label") * F.col("weight")).alias("ones"), F.sum("weight").alias("n")).collect()
    centre = (np.arange(CELLS) + 0.5) / CELLS
    out = {}
    for kind in sorted({r["kind"] for r in rows}):
        ones, total = np.zeros(CELLS), np.zeros(CELLS)
        for r in rows:
            if r["kind"] == kind:
                ones[r["cell"]], total[r["cell"]] = r["ones"], r["n"]
        good = np.flatnonzero(isotonic(ones, total, 0.0, 1.0)(centre) >= precision)
        if len(good) and ones.sum():
            out[kind] = float(good[0] / CELLS)
    return out


def weighted(rows: DataFrame) -> DataFrame:
    """``kind, label, v, fold, weight``: the candidates that count for learning, equal ones of a fold as one row with their number.

    A row's fold comes from its document, so all candidates of a document, and of its copies by id, are in one."""
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    spread = rows.select(fold.alias("fold"), F.inline("found.candidates")).where("free or label = 1")
    counts = spread.groupBy("kind", "label", "fold", "x").agg(F.count("*").cast("double").alias("weight"))
    return stored(counts.withColumn("v", array_to_vector("x")).drop("x"), "candidates")


def fit(candidates: DataFrame, trees: int):
    """Trees over weighted candidates; None without both classes."""
    if {r["label"] for r in candidates.select("label").distinct().collect()} != {0, 1}:
        return None
    learner = GBTClassifier(featuresCol="v", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=3, maxBins=BINS, stepSize=0.3, seed=3)
    return learner.fit(candidates)


def added_spans(rows: DataFrame, trees: int, precision: float) -> DataFrame:
    """``row`` and the accepted candidates of each row that has some; ``rows`` is a stored table."""
    candidates = weighted(rows)
    nothing = rows.sparkSession.createDataFrame([], "row long, added array<struct<kind:int,start:int,end:int,score:double>>")
    model = fit(candidates, trees)
    score = vector_to_array("probability")[1]
    unseen = None
    for k in range(FOLDS):
        other = fit(candidates.where(F.col("fold") != k), trees) if model is not None else None
        if other is not None:
            part = other.transform(candidates.where(F.col("fold") == k)).select("kind", "label", "weight", score.alias("score"))
            unseen = part if unseen is None else unseen.unionByName(part)
    limits = {} if unseen is None else thresholds(unseen, precision)
    if not limits:
        return nothing
    enough = F.lit(False)
    for kind, limit in limits.items():
        enough = enough | ((F.col("kind") == kind) & (F.col("score") >= limit))
    open_ = rows.select("row", F.inline("found.candidates")).where("free").withColumn("v", array_to_vector("x"))
    scored = model.transform(open_).select("row", "kind", "start", "end", score.alias("score")).where(enough)
    return scored.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", "score")).alias("added"))


def spans(docs: DataFrame, trees: int = 10, precision: float = 0.95) -> DataFrame:
    """doc_id, ``base`` and ``spans`` (arrays of kind, start, end) of every row."""
    rows = docs.select("doc_id", found_in(F.col("text")).alias("found"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "spans")
    added = added_spans(rows, trees, precision)
    out = rows.select("row", "doc_id", "found.base").join(added, "row", "left")
    return out.select("doc_id", "base", best_first(F.col("base"), F.col("added")).alias("spans"))


def report(docs: DataFrame, **options) -> DataFrame:
    """Counts of base spans by kind, digest of the base spans, and all spans as text."""
    found = spans(docs, **options)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def redact(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in brackets."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, all_spans: pd.Series) -> pd.Series:
        out = []
        for t, rows in zip(texts, all_spans, strict=True):
            reach, parts = 0, []
            for s in sorted(rows, key=lambda s: (s["start"], -s["end"])) if t else ():
                if s["start"] >= reach:
                    parts += [t[reach : s["start"]], f"[{KINDS[s['kind']]}]"]
                reach = max(reach, s["end"])
            out.append("".join([*parts, t[reach:]]) if t else t)
        return pd.Series(out)

    return run(text, found)
