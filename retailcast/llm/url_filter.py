"""URL filter: rules by host and path, and a character language-model ratio for the other URLs.

Two smoothed variable-order Markov models (characters, contexts of up to ``ORDER``) are counted from the
URLs that rules accept and reject. A URL without a rule is judged by its length-normalised difference
of log-likelihoods, calibrated by isotonic regression: each half of the rule-judged URLs is scored by
the counts of the other half. Counts cover all pages and are exact: the n-grams are a table that grows with the
input and never meets in one place. The gain of a character follows from its longest n-gram, so it is computed once
for each distinct one, and chunks of URLs join the gains they need. Gains are summed as whole numbers, in any order.

Defined cases: a null URL and one without ``://`` have empty host and path and no rule; an empty URL has
difference 0; without accepted or without rejected URLs the models say nothing and the verdict is allow.
Repeated rows get equal verdicts. Extra columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailcast.llm.calibration import CELLS, isotonic
from retailcast.llm.common import stored

#: fixed values: verdict, host and path of each rule
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

ORDER = 5
WEIGHT = 2.0  # pseudo-counts given to the shorter context
RANGE = (-5.0, 5.0)
PIECE = 1 << 20  # characters counted or scored together
SCALE = 1 << 32  # gains are whole multiples of 1 / SCALE
SIDES = ((0, 0), (0, 1), (1, 0), (1, 1))  # half, class (0 rejected, 1 accepted)


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, and rule and ruled (its verdict) of the longest rule that fits."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce("url", F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    out = pages.select(
        "page_id",
        url.alias("url"),
        F.translate(F.regexp_extract(url, parts, 1), upper, lower).alias("host"),
        F.regexp_extract(url, parts, 2).alias("path"),
    )
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer rules are put on top
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        ruled = F.when(fits, F.lit(verdict)).otherwise(ruled)
    return out.select("*", rule.alias("rule"), ruled.alias("ruled"))


def longest_grams(url: str) -> list[str]:
    """The n-gram that ends at each position after the opening mark, as long as the models look back."""
    marked = f"\x02{url}\x03"
    return [marked[max(at - ORDER, 0) : at + 1] for at in range(1, len(marked))]


def pieces(urls: list[str]) -> Iterator[slice]:
    """Runs of URLs of about ``PIECE`` characters; a longer URL is a run of its own."""
    begin = size = 0
    for at, url in enumerate(urls):
        if size and size + len(url) > PIECE:
            yield slice(begin, at)
            begin, size = at, 0
        size += len(url) + 2
    if urls:
        yield slice(begin, len(urls))


def count_grams(urls: DataFrame) -> DataFrame:
    """``gram`` and its counts ``c00, c01, c10, c11`` (half, class) over all rule-judged rows, one row for each
    n-gram of 1 to ORDER + 1 characters."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (half, label), part in pdf.groupby(["half", "class"]):
                texts, times = part["url"].tolist(), part["n"].tolist()
                for run in pieces(texts):
                    found: Counter[str] = Counter()
                    for text, n in zip(texts[run], times[run], strict=True):
                        marked = f"\x02{text}\x03"
                        for size in range(1, ORDER + 2):
                            for at in range(len(marked) - size + 1):
                                found[marked[at : at + size]] += n
                    out = pd.DataFrame({"gram": list(found), "n": list(found.values())})
                    yield out.assign(**{"half": half, "class": label})

    judged = urls.where("class is not null").select("url", "n", "half", "class")
    emitted = judged.mapInPandas(count, "gram string, n long, half int, class int")
    return emitted.groupBy("gram").agg(
        *(F.sum(F.when((F.col("half") == h) & (F.col("class") == k), F.col("n")).otherwise(0)).alias(f"c{h}{k}") for h, k in SIDES)
    )


def gains(grams: DataFrame, counts: DataFrame, characters: np.ndarray) -> DataFrame:
    """``gram, g0, g1, whole`` for each longest gram: log-probability of its last character under the accepted minus
    the rejected model, by the counts of half 1, of half 0 and of both, in units of 1 / SCALE.

    ``characters`` are the characters counted by half and class.
    """
    size = F.length("gram")
    roles = [(f"s{m}", F.when(size >= m, F.substring("gram", -m, m))) for m in range(1, ORDER + 2)]  # suffixes
    roles += [(f"x{m}", F.when(size >= m, F.expr(f"substring(gram, -{m}, {m - 1})"))) for m in range(2, ORDER + 2)]  # their contexts
    asked = grams.select(
        F.col("gram").alias("longest"),
        F.explode(F.array(*(F.struct(F.lit(r).alias("role"), g.alias("gram")) for r, g in roles))).alias("ask"),
    ).select("longest", "ask.role", "ask.gram")
    met = asked.where("gram is not null").join(counts.hint("merge"), "gram", "left")
    wide = met.groupBy("longest").agg(
        *(
            F.sum(F.when(F.col("role") == r, F.coalesce(F.col(f"c{h}{k}"), F.lit(0))).otherwise(0)).cast("double").alias(f"{r}_{h}{k}")
            for r, _ in roles
            for h, k in SIDES
        )
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["longest"].str.len().to_numpy()
            out = {"gram": pdf["longest"]}
            for name, halves in (("g0", [1]), ("g1", [0]), ("whole", [0, 1])):
                if not (characters[halves].sum(0) > 0).all():
                    halves = [0, 1]  # a half without URLs of a class cannot judge the other one
                logs = []
                for k in (0, 1):

                    def count(role: str, halves=halves, k=k) -> np.ndarray:
                        return sum(pdf[f"{role}_{h}{k}"].to_numpy() for h in halves)

                    p = (count("s1") + 1e-2) / (characters[halves, k].sum() + 1e-2 * 256)
                    for m in range(2, ORDER + 2):
                        here = count(f"s{m}")
                        longer = (here + WEIGHT * p) / (np.maximum(count(f"x{m}"), here) + WEIGHT)
                        p = np.where(size >= m, longer, p)
                    logs.append(np.log(p))
                out[name] = np.rint((logs[1] - logs[0]) * SCALE).astype(np.int64)
            yield pd.DataFrame(out)

    return wide.mapInPandas(compare, "gram string, g0 long, g1 long, whole long")


def differences(ruled: DataFrame) -> DataFrame | None:
    """``url, n, half, class, other, whole`` of every distinct URL: its rows, and its log-likelihood under the accepted
    minus the rejected model for each character, by the counts of the other half and by all counts. A half without
    URLs of a class leaves the other half to all counts, as in a table of few URLs. None without accepted or without rejected URLs.

    URLs are dealt into chunks of about ``PIECE`` characters; a chunk asks for each of its grams once.
    """
    distinct = ruled.groupBy("url").agg(F.count("*").alias("n"), (F.first("ruled") == "allow").cast("int").alias("class"))
    distinct = distinct.withColumn("half", F.pmod(F.xxhash64("url"), F.lit(2)).cast("int"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, size = TaskContext.get().partitionId() << 33, 0
        for pdf in batches:
            numbers = []
            for url in pdf["url"]:
                if size and size + len(url) > PIECE:
                    chunk, size = chunk + 1, 0
                size += len(url) + 2
                numbers.append(chunk)
            yield pdf.assign(chunk=np.array(numbers, np.int64))

    columns = "url string, n long, class int, half int"
    typed = distinct.select("url", "n", "class", "half")
    urls = stored(typed.mapInPandas(deal, f"{columns}, chunk long"), "urls")
    characters = np.zeros((2, 2))
    sums = urls.where("class is not null").groupBy("half", "class").agg(F.sum((F.length("url") + 1) * F.col("n")).alias("n"))
    for row in sums.collect():
        characters[row["half"], row["class"]] = row["n"]
    if not (characters.sum(0) > 0).all():
        return None

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk, part in pdf.groupby("chunk"):
                yield pd.DataFrame({"chunk": chunk, "gram": list({g for url in part["url"] for g in longest_grams(url)})})

    asked = stored(urls.select("chunk", "url").mapInPandas(ask, "chunk long, gram string"), "asked")
    counts = stored(count_grams(urls), "gram-counts")
    known = stored(gains(asked.select("gram").distinct(), counts, characters), "gains")
    answers = asked.join(known.hint("merge"), "gram")

    def add(part: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        gain = dict(zip(answer["gram"], zip(answer["g0"], answer["g1"], answer["whole"], strict=True), strict=True))
        other, whole = [], []
        for url, half in zip(part["url"], part["half"], strict=True):
            found = [gain[g] for g in longest_grams(url)]
            other.append(sum(int(g[half]) for g in found) / SCALE / len(found))
            whole.append(sum(int(g[2]) for g in found) / SCALE / len(found))
        out = part[["url", "n", "half"]].assign(other=other, whole=whole)
        out["class"] = part["class"].astype("Int64")
        return out[["url", "n", "class", "half", "other", "whole"]]

    scored = urls.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(add, f"{columns}, other double, whole double")
    return stored(scored, "differences")


def calibrated(found: DataFrame) -> DataFrame:
    """``url`` and ``score``, the calibrated probability that it is accepted."""
    place = F.floor((F.col("other") - RANGE[0]) / (RANGE[1] - RANGE[0]) * CELLS)
    judged = found.where("class is not null").select(F.least(F.greatest(place, F.lit(0)), F.lit(CELLS - 1)).alias("cell"), "class", "n")
    rows = judged.groupBy("cell").agg(F.sum(F.col("class") * F.col("n")).alias("ones"), F.sum("n").alias("n")).toPandas()
    ones, total = np.zeros(CELLS), np.zeros(CELLS)
    ones[rows["cell"].astype(int)], total[rows["cell"].astype(int)] = rows["ones"], rows["n"]
    calibrate = isotonic(ones, total, *RANGE)

    @F.pandas_udf("double")
    def score(difference: pd.Series) -> pd.Series:
        return pd.Series(calibrate(difference.to_numpy()))

    return found.select(F.col("url").alias("scored_url"), score("whole").alias("score"))


def judge(pages: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score (probability of acceptance) of every page."""
    ruled = with_rules(pages.select("page_id", "url"), rules)
    found = differences(ruled)
    if found is None:
        scored = ruled.withColumn("score", F.lit(1.0))
    else:
        known = stored(calibrated(found), "url-scores")
        scored = ruled.join(known.hint("merge"), ruled["url"] == known["scored_url"], "left")
    by_model = F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")
