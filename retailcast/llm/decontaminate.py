"""Benchmark decontamination by suffix arrays over the training words.

Shards of training documents are indexed by a suffix array over their words; every suffix of every
benchmark item is looked up in every shard by binary search, which yields all verbatim matches of
at least ``window`` words, their locations and, by joining matches on one diagonal, the longest
ones. A shard is a run of documents of one task, bounded by ``SHARD`` characters. Suffixes are sorted
to the depth of a window, which is all the search compares; suffixes that cannot start a window
(their first words start none) are left out before sorting.

The benchmark is a query set against all documents: it is sent to the tasks in blocks of bounded
size, one pass for each block.

Defined cases: a null text has no words; an item with fewer words than a window is one window; an
item without words matches nothing; items without an id are named by an empty string; several rows
of one item count as one item. Repeated documents get equal results. Extra columns are kept by
``remove`` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 16 << 20  # characters of benchmark text sent to the tasks at once
SHARD = 4 << 20  # characters of training text indexed together
FLAGS = 1 << 22
MATCH = "struct<n_words:bigint,n_hit:bigint,matches:array<struct<item_id:string,item_start:int,doc_start:int,length:int>>>"

_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters outside ASCII blanks, signs and controls, A-Z in lower case."""
    return text.encode("utf-8", "replace").translate(_WORDS).split() if text else []


@dataclass(frozen=True)
class Suffixes:
    """Windows of one block of the benchmark, ready for binary search."""

    vocabulary: dict[bytes, int]
    window: int
    depth: int
    names: list[str]
    low: np.ndarray
    high: np.ndarray
    item: np.ndarray
    start: np.ndarray
    length: np.ndarray
    flags: np.ndarray


def _mix(columns: list[np.ndarray]) -> np.ndarray:
    code = np.zeros(len(columns[0]), np.uint32)
    for c in columns:
        code = (code ^ c.astype(np.uint32)) * np.uint32(0x9E3779B1)
        code ^= code >> np.uint32(15)
    return code & np.uint32(FLAGS - 1)


def _keys(rows: np.ndarray) -> np.ndarray:
    """Word numbers as byte strings that sort like the rows; a number is never 0, the filler is."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


def index_items(items: list[tuple[str, str]], window: int) -> Suffixes:
    vocabulary: dict[bytes, int] = {}
    rows, item, start, length, names = [], [], [], [], []
    for name, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        if not ids:
            continue
        names.append(name)
        size = min(window, len(ids))
        for at in range(len(ids) - size + 1):
            rows.append(ids[at : at + size] + [0] * (window - size))
            item.append(len(names) - 1)
            start.append(at)
            length.append(size)
    matrix = np.array(rows, np.uint32).reshape(-1, window)
    lengths = np.array(length, np.int64)
    depth = int(min(3, lengths.min(initial=window)))
    flags = np.zeros(FLAGS, bool)
    if len(matrix):
        flags[_mix([matrix[:, k] for k in range(depth)])] = True
    filler = np.arange(window) >= lengths[:, None]
    return Suffixes(
        vocabulary, window, depth, names, _keys(matrix), _keys(np.where(filler, 0xFFFFFFFF, matrix)),
        np.array(item, np.int64), np.array(start, np.int64), lengths, flags,
    )


def matches_in(texts: list[str | None], index: Suffixes) -> list[tuple[int, int, list[tuple[str, int, int, int]]]]:
    """Words, hit words and maximal matches of each text of one shard."""
    runs = [words_of(t) for t in texts]
    sizes = np.array([len(r) for r in runs], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])  # a 0 ends each document
    ids = np.zeros(begin[-1] + index.window, np.uint32)
    get = index.vocabulary.get
    for at, run in zip(begin, runs, strict=False):
        ids[at : at + len(run)] = np.fromiter(map(get, run, repeat(0)), np.uint32, len(run))
    out = [(int(n), 0, []) for n in sizes]
    if not len(index.low):
        return out
    last = begin[-1]
    heads = [ids[k : k + last] for k in range(index.depth)]
    open_ = np.logical_and.reduce([h > 0 for h in heads])
    at = np.flatnonzero(open_)
    at = at[index.flags[_mix([h[at] for h in heads])]]
    if not len(at):
        return out
    rows = ids[at[:, None] + np.arange(index.window)]
    rows[np.cumsum(rows == 0, axis=1) > 0] = 0
    keys = _keys(rows)
    order = np.argsort(keys, kind="stable")
    array, keys = at[order], keys[order]
    low, high = np.searchsorted(keys, index.low, "left"), np.searchsorted(keys, index.high, "right")
    times = np.maximum(high - low, 0)
    if not times.sum():
        return out
    which = np.repeat(np.arange(len(times)), times)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    place = array[low[which] + offset]
    # windows that follow each other on one diagonal are one match
    item, start, length = index.item[which], index.start[which], index.length[which]
    diagonal = place - start
    by = np.lexsort((place, diagonal, item))
    item, start, length, place, diagonal = (x[by] for x in (item, start, length, place, diagonal))
    new = np.ones(len(place), bool)
    new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(place)))
    item, start, place, length = item[first], start[first], place[first], length[first] + count - 1
    edge = np.zeros(last + 2, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + length, -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
    doc = np.searchsorted(begin, place, "right") - 1
    for d in np.unique(doc).tolist():
        out[d] = (int(sizes[d]), int(hit[begin[d + 1]] - hit[begin[d]]), [])
    for d, i, s, p, n in zip(doc.tolist(), item.tolist(), start.tolist(), (place - begin[doc]).tolist(), length.tolist(), strict=True):
        out[d][2].append((index.names[i], s, p, n))
    return out


def _scan(text: Column, index: Suffixes) -> Column:
    @F.pandas_udf(MATCH)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            results, shard, size = [], [], 0
            for t in texts:
                shard.append(t)
                size += len(t or "")
                if size > SHARD:
                    results += matches_in(shard, index)
                    shard, size = [], 0
            results += matches_in(shard, index) if shard else []
            yield pd.DataFrame(results, columns=["n_words", "n_hit", "matches"])

    return run(text)


def _covered(matches: Column) -> Column:
    """Words covered by the matches of several blocks."""

    @F.pandas_udf("long")
    def run(series: pd.Series) -> pd.Series:
        def one(found):
            total, reach = 0, 0
            for a, b in sorted((m["doc_start"], m["doc_start"] + m["length"]) for m in found):
                total += max(0, b - max(a, reach))
                reach = max(reach, b)
            return total

        return series.map(one)

    return run(matches)


def item_blocks(benchmark: DataFrame, limit: int = BLOCK) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in blocks of about ``limit`` characters; the blocks are hash parts of the items."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").alias("body")
    ).where("body is not null")
    total = items.agg(F.sum(F.length("body")).alias("n")).first()["n"] or 0
    count = -(-total // limit) or 1
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("name", "body"), F.lit(count)) == k)
        yield sorted((r["name"], r["body"]) for r in part.collect())


def with_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block: int = BLOCK) -> DataFrame:
    """``row`` (the input columns) and ``found`` (n_words, n_hit, matches) of every document."""
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = out.withColumn("found", F.lit(None).cast(MATCH))
    blocks = 0
    for items in item_blocks(benchmark, block):
        blocks += 1
        seen = _scan(F.col("row.text"), index_items(items, window))
        if blocks == 1:
            out = out.withColumn("found", seen)
            continue
        out = out.withColumn("more", seen)
        joined = F.concat("found.matches", "more.matches")
        out = out.withColumn("found", F.struct(F.col("found.n_words"), _covered(joined).alias("n_hit"), joined.alias("matches")))
        out = out.drop("more")
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    names = F.array_sort(F.array_distinct(F.transform("found.matches", lambda m: m["item_id"])))
    found = with_matches(docs.select("doc_id", "text"), benchmark, window).select("row.doc_id", "found", names.alias("names"))
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("names").cast("long").alias("n_items"),
        F.sha2(F.array_join("names", ","), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Maximal verbatim matches: doc_id, item_id, item_start, doc_start and length in words."""
    found = with_matches(docs.select("doc_id", "text"), benchmark, window)
    return found.select("row.doc_id", F.inline("found.matches"))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without any match, all columns as they were."""
    return with_matches(docs, benchmark, window).where("found.n_hit = 0").select("row.*")


