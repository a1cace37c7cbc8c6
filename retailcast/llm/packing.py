"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

A document longer than a bin fills whole bins of its own; the rest of it is an item. Items are placed
longest first. Bins are kept in order of their residual; the successor search starts at the tightest bin that
has room and goes on until one is found whose bitmaps of sources and duplicate clusters do not meet
the item's, so that a bin never holds two documents of a source or of a cluster. Without such a bin a new
one is opened.

Items are dealt by a hash of their content (id, source, cluster, length, number of the copy) into parts of about
``PART`` items, each packed by one task, so bins do not depend on files or partitions; a source or a cluster with a
third of all rows is spread evenly over the parts. All documents are placed. ``part_size`` of at least the number
of items is one search over all of them.

Defined cases: a null or blank text has no tokens and gets no bin (null); a null source or cluster
conflicts with nothing; ties in length are placed by id, source, cluster and copy; repeated rows are placed each,
in different bins if they share a cluster. Extra columns are never read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailcast.llm.common import stored

CAPACITY = 2048
PART = 4096
RUN = 1 << 15  # copies of one row that are listed together


def pack(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each item (length, source bitmap, cluster bitmap), in the order given."""
    order: list[tuple[int, int]] = []  # residual, bin
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for length, source, cluster in items:
        at = bisect_left(order, (length, -1))
        while at < len(order) and (sources[order[at][1]] & source or clusters[order[at][1]] & cluster):
            at += 1
        if at < len(order):
            residual, chosen = order.pop(at)
        else:
            residual, chosen = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        out.append((chosen, capacity - residual))
        sources[chosen] |= source
        clusters[chosen] |= cluster
        if residual > length:
            insort(order, (residual - length, chosen))
    return out


def bitmaps(values: list) -> list[int]:
    """One bit per value that occurs more than once; values that cannot conflict have none."""
    repeated = [v for v, n in Counter(values).items() if n > 1 and v is not None]
    bit = {v: 1 << i for i, v in enumerate(repeated)}
    return [bit.get(v, 0) for v in values]


def place(items: DataFrame, capacity: int = CAPACITY, part_size: int = PART) -> DataFrame:
    """Bins filled alone, bin and offset of the rest of each row; ``items`` has doc_id, source, cluster, n_tokens."""
    key = ["doc_id", "source", "cluster", "n_tokens"]
    # equal rows can stand for each other, so their number is all that has to be known
    counted = stored(items.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")), "items")
    parts = max(1, -(-(counted.agg(F.sum("copies")).first()[0] or 0) // part_size))
    runs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN))
    copies = counted.select(*key, "copies", F.explode(runs).alias("run")).select(
        *key,
        F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("copies"), (F.col("run") + 1) * RUN) - 1)).alias("copy"),
    )
    rows = copies.withColumns({"n_full": F.floor(F.col("n_tokens") / capacity), "rest": F.col("n_tokens") % capacity})
    dealt = rows.where("rest > 0").withColumn("part", F.pmod(F.xxhash64(*key, "copy"), F.lit(parts)))

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("rest", "descending"), *[(c, "ascending") for c in (*key, "copy")]])
        columns = [part["rest"].to_pylist(), *[bitmaps(part[c].to_pylist()) for c in ("source", "cluster")]]
        found = pack(list(zip(*columns, strict=True)), capacity)
        first = part["part"][0].as_py() << 32
        bins, starts = pa.array([first + b for b, _ in found], pa.int64()), pa.array([at for _, at in found], pa.int64())
        return part.append_column("bin_id", bins).append_column("bin_start", starts).select(names)

    names = ["doc_id", "n_tokens", "n_full", "bin_id", "bin_start", "source", "cluster"]
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema} | {"bin_id": "bigint", "bin_start": "bigint"}
    placed = dealt.groupBy("part").applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))
    none = F.lit(None).cast("long")
    return placed.unionByName(rows.where("rest = 0").withColumns({"bin_id": none, "bin_start": none}).select(*names))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, part_size: int = PART, groups: DataFrame | None = None
) -> DataFrame:
    """doc_id, n_tokens (words), n_full (bins filled alone), bin_id and bin_start of the rest of every row.

    The cluster of a row is that of its id in ``groups`` (doc_id, component_id), such as the result of the SimHash
    operator. Without groups, or for a row without an id, it is a hash of its text in lower case with blanks made equal.
    """
    plain = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    cluster = F.when(F.col("text").isNotNull(), F.xxhash64(plain))
    items = docs.select("doc_id", "source", cluster.alias("cluster"), word_count(F.col("text")).alias("n_tokens"))
    if groups is not None:
        named = groups.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        named_cluster = F.when(F.col("cluster").isNotNull(), F.coalesce("component_id", "cluster"))
        items = items.join(named, "doc_id", "left").withColumn("cluster", named_cluster).drop("component_id")
    return place(items, capacity, part_size)
