"""Near-duplicates by SimHash fingerprints and BK-trees.

A 64-bit fingerprint has a bit set if more than half of the document's word shingles have it in their
XXH64 (seed 42). Fingerprints link when they differ in at most ``radius`` bits, and the components
of the links are the groups.

Distinct fingerprints are dealt into shards. The 64 bits are cut into more blocks than ``radius``, so
two linked fingerprints agree on all but ``radius`` blocks; one shard holds the fingerprints that
agree on one choice of blocks, hence every link lies inside a shard. A shard over ``shard_size`` is
cut into pieces, and each pair of pieces is a task of its own. A task builds a BK-tree (children keyed
by their Hamming distance to the parent) over one piece and follows only edges within the radius.
Tasks emit spanning links, never all pairs.

Defined cases: null and blank texts have fingerprint zero and are linked like any other; texts with
fewer words than a shingle are one shingle; repeated rows share a fingerprint; a row without an id
gets the smallest id of its group, null if there is none. Extra columns are not read by the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailcast.llm.common import stored
from retailcast.llm.components import connected

BITS = 64
SEED = 42
PIECE = 1 << 16  # shingles counted together


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned fingerprint of a whole text."""
    words = text.encode("utf-8", "replace").lower().split() if text else []  # A-Z and ASCII blanks only
    if not words:
        return 0
    n = max(len(words) - width + 1, 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, PIECE):
        run = words[at : at + PIECE + width - 1]
        if len(run) < width:
            shingles = [b" ".join(run)]
        else:
            shingles = list(map(b" ".join, zip(*(run[k:] for k in range(width)), strict=False)))
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_of(text: Column, width: int = 4) -> Column:
    """The fingerprint as a signed 64-bit number."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return run(text)


class BKTree:
    """Values at nodes; the children of a node are keyed by their distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, at = len(self.values) - 1, 0
        while at != new:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), new)

    def within(self, value: int, radius: int) -> list[int]:
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(self.values[at])
            stack += [child for edge, child in self.children[at].items() if abs(edge - distance) <= radius]
        return found


class Forest:
    """Union-find that keeps the links which joined two sets."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent.setdefault(x, x)
        while parent != self.parent[parent]:
            self.parent[x] = self.parent[parent]
            x, parent = parent, self.parent[parent]
        return parent

    def link(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((x, y))


def blocks_for(n: int, radius: int, load: int = 64) -> int:
    """Fewest blocks for which a shard of evenly spread fingerprints holds about ``load`` of them."""
    return next((b for b in range(radius + 1, 4 * radius + 8) if n <= load << (BITS * (b - radius) // b)), 4 * radius + 8)


def masks(blocks: int, radius: int) -> list[int]:
    """One mask per choice of the blocks that have to agree."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def links(prints: DataFrame, radius: int = 4, shard_size: int = 4096) -> DataFrame:
    """Links ``a, b`` that connect the same fingerprints as all pairs within the radius do.

    ``prints`` has distinct, non-null fingerprints in a stored column ``fp``.
    """
    choice = masks(blocks_for(prints.count(), radius), radius)
    keyed = prints.select(
        "fp",
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("key"))
                    for t, m in enumerate(choice)
                )
            )
        ).alias("shard"),
    ).select("fp", "shard.t", "shard.key")
    sizes = stored(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "shards")
    dealt = keyed.join(sizes, ["t", "key"]).select(
        "t", "key", "fp", F.ceil(F.col("n") / shard_size).cast("int").alias("parts")
    )
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = (
        dealt.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
        .repartition("t", "key", "i", "j")
        .groupBy("t", "key", "i", "j")
        .agg(
            F.collect_list(F.when(F.col("part") == F.col("i"), F.col("fp"))).alias("tree"),
            F.collect_list(F.when((F.col("part") == F.col("j")) & (F.col("i") != F.col("j")), F.col("fp"))).alias("asked"),
            F.first(F.col("i") == F.col("j")).alias("own"),
        )
        .select("tree", "asked", "own")
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full = (1 << BITS) - 1
        for pdf in batches:
            forest = Forest()
            for shard, asked, own in zip(pdf["tree"], pdf["asked"], pdf["own"], strict=True):
                tree = BKTree()
                for value in sorted(int(v) & full for v in shard):
                    if own:
                        for near in tree.within(value, radius):
                            forest.link(value, near)
                    tree.add(value)
                for value in (int(v) & full for v in asked):
                    for near in tree.within(value, radius):
                        forest.link(value, near)
            found = np.array(forest.links, np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return tasks.mapInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    rows = stored(docs.select("doc_id", fingerprint_of(F.col("text"), width).alias("fp")), "prints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-prints")
    groups = stored(connected(links(prints.select("fp"), radius)), "groups")
    named = prints.join(groups, prints["fp"] == groups["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first_id"
    )
    named = stored(named, "named")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stored(named.join(smallest, "root").select("fp", "component_id"), "components")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def only(docs: DataFrame, rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is in ``chosen``, once each; ``rows`` has the keys of all."""
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").alias("key_id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key_text"),
    )
    same = F.col("key_id").eqNullSafe(F.col("keep_id")) & (F.col("key_text") == F.col("keep_text"))
    left = keyed.join(stored(chosen, "chosen").hint("merge"), same, "left_semi")
    if not rows.groupBy("key_id", "key_text").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["key_id", "key_text"])  # only repeated rows need this exchange
    return left.select("row.*")


def keep_one(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """One row of each group, all columns as they were: the smallest id, nulls last, then the smallest text.

    Of rows that are equal in id and text one stays. Only ids and fingerprints are compared; texts move
    once, to meet the keys of the rows to keep.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(
        docs.select(
            F.col("doc_id").alias("key_id"), F.xxhash64(text).alias("key_text"), fingerprint_of(F.col("text"), width).alias("fp")
        ),
        "prints",
    )
    order = F.struct(F.col("key_id").isNull().alias("last"), "key_id", "key_text")
    prints = stored(rows.groupBy("fp").agg(F.min(order).alias("best")), "distinct-prints")
    groups = stored(connected(links(prints.select("fp"), radius)), "groups")
    chosen = (
        prints.join(groups, prints["fp"] == groups["node"], "left")
        .groupBy(F.coalesce("root", "fp").alias("root"))
        .agg(F.min("best").alias("best"))
        .select(F.col("best.key_id").alias("keep_id"), F.col("best.key_text").alias("keep_text"))
    )
    return only(docs, rows, chosen)
