"""Interaction of text filters: what each removes in every order, and its Shapley share from the potential of the removal game.

A coalition of filters removes the documents that fail any of them. The removals of all coalitions of a part follow from the
counts of its failure patterns, so documents are counted once and every order is a chain of coalitions: a filter's
step removes the difference of two of them.

The potential (Hart and Mas-Colell) of a coalition S is ``P(S) = (v(S) + sum of P(S without i)) / |S|``, and a filter's Shapley
value is ``P(all) - P(all without it)``. Potentials are kept in whole numbers, multiplied by the number of orders.

Five filters are given: few words, few distinct words, many capitals, symbols, and a text that a smaller id
has already. A document is in the part of its source.

Defined cases: a null text counts as empty, and empty texts are identical; a null source counts as the empty string. Repeated rows are documents of their own, but rows of the smallest id are no
copies of each other. A row without an id is no copy and no original, and has no labels. An id with several label rows takes
the larger label. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailcast.llm.common import bind, labelled

BLANK = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure of the four filters that look at one text."""

    def judged(t: Column) -> Column:
        def counted(words: Column) -> Column:
            n = F.size(words)
            return F.struct((n < 200).alias("A"), (100 * F.size(F.array_distinct(words)) < 50 * n).alias("B"))

        words = F.filter(F.split(t, BLANK), lambda w: w != "")
        capitals = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]", ""))
        return F.struct(
            bind(words, counted).alias("words"),
            (F.lit(100) * capitals.cast("long") > F.lit(2) * F.length(t)).alias("C"),
            t.rlike(r"[#$%&*|]").alias("D"),
        )

    found = bind(F.coalesce(text, F.lit("")), judged)
    return {"A": found["words"]["A"], "B": found["words"]["B"], "C": found["C"], "D": found["D"]}


def pattern_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask`` (bit i: fails filter i) and the numbers ``n``, ``good`` and ``toxic`` of documents.

    Ids meet their labels by one exchange, which also folds repeated rows. Copies are told from originals on the
    counts by text digest, part and label, which are small however many copies a text has.
    """
    fails = text_filters(F.col("text"))
    bits = sum((fails[f].cast("int") * (1 << i) for i, f in enumerate("ABCD")), F.lit(0))
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("source"), F.lit("")).alias("part"),
        bits.alias("mask"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
    )
    marks = labelled(labels, "quality").select("label_id", F.col("label").alias("good"))
    toxic = labelled(labels, "toxic").select(F.col("label_id").alias("toxic_id"), F.col("label").alias("toxic"))
    rows = rows.join(marks, F.col("doc_id") == F.col("label_id"), "left").join(toxic, F.col("doc_id") == F.col("toxic_id"), "left")
    kinds = ("digest", "part", "mask", "good", "toxic")
    once = rows.groupBy("doc_id", *kinds).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    sums = once.groupBy(*kinds).agg(F.sum("n").alias("n"), first.alias("first"), nameless.alias("nameless"))
    least = sums.groupBy(F.col("digest").alias("key")).agg(F.min("first.doc_id").alias("original"))
    met = sums.join(least, F.col("digest") == F.col("key"))
    own = F.when(F.col("first.doc_id") == F.col("original"), F.col("first.n")).otherwise(0) + F.col("nameless")
    split = F.array(
        F.struct(F.col("mask").alias("mask"), own.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - own).alias("n"))
    )
    flat = met.select("part", "good", "toxic", F.explode(split).alias("s")).where("s.n > 0")
    return flat.groupBy("part", F.col("s.mask").alias("mask")).agg(
        F.sum("s.n").alias("n"),
        F.sum(F.when(F.col("good") == 1, F.col("s.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic") == 1, F.col("s.n")).otherwise(0)).alias("toxic"),
    )


def coalitions(patterns: DataFrame, filters: int) -> DataFrame:
    """One row a part: arrays over all coalitions of the documents removed (``v``), the good and the toxic ones among them,
    ``alone`` (failing exactly these filters), and the number of documents ``total``."""
    names = {"v": "n", "good": "good", "toxic": "toxic"}
    parts = patterns.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("m"),  # 2^filters entries at most
    )
    masks = F.sequence(F.lit(0), F.lit((1 << filters) - 1))

    def of(mask: Column, field: str) -> Column:
        return F.coalesce(F.try_element_at("m", mask)[field], F.lit(0)).cast("long")

    def removed(field: str) -> Column:
        return F.transform(
            masks,
            lambda s: F.aggregate(
                F.filter(masks, lambda m: m.bitwiseAND(s) != 0), F.lit(0).cast("long"), lambda total, m: total + of(m, field)
            ),
        )

    return parts.select(
        "part", "total", *[removed(field).alias(name) for name, field in names.items()], F.transform(masks, lambda m: of(m, "n")).alias("alone")
    )


def potentials(games: DataFrame, filters: int) -> DataFrame:
    """Adds ``p``, the potential of every coalition times the number of orders, each from those one filter smaller."""
    members = F.array(*[F.lit(1 << i) for i in range(filters)])

    def extended(p: Column, s: Column) -> Column:
        own = F.filter(members, lambda b: s.bitwiseAND(b) != 0)
        smaller = F.aggregate(own, F.lit(0).cast("long"), lambda total, b: total + F.get(p, s.bitwiseXOR(b)))
        worth = factorial(filters) * F.get("v", s) + smaller
        return F.array_append(p, F.call_function("div", worth, F.size(own).cast("long")))

    grown = F.aggregate(F.sequence(F.lit(1), F.lit((1 << filters) - 1)), F.array(F.lit(0)).cast("array<long>"), extended)
    return games.withColumn("p", grown)


def audit(patterns: DataFrame, names: str = "ABCDE") -> DataFrame:
    """All orders of the filters, step by step, for every part. ``patterns`` as from ``pattern_counts``; bit i is ``names[i]``."""
    games = potentials(coalitions(patterns, len(names)), len(names))
    orders = F.array(*[F.lit("".join(o)) for o in permutations(names)])
    full = (1 << len(names)) - 1
    rows = games.withColumn("filter_order", F.explode(orders)).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(names))))
    )

    def coalition(letters: Column) -> Column:
        return sum((F.when(F.contains(letters, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(names)), F.lit(0))

    rows = rows.withColumns(
        {
            "before": coalition(F.substring("filter_order", F.lit(1), F.col("step") - 1)),
            "bit": coalition(F.substring("filter_order", F.col("step"), F.lit(1))),
        }
    ).withColumn("after", F.col("before") + F.col("bit"))

    def gained(name: str) -> Column:
        return F.get(name, F.col("after")) - F.get(name, F.col("before"))

    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.get("v", F.col("after"))).alias("kept"),
        gained("v").alias("removed"),
        (F.get("v", F.col("bit")) - gained("v")).alias("redundant"),
        F.get("alone", F.col("bit")).alias("unique_fails"),
        gained("good").alias("good_lost"),
        gained("toxic").alias("toxic_lost"),
        (F.get("p", F.lit(full)) - F.get("p", F.lit(full) - F.col("bit"))).alias("shapley"),
    )
