"""Exact linear-interpolated quantiles.

``percentile`` keeps every distinct value of a group in one task. That is fine for
one series (at most one value per day) and wrong for a whole table, for which
``global_quantiles`` finds the needed ranks in two steps: distinct values are counted
map-side, cut into many buckets at the quantiles of a sample, and only the buckets that hold
a wanted rank are sorted. The sample decides balance only, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series_quantiles(target: str, probs: Sequence[float]) -> Column:
    """Quantiles of a bounded group, for use in ``agg`` or over a series partition."""
    return F.percentile(target, F.array(*[F.lit(float(p)) for p in probs]))


def global_quantiles(
    df: DataFrame, target: str, probs: Sequence[float], buckets: int = 1024
) -> DataFrame:
    """One row ``q array<double>`` with the quantiles of a column of the whole frame.

    ``buckets`` is a power of two. Null and NaN are left out.
    """
    if buckets < 2 or buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    value = F.nanvl(F.col(target).cast("double"), F.lit(None).cast("double"))
    counts = df.select(value.alias("x")).where(F.col("x").isNotNull()).groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    # keeps the count in both uses below, so that they share one exchange and the input is read once
    counts = counts.where(F.col("c") > 0)
    # the values of smallest hash are a fixed random sample, of bounded size
    sample = counts.orderBy(F.xxhash64("x"), "x").limit(8 * buckets).agg(F.sort_array(F.collect_list("x")).alias("s"))
    at = f"transform(sequence(1, {buckets - 1}), i -> get(s, cast(i * size(s) / {buckets} AS int)))"
    edges = sample.select(F.expr(at).alias("edges")).scalar()
    # binary search: the number of edges below the value
    steps, step = [], buckets // 2
    while step:
        steps.append(str(step))
        step //= 2
    search = f"aggregate(array({', '.join(steps)}), 0, (b, s) -> b + if(get(edges, b + s - 1) < x, s, 0))"
    placed = counts.withColumn("edges", edges).select("x", "c", F.expr(search).alias("b"))

    # at most ``buckets`` rows
    whole = Window.orderBy("b")
    totals = placed.groupBy("b").agg(F.sum("c").alias("size")).select(
        "b",
        "size",
        (F.sum("size").over(whole) - F.col("size")).alias("before"),
        F.sum("size").over(Window.partitionBy()).alias("n"),
    )
    wanted = ", ".join(
        f"named_struct('i', {i}, 'k', {k}, 'h', {float(p)!r}D * (n - 1), 'r', {f}({float(p)!r}D * (n - 1)))"
        for i, p in enumerate(probs)
        for k, f in ((0, "floor"), (1, "ceil"))
    )
    inside = F.expr(f"filter(array({wanted}), t -> t.r >= before AND t.r < before + size)")
    hits = totals.select("b", "before", inside.alias("ranks")).where(F.size("ranks") > 0)
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("b").orderBy("x"))
    numbered = placed.join(hits, "b").select("x", "c", upto.alias("upto"), "ranks")
    found = numbered.select("x", F.expr("inline(filter(ranks, t -> t.r < upto AND t.r >= upto - c))"))
    picks = []
    for i in range(len(probs)):
        low = F.max(F.when((F.col("i") == i) & (F.col("k") == 0), F.col("x")))
        high = F.max(F.when((F.col("i") == i) & (F.col("k") == 1), F.col("x")))
        part = F.max(F.when(F.col("i") == i, F.col("h") - F.floor("h")))
        picks.append(low + (high - low) * part)
    return found.agg(F.array(*picks).alias("q"))
