"""Isolation forest (Liu, Ting, Zhou 2008) as Spark jobs.

Trees grow from small samples picked by a row hash, so the same rows are picked
whatever the partitioning; all rows are then scored where they lie. The cut-off is
the exact quantile of the scores. Every draw is an MD5 of a row's key or of a node's number,
so any engine can grow the same trees, and ``tree_table`` gives them as rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from retailcast.operators.quantiles import global_quantiles
from retailcast.session import scratch_path

HITS = 4  # rows expected to be hit per tree, as a multiple of the sample; the sample is the first of them
EULER_GAMMA = 0.5772156649015329
PRIME = 2**31 - 1  # a row's draws for tree t are (a + t * b) mod PRIME, independent for any two trees

_NODES = (
    "tree int, points int, number array<bigint>, feature array<int>, threshold array<double>, left array<int>, depth array<double>"
)


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def node_draws(seed: int, tree: int, number: int) -> tuple[float, float]:
    """Two numbers of [0, 1) for a node: which feature it cuts, and where."""
    digest = hashlib.md5(f"{seed}:{tree}:{number}".encode()).hexdigest()
    return int(digest[:8], 16) / 2**32, int(digest[8:16], 16) / 2**32


def _grow(points: np.ndarray, limit: int, seed: int, tree: int) -> dict[str, list]:
    """Random axis cuts until a point is alone or the depth limit is reached.

    The children of node k are numbered 2k and 2k + 1, the root 1. The right child follows the left one in the
    lists; a leaf has feature -1 and stores its depth.
    """
    number, feature, threshold, left, depth = [1], [-1], [0.0], [-1], [0.0]
    todo = [(0, points, 0)]
    while todo:
        node, rows, level = todo.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if level >= limit or len(rows) <= 1 or len(usable) == 0:
            depth[node] = level + float(mean_path(len(rows)))
            continue
        which, where = node_draws(seed, tree, number[node])
        f = int(usable[int(which * len(usable))])
        cut = float(low[f] + where * (high[f] - low[f]))
        if cut >= high[f]:  # by rounding; both sides keep a point
            cut = float(low[f])
        child = len(feature)
        feature[node], threshold[node], left[node] = f, cut, child
        number += [2 * number[node], 2 * number[node] + 1]
        for values in (feature, left):
            values += [-1, -1]
        for values in (threshold, depth):
            values += [0.0, 0.0]
        below = rows[:, f] <= cut
        todo += [(child, rows[below], level + 1), (child + 1, rows[~below], level + 1)]
    return {"number": number, "feature": feature, "threshold": threshold, "left": left, "depth": depth}


def _for_scoring(node_lists) -> dict[str, np.ndarray]:
    """Arrays in which a leaf leads to itself, so that every row takes the same number of steps."""
    feature, threshold = np.array(node_lists["feature"]), np.array(node_lists["threshold"])
    left, leaf = np.array(node_lists["left"]), np.array(node_lists["feature"]) < 0
    return {
        "feature": np.where(leaf, 0, feature),
        "threshold": np.where(leaf, np.inf, threshold),
        "left": np.where(leaf, np.arange(len(leaf)), left),
        "depth": np.array(node_lists["depth"]),
        "number": np.array(node_lists["number"]),
    }


def _path_lengths(x: np.ndarray, tree: dict[str, np.ndarray], steps: int) -> np.ndarray:
    node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    for _ in range(steps):
        node = tree["left"][node] + (x[rows, tree["feature"][node]] > tree["threshold"][node])
    return tree["depth"][node]


@dataclass
class IsolationForest:
    contamination: float = 0.01
    n_trees: int = 100
    sample_size: int = 256
    seed: int = 42

    def __post_init__(self) -> None:
        self.features: list[str] = []
        self.trees: list[dict[str, np.ndarray]] = []
        self.medians: list[float] = []
        self.drawn = 0

    def _inputs(self) -> list[Column]:
        return [
            F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(m))
            for f, m in zip(self.features, self.medians, strict=True)
        ]

    def fit(self, df: DataFrame, features: Sequence[str], row_key: Sequence[str]) -> IsolationForest:
        """Grow the trees. The driver receives medians and tree nodes, both of bounded size."""
        self.features = list(features)
        medians = [global_quantiles(df, f, (0.5,)).scalar() for f in self.features]
        row = df.sparkSession.range(1).select(*[F.get(m, F.lit(0)).alias(f"m{i}") for i, m in enumerate(medians)]).first()
        self.medians = [0.0 if v is None else float(v) for v in row]

        # every tree draws from all rows: a row goes to the trees for which its draw is small
        key = F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in row_key], F.lit(str(self.seed))))
        part = lambda at: F.conv(F.substring("_h", at, 8), 16, 10).cast("bigint") % PRIME
        pool = df.select(key.alias("_h"), F.array(*self._inputs()).alias("x"))
        pool = pool.select("x", part(1).alias("_a"), part(9).alias("_b"))
        bound = math.ceil(PRIME * min(1.0, HITS * self.sample_size / max(df.count(), 1)))
        numbers = F.sequence(F.lit(0), F.lit(self.n_trees - 1))
        draw = lambda t: (F.col("_a") + t.cast("bigint") * F.col("_b")) % PRIME
        trees = F.explode(F.filter(numbers, lambda t: draw(t) < bound))
        order = Window.partitionBy("tree").orderBy(draw(F.col("tree")), "x")
        drawn = (
            pool.withColumn("tree", trees)
            .withColumn("_place", F.row_number().over(order))
            .where(F.col("_place") <= self.sample_size)
            .select("tree", "x")
        )
        limit, seed = math.ceil(math.log2(self.sample_size)), self.seed

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            points = np.vstack(pdf["x"].to_numpy())
            return pd.DataFrame([{"tree": tree, "points": len(points), **_grow(points, limit, seed, tree)}])

        nodes = drawn.groupBy("tree").applyInPandas(grow, _NODES).orderBy("tree").collect()
        self.trees = [_for_scoring(n) for n in nodes]
        self.drawn = max((n["points"] for n in nodes), default=0)
        return self

    def tree_table(self, spark: SparkSession) -> DataFrame:
        """(tree, node, feature, threshold, depth): a leaf has a depth, any other node a feature and a threshold.

        Rows with a value of at most the threshold go on to node 2k, others to 2k + 1.
        """
        rows = []
        for t, tree in enumerate(self.trees):
            leaf = np.isinf(tree["threshold"])
            for k in range(len(leaf)):
                cut = (None, None, float(tree["depth"][k])) if leaf[k] else (
                    self.features[tree["feature"][k]], float(tree["threshold"][k]), None
                )
                rows.append((t, int(tree["number"][k]), *cut))
        return spark.createDataFrame(rows, "tree int, node bigint, feature string, threshold double, depth double")

    def score(self) -> Column:
        """Anomaly score in (0, 1], to 12 digits, so that ties do not depend on the order of sums; higher is more isolated."""
        trees, scale = self.trees, max(float(mean_path(self.drawn)), 1e-12)
        steps = math.ceil(math.log2(self.sample_size))

        @F.pandas_udf(DoubleType())
        def isolation(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            total = np.zeros(len(x))
            for tree in trees:
                total += _path_lengths(x, tree, steps)
            return pd.Series(np.rint(np.exp2(-total / (len(trees) * scale)) * 1e12) / 1e12)

        return isolation(*self._inputs())

    def flag(self, df: DataFrame) -> DataFrame:
        """Add ``anomaly_if``: the score is above its ``1 - contamination`` quantile. Rows are scored once and written."""
        path = scratch_path(df.sparkSession, "scores")
        df.withColumn("_score", self.score()).write.parquet(path)
        scored = df.sparkSession.read.parquet(path)
        cut = global_quantiles(scored, "_score", (1.0 - self.contamination,)).scalar()
        return scored.withColumn("anomaly_if", F.col("_score") > F.get(cut, F.lit(0))).drop("_score")
