"""A kd-tree over distinct points in two levels.

The upper level is broadcast. It is grown by rounds -- count all points per leaf,
split every leaf over ``leaf_rows`` by a sample of its own rows, count again -- so
the bound holds for the points and not only for the sample; but it never has more
than about ``MAX_LEAVES`` leaves: beyond that its leaves grow with the points, and
what the driver holds and broadcasts does not. The lower level is built inside
the task that holds a leaf's points, from those points (``knn``).

``grow`` splits at medians of the widest dimension. Points must be distinct, so a
leaf can always be split.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch.session import Shared

LEAF = -1
#: leaves of the upper level: at 6 dimensions about 20 MB of broadcast tree
MAX_LEAVES = 1 << 16


class Tree:
    """Parallel lists of nodes: split feature (or LEAF), threshold, children, region."""

    def __init__(self, dims: int) -> None:
        self.feat, self.thr, self.left, self.right = [LEAF], [0.0], [-1], [-1]
        self.lo, self.hi = [np.full(dims, -np.inf)], [np.full(dims, np.inf)]

    def grow(self, node: int, x: np.ndarray, cap: int) -> None:
        """Split ``node`` until its leaves hold at most ``cap`` rows of ``x``."""
        todo = [(node, x)]
        while todo:
            me, x = todo.pop()
            spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(1)
            if len(x) <= cap or not spread.max() > 0:
                continue
            f = int(np.argmax(spread))
            t = float(np.median(x[:, f]))
            if not (x[:, f] < t).any():
                t = float(x[:, f][x[:, f] > x[:, f].min()].min())
            go = x[:, f] < t
            self.feat[me], self.thr[me] = f, t
            for side, rows in (("left", x[go]), ("right", x[~go])):
                lo, hi = self.lo[me].copy(), self.hi[me].copy()
                (hi if side == "left" else lo)[f] = t
                child = len(self.feat)
                self.feat.append(LEAF)
                self.thr.append(0.0)
                self.left.append(-1)
                self.right.append(-1)
                self.lo.append(lo)
                self.hi.append(hi)
                getattr(self, side)[me] = child
                todo.append((child, rows))

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf (node number) of every row."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.feat[node] == LEAF:
                out[rows] = node
                continue
            go = x[rows, self.feat[node]] < self.thr[node]
            todo += [(self.left[node], rows[go]), (self.right[node], rows[~go])]
        return out

    def near(self, x: np.ndarray, radius: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows whose ball reaches it); only branches that are reached are looked at."""
        found, todo = [], [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            gap = np.maximum(np.maximum(self.lo[node] - x[rows], x[rows] - self.hi[node]), 0.0)
            rows = rows[np.sqrt((gap ** 2).sum(axis=1)) <= radius[rows]]
            if not len(rows):
                continue
            if self.feat[node] == LEAF:
                found.append((node, rows))
            else:
                todo += [(self.left[node], rows), (self.right[node], rows)]
        return found


def with_leaf(df: DataFrame, tree, feats: Sequence[str]) -> DataFrame:
    """``df`` with ``leaf``; ``tree`` is a broadcast ``Tree``."""
    def run(batches):
        for pdf in batches:
            yield pdf.assign(leaf=tree.value.route(pdf[list(feats)].to_numpy(np.float64)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, schema + ", leaf bigint")


def fit(points: DataFrame, feats: Sequence[str], leaf_rows: int, sample_rows: int = 50_000, max_leaves: int = MAX_LEAVES) -> Tree:
    """Rounds of (sample the oversized leaves, split them, count again)."""
    spark, feats = points.sparkSession, list(feats)
    tree = Tree(len(feats))
    big = {0: points.count()}
    leaf_rows = max(leaf_rows, -(-4 * big[0] // max_leaves))  # leaves end between a quarter of this and this
    draw = F.pmod(F.xxhash64(*feats), F.lit(1 << 30)) / F.lit(float(1 << 30))
    while big := {leaf: n for leaf, n in big.items() if n > leaf_rows}:
        shared = Shared(spark, tree)
        share = min(1.0, sample_rows / sum(big.values()))
        routed = with_leaf(points.select(*feats), shared, feats).where(F.col("leaf").isin(list(big)))
        sample = routed.where(draw < share).toPandas()
        for leaf, rows in sample.groupby("leaf"):
            cap = max(1, int(leaf_rows * len(rows) / big[leaf] / 2))
            tree.grow(int(leaf), rows[feats].to_numpy(np.float64), cap)
        shared = Shared(spark, tree)
        counts = with_leaf(points.select(*feats), shared, feats).groupBy("leaf").count().where(F.col("count") > leaf_rows).collect()
        now = {r["leaf"]: r["count"] for r in counts}
        if now == big:  # a sample that met too few rows: draw more
            if share == 1.0:
                break
            sample_rows *= 4
        big = now
    return tree
