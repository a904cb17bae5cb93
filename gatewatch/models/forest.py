"""Random forests of unlimited depth (M4) whose model stays off the driver.

* Bin: every feature at up to ``BINS - 1`` quantiles; a missing value goes right,
  as it does in MLlib. Rows with the same bins are the same row to every tree, so
  the forest is fitted on the *cells*: bins, rows of class 0, rows of class 1.
  There are at most ``BINS ** features`` of them, however many rows.
* Bag: a row's weight in a tree is Poisson(1); a cell's is the sum of its rows',
  Poisson(rows), from a generator seeded by (seed, tree).
* Grow: ``groupBy(group).applyInArrow``; a group holds a few trees and the cells,
  and grows every tree level by level with NumPy: per node a random subset of
  sqrt(features), the best Gini cut over the bins. A tree is one row, written.
* Score: the distinct cells of the rows, in bounded chunks, are cogrouped with the
  trees, a group adds up its trees' votes, and the rows take their cell's mean.

Several training sets, told apart by a column ``by``, get a forest each in the same
jobs; a row is scored by the forest of its own value.

Nothing but the bin edges passes the driver. Cells are sorted and votes are whole
numbers, so the result does not depend on the order of rows or tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewatch.models.boosting import _columns, _matrix, edges_by
from gatewatch.session import write_once

BINS = 32
MAX_DEPTH = 30
GROUPS = 25
CHUNK_CELLS = 200_000  # of one scoring group
NODES_AT_ONCE = 1 << 14
UNIT = 1 << 44  # votes are summed as whole numbers


@dataclass
class Forest:
    """``trees``: a row a tree, its nodes as packed arrays; ``edges`` per training set."""
    trees: DataFrame
    edges: dict
    feats: list
    groups: int


def _bins(columns: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> np.ndarray:
    """Values -> bins: the number of edges below the value; missing ones are past all edges."""
    out = np.empty((len(columns[0]), len(edges)), np.uint8)
    for j, (c, e) in enumerate(zip(columns, edges)):
        out[:, j] = np.where(np.isnan(c), len(e), np.searchsorted(e, c, "left"))
    return out


def _with_cell(df: DataFrame, feats: Sequence[str], edges: dict) -> DataFrame:
    """``df`` and ``gw_cell``, the row's bins by the edges of its ``gw_by``."""
    n, width = len(feats), len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, columns = b.column(width + n).to_numpy(zero_copy_only=False), _columns(b, width, n)
            x = np.zeros((b.num_rows, n), np.uint8)
            for key, e in edges.items():
                at = np.flatnonzero(of == key)
                x[at] = _bins([c[at] for c in columns], e)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array([r.tobytes() for r in x], pa.binary())], [*b.schema.names[:width], "gw_cell"])

    schema = T.StructType([*df.schema, T.StructField("gw_cell", T.BinaryType())])
    return df.select("*", *[F.col(f"`{c}`").cast("double").alias(f"gw_x{i}") for i, c in enumerate(feats)], F.col("gw_by").alias("gw_of")) \
        .mapInArrow(run, schema)


def grow_tree(x: np.ndarray, n0: np.ndarray, n1: np.ndarray, weights: tuple[float, float], max_depth: int, width: int,
              rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """(feature or -1, bin, left child, share of class 1) per node, for cells ``x`` with
    ``n0`` and ``n1`` drawn rows. Bins up to ``bin`` go left; the right child is next to the left."""
    some = np.flatnonzero(n0 + n1)
    x, n0, n1 = x[some], n0[some].astype(float), n1[some].astype(float)
    n_try = int(np.ceil(np.sqrt(x.shape[1])))
    at, size, nodes, out = np.zeros(len(x), np.int64), 1, 1, []
    for depth in range(max_depth + 1):
        c0, c1 = np.bincount(at, n0, size), np.bincount(at, n1, size)
        p0, p1 = weights[0] * c0, weights[1] * c1
        feature, cut, left = np.full(size, -1, np.int8), np.zeros(size, np.uint8), np.zeros(size, np.int32)
        out.append((feature, cut, left, p1 / (p0 + p1)))
        mixed = np.flatnonzero((c0 > 0) & (c1 > 0)) if depth < max_depth else np.empty(0, np.int64)
        if not len(mixed):
            break
        place = np.full(size, -1)
        place[mixed] = np.arange(len(mixed))
        rows = np.flatnonzero(place[at] >= 0)
        rows = rows[np.argsort(place[at[rows]], kind="stable")]
        x, n0, n1, at = x[rows], n0[rows], n1[rows], at[rows]
        mine = place[at]
        pick = np.sort(np.argsort(rng.random((len(mixed), x.shape[1])), axis=1)[:, :n_try], axis=1)
        for s in range(0, len(mixed), NODES_AT_ONCE):
            who = mixed[s:s + NODES_AT_ONCE]
            of = slice(*np.searchsorted(mine, [s, s + len(who)]))
            node, gains = mine[of] - s, []
            q0, q1 = p0[who, None], p1[who, None]
            for j in range(n_try):
                key = node * width + x[np.arange(of.start, of.stop), pick[mine[of], j]]
                l0, l1 = (np.bincount(key, c[of], len(who) * width).reshape(-1, width).cumsum(axis=1)[:, :-1] * w for c, w in zip((n0, n1), weights))
                r0, r1 = q0 - l0, q1 - l1
                lw, rw = l0 + l1, r0 + r1
                ok = (lw > 0) & (rw > 1e-9 * (q0 + q1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = ((l0 ** 2 + l1 ** 2) / lw + (r0 ** 2 + r1 ** 2) / rw - (q0 ** 2 + q1 ** 2) / (q0 + q1)) / (q0 + q1)
                gains.append(np.where(ok, gain, -1.0))
            gains = np.concatenate(gains, axis=1)
            best = gains.argmax(axis=1)
            found = np.flatnonzero(gains[np.arange(len(who)), best] > 1e-12)
            feature[who[found]] = pick[s + found, best[found] // (width - 1)]
            cut[who[found]] = best[found] % (width - 1)
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            break
        left[split] = nodes + 2 * np.arange(len(split))
        rows = np.flatnonzero(feature[at] >= 0)
        x, n0, n1, at = x[rows], n0[rows], n1[rows], at[rows]
        at = left[at] - nodes + (x[np.arange(len(x)), feature[at]] > cut[at])
        size = 2 * len(split)
        nodes += size
    return tuple(np.concatenate(c) for c in zip(*out))


def route(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The leaf of every row of bins."""
    at, todo = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(todo := todo[feature[at[todo]] >= 0]):
        node = at[todo]
        at[todo] = left[node] + (x[todo, feature[node]] > cut[node])
    return at


def _by(by: str | None):
    return (F.col(by) if by else F.lit(0)).cast("int").alias("gw_by")


def fit(train: DataFrame, feats: Sequence[str], label: str, n_trees: int, max_depth: int, balanced: bool, seed: int, by: str | None = None) -> Forest:
    """``label`` is 0 or 1; ``balanced`` weighs a class of n_c rows by n / (classes n_c).
    With ``by`` (a whole number) the rows of every value get a forest of their own."""
    feats, groups = list(feats), min(n_trees, GROUPS)
    rows = write_once(train.where(F.col(label).isNotNull()).select(
        _by(by), *[F.col(c).cast("double").alias(c) for c in feats], F.col(label).cast("int").alias("gw_y")), "fit_on")
    edges = edges_by(rows, "gw_by", feats, BINS)
    cells = write_once(_with_cell(rows, feats, edges).groupBy("gw_by", "gw_cell").agg(
        F.sum(1 - F.col("gw_y")).alias("n0"), F.sum("gw_y").alias("n1")), "cells")
    schema = "gw_by int, tree int, feature binary, cut binary, left binary, share binary"

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        own = key[0].as_py()
        width = max(len(e) for e in edges[own]) + 1
        x = _matrix(table.column("gw_cell"), np.uint8, len(feats))
        order = np.lexsort(x.T)
        x, n0, n1 = x[order], table.column("n0").to_numpy()[order], table.column("n1").to_numpy()[order]
        counts = np.array([n0.sum(), n1.sum()])
        weights = tuple(counts.sum() / ((counts > 0).sum() * np.maximum(counts, 1))) if balanced else (1.0, 1.0)
        found = []
        for t in range(key[1].as_py(), n_trees, groups):
            rng = np.random.default_rng([seed, t])
            b0, b1 = rng.poisson(n0), rng.poisson(n1)
            if b0.any() or b1.any():  # a tree that drew no row has no vote
                found.append((own, t, *[c.tobytes() for c in grow_tree(x, b0, b1, weights, max_depth, width, rng)]))
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*found)) or [()] * 6, [pa.int32(), pa.int32(), *[pa.binary()] * 4])],
                        ["gw_by", "tree", "feature", "cut", "left", "share"])

    dealt = cells.withColumn("gw_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return Forest(write_once(dealt.groupBy("gw_by", "gw_g").applyInArrow(grow, schema), "forest"), edges, feats, groups)


def with_probability(df: DataFrame, model: Forest, out: str, by: str | None = None) -> DataFrame:
    """``df`` and ``out``: the mean of the trees' shares of class 1 (0 without any tree)."""
    marked = write_once(_with_cell(df.select("*", _by(by)), model.feats, model.edges), "marked")
    cells = write_once(marked.select("gw_by", "gw_cell").distinct(), "asked")
    chunks, n = max(1, -(-cells.count() // CHUNK_CELLS)), len(model.feats)
    asked = cells.select("gw_by", "gw_cell", F.pmod(F.xxhash64("gw_cell"), F.lit(chunks)).cast("int").alias("gw_chunk"),
                         F.explode(F.sequence(F.lit(0), F.lit(model.groups - 1))).alias("gw_g"))
    trees = model.trees.select("*", (F.col("tree") % model.groups).alias("gw_g"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("gw_chunk"))

    def vote(cell: pa.Table, forest: pa.Table) -> pa.Table:
        x = _matrix(cell.column("gw_cell"), np.uint8, n)
        votes = np.zeros(len(x), np.int64)
        kinds = {"feature": np.int8, "cut": np.uint8, "left": np.int32, "share": np.float64}
        for i in range(forest.num_rows):
            feature, cut, left, share = (np.frombuffer(forest.column(c)[i].as_py(), k) for c, k in kinds.items())
            votes += np.rint(share * UNIT).astype(np.int64)[route(x, feature, cut, left)]
        return pa.table([cell.column("gw_by"), cell.column("gw_cell"), pa.array(votes), pa.array(np.full(len(x), forest.num_rows, np.int64))],
                        ["gw_by", "gw_cell", "gw_votes", "gw_n"])

    keys = ["gw_by", "gw_g", "gw_chunk"]
    found = asked.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInArrow(vote, "gw_by int, gw_cell binary, gw_votes bigint, gw_n bigint")
    mean = found.groupBy("gw_by", "gw_cell").agg((F.sum("gw_votes") / F.lit(float(UNIT)) / F.nullif(F.sum("gw_n"), F.lit(0))).alias(out))
    return marked.join(mean, ["gw_by", "gw_cell"], "left").select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(F.col(out), F.lit(0.0)).alias(out))
