"""Second-order gradient boosting on histograms.

Rows are binned once and written. A *track* is one ensemble: its own rows (all
but one fold, say), learning rate, depth and weight of the positives. All tracks
grow together, in one barrier stage: every task holds its rows' bins and margins,
sums gradients and Hessians per (track, node, feature, bin), and hands its sums to
the other tasks (``allGather``); with the whole sums, whose number does not depend
on the rows, each task picks the same best split of every node. So a level of a
tree costs one exchange, not a job, and the rows are read once.

    gain = GL^2 / (HL + l) + GR^2 / (HR + l) - G^2 / (H + l),  leaf = -rate G / (H + l)

with H of at least ``min_hessian`` on both sides. Missing values are a bin of
their own that goes to the better side. Ties take the first feature, then the
lowest bin. Sums are of whole numbers (``UNIT`` a unit), so they do not depend
on the order of rows or tasks; the margins start at 0.

A task takes about ``ROWS`` rows, at some 50 bytes and 50 a track each, since an
exchange takes a second, however small; the tasks are
no more than half of the cluster's slots, since a barrier stage must run at once.
Nodes whose sums are too many for one exchange are taken in blocks.
"""

from __future__ import annotations

import base64
import pickle
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch.session import Shared, write_once

BINS = 64
MISSING = 255
KEEP = 20  # rounds whose trees are summed before they are added to the margins
UNIT = 1 << 20
ROWS = 500_000  # of one task
EXCHANGE_BYTES = 32 << 20  # sums that all tasks receive at once


@dataclass
class Track:
    """One ensemble: rows whose fold is not ``without``; -1 takes all rows."""
    rate: float = 0.1
    depth: int = 4
    positive: float = 1.0
    without: int = -1


@dataclass
class Tree:
    """Nodes as lists; ``feature`` is -1 at a leaf. Bins up to ``bin`` go left, missing ones by ``missing``."""
    feature: list = field(default_factory=lambda: [-1])
    bin: list = field(default_factory=lambda: [0])
    missing: list = field(default_factory=lambda: [False])
    left: list = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of bins."""
        at = np.zeros(len(x), np.int64)
        while self.descend(x, at):
            pass
        return at

    def descend(self, x: np.ndarray, at: np.ndarray) -> bool:
        """Moves the rows at inner nodes to their children; whether there were any."""
        feature, cut, missing, left = (np.array(c) for c in (self.feature, self.bin, self.missing, self.left))
        inner = np.flatnonzero(feature[at] >= 0)
        node = at[inner]
        b = x[inner, feature[node]]
        goes = np.where(b == MISSING, missing[node], b <= cut[node])
        at[inner] = left[node] + ~goes
        return len(inner) > 0

    def split(self, node: int, feature: int, cut: int, missing: bool, left: float, right: float) -> None:
        self.feature[node], self.bin[node], self.missing[node], self.left[node] = feature, cut, missing, len(self.feature)
        for value in (left, right):
            self.feature.append(-1)
            self.bin.append(0)
            self.missing.append(False)
            self.left.append(0)
            self.value.append(value)


@dataclass
class Ensemble:
    edges: list
    tracks: list
    trees: list  # per track

    def margins(self, x: np.ndarray, since: int = 0) -> np.ndarray:
        """rows x tracks: the sums of the trees from round ``since`` on."""
        out = np.zeros((len(x), len(self.tracks)))
        for k, trees in enumerate(self.trees):
            for t in trees[since:]:
                out[:, k] += np.array(t.value)[t.route(x)]
        return out

    def bins(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """Values -> bins: the number of edges below the value."""
        out = np.empty((len(columns[0]) if columns else 0, len(self.edges)), np.uint8)
        for j, (c, e) in enumerate(zip(columns, self.edges)):
            out[:, j] = np.where(np.isnan(c), MISSING, np.searchsorted(e, c, "left"))
        return out


def _quantiles(feats: Sequence[str], bins: int) -> list:
    share = [i / bins for i in range(1, bins)]
    return [F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None)), share, 10_000).alias(f"q{i}") for i, c in enumerate(feats)]


def _distinct(quantiles: Sequence) -> list[np.ndarray]:
    return [np.unique(np.array(q if q is not None else [], float)) for q in quantiles]


def quantile_edges(df: DataFrame, feats: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Per feature the distinct values at up to ``bins - 1`` quantiles; a value is in the bin of the first edge not below it."""
    return _distinct(df.agg(*_quantiles(feats, bins)).first())


def edges_by(df: DataFrame, by: str, feats: Sequence[str], bins: int = BINS) -> dict:
    """``quantile_edges`` of the rows of every value of ``by``, of which there are few."""
    return {r[0]: _distinct(r[1:]) for r in df.groupBy(by).agg(*_quantiles(feats, bins)).collect()}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _columns(b: pa.RecordBatch, first: int, n: int) -> list[np.ndarray]:
    return [b.column(first + j).to_numpy(zero_copy_only=False).astype(float) for j in range(n)]


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def binned(df: DataFrame, feats: Sequence[str], label: str, fold: str | None, model: Ensemble) -> DataFrame:
    """y, fold and bins per row, written."""
    shared, n = Shared(df.sparkSession, model), len(feats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = shared.value.bins(_columns(b, 2, n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "fold", "bins"])

    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"),
                                                     *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(feats)])
    return write_once(rows.mapInArrow(run, "y int, fold int, bins binary"), "binned")


def best_split(g: np.ndarray, h: np.ndarray, ridge: float, min_hessian: float) -> tuple | None:
    """(gain, feature, bin, missing goes left, G and H of the left side) for sums
    [feature, bin], the last bin being the missing values."""
    total_g, total_h = g[0].sum(), h[0].sum()
    best = None
    left_g, left_h = np.cumsum(g[:, :-1], axis=1), np.cumsum(h[:, :-1], axis=1)
    whole = total_g ** 2 / (total_h + ridge)
    for side in (False, True):  # missing right, missing left
        lg, lh = (left_g + g[:, -1:], left_h + h[:, -1:]) if side else (left_g, left_h)
        rg, rh = total_g - lg, total_h - lh
        gain = lg ** 2 / (lh + ridge) + rg ** 2 / (rh + ridge) - whole
        gain[(lh < min_hessian) | (rh < min_hessian)] = -np.inf
        f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if gain[f, b] > 1e-9 and (best is None or gain[f, b] > best[0]):
            best = float(gain[f, b]), int(f), int(b), side, float(lg[f, b]), float(lh[f, b])
    return best


def fit(train: DataFrame, feats: Sequence[str], tracks: Sequence[Track], label: str = "is_attack_ip", fold: str | None = None,
        rounds: int = 100, ridge: float = 1.0, min_hessian: float = 1.0, bins: int = BINS, edges: list | None = None, tasks: int | None = None) -> Ensemble:
    """Boosts all ``tracks`` at once; ``train`` has ``feats``, ``label`` (0/1) and ``fold``.
    ``tasks`` changes the work, not the result."""
    feats, tracks = list(feats), list(tracks)
    model = Ensemble([np.asarray(e, float) for e in edges] if edges is not None else quantile_edges(train, feats, bins), tracks, [[] for _ in tracks])
    if max((len(e) for e in model.edges), default=0) >= MISSING:
        raise ValueError("at most 254 edges a feature")
    state = binned(train, feats, label, fold, model)
    if tasks is None:
        tasks = max(1, min(-(-state.count() // ROWS), train.sparkSession.sparkContext.defaultParallelism // 2))
    shared, n_feats, keep, exchange = Shared(train.sparkSession, model), len(feats), KEEP, EXCHANGE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), _matrix(b.column(2), np.uint8, n_feats)) for b in batches]
        parts.append((np.empty(0, np.int32), np.empty(0, np.int32), np.empty((0, n_feats), np.uint8)))
        y, folds, x = (np.concatenate(c) for c in zip(*parts))
        del parts

        def whole(sums: np.ndarray) -> np.ndarray:
            if tasks == 1:
                return sums
            sent = context.allGather(base64.b64encode(zlib.compress(sums.tobytes(), 1)).decode())
            return sum(np.frombuffer(zlib.decompress(base64.b64decode(m)), np.int64) for m in sent).reshape(sums.shape)

        trees = _boost(x, y, folds, shared.value, rounds, ridge, min_hessian, keep, exchange // tasks ** 2, whole)
        if context.partitionId() == 0:
            values = [[(t.feature, t.bin, t.missing, t.left, t.value) for t in ts] for ts in trees]
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(values))], pa.binary())], ["trees"])

    found = state.repartition(tasks).mapInArrow(run, "trees binary", barrier=True).collect()[0]  # all tasks: a barrier stage cannot run in part
    model.trees = [[Tree(*t) for t in ts] for ts in pickle.loads(zlib.decompress(found["trees"]))]
    return model


def _boost(x: np.ndarray, y: np.ndarray, folds: np.ndarray, model: Ensemble, rounds: int, ridge: float, min_hessian: float, keep: int,
           block_bytes: int, whole: Callable[[np.ndarray], np.ndarray]) -> list[list[Tree]]:
    """A task's part of the boosting: the trees of every track. ``whole`` adds up all tasks' sums."""
    tracks, width = model.tracks, max(len(e) for e in model.edges) + 2  # bins 0 .. edges, and the missing
    cells = np.ascontiguousarray(np.where(x == MISSING, width - 1, x).T)
    at_once = max(1, block_bytes // (16 * len(cells) * width))
    weight = [np.where(y == 1, t.positive, 1.0) for t in tracks]
    use = [folds != t.without for t in tracks]
    margins, since = np.zeros((2, len(tracks), len(x)))
    out: list[list[Tree]] = [[] for _ in tracks]
    for r in range(rounds):
        trees = [Tree() for _ in tracks]
        at = [np.zeros(len(x), np.int64) for _ in tracks]
        slopes = []
        for k, w in enumerate(weight):
            p = _sigmoid(margins[k] + since[k])
            slopes.append((np.rint(w * (p - y) * UNIT), np.rint(w * p * (1 - p) * UNIT)))
        open_ = [(k, 0) for k in range(len(tracks))]  # nodes that may be split
        known: dict = {}  # (track, node) -> (G, H)
        depth = 0
        while open_:
            todo = []
            for s in range(0, len(open_), at_once):
                block = open_[s:s + at_once]
                sums = whole(_histograms(cells, width, block, trees, at, use, slopes)) / UNIT
                for (k, node), (g, h) in zip(block, sums.swapaxes(0, 1)):
                    if node == 0:
                        known[k, 0] = g[0].sum(), h[0].sum()
                        trees[k].value[0] = -tracks[k].rate * known[k, 0][0] / (known[k, 0][1] + ridge)
                    found = best_split(g, h, ridge, min_hessian)
                    if found is None:
                        continue
                    _, f, cut, missing, lg, lh = found
                    rg, rh = known[k, node][0] - lg, known[k, node][1] - lh
                    new = len(trees[k].feature)
                    trees[k].split(node, f, cut, missing, -tracks[k].rate * lg / (lh + ridge), -tracks[k].rate * rg / (rh + ridge))
                    known |= {(k, new): (lg, lh), (k, new + 1): (rg, rh)}
                    if depth + 1 < tracks[k].depth:
                        todo += [(k, n) for n, c in ((new, lh), (new + 1, rh)) if c >= 2 * min_hessian]
            for tree, leaf in zip(trees, at):
                tree.descend(x, leaf)
            open_, depth = sorted(todo), depth + 1
        for k, tree in enumerate(trees):
            out[k].append(tree)
            since[k] += np.array(tree.value)[at[k]]
        if (r + 1) % keep == 0:
            margins += since
            since[:] = 0
    return out


def _histograms(cells: np.ndarray, width: int, nodes: list, trees: list, at: list, use: list, slopes: list) -> np.ndarray:
    """Sums of gradients and Hessians [2, node, feature, bin] of one task's rows."""
    out = np.zeros((2, len(nodes), len(cells), width), np.int64)
    for k in sorted({k for k, _ in nodes}):
        mine = [i for i, n in enumerate(nodes) if n[0] == k]
        slot = np.full(len(trees[k].feature), -1)
        slot[[nodes[i][1] for i in mine]] = np.arange(len(mine))
        on = np.flatnonzero((slot[at[k]] >= 0) & use[k])
        start = slot[at[k][on]] * width
        values = [v[on] for v in slopes[k]]
        for f, c in enumerate(cells):
            key = start + c[on]
            for into, v in zip(out, values):
                into[mine[0]:mine[-1] + 1, f] = np.bincount(key, v, len(mine) * width).reshape(-1, width)
    return out


def with_probabilities(df: DataFrame, feats: Sequence[str], model: Ensemble, out: str) -> DataFrame:
    """``df`` and ``out``: array of P(1), one a track. No shuffle."""
    from pyspark.sql import types as T

    shared, n, width = Shared(df.sparkSession, model), len(feats), len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _sigmoid(shared.value.margins(shared.value.bins(_columns(b, width, n))))
            ends = pa.array(np.arange(b.num_rows + 1) * len(model.tracks), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], [*b.schema.names[:width], out])

    schema = T.StructType([*df.schema, T.StructField(out, T.ArrayType(T.DoubleType()))])
    return df.select("*", *[F.col(f"`{c}`").cast("double").alias(f"gw_x{i}") for i, c in enumerate(feats)]).mapInArrow(run, schema)


def platt_all(scored: DataFrame, probabilities: str, label: str, fold: str, n: int, steps: int = 50) -> list[tuple[float, float]]:
    """Platt's sigmoid for every track k on the rows of fold k, all in one pass a
    Newton step: (a, b) of ``1 / (1 + exp(-(a p + b)))``. Targets are smoothed."""
    rows = write_once(scored.select(F.get(F.col(probabilities), F.col(fold)).alias("p"), F.col(fold).alias("k"), F.col(label).cast("int").alias("y"))
                      .where("p IS NOT NULL AND y IS NOT NULL"), "held_out")
    count = {r["k"]: (r["pos"], r["n"] - r["pos"]) for r in rows.groupBy("k").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).collect()}
    fits = {k: np.zeros(2) for k in range(n)}
    t1 = {k: (c[0] + 1) / (c[0] + 2) for k, c in count.items()}
    t0 = {k: 1 / (c[1] + 2) for k, c in count.items()}
    pick = lambda values: F.element_at(F.create_map(*[F.lit(v) for k, x in sorted(values.items()) for v in (k, float(x))]), F.col("k"))
    for _ in range(steps if count else 0):
        z = pick({k: v[0] for k, v in fits.items()}) * F.col("p") + pick({k: v[1] for k, v in fits.items()})
        q = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        e, v = q - F.when(F.col("y") == 1, pick(t1)).otherwise(pick(t0)), q * (F.lit(1.0) - q)
        whole = lambda c: F.sum(F.round(c * (1 << 40)).cast("decimal(38,0)")).cast("double") / float(1 << 40)
        moved = 0.0
        for r in rows.groupBy("k").agg(whole(e * F.col("p")).alias("ga"), whole(e).alias("gb"), whole(v * F.col("p") * F.col("p")).alias("aa"),
                                       whole(v * F.col("p")).alias("ab"), whole(v).alias("bb")).collect():
            hessian = np.array([[r["aa"], r["ab"]], [r["ab"], r["bb"]]]) + 1e-10 * np.eye(2)
            move = np.linalg.solve(hessian, [r["ga"], r["gb"]])
            move *= min(1.0, 10.0 / max(np.abs(move).max(), 1e-12))
            fits[r["k"]] = fits[r["k"]] - move
            moved = max(moved, float(np.abs(move).max()))
        if moved < 1e-9:
            break
    return [tuple(fits[k].tolist()) for k in range(n)]
