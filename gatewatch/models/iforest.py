"""Isolation forest (M7; Liu, Ting & Zhou 2008).

* Sample: every tree takes the ``psi = min(256, n)`` training rows with the
  smallest (row, tree) hash -- without replacement per tree, independent of
  partitioning and of the number of rows.
* Build: ``groupBy(tree).applyInPandas`` grows one tree per group from its
  psi rows (NumPy, seeded per tree) -> node table.
* Score: the node table (at most trees * (2 psi - 1) rows: a bounded model,
  not data) is broadcast; ``mapInPandas`` walks all trees for a batch of rows
  vectorised by depth. Anomaly score ``s = 2^(-E[h] / c(psi))``.
* Cut: rows whose score exceeds the ``1 - contamination`` quantile of the
  training scores (``percentile_approx``) are outliers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "leaf_size int, depth int")


def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful BST search with n points."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _tree_hash(own: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A non-negative hash of (row hash, tree, seed)."""
    with np.errstate(over="ignore"):
        h = own ^ (np.uint64(tree + 1) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) >> np.uint64(1)


def _grow(feat_cols, seed, psi, key):
    height_limit = int(math.ceil(math.log2(max(psi, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["gw_tree"].iloc[0])
        pdf = pdf.sort_values(["gw_h", key]).head(psi)  # of those below the limit, the smallest
        x = pdf[list(feat_cols)].to_numpy(dtype=np.float64)
        rng = np.random.default_rng([int(seed), tree])
        rows = []

        def node(idx, depth):
            me = len(rows)
            rows.append(None)
            sub = x[idx]
            if depth >= height_limit or len(idx) <= 1:
                rows[me] = (tree, me, -1, 0.0, -1, -1, len(idx), depth)
                return me
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            cand = np.flatnonzero(hi > lo)
            if len(cand) == 0:
                rows[me] = (tree, me, -1, 0.0, -1, -1, len(idx), depth)
                return me
            f = int(rng.choice(cand))
            t = float(rng.uniform(lo[f], hi[f]))
            left = node(idx[sub[:, f] < t], depth + 1)
            right = node(idx[sub[:, f] >= t], depth + 1)
            rows[me] = (tree, me, f, t, left, right, 0, depth)
            return me

        node(np.arange(len(x)), 0)
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right",
                                           "leaf_size", "depth"])
    return build


def _hash_limit(psi: int, n: int) -> int:
    """Hashes below this are of about ``psi + 8 sqrt(psi) + 32`` of ``n`` rows: fewer than
    ``psi`` are below it with a probability under 1e-14."""
    return int(min(1.0, (psi + 8 * math.sqrt(psi) + 32) / max(n, 1)) * (1 << 63))


def tree_samples(train: DataFrame, feats: list[str], n_trees: int, psi: int, n: int, seed, key: str) -> DataFrame:
    """``key, feats, gw_tree, gw_h``: for every tree the rows whose (row, tree) hash is
    below a limit set from the count, so a tree's group has ``psi`` rows and a few
    more, whatever the number of tasks. A tree that is short of rows (a chance of
    1e-14, or rows that share a key) gets a limit of its own."""
    from gatewatch.models.supervised import materialise

    kind = train.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ", ".join(f"`{c}` double" for c in feats) + ", gw_tree int, gw_h bigint"
    rows = train.select(key, *[F.col(c).cast("double").alias(c) for c in feats])

    def draw(limits: dict[int, int]) -> DataFrame:
        def run(batches):
            for pdf in batches:
                own = pd.util.hash_pandas_object(pdf[key].astype(str), index=False).to_numpy()
                for t, limit in limits.items():
                    h = _tree_hash(own, t, seed)
                    at = np.flatnonzero(h < np.uint64(limit))
                    if len(at):
                        yield pdf.iloc[at].assign(gw_tree=np.int32(t), gw_h=h[at].astype(np.int64))
        return rows.mapInPandas(run, schema)

    limits = {t: _hash_limit(psi, n) for t in range(n_trees)}
    while True:
        sample = materialise(draw(limits))
        have = {r["gw_tree"]: r["count"] for r in sample.groupBy("gw_tree").count().collect()}
        short = [t for t in limits if have.get(t, 0) < psi and limits[t] < 1 << 63]
        if not short:
            return sample
        limits |= {t: min(4 * limits[t], 1 << 63) for t in short}


def fit(train: DataFrame, feat_cols: Sequence[str], n_trees: int = 150, max_samples: int = 256,
        seed=42, key: str = "user_id") -> tuple[pd.DataFrame, int]:
    """-> (node table as pandas, psi). The node table is the bounded model.

    One sampling law at every size: tree ``t`` takes the ``psi`` rows with the
    smallest hash of (row, tree), so trees are independent samples without
    replacement that may overlap, as in the paper."""
    n = train.count()
    psi = int(min(max_samples, n))
    sample = tree_samples(train, list(feat_cols), n_trees, psi, n, seed, key)
    nodes = sample.groupBy("gw_tree").applyInPandas(_grow(feat_cols, seed, psi, key), NODE_SCHEMA)
    return nodes.toPandas(), psi


def _path_lengths(x: np.ndarray, model: dict) -> np.ndarray:
    total = np.zeros(len(x))
    for t, arr in model["trees"].items():
        feat, thr, left, right, size, depth = arr
        cur = np.zeros(len(x), dtype=np.int64)
        while True:
            internal = feat[cur] >= 0
            if not internal.any():
                break
            f = feat[cur[internal]]
            go_left = x[np.flatnonzero(internal), f] < thr[cur[internal]]
            nxt = np.where(go_left, left[cur[internal]], right[cur[internal]])
            cur[internal] = nxt
        total += depth[cur] + c_factor(size[cur])
    return total / len(model["trees"])


def _to_model(nodes: pd.DataFrame, psi: int) -> dict:
    trees = {}
    for t, g in nodes.groupby("tree"):
        g = g.sort_values("node")
        trees[int(t)] = tuple(g[c].to_numpy() for c in ("feature", "threshold", "left", "right",
                                                         "leaf_size", "depth"))
    return {"trees": trees, "c_psi": float(c_factor(np.array([psi]))[0])}


def score(df: DataFrame, model_nodes: pd.DataFrame, psi: int, feat_cols: Sequence[str],
          key: str = "user_id") -> DataFrame:
    """``key, if_score`` (higher = more anomalous)."""
    spark = df.sparkSession
    bmodel = spark.sparkContext.broadcast(_to_model(model_nodes, psi))

    def run(batches):
        m = bmodel.value
        for pdf in batches:
            if pdf.empty:
                continue
            x = pdf[list(feat_cols)].to_numpy(dtype=np.float64)
            h = _path_lengths(x, m)
            yield pd.DataFrame({key: pdf[key].to_numpy(), "if_score": np.power(2.0, -h / m["c_psi"])})

    kt = df.schema[key].dataType.simpleString()
    return df.select(key, *[F.col(c).cast("double") for c in feat_cols]) \
        .mapInPandas(run, f"`{key}` {kt}, if_score double")


def isolation_forest(train: DataFrame, data: DataFrame, feat_cols: Sequence[str], key: str = "user_id",
                     n_trees: int = 150, max_samples: int = 256, contamination: float = 0.05,
                     seed=42) -> DataFrame:
    """Fit on ``train``, score ``data``: ``key, if_score, iso_pred``."""
    nodes, psi = fit(train, feat_cols, n_trees, max_samples, seed, key)
    scored = score(data, nodes, psi, feat_cols, key)
    return cut_flags(score(train, nodes, psi, feat_cols, key), scored, "if_score", contamination, "iso_pred").select(key, "if_score", "iso_pred")


def cut_flags(train: DataFrame, data: DataFrame, col: str, contamination: float, out: str) -> DataFrame:
    """``data`` with ``out`` = 1 above the ``1 - contamination`` percentile of ``train``'s scores."""
    cut = train.agg(F.percentile_approx(col, 1.0 - float(contamination), 100000).alias("gw_cut"))
    return data.crossJoin(F.broadcast(cut)).withColumn(out, (F.col(col) > F.col("gw_cut")).cast("int")).drop("gw_cut")
