"""Exact k-nearest neighbours of query rows among a reference set.

One method at every size. Equal reference points become one point with its
``k + 1`` smallest ids, equal query points one query, so copies cost nothing.
The points are dealt to the leaves of a kd-tree whose leaves are all bounded
(:mod:`gatewatch.models.kdtree`, the upper level; a task splits a large leaf by a
tree of its own):

1. every query looks for neighbours in its own leaf, which gives a radius;
2. it visits the other leaves that its ball reaches, found down the tree;
3. its candidate lists are merged.

Neighbours are ordered by (distance, id), also across leaves. A group holds
one leaf of points and at most about ``leaf_rows`` queries.

Several reference sets, told apart by a column ``by``, are searched in the same
jobs: they share the tree, and a leaf's number holds the set's.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewatch.models import kdtree
from gatewatch.session import Shared

LEAF_ROWS = 4096
BLOCK_BYTES = 32 << 20  # of one block of differences
SET_BITS = 32  # a leaf's number is (set << SET_BITS) + leaf of the tree


def _nearest(q: np.ndarray, x: np.ndarray, ids: list, k: int) -> tuple[list, list]:
    """Per query the ``k`` (distance, id) smallest among points that hold several ids each."""
    if not len(q) or not len(x):
        return [[] for _ in range(len(q))], [[] for _ in range(len(q))]
    point = np.repeat(np.arange(len(x)), [len(i) for i in ids])
    names = np.array([n for i in ids for n in i], dtype=object)
    order = np.argsort(names, kind="stable")
    point, names = point[order], names[order]  # columns in the order of ids
    out_i, out_d = [], []
    step = max(1, BLOCK_BYTES // (8 * max(1, max(x.size, len(names)))))
    for s in range(0, len(q), step):
        d = np.sqrt(((q[s:s + step, None, :] - x[None, :, :]) ** 2).sum(axis=2))[:, point]
        some = np.broadcast_to(np.arange(d.shape[1]), d.shape)
        if d.shape[1] > k:
            cut = np.partition(d, k - 1, axis=1)[:, k - 1]
            most = int((d <= cut[:, None]).sum(axis=1).max())  # the k-th and what ties with it
            if most < d.shape[1]:
                some = np.sort(np.argpartition(d, most - 1, axis=1)[:, :most], axis=1)
        near = np.take_along_axis(d, some, axis=1)
        by = np.argsort(near, axis=1, kind="stable")[:, :k]  # ties stay in the order of ids
        out_d += np.take_along_axis(near, by, axis=1).tolist()
        out_i += names[np.take_along_axis(some, by, axis=1)].tolist()
    return out_i, out_d


def _nearest_in_leaf(q: np.ndarray, x: np.ndarray, ids: list, k: int, rows: int) -> tuple[list, list]:
    """``_nearest`` through the lower level: a tree over this leaf's own points."""
    if len(x) <= rows or not len(q):
        return _nearest(q, x, ids, k)
    tree = kdtree.Tree(x.shape[1])
    tree.grow(0, x, rows)
    at, home = tree.route(x), tree.route(q)
    found: list = [[] for _ in range(len(q))]
    inside = {leaf: np.flatnonzero(at == leaf) for leaf in np.unique(at).tolist()}

    def look(leaf: int, who: np.ndarray) -> None:
        mine = inside.get(leaf)
        if mine is None or not len(who):
            return
        i, d = _nearest(q[who], x[mine], [ids[j] for j in mine.tolist()], k)
        for w, names, dists in zip(who.tolist(), i, d):
            found[w] = sorted([*found[w], *zip(dists, names)])[:k]

    for leaf in np.unique(home).tolist():
        look(leaf, np.flatnonzero(home == leaf))
    radius = np.array([f[-1][0] if len(f) >= k else np.inf for f in found])
    for leaf, who in tree.near(q, radius):
        look(leaf, who[home[who] != leaf])
    return [[n for _, n in f] for f in found], [[d for d, _ in f] for f in found]


def _search(queries: DataFrame, points: DataFrame, feats: list[str], k: int, leaf_rows: int) -> DataFrame:
    """``queries`` (feats, leaf) against the points of their leaf: feats, leaf, i, d.
    Leaves with many queries are searched in several groups."""
    sc = queries.sparkSession.sparkContext
    # one number per leaf: bounded like the tree. A group of queries is as large as
    # the leaf at least, so the copies of a leaf's points are no more rows than its queries
    held = {r["leaf"]: max(leaf_rows, r["count"]) for r in points.groupBy("leaf").count().collect()}
    chunks = sc.broadcast({r["leaf"]: -(-r["count"] // held.get(r["leaf"], leaf_rows)) for r in queries.groupBy("leaf").count().collect()})

    def spread(batches):
        for pdf in batches:
            n = pdf["leaf"].map(chunks.value).fillna(0).astype(int)
            rep = pdf.loc[pdf.index.repeat(n)]
            yield rep.assign(chunk=rep.groupby(level=0).cumcount().astype("int64"))

    def own(batches):
        for pdf in batches:
            h = pd.util.hash_pandas_object(pdf[feats], index=False).to_numpy()
            yield pdf.assign(chunk=(h % pdf["leaf"].map(chunks.value).to_numpy(np.uint64)).astype(np.int64))

    base = ", ".join(f"`{f}` double" for f in feats)
    q = queries.mapInPandas(own, base + ", leaf bigint, chunk bigint")
    p = points.mapInPandas(spread, base + ", ids array<string>, leaf bigint, chunk bigint")

    def local(qdf: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        i, d = _nearest_in_leaf(qdf[feats].to_numpy(np.float64), pdf[feats].to_numpy(np.float64), [list(x) for x in pdf["ids"]], k, leaf_rows)
        return qdf[[*feats, "leaf"]].assign(i=pd.Series(i, dtype=object, index=qdf.index), d=pd.Series(d, dtype=object, index=qdf.index))

    return q.groupBy("leaf", "chunk").cogroup(p.groupBy("leaf", "chunk")) \
        .applyInPandas(local, base + ", leaf bigint, i array<string>, d array<double>")


def knn(queries: DataFrame, ref: DataFrame, id_col: str, feat_cols: Sequence[str], k: int,
        exclude_self: bool = False, leaf_rows: int = LEAF_ROWS, max_leaves: int = kdtree.MAX_LEAVES, by: str | None = None) -> DataFrame:
    """``id_col, nbr_ids array<string>, nbr_dists array<double>`` per query row,
    neighbours by (distance, id). Ids are compared as strings. ``leaf_rows`` and
    ``max_leaves`` change the work, not the result. With ``by`` (a small whole number,
    also returned) a row's neighbours are those of its own set."""
    from gatewatch.models.supervised import materialise

    feats = list(feat_cols)
    keys, own_set = ["gw_set", *feats], (F.col(by) if by else F.lit(0)).cast("bigint").alias("gw_set")
    prep = lambda df: df.select(own_set, F.col(id_col).cast("string").alias(id_col), *[F.col(c).cast("double").alias(c) for c in feats])
    q_rows, r_rows = materialise(prep(queries)), prep(ref)
    need = k + 1 if exclude_self else k
    first = Window.partitionBy(*keys).orderBy(id_col)
    points = materialise(r_rows.withColumn("gw_n", F.row_number().over(first)).where(F.col("gw_n") <= need)
                         .groupBy(*keys).agg(F.array_sort(F.collect_list(id_col)).alias("ids")))
    places = materialise(points.select(*feats).distinct()) if by else points
    tree = Shared(queries.sparkSession, kdtree.fit(places, feats, max(leaf_rows, 2), max_leaves=max_leaves))
    in_set = lambda df: kdtree.with_leaf(df, tree, feats).withColumn("leaf", F.shiftleft("gw_set", SET_BITS) + F.col("leaf"))
    placed = materialise(in_set(points).drop("gw_set"))
    asked = materialise(in_set(q_rows.select(*keys).distinct()).drop("gw_set"))
    near = materialise(_search(asked, placed, feats, need, leaf_rows))
    radius = F.when(F.size("d") >= need, F.element_at("d", -1)).otherwise(F.lit(float("inf")))

    def visits(batches):
        for pdf in batches:
            x, sets = pdf[feats].to_numpy(np.float64), pdf["leaf"].to_numpy() >> SET_BITS << SET_BITS
            home = tree.value.route(x)
            for leaf, rows in tree.value.near(x, pdf["r"].to_numpy(np.float64)):
                rows = rows[home[rows] != leaf]
                if len(rows):
                    yield pdf.iloc[rows][feats].assign(leaf=sets[rows] + leaf)

    base = ", ".join(f"`{f}` double" for f in feats)
    lists = near
    if len(tree.value.feat) > 1:  # else there is no other leaf
        away = materialise(near.select(*feats, "leaf", radius.alias("r")).mapInPandas(visits, base + ", leaf bigint"))
        lists = near.unionByName(_search(away, placed, feats, need, leaf_rows))
    merged = lists.select(F.shiftright("leaf", SET_BITS).alias("gw_set"), *feats, F.arrays_zip("d", "i").alias("z")).groupBy(*keys) \
        .agg(F.slice(F.array_sort(F.flatten(F.collect_list("z"))), 1, need).alias("z"))
    z = F.filter("z", lambda e: e["i"] != F.col(id_col)) if exclude_self else F.col("z")
    return q_rows.join(merged, keys).withColumn("z", F.slice(z, 1, k)) \
        .select(*([F.col("gw_set").alias(by)] if by else []), id_col, F.col("z.i").alias("nbr_ids"), F.col("z.d").alias("nbr_dists"))
