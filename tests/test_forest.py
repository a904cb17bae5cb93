"""The forest: one tree against a plain greedy one, and a model that the driver never holds."""
import numpy as np
import pandas as pd
import pytest

from gatewatch.models import forest as FO
from gatewatch.models import supervised as M

FEATS = list(M.BASE_FEATURES)


def plain(x, n0, n1, w, depth, width):
    """Share of class 1 at the leaf of every cell, by recursion over all features."""
    out = np.zeros(len(x))

    def impurity(rows):
        a, b = w[0] * n0[rows].sum(), w[1] * n1[rows].sum()
        return (a + b) - (a * a + b * b) / (a + b)

    def grow(rows, d):
        a, b = w[0] * n0[rows].sum(), w[1] * n1[rows].sum()
        best = (1e-9, None)
        for f in range(x.shape[1]) if a and b and d < depth else ():
            for cut in range(width - 1):
                go = x[rows, f] <= cut
                if go.all() or not go.any():
                    continue
                gain = impurity(rows) - impurity(rows[go]) - impurity(rows[~go])
                if gain > best[0] + 1e-9:
                    best = gain, go
        if best[1] is None:
            out[rows] = b / (a + b)
            return
        grow(rows[best[1]], d + 1)
        grow(rows[~best[1]], d + 1)

    grow(np.arange(len(x)), 0)
    return out


@pytest.mark.parametrize("depth,at_once", [(30, 1 << 14), (30, 2), (3, 1 << 14)])
def test_a_tree_equals_a_plain_one(monkeypatch, depth, at_once):
    monkeypatch.setattr(FO, "NODES_AT_ONCE", at_once)
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 12, (150, 1)), axis=0).astype(np.uint8)  # sqrt(1): every feature is tried
    n0, n1 = rng.integers(0, 5, len(x)), rng.integers(0, 5, len(x))
    n0[0] = 1
    feature, cut, left, share = FO.grow_tree(x, n0, n1, (0.5, 3.0), depth, 12, rng)
    some = n0 + n1 > 0
    got = share[FO.route(x, feature, cut, left)]
    assert np.allclose(got[some], plain(x[some], n0[some], n1[some], (0.5, 3.0), depth, 12))


def test_every_cell_gets_a_leaf_of_its_own():
    """Unlimited depth separates what the bins separate, unless no drawn feature has a gain."""
    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 32, (3000, 4)), axis=0).astype(np.uint8)
    y = rng.integers(0, 2, len(x))
    feature, cut, left, share = FO.grow_tree(x, 1 - y, y, (1.0, 1.0), 30, 32, rng)
    assert ((share[FO.route(x, feature, cut, left)] >= 0.5) == y).mean() > 0.98
    assert (feature < 0).sum() == (feature >= 0).sum() + 1


def test_the_model_is_a_table_and_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(600, 4)), columns=FEATS)
    pdf.insert(0, "user_id", [f"u{i}" for i in range(600)])
    pdf["is_attack_ip"] = ((pdf.failed_count * pdf.avg_rtt > 0) ^ (rng.random(600) < 0.1)).astype(int)
    df = spark.createDataFrame(pdf)
    fits = [M.fit_forest(df.repartition(n), FEATS, n_trees=30) for n in (1, 7)]
    assert fits[0].trees.count() == 30
    a, b = (M.predict_proba(m, df.repartition(3), FEATS, "rf").toPandas().set_index("user_id").sort_index() for m in fits)
    pd.testing.assert_frame_equal(a, b)
    assert ((a.rf_prob >= 0.5) == (a.is_attack_ip == 1)).mean() > 0.9
    assert M.predict_proba(fits[0], df.limit(0), FEATS, "rf").count() == 0


def test_copies_of_rows_are_kept(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", 1.0, 0), ("b", None, 1), (None, 3.0, 1)], "user_id string, x double, is_attack_ip int")
    out = M.predict_proba(M.fit_forest(df, ["x"], n_trees=20), df, ["x"], "rf").toPandas()
    assert out.user_id.isna().sum() == 1 and (out.user_id == "a").sum() == 2
    assert out[out.user_id == "a"].rf_prob.nunique() == 1 and out[out.user_id != "a"].rf_prob.min() > 0.5
