"""Model operators on planted fixtures, against NumPy brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gatewatch.models import iforest as IF
from gatewatch.models import lof as LOF
from gatewatch.models import supervised as M
from gatewatch.models.knn import knn

FEATS = ["failed_count", "login_freq", "unique_ips", "avg_rtt"]


def planted(seed=0):
    rng = np.random.default_rng(seed)
    a = rng.normal([5, 50, 3, 40], [1, 5, 0.5, 4], size=(300, 4))      # dense cluster
    b = rng.normal([12, 90, 6, 80], [3, 12, 1.5, 10], size=(175, 4))   # sparser cluster
    o = rng.uniform([30, 150, 15, 150], [60, 300, 30, 400], size=(25, 4))
    x = np.vstack([a, b, o])
    y = np.r_[np.zeros(475, int), np.ones(25, int)]
    pdf = pd.DataFrame(x, columns=FEATS)
    pdf.insert(0, "user_id", [f"u{i:03d}" for i in range(len(x))])
    pdf["is_attack_ip"] = y
    return pdf


@pytest.fixture(scope="module")
def outliers(spark):
    return spark.createDataFrame(planted())


def brute_knn(q, r, k, exclude_self):
    d = np.sqrt(((q[:, None, :] - r[None, :, :]) ** 2).sum(-1))
    if exclude_self:
        np.fill_diagonal(d, np.inf)
    idx = np.argsort(d, axis=1, kind="stable")[:, :k]
    return idx, np.take_along_axis(d, idx, 1)


def brute_lof(train, data, k):
    idx, dist = brute_knn(train, train, k, True)
    kdist = dist[:, -1]
    lrd = 1.0 / (np.maximum(dist, kdist[idx]).mean(1) + 1e-10)
    qi, qd = brute_knn(data, train, k, False)
    lrd_q = 1.0 / (np.maximum(qd, kdist[qi]).mean(1) + 1e-10)
    return lrd[qi].mean(1) / lrd_q


@pytest.mark.parametrize("leaf_rows", [10_000, 120, 40])
def test_knn_exact(spark, outliers, leaf_rows):
    pdf = planted()
    x = pdf[FEATS].to_numpy()
    got = knn(outliers, outliers, "user_id", FEATS, 5, exclude_self=True, leaf_rows=leaf_rows).toPandas()
    got = got.set_index("user_id").loc[pdf["user_id"]]
    _, bd = brute_knn(x, x, 5, True)
    assert np.allclose(np.vstack(got["nbr_dists"].to_numpy()), bd)


def test_lof_matches_brute_force_and_finds_outliers(spark, outliers):
    pdf = planted()
    train_ids = set(pdf["user_id"][::2])
    train = outliers.where(F.col("user_id").isin(list(train_ids)))
    got = LOF.lof_scores(train, outliers, "user_id", FEATS, k=20).toPandas().set_index("user_id")
    tr = pdf[pdf["user_id"].isin(train_ids)][FEATS].to_numpy()
    want = brute_lof(tr, pdf[FEATS].to_numpy(), 20)
    assert np.allclose(got.loc[pdf["user_id"], "lof"].to_numpy(), want, rtol=1e-6)
    flagged = got.loc[pdf["user_id"], "lof_pred"].to_numpy()
    assert flagged[-25:].mean() >= 0.9          # planted outliers found
    assert flagged[:475].mean() <= 0.08         # inliers mostly kept


def test_isolation_forest_recall_and_rate(spark, outliers):
    pdf = planted()
    train = outliers.where(F.col("user_id").isin(list(pdf["user_id"][::2])))
    got = IF.isolation_forest(train, outliers, FEATS, n_trees=150).toPandas().set_index("user_id")
    s = got.loc[pdf["user_id"]]
    assert s["iso_pred"].to_numpy()[-25:].mean() >= 0.9
    assert s["if_score"].to_numpy()[-25:].min() > np.median(s["if_score"].to_numpy()[:475])
    on_train = got.loc[pdf["user_id"][::2], "iso_pred"].to_numpy()
    assert 0.03 <= on_train.mean() <= 0.07  # ~contamination of the training rows is cut
    assert s["iso_pred"].to_numpy()[:475].mean() <= 0.03


def test_iforest_path_length_brute(spark):
    # a single tree on 2 points: depth-1 split, both leaves size 1 -> h = 1
    nodes = pd.DataFrame([(0, 0, 0, 0.5, 1, 2, 0, 0), (0, 1, -1, 0.0, -1, -1, 1, 1), (0, 2, -1, 0.0, -1, -1, 1, 1)],
                         columns=["tree", "node", "feature", "threshold", "left", "right", "leaf_size", "depth"])
    m = IF._to_model(nodes, 2)
    assert np.allclose(IF._path_lengths(np.array([[0.0], [1.0]]), m), [1.0, 1.0])
    assert IF.c_factor(np.array([256]))[0] == pytest.approx(2 * (np.log(255) + np.euler_gamma) - 2 * 255 / 256)


def test_smote_balanced_and_on_segments(spark, outliers):
    out = M.smote(outliers, FEATS, k=5).toPandas()
    counts = out["is_attack_ip"].value_counts()
    assert counts[0] == counts[1] == 475
    syn = out[out["user_id"].str.startswith("smote-")]
    mino = planted().query("is_attack_ip == 1")[FEATS].to_numpy()
    # every synthetic point lies on a segment between two minority points
    for row in syn[FEATS].to_numpy()[:60]:
        ok = False
        for a in mino:
            d = row - a
            for b in mino:
                seg = b - a
                if np.allclose(seg, 0):
                    continue
                t = d @ seg / (seg @ seg)
                if -1e-9 <= t <= 1 + 1e-9 and np.allclose(a + t * seg, row, atol=1e-6):
                    ok = True
                    break
            if ok:
                break
        assert ok


def test_supervised_models_learn_planted_signal(spark, outliers):
    from gatewatch.operators.features import split_flag
    s = split_flag(outliers)
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    out = M.score_and_export(train, test, FEATS).toPandas()
    y = out["is_attack_ip"].to_numpy()
    for c in ("logreg_pred", "rf_pred"):
        assert (out[c].to_numpy()[y == 1] == 1).mean() >= 0.8
        assert (out[c].to_numpy()[y == 0] == 0).mean() >= 0.9


def test_logistic_regularisation_matches_sklearn_form(spark):
    # closed-form check of the objective scaling on a 1-D separable-ish set
    pdf = pd.DataFrame({"user_id": [str(i) for i in range(40)], "x": np.r_[np.linspace(0, 1, 20), np.linspace(0.8, 2, 20)],
                        "is_attack_ip": np.r_[np.zeros(20, int), np.ones(20, int)]})
    m = M.fit_logistic(spark.createDataFrame(pdf), ["x"], balanced=False, C=1.0)
    w, b = float(m.coefficients[0]), float(m.intercept)
    x, y = pdf["x"].to_numpy(), pdf["is_attack_ip"].to_numpy()
    p = 1 / (1 + np.exp(-(w * x + b)))
    grad_w = ((p - y) * x).sum() + w          # d/dw [C * sum loss + 0.5 w^2], C = 1
    grad_b = (p - y).sum()
    assert abs(grad_w) < 1e-3 and abs(grad_b) < 1e-3


def test_calibrated_boosting_probabilities(spark, outliers):
    from gatewatch.operators.features import split_flag
    s = split_flag(outliers)
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    out = M.calibrated_boosting(train, test, FEATS, n_iter=10).toPandas()
    assert out["meta_prob"].between(0, 1).all()
    y = out["is_attack_ip"].to_numpy()
    assert out["meta_prob"].to_numpy()[y == 1].mean() > out["meta_prob"].to_numpy()[y == 0].mean() + 0.3


@pytest.mark.parametrize("leaf_rows,max_leaves", [(30, 1 << 16), (100, 1 << 16), (4096, 1 << 16), (30, 8), (10, 1)])
def test_knn_exact_with_heavy_duplicates_and_ties(spark, leaf_rows, max_leaves):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(600, 3)), 1)  # a coarse grid: many equal distances
    x[:200] = [1.0, 2.0, 3.0]                   # a third of all rows share one vector
    ids = np.array([f"p{i}" for i in range(len(x))])
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf.insert(0, "id", ids)
    df = spark.createDataFrame(pdf).repartition(5)
    got = knn(df, df, "id", ["a", "b", "c"], 7, exclude_self=True, leaf_rows=leaf_rows, max_leaves=max_leaves) \
        .toPandas().set_index("id").loc[ids]
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    for i in range(len(x)):
        want = sorted((d[i, j], ids[j]) for j in range(len(x)) if j != i)[:7]
        assert list(got.iloc[i]["nbr_ids"]) == [n for _, n in want]
        assert np.allclose(got.iloc[i]["nbr_dists"], [v for v, _ in want])
    q = spark.createDataFrame(pd.DataFrame({"id": [f"q{i}" for i in range(50)], **{c: np.round(rng.normal(size=50), 1) for c in "abc"}}))
    got_q = knn(q, df, "id", ["a", "b", "c"], 5, leaf_rows=leaf_rows, max_leaves=max_leaves).toPandas().set_index("id")
    for r in q.toPandas().itertuples():
        dq = np.sqrt(((x - np.array([r.a, r.b, r.c])) ** 2).sum(-1))
        assert list(got_q.loc[r.id, "nbr_ids"]) == [n for _, n in sorted(zip(dq, ids))[:5]]


def test_knn_of_few_and_no_points(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 1.0)], "id string, x double")
    got = {r.id: r.nbr_ids for r in knn(df, df, "id", ["x"], 5, exclude_self=True).collect()}
    assert got == {"a": ["b"], "b": ["a"]}


def test_the_broadcast_tree_does_not_grow_with_the_points(spark):
    from gatewatch.models import kdtree

    rng = np.random.default_rng(1)
    sizes = []
    for n in (5_000, 40_000):
        pts = spark.createDataFrame(pd.DataFrame(rng.normal(size=(n, 2)), columns=["a", "b"]))
        tree = kdtree.fit(pts, ["a", "b"], leaf_rows=10, sample_rows=2_000, max_leaves=64)
        sizes.append(sum(f == kdtree.LEAF for f in tree.feat))
    assert max(sizes) <= 64


@pytest.mark.parametrize("n", [4_000, 16_000])
def test_kdtree_leaves_are_bounded_at_any_size(spark, n):
    """The sample stays the same while the points grow."""
    from gatewatch.models import kdtree

    rng = np.random.default_rng(0)
    pts = spark.createDataFrame(pd.DataFrame(rng.normal(size=(n, 2)) ** 3, columns=["a", "b"]))
    tree = kdtree.fit(pts, ["a", "b"], leaf_rows=200, sample_rows=500)
    shared = spark.sparkContext.broadcast(tree)
    sizes = [r["count"] for r in kdtree.with_leaf(pts, shared, ["a", "b"]).groupBy("leaf").count().collect()]
    assert sum(sizes) == n and max(sizes) <= 200


def test_forest_sample_is_the_smallest_hashes_however_partitioned(spark, outliers):
    a, psi = IF.fit(outliers.repartition(1), FEATS, n_trees=5, max_samples=64)
    b, _ = IF.fit(outliers.repartition(9), FEATS, n_trees=5, max_samples=64)
    assert psi == 64
    pd.testing.assert_frame_equal(a.sort_values(["tree", "node"], ignore_index=True), b.sort_values(["tree", "node"], ignore_index=True))
    assert (a[a.feature < 0].groupby("tree").leaf_size.sum() == 64).all()


def test_one_class_fit_gives_probability_zero(spark, outliers):
    benign = outliers.where("is_attack_ip = 0")
    for m in (M.fit_forest(benign, FEATS, n_trees=3), M.fit_logistic(benign, FEATS)):
        rows = M.predict_proba(m, outliers, FEATS, "x").select("x_prob", "x_pred").distinct().collect()
        assert [(round(r.x_prob, 6), r.x_pred) for r in rows] == [(0.0, 0)]


def test_base_probabilities_are_held_out(spark):
    """Random labels: a model that has seen a row's label would know it."""
    from gatewatch.plans.q_models import _held_out_probs

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(300, 4)), columns=FEATS)
    pdf.insert(0, "user_id", [f"u{i}" for i in range(300)])
    pdf["is_attack_ip"] = (rng.random(300) < 0.4).astype(int)
    got = _held_out_probs(spark.createDataFrame(pdf)).toPandas()
    assert sorted(got.user_id) == sorted(pdf.user_id)
    gap = got[got.is_attack_ip == 1].rf_prob.mean() - got[got.is_attack_ip == 0].rf_prob.mean()
    assert abs(gap) < 0.1


def test_metrics_comparison_builds(spark, monkeypatch):
    """Its own block is built on the table; the two slow fits, built by their own queries, are stood in for."""
    from gatewatch.plans import q_models as Q
    from tests.conftest import SF_SMALL

    other = spark.range(1).selectExpr("'other' AS detector")
    monkeypatch.setattr(Q, "_meta_comparison", lambda s, d: other)
    monkeypatch.setattr(Q, "_linux_evaluation", lambda s, d: other)
    monkeypatch.setattr(Q.EV, "merge_metrics", lambda rules, meta, linux: rules)
    from gatewatch.operators.anomaly import DETECTORS
    got = Q._metrics_comparison(spark, SF_SMALL).collect()
    assert sorted(r.detector for r in got) == sorted(DETECTORS)
