"""Histogram boosting equals a plain greedy one; folds, settings and calibration in one pass."""
import numpy as np
import pytest

from gatewatch.models import boosting as B


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


def plain(x, y, track, rounds, use):
    """Margins of all rows after greedy second-order boosting on bins, row by row sums."""
    m = np.zeros(len(y))
    for _ in range(rounds):
        p, w = sigmoid(m), np.where(y == 1, track.positive, 1.0)
        g, h = np.rint(w * (p - y) * B.UNIT) / B.UNIT, np.rint(w * p * (1 - p) * B.UNIT) / B.UNIT
        add = np.zeros(len(y))

        def grow(rows, fit, depth, g=g, h=h, add=add):
            sg, sh = g[fit].sum(), h[fit].sum()
            best = (1e-9, None)
            for missing in (False, True):
                for f in range(x.shape[1]) if depth < track.depth and (depth == 0 or sh >= 2) else ():
                    for cut in range(int(x[x < 255].max()) + 1):
                        left = np.where(x[:, f] == 255, missing, x[:, f] <= cut)
                        a, b = fit & left, fit & ~left
                        lh, rh = h[a].sum(), h[b].sum()
                        if lh < 1 or rh < 1:
                            continue
                        gain = g[a].sum() ** 2 / (lh + 1) + g[b].sum() ** 2 / (rh + 1) - sg ** 2 / (sh + 1)
                        if gain > best[0] + 1e-9:
                            best = gain, left
            if best[1] is None:
                add[rows] = -track.rate * sg / (sh + 1)
                return
            grow(rows & best[1], fit & best[1], depth + 1)
            grow(rows & ~best[1], fit & ~best[1], depth + 1)

        grow(np.ones(len(y), bool), use, 0)
        m = m + add
    return m


@pytest.fixture()
def table(spark):
    rng = np.random.default_rng(4)
    n = 300
    x = rng.normal(size=(n, 3)).round(2)
    x[rng.random((n, 3)) < 0.1] = np.nan
    y = ((np.nan_to_num(x[:, 0]) + np.nan_to_num(x[:, 1]) ** 2 + rng.normal(size=n) * 0.3) > 0.8).astype(int)
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], int(c), i % 3) for i, (r, c) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id int, a double, b double, c double, is_attack_ip int, fold int").repartition(5)


def test_equals_plain_boosting(table, monkeypatch):
    monkeypatch.setattr(B, "KEEP", 2)  # margins are written anew on the way
    x, y, df = table
    edges = [[-1.0, -0.3, 0.0, 0.4, 1.1]] * 3
    tracks = [B.Track(0.3, 3, 2.0, 0), B.Track(0.5, 2, 1.0, 1), B.Track(0.1, 1, 5.0, -1)]
    feats = ["a", "b", "c"]
    model = B.fit(df, feats, tracks, fold="fold", rounds=5, edges=edges)
    bins = model.bins(list(x.T))
    got = model.margins(bins)
    for k, t in enumerate(tracks):
        use = (np.arange(len(y)) % 3) != t.without
        assert np.allclose(got[:, k], plain(bins, y, t, 5, use), atol=1e-9)
    out = {r.id: r.p for r in B.with_probabilities(df, feats, model, "p").collect()}
    assert np.allclose([out[i] for i in range(len(y))], sigmoid(got))
    again = B.fit(df.repartition(2), feats, tracks, fold="fold", rounds=5, edges=edges)
    assert [t.value for ts in again.trees for t in ts] == [t.value for ts in model.trees for t in ts]  # order-free


def test_platt_minimises_the_smoothed_loss(spark):
    rng = np.random.default_rng(2)
    p, k = rng.random(600), np.arange(600) % 2
    y = (rng.random(600) < sigmoid(6 * p - 2)).astype(int)
    df = spark.createDataFrame([([float(v), float(v)], int(c), int(f)) for v, c, f in zip(p, y, k)], "p array<double>, y int, fold int")
    for f, (a, b) in enumerate(B.platt_all(df, "p", "y", "fold", 2)):
        on = k == f
        n1, n0 = y[on].sum(), (1 - y[on]).sum()
        t = np.where(y[on] == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        e = sigmoid(a * p[on] + b) - t
        assert abs(e.sum()) < 1e-4 and abs((e * p[on]).sum()) < 1e-4


def test_one_class_and_empty(spark, table):
    _, _, df = table
    one = B.fit(df.where("is_attack_ip = 0"), ["a", "b"], [B.Track()], rounds=3)
    assert all(r.p[0] < 0.5 for r in B.with_probabilities(df, ["a", "b"], one, "p").collect())
    none = B.fit(df.limit(0), ["a"], [B.Track()], rounds=2)
    assert {r.p[0] for r in B.with_probabilities(df, ["a"], none, "p").collect()} == {0.5}


@pytest.mark.parametrize("tasks", [1, 2])
def test_rounds_are_not_jobs(spark, table, monkeypatch, tasks):
    """A level of a tree was a job; now all rounds are one stage, also in blocks of few nodes."""
    _, _, df = table
    monkeypatch.setattr(B, "EXCHANGE_BYTES", 1 << 16)
    feats, tracks, jobs = ["a", "b", "c"], [B.Track(0.3, 3, 2.0, 0), B.Track(0.5, 2)], []
    for rounds in (1, 2):
        group = f"boosting-{tasks}-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        model = B.fit(df, feats, tracks, fold="fold", rounds=rounds, tasks=tasks)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("other", "other")
    assert jobs[0] == jobs[1]
    monkeypatch.undo()
    whole = B.fit(df, feats, tracks, fold="fold", rounds=2, tasks=1)
    assert [t.value for ts in whole.trees for t in ts] == [t.value for ts in model.trees for t in ts]
