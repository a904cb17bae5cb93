"""Folds as a column: each fold's rows are what a run on its rows alone gives, and the jobs are shared."""
import numpy as np
import pandas as pd
import pytest

from gatewatch.models import forest as FO
from gatewatch.models import supervised as M
from gatewatch.models.knn import knn
from gatewatch.plans import q_models as Q

FEATS = list(M.BASE_FEATURES)


def rows_of(n, seed=5):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(rng.integers(0, 9, (n, 4)).astype(float), columns=FEATS)  # few values: copies of points, also across folds
    pdf.insert(0, "user_id", [f"u{i:03}" for i in range(n)])
    pdf["is_attack_ip"] = ((pdf.failed_count > 5) ^ (rng.random(n) < 0.2)).astype(int)
    pdf["part"] = rng.integers(0, 3, n)
    pdf.loc[pdf.part == 2, "is_attack_ip"] = 0  # one class only: nothing to add
    pdf.loc[pdf.index[pdf.part == 2][:1], "user_id"] = "u000"  # an id in two parts
    return pdf


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows_of(400)).repartition(5)


def sorted_rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("leaf_rows", [4096, 16])
def test_neighbours_are_of_the_own_set(table, leaf_rows):
    got = knn(table, table, "user_id", FEATS, 4, exclude_self=True, leaf_rows=leaf_rows, by="part")
    for p in range(3):
        mine = table.where(f"part = {p}")
        alone = knn(mine, mine, "user_id", FEATS, 4, exclude_self=True)
        assert sorted_rows(got.where(f"part = {p}"), "user_id", "nbr_ids", "nbr_dists") == sorted_rows(alone, "user_id", "nbr_ids", "nbr_dists")


def test_smote_by_equals_smote_of_each_part(table):
    got = M.smote_by(table, "part", FEATS)
    for p in range(3):
        alone = M.smote(table.where(f"part = {p}").drop("part"), FEATS)
        assert sorted_rows(got.where(f"part = {p}"), "user_id", *FEATS, "is_attack_ip") == sorted_rows(alone, "user_id", *FEATS, "is_attack_ip")


def test_a_forest_for_each_part(table):
    model = FO.fit(table, FEATS, "is_attack_ip", 12, 30, True, 42, by="part")
    got = FO.with_probability(table, model, "p", by="part")
    assert got.columns == [*table.columns, "p"]
    for p in range(3):
        mine = table.where(f"part = {p}")
        alone = FO.with_probability(mine, FO.fit(mine, FEATS, "is_attack_ip", 12, 30, True, 42), "p")
        assert sorted_rows(got.where(f"part = {p}"), "user_id", "p") == sorted_rows(alone, "user_id", "p")
    other = FO.with_probability(table.selectExpr("user_id", *FEATS, "7 AS part"), model, "p", by="part")
    assert {r.p for r in other.select("p").collect()} == {0.0}  # no forest, no vote


def test_held_out_probabilities_search_and_grow_once(table, monkeypatch):
    """Neighbour searches, forests and scores were run once a fold."""
    calls = []
    counted = lambda name, f: lambda *a, **k: calls.append(name) or f(*a, **k)
    monkeypatch.setattr(M, "knn", counted("knn", M.knn))
    monkeypatch.setattr(FO, "fit", counted("fit", FO.fit))
    monkeypatch.setattr(FO, "with_probability", counted("score", FO.with_probability))
    feats = table.where("part < 2").drop("part")
    out = Q._held_out_probs(feats)
    assert sorted(calls) == ["fit", "knn", "score"]
    assert out.columns == [*feats.columns, "logreg_prob", "logreg_pred", "rf_prob", "rf_pred"] and out.count() == feats.count()
    assert out.where("rf_prob BETWEEN 0 AND 1 AND logreg_prob BETWEEN 0 AND 1").count() == feats.count()
