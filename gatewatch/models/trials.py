"""Tuning trials (M10): every setting of the published tables, scored on held-out rows.

All predictions of a table end up as columns of one frame, so one confusion
pass serves all of its settings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch.models import boosting as B
from gatewatch.models import iforest as IF
from gatewatch.models import lof as LOF
from gatewatch.models import supervised as M
from gatewatch.operators.evaluate import confusion, metrics

# The settings of the insider-threat and the Linux tables. The
# last of each list is the one that the tables call best.
# logistic: (balanced, max_iter, l1, C)
LOGISTIC = {
    "cert": [(False, 100, False, 1.0), (True, 100, False, 1.0), (True, 500, True, 1.0), (True, 2000, False, 0.5), (True, 1000, False, 1.0)],
    "linux": [(False, 100, False, 1.0), (True, 200, False, 1.0), (True, 500, True, 1.0), (True, 2000, False, 1.0), (True, 1000, False, 1.0)],
}
# forest: (trees, depth or None, balanced)
FOREST = {
    "cert": [(10, None, False), (50, 10, True), (150, 20, False), (200, 50, True), (100, None, True)],
    "linux": [(20, 5, False), (50, 15, True), (150, 30, False), (250, None, True), (100, None, True)],
}
# boosting: (learning rate, depth, positive weight, threshold)
BOOSTING = {
    "cert": [(0.1, 3, 1, 0.5), (0.01, 5, 10, 0.5), (0.1, 10, 50, 0.5), (0.2, 4, 99, 0.5), (0.05, 6, 99, 0.1)],
    "linux": [(0.1, 3, 1, 0.5), (0.01, 5, 20, 0.5), (0.1, 12, 75, 0.5), (0.3, 5, 99, 0.5), (0.05, 6, 99, 0.1)],
}
# isolation forest: (trees, contamination)
ISOLATION = {
    "cert": [(50, 0.2), (100, 0.1), (150, 0.068), (200, 0.01), (150, 0.05)],
    "linux": [(50, 0.2), (100, 0.15), (150, 0.08), (250, 0.02), (150, 0.05)],
}
# LOF: (neighbours, contamination, novelty)
NEIGHBOURS = {
    "cert": [(5, 0.2, False), (10, 0.1, False), (20, 0.15, False), (50, 0.01, True), (20, 0.05, True)],
    "linux": [(5, 0.2, False), (15, 0.1, False), (20, 0.15, False), (40, 0.02, True), (20, 0.05, True)],
}


def _report(scored: DataFrame, label: str, names: Sequence[str]) -> DataFrame:
    return metrics(confusion(scored, label, [f"{n}_pred" for n in names])) \
        .withColumn("detector", F.regexp_replace("detector", "_pred$", ""))


def supervised_trials(train: DataFrame, test: DataFrame, table: str, feats: Sequence[str] = M.BASE_FEATURES,
                      label: str = M.LABEL, seed: int = 42, key: str = "user_id") -> DataFrame:
    train, scored = M.materialise(train), M.materialise(test.select(key, *feats, label))
    jobs = {f"logistic_{i}": (lambda s=s: M.fit_logistic(train, feats, label, s[0], s[3], s[1], s[2])) for i, s in enumerate(LOGISTIC[table], 1)}
    jobs |= {f"forest_{i}": (lambda s=s: M.fit_forest(train, feats, label, s[0], s[1], s[2], seed)) for i, s in enumerate(FOREST[table], 1)}
    for name, model in zip(jobs, M.parallel(lambda job: job(), jobs.values())):
        scored = M.predict_proba(model, scored, feats, name).drop(f"{name}_prob")
    return _report(scored, label, list(jobs))


def boosting_trials(train: DataFrame, test: DataFrame, table: str, feats: Sequence[str] = M.BASE_FEATURES, label: str = M.LABEL,
                    rounds: int = 100, seed: int = 42, key: str = "user_id") -> DataFrame:
    """All settings are tracks of one boosting: a pass over the rows serves them all."""
    tracks = [B.Track(rate, depth, float(positive)) for rate, depth, positive, _ in BOOSTING[table]]
    model = B.fit(train, feats, tracks, label, rounds=rounds)
    names = [f"boosting_{i}" for i in range(1, len(tracks) + 1)]
    scored = B.with_probabilities(test.select(key, *feats, label), feats, model, "gw_p")
    for i, (name, s) in enumerate(zip(names, BOOSTING[table])):
        scored = scored.withColumn(f"{name}_pred", (F.get("gw_p", F.lit(i)) >= s[3]).cast("int"))
    return _report(M.materialise(scored), label, names)


def unsupervised_trials(train: DataFrame, data: DataFrame, table: str, feats: Sequence[str] = M.BASE_FEATURES,
                        label: str = M.LABEL, seed: int = 42, key: str = "user_id") -> DataFrame:
    """Without novelty, LOF is fitted on the rows that it judges, a row not being its own neighbour."""
    train, data = M.materialise(train), M.materialise(data)

    def isolate(s):
        return IF.isolation_forest(train, data, feats, key, n_trees=s[0], contamination=s[1], seed=seed).select(key, "iso_pred")

    def neighbours(s):
        fit_on = train if s[2] else data
        return LOF.lof_scores(fit_on, data, key, feats, k=s[0], contamination=s[1], novelty=s[2]).select(key, "lof_pred")

    jobs = {f"isolation_{i}": (isolate, s) for i, s in enumerate(ISOLATION[table], 1)}
    jobs |= {f"neighbours_{i}": (neighbours, s) for i, s in enumerate(NEIGHBOURS[table], 1)}
    out = data.select(key, label)
    for name, found in zip(jobs, M.parallel(lambda job: M.materialise(job[0](job[1]).toDF(key, "gw_p")), jobs.values())):
        out = out.join(found.withColumnRenamed("gw_p", f"{name}_pred"), key, "left")
    return _report(out, label, list(jobs))
