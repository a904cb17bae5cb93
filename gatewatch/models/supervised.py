"""Supervised models on per-entity feature tables.

MLlib's regression and :mod:`forest` run distributed; the wrappers add the
reference's conventions: balanced class weights, sklearn-equivalent L2 strength,
SMOTE oversampling, sigmoid (Platt) calibration per fold, out-of-fold
stacking, and a parameter grid evaluated with one-pass confusion counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewatch.functions.noise import uniform
from gatewatch.models import forest
from gatewatch.models.knn import knn
from gatewatch.operators.features import class_weights, fold_ids

LABEL = "is_attack_ip"
BASE_FEATURES = ("failed_count", "login_freq", "unique_ips", "avg_rtt")


def assemble(df: DataFrame, feats: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(feats), outputCol=out, handleInvalid="keep") \
        .transform(df.withColumns({c: F.col(c).cast("double") for c in feats}))


def _label(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn("gw_label", F.col(label).cast("double"))


def fit_logistic(train: DataFrame, feats: Sequence[str], label: str = LABEL, balanced: bool = True,
                 C: float = 1.0, max_iter: int = 1000, l1: bool = False):
    """M3: ``min C * sum_i w_i loss_i + 0.5 |b|^2`` (sklearn form) written as
    Spark's ``(1/W) sum w_i loss_i + (lambda/2)|b|^2`` with lambda = 1/(C W)."""
    data = class_weights(train, label, "gw_w") if balanced else train.withColumn("gw_w", F.lit(1.0))
    data = _label(assemble(data, feats), label)
    w_total = data.agg(F.sum("gw_w")).first()[0] or 1.0
    lr = LogisticRegression(featuresCol="features", labelCol="gw_label", weightCol="gw_w",
                            maxIter=max_iter, regParam=1.0 / (C * w_total),
                            elasticNetParam=1.0 if l1 else 0.0, standardization=False)
    return lr.fit(data)


def fit_forest(train: DataFrame, feats: Sequence[str], label: str = LABEL, n_trees: int = 100,
               max_depth: int | None = None, balanced: bool = True, seed: int = 42, by: str | None = None):
    """M4: ``max_depth=None`` (unlimited) becomes 30. Fitted and kept as a table (:mod:`forest`)."""
    return forest.fit(train, feats, label, n_trees, min(max_depth or forest.MAX_DEPTH, forest.MAX_DEPTH), balanced, seed, by)


def predict_proba(model, df: DataFrame, feats: Sequence[str], prefix: str, by: str | None = None) -> DataFrame:
    """Adds ``{prefix}_prob`` (P(class 1)) and ``{prefix}_pred`` (prob >= .5); ``by``
    names the column that tells which of a forest's training sets scores a row."""
    if isinstance(model, forest.Forest):
        return forest.with_probability(df, model, f"{prefix}_prob", by) \
            .withColumn(f"{prefix}_pred", (F.col(f"{prefix}_prob") >= 0.5).cast("int"))
    out = model.transform(assemble(df, feats, "features"))
    prob = F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))  # one-class fits have no class 1
    return (out.withColumn(f"{prefix}_prob", prob)
            .withColumn(f"{prefix}_pred", (F.col(f"{prefix}_prob") >= 0.5).cast("int"))
            .drop("features", "rawPrediction", "probability", "prediction"))


def smote(train: DataFrame, feats: Sequence[str], label: str = LABEL, k: int = 5, seed=42,
          key: str = "user_id") -> DataFrame:
    """M1 (Chawla et al. 2002): synthesise ``x + u (nn - x)`` minority rows
    until both classes have the same count. Base rows are taken round-robin
    over a dense index of the minority, the neighbour (one of the k nearest
    minority rows) and ``u`` from keyed hashes. ``k = min(k, n_min - 1)``;
    with <= 1 minority row the input is returned unchanged."""
    made = _synthetic(train.select("*", F.lit(0).alias("gw_by")), "gw_by", feats, label, k, seed, key)
    if made is None:
        return train
    return materialise(train.select(key, *[F.col(c).cast("double") for c in feats], label).unionByName(made.drop("gw_by")))


def smote_by(train: DataFrame, by: str, feats: Sequence[str], label: str = LABEL, k: int = 5, seed=42,
             key: str = "user_id") -> DataFrame:
    """``smote`` of the rows of every value of ``by`` (a small whole number), all in the same jobs."""
    rows = train.select(by, key, *[F.col(c).cast("double") for c in feats], label)
    made = _synthetic(rows, by, feats, label, k, seed, key)
    return materialise(rows if made is None else rows.unionByName(made))


def _synthetic(train: DataFrame, by: str, feats: Sequence[str], label: str, k: int, seed, key: str) -> DataFrame | None:
    """The rows that ``smote`` adds, with ``by``; None if there are none."""
    counts: dict = {}
    for r in train.groupBy(by, label).count().collect():  # a few rows a value
        counts.setdefault(r[0], {})[r[1]] = r[2]
    plan = []  # value, its minority label, rows of it, rows to make
    for own, count in sorted(counts.items()):
        if len(count) < 2:
            continue
        minority = min(count, key=lambda c: (count[c], c))
        n_min, need = count[minority], max(count.values()) - count[minority]
        if n_min > 1 and need > 0:
            plan.append((own, minority, n_min, need))
    if not plan:
        return None
    kind, spark = train.schema[label].dataType, train.sparkSession
    mino = train.where(reduce(Column.__or__, [(F.col(by) == own) & (F.col(label) == minority) for own, minority, _, _ in plan]))
    nbrs = knn(mino, mino, key, feats, max(min(k, n_min - 1) for _, _, n_min, _ in plan), exclude_self=True, by=by)
    idx, gen, ahead = dense_index(mino.select(by, key), [by, key], "gw_idx"), [], 0
    for own, minority, n_min, need in plan:
        gen.append(spark.range(need).select("id", F.lit(own).cast(train.schema[by].dataType).alias(by), (F.col("id") % F.lit(n_min) + F.lit(ahead)).alias("gw_idx"),
                                            F.floor(uniform("id", seed, "smote.nbr") * min(k, n_min - 1)).cast("int").alias("gw_pick"),
                                            uniform("id", seed, "smote.gap").alias("gw_gap"), F.lit(minority).cast(kind).alias("gw_label")))
        ahead += n_min
    base = idx.join(nbrs, [by, key]).join(mino.select(by, key, *feats), [by, key])
    g = reduce(DataFrame.unionByName, gen).join(base, [by, "gw_idx"]).withColumn("gw_nbr", F.element_at("nbr_ids", F.col("gw_pick") + 1))
    other = mino.select(by, F.col(key).alias("gw_nbr"), *[F.col(c).alias(f"gw_n_{c}") for c in feats])
    return g.join(other, [by, "gw_nbr"]).select(
        by, F.concat(F.lit("smote-"), F.col("id").cast("string")).alias(key),
        *[(F.col(c) + F.col("gw_gap") * (F.col(f"gw_n_{c}") - F.col(c))).alias(c) for c in feats],
        F.col("gw_label").alias(label))


def parallel(fn, items, workers: int = 5):
    """Run independent fits as concurrent Spark jobs (driver threads only
    submit jobs; the work runs on executors)."""
    from concurrent.futures import ThreadPoolExecutor

    items = list(items)
    with ThreadPoolExecutor(max_workers=max(1, min(workers, len(items)))) as ex:
        return list(ex.map(fn, items))


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder: every
    later fit reads the written rows instead of re-running the upstream plan,
    and a lost executor's work is re-read rather than recomputed."""
    from gatewatch.session import shared_dir

    shared_dir(df.sparkSession)
    return df.checkpoint()


def dense_index(df: DataFrame, key: str | Sequence[str], out: str) -> DataFrame:
    """0..n-1 in key order without a single-partition window: range
    partitioning, per-partition counts (one row per partition), offsets
    from those counts, then a local row number."""
    from pyspark.sql import Window

    from gatewatch.session import shared_dir

    shared_dir(df.sparkSession)
    key = [key] if isinstance(key, str) else list(key)
    parts = df.repartitionByRange(*key).withColumn("gw_pid", F.spark_partition_id())
    parts = parts.checkpoint()  # stable partition contents under retries
    sizes = parts.groupBy("gw_pid").count()
    offs = sizes.select("gw_pid", (F.sum("count").over(Window.orderBy("gw_pid")) - F.col("count")).alias("gw_off"))
    local = parts.withColumn("gw_local", F.row_number().over(Window.partitionBy("gw_pid").orderBy(*key)) - 1)
    return local.join(F.broadcast(offs), "gw_pid").select(
        "*", (F.col("gw_off") + F.col("gw_local")).alias(out)).drop("gw_pid", "gw_off", "gw_local")


def calibrated_boosting(train: DataFrame, data: DataFrame, feats: Sequence[str], label: str = LABEL,
                        folds: int = 5, n_iter: int = 100, max_depth: int = 4, step: float = 0.05,
                        seed: int = 42, key: str = "user_id") -> DataFrame:
    """M5: boosted trees with positive weight neg/pos; per fold fit on the
    other folds, Platt-calibrate on the held-out fold; average the folds'
    calibrated probabilities. -> ``data`` + ``meta_prob``. All folds are boosted
    together (:mod:`boosting`), and calibrated together."""
    from gatewatch.models import boosting as B
    from gatewatch.operators.evaluate import positive_weight

    spw = positive_weight(train, label).first()[0]
    rows = materialise(fold_ids(train, key, folds, seed))
    tracks = [B.Track(step, max_depth, float(spw), f) for f in range(folds)]
    model = B.fit(rows, feats, tracks, label, "fold", n_iter)
    fits = B.platt_all(B.with_probabilities(rows, feats, model, "gw_p"), "gw_p", label, "fold", folds)
    used = [f for f in range(folds) if f in {r[0] for r in rows.select("fold").distinct().collect()}] or [0]
    p = [F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(fits[f][0]) * F.get("gw_p", F.lit(f)) + F.lit(fits[f][1])))) for f in used]
    return B.with_probabilities(data, feats, model, "gw_p") \
        .withColumn("meta_prob", sum(p[1:], p[0]) / F.lit(float(len(p)))).drop("gw_p")


def stacking(train: DataFrame, data: DataFrame, feats: Sequence[str], label: str = LABEL,
             folds: int = 5, seed: int = 42, key: str = "user_id") -> DataFrame:
    """M6: base RF (30 trees, depth 3) + LR; out-of-fold base probabilities
    train the final LR; bases refit on all of train score ``data``."""
    tr = materialise(fold_ids(train, key, folds, seed))
    data = materialise(data)

    def one_fold(f):
        fit_part, held = tr.where(F.col("fold") != f), tr.where(F.col("fold") == f)
        rf = fit_forest(fit_part, feats, label, 30, 3, balanced=False, seed=seed)
        lr = fit_logistic(fit_part, feats, label, balanced=False)
        h = predict_proba(rf, held, feats, "rf")
        h = predict_proba(lr, h, feats, "lr")
        return h.select(key, label, "rf_prob", "lr_prob")

    oof = parallel(one_fold, range(folds))
    stack = oof[0]
    for o in oof[1:]:
        stack = stack.unionByName(o)
    stack = materialise(stack)
    final, rf, lr = parallel(lambda job: job(), [
        lambda: fit_logistic(stack, ["rf_prob", "lr_prob"], label, balanced=False),
        lambda: fit_forest(tr, feats, label, 30, 3, balanced=False, seed=seed),
        lambda: fit_logistic(tr, feats, label, balanced=False)])
    s = predict_proba(lr, predict_proba(rf, data, feats, "rf"), feats, "lr")
    return predict_proba(final, s, ["rf_prob", "lr_prob"], "stack")


def score_and_export(train: DataFrame, test: DataFrame, feats: Sequence[str] = BASE_FEATURES,
                     label: str = LABEL, use_smote: bool = True, seed: int = 42,
                     key: str = "user_id") -> DataFrame:
    """M9: fit LR and RF (balanced, after SMOTE) on train; per test row the
    features, both probabilities / predictions and the label."""
    fit_on = smote(train, feats, label, 5, seed, key) if use_smote else train
    fit_on = materialise(fit_on)
    test = materialise(test)
    lr, rf = parallel(lambda job: job(), [lambda: fit_logistic(fit_on, feats, label),
                                          lambda: fit_forest(fit_on, feats, label, 100, None, seed=seed)])
    out = predict_proba(rf, predict_proba(lr, test, feats, "logreg"), feats, "rf")
    return out.select(key, *feats, "logreg_prob", "logreg_pred", "rf_prob", "rf_pred", label)
