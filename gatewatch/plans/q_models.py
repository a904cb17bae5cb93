"""Catalog: supervised and unsupervised detectors (no SQL oracle; these are
iterative fits -- checked by row counts here and by brute-force tests)."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch.models import boosting as B
from gatewatch.models import iforest as IF
from gatewatch.models import lof as LOF
from gatewatch.models import supervised as M
from gatewatch.models import trials as T
from gatewatch.operators import evaluate as EV
from gatewatch.operators import features as FT
from gatewatch.operators import scoring as SC
from gatewatch.operators import audit as A
from gatewatch.plans import sqlgen as SQ
from gatewatch.plans.catalog import register
from gatewatch.plans.q_features import SPLIT_SQL, UF as UF_SQL
from gatewatch.session import tidy
from gatewatch.sources import login_events
from gatewatch.sources import readers as R
from gatewatch.sources import sinks as SK
from gatewatch.sources.tables import load_table

FAM = "models"
FEATS = list(M.BASE_FEATURES)


def _split(spark, d):
    feats = FT.split_flag(FT.universal_features(login_events(spark, d)))
    return feats.where("split = 'train'").drop("split"), feats.where("split = 'test'").drop("split")


def _smote(spark, d):
    train, _ = _split(spark, d)
    return EV.class_distribution(M.smote(train, FEATS))


def _smote_sql() -> str:
    from gatewatch.plans import sqlgen as S
    from gatewatch.plans.q_features import SPLIT_SQL, UF

    return S.with_le(UF) + f"""
, tr AS (SELECT * FROM ({SPLIT_SQL}) WHERE split = 'train')
, cc AS (SELECT is_attack_ip, COUNT(*) AS c FROM tr GROUP BY is_attack_ip)
SELECT is_attack_ip,
       CASE WHEN (SELECT COUNT(*) FROM cc) < 2 OR (SELECT MIN(c) FROM cc) <= 1 THEN c  -- nothing to interpolate
            ELSE (SELECT MAX(c) FROM cc) END AS n
FROM cc"""


# SMOTE's row values are random draws, but its contract -- both classes end
# at the majority count of the training split, unless the minority has at
# most one row (then the data passes unchanged) -- is SQL-checkable.
register("smote_balance", _smote_sql(), FAM)(_smote)


def _lr(spark, d):
    train, test = _split(spark, d)
    m = M.fit_logistic(train, FEATS)
    return M.predict_proba(m, test, FEATS, "logreg").select("user_id", "logreg_prob", "logreg_pred", "is_attack_ip")


register("logistic_regression", None, FAM)(_lr)


def _rf(spark, d):
    train, test = _split(spark, d)
    m = M.fit_forest(train, FEATS, n_trees=100)
    return M.predict_proba(m, test, FEATS, "rf").select("user_id", "rf_prob", "rf_pred", "is_attack_ip")


register("random_forest", None, FAM)(_rf)


def _export(spark, d):
    train, test = _split(spark, d)
    return M.score_and_export(train, test, FEATS)


register("score_and_export", None, FAM)(_export)


def _base_metrics(spark, d):
    return EV.metrics(EV.confusion(_export(spark, d), "is_attack_ip", ["logreg_pred", "rf_pred"]))


register("supervised_metrics", None, FAM)(_base_metrics)


def _held_out_probs(feats, folds: int = 5):
    """``feats`` with base-model probabilities that no row's own label reached:
    per stratified fold, both models are fitted on the other folds. The folds are
    a column, so their oversampling, forests and scores are the same few jobs."""
    rows = M.materialise(FT.fold_ids(feats, k=folds, seed=11))
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))
    fit_on = M.smote_by(rows.withColumn("without", F.explode(others)), "without", FEATS)
    tidy(rows.sparkSession)  # the searches before it and the fits leave hundreds of plans on the driver
    rf, *lrs = M.parallel(lambda job: job(), [lambda: M.fit_forest(fit_on, FEATS, n_trees=100, by="without"),
                                              *[partial(M.fit_logistic, fit_on.where(F.col("without") == f).drop("without"), FEATS) for f in range(folds)]], folds + 1)
    tidy(rows.sparkSession)
    held = reduce(DataFrame.unionByName, [M.predict_proba(lr, rows.where(F.col("fold") == f), FEATS, "logreg") for f, lr in enumerate(lrs)])
    return M.predict_proba(rf, held, FEATS, "rf", by="fold").drop("fold")


def _meta_inputs(spark, d):
    le = login_events(spark, d)
    scored, session = M.parallel(lambda job: job(), [lambda: _held_out_probs(FT.universal_features(le)), lambda: FT.session_features(le)])
    return scored.join(session, "user_id")


# The meta model's input names.
META_FEATURES = ["logreg_prob", "rf_prob", "failed_count", "login_freq", "unique_ips", "avg_rtt",
                 "success_count", "failed_success_ratio", "unusual_login_hour", "is_new_ip", "is_new_device",
                 "consecutive_failed_attempts", "recent_failed_5m", "recent_failed_30m", "recent_failed_24h",
                 "avg_failed_gap", "unique_devices"]


def _meta_scored(spark, d):
    """Every user's meta result and the split: the boosting is fitted on the
    stratified train rows and scores all rows, which are all published; reports
    on held-out rows take ``split = 'test'``."""
    x = M.materialise(_meta_inputs(spark, d))
    rows = FT.split_flag(x, seed=7)
    out = M.calibrated_boosting(rows.where("split = 'train'"), rows, META_FEATURES)
    split = rows.select("user_id", "split")
    return SK.publish_meta(M.materialise(out), 0.1).join(split, "user_id")


def _meta(spark, d):
    return _meta_scored(spark, d).drop("split")


register("calibrated_boosting", None, FAM)(_meta)


# Two rounds of stumps on fixed edges, for which SQL can say the whole fit.
STUMP_EDGES = {"failed_count": [2, 5, 8, 11, 14, 17, 20, 25], "login_freq": [10, 20, 40, 60, 80, 100, 120], "unique_ips": [5, 10, 20, 40, 60]}


def _stumps(spark, d):
    feats = FT.universal_features(login_events(spark, d))
    model = B.fit(feats, list(STUMP_EDGES), [B.Track(0.3, 1, 2.0), B.Track(0.5, 1, 1.0)], rounds=2, edges=list(STUMP_EDGES.values()))
    return B.with_probabilities(feats, list(STUMP_EDGES), model, "p") \
        .select("user_id", F.round(F.get("p", F.lit(0)), 6).alias("prob_weighted"), F.round(F.get("p", F.lit(1)), 6).alias("prob_plain"))


def _stump_rounds_sql(name: str, rate: float, positive: float) -> str:
    """CTEs up to ``{name}2``: user_id, is_attack_ip, features and margin after two rounds."""
    cuts = " UNION ALL ".join(f"SELECT {i} AS f, {j} AS b, {v} AS cut" for i, e in enumerate(STUMP_EDGES.values()) for j, v in enumerate(e))
    value = "CASE f " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(STUMP_EDGES)) + " END"
    unit, out = float(B.UNIT), []
    for r in (1, 2):
        src = f"(SELECT *, 0.0 AS m FROM uf)" if r == 1 else f"{name}1"  # noqa: F541
        w = f"(CASE WHEN is_attack_ip = 1 THEN {positive} ELSE 1.0 END)"
        out.append(f"""{name}g{r} AS (SELECT *, round({w} * (1.0 / (1.0 + exp(-m)) - is_attack_ip) * {unit}) / {unit} AS g,
          round({w} / (1.0 + exp(-m)) * (1.0 - 1.0 / (1.0 + exp(-m))) * {unit}) / {unit} AS h FROM {src}),
{name}t{r} AS (SELECT SUM(g) AS tg, SUM(h) AS th FROM {name}g{r}),
{name}c{r} AS (SELECT f, b, cut, SUM(CASE WHEN {value} <= cut THEN g ELSE 0 END) AS lg, SUM(CASE WHEN {value} <= cut THEN h ELSE 0 END) AS lh
          FROM {name}g{r}, ({cuts}) GROUP BY f, b, cut),
{name}b{r} AS (SELECT * FROM {name}c{r}, {name}t{r} WHERE lh >= 1 AND th - lh >= 1
          AND lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) - tg * tg / (th + 1) > 1e-9
          ORDER BY round(lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) - tg * tg / (th + 1), 9) DESC, f, b LIMIT 1),
{name}{r} AS (SELECT x.* EXCLUDE (m, g, h), m + coalesce(CASE WHEN {value} <= cut THEN -{rate} * lg / (lh + 1)
          ELSE -{rate} * (b.tg - lg) / (b.th - lh + 1) END, -{rate} * t.tg / (t.th + 1)) AS m
          FROM {name}g{r} x CROSS JOIN {name}t{r} t LEFT JOIN {name}b{r} b ON true)""")
    return ",\n".join(out)


register("boosted_stumps", SQ.with_le(UF_SQL, _stump_rounds_sql("a", 0.3, 2.0), _stump_rounds_sql("z", 0.5, 1.0)) + """
SELECT a2.user_id, round(1.0 / (1.0 + exp(-a2.m)), 6) AS prob_weighted, round(1.0 / (1.0 + exp(-z2.m)), 6) AS prob_plain
FROM a2 JOIN z2 ON a2.user_id = z2.user_id""", FAM)(_stumps)


def _linux_aug(spark, d):
    lin = R.normalise_rba(R.normalise_linux(R.linux_raw_from_events(load_table(spark, d, "events"))))
    return FT.augment_overlap(FT.impute_mean(FT.universal_features(lin, key="ip", label="any")))


def _stacking(spark, d):
    split = FT.split_flag(_linux_aug(spark, d))
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    s = M.stacking(M.smote(train.drop("split"), FEATS), test, FEATS)
    return EV.metrics(EV.confusion(SC.flip_predictions(s, "stack_pred", 42, 0.0003, out_col="stack_dp_pred"),
                                   "is_attack_ip", ["stack_pred", "stack_dp_pred"]))


register("stacking_linux", None, FAM)(_stacking)


SIX = [*FEATS, "logreg_prob", "rf_prob"]


def _six_features(spark, d):
    """The unsupervised detectors' inputs, written once: the four features and
    the two base probabilities, here the fixed models' (F16, F17), with the split."""
    feats = FT.universal_features(login_events(spark, d))
    scored = feats.withColumn("logreg_prob", SC.logistic_score([F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATS])) \
        .withColumn("rf_prob", SC.stump_vote("failed_count").cast("double"))
    return M.materialise(FT.split_flag(scored))


def _six_trained(spark, d):
    """The same inputs with the trained base models' probabilities, each row's from
    models that its own label did not reach."""
    scored = _held_out_probs(FT.universal_features(login_events(spark, d)))
    return M.materialise(FT.split_flag(scored.select("user_id", *SIX, "is_attack_ip")))


def _iforest(spark, d, feats=None):
    allf = _six_features(spark, d) if feats is None else feats
    return IF.isolation_forest(allf.where("split = 'train'"), allf, SIX).join(allf.select("user_id", "is_attack_ip"), "user_id")


register("isolation_forest", None, FAM)(_iforest)


def _lof(spark, d, feats=None):
    allf = _six_features(spark, d) if feats is None else feats
    return LOF.lof_scores(allf.where("split = 'train'"), allf, "user_id", SIX, k=20, contamination=0.05) \
        .join(allf.select("user_id", "is_attack_ip"), "user_id")


# Contracts of fitted models: the keys, probabilities in [0, 1], predictions at
# the threshold on every row, and for the regression a vanishing gradient.
def _contract(df, prob, pred, t=0.5):
    return df.select("user_id", F.col(prob).between(0, 1).alias("prob_ok"),
                     (F.col(pred) == (F.col(prob) >= t).cast("int")).alias("pred_ok"))


_TEST_KEYS = SQ.with_le(UF_SQL) + f"""
SELECT user_id, true AS prob_ok, true AS pred_ok FROM ({SPLIT_SQL}) WHERE split = 'test'"""
_ALL_KEYS = SQ.with_le(UF_SQL) + "SELECT user_id, true AS prob_ok, true AS pred_ok FROM uf"

register("logistic_contract", _TEST_KEYS, FAM)(lambda spark, d: _contract(_lr(spark, d), "logreg_prob", "logreg_pred"))
register("forest_contract", _TEST_KEYS, FAM)(lambda spark, d: _contract(_rf(spark, d), "rf_prob", "rf_pred"))
register("export_contract", _TEST_KEYS, FAM)(lambda spark, d: _contract(_export(spark, d), "rf_prob", "rf_pred"))
register("meta_contract", _ALL_KEYS, FAM)(lambda spark, d: _contract(_meta(spark, d), "meta_prob", "meta_pred", 0.1))


def _gradient(spark, d):
    """Per coefficient: is the penalised, weighted loss flat there?"""
    train = M.materialise(_split(spark, d)[0])
    m = M.fit_logistic(train, FEATS)
    rows = FT.class_weights(train, M.LABEL, "w").withColumns({c: F.col(c).cast("double") for c in FEATS})
    z = sum((F.lit(float(b)) * F.col(c) for b, c in zip(m.coefficients, FEATS)), F.lit(float(m.intercept)))
    gap = F.col("w") * (F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) - F.col(M.LABEL))
    one = {**{c: F.col(c) for c in FEATS}, "intercept": F.lit(1.0)}
    beta = dict(zip(FEATS, m.coefficients), intercept=0.0)
    sums = rows.agg(*[(F.abs(F.sum(gap * x) + F.lit(float(beta[c]))) < 1e-3 * F.sum(F.col("w") * F.abs(x))).alias(c) for c, x in one.items()])
    return sums.unpivot([], list(one), "coefficient", "gradient_is_zero")


register("logistic_gradient", "SELECT unnest(['failed_count', 'login_freq', 'unique_ips', 'avg_rtt', 'intercept']) AS coefficient, "
         "COUNT(*) > 0 AS gradient_is_zero FROM events", FAM)(_gradient)

register("forest_share", SQ.with_le(UF_SQL) + f"""
SELECT COUNT(*) AS n, true AS share_ok FROM ({SPLIT_SQL}) WHERE split = 'train'""", FAM)(
    lambda spark, d: (lambda f: _iforest(spark, d, f).join(f.where("split = 'train'").select("user_id"), "user_id").agg(
        F.count(F.lit(1)).alias("n"), (F.abs(F.avg("iso_pred") - 0.05) <= F.lit(1.5) / F.count(F.lit(1)) + 0.005).alias("share_ok")))(_six_features(spark, d)))


def _lof_sql() -> str:
    """Exact neighbours by a self-join, then the definition (k = 20, 5 percent)."""
    from gatewatch.plans import sqlgen as S
    from gatewatch.plans.q_features import SPLIT_SQL, UF

    gap = " + ".join(f"(q.f{i} - t.f{i}) * (q.f{i} - t.f{i})" for i in range(6))
    linear = "0.5 * failed_count + 0.2 * login_freq + 0.1 * unique_ips + 0.05 * coalesce(avg_rtt, 0)"
    return S.with_le(UF) + f"""
, x AS (SELECT user_id, is_attack_ip, split, CAST(failed_count AS DOUBLE) AS f0, CAST(login_freq AS DOUBLE) AS f1,
               CAST(unique_ips AS DOUBLE) AS f2, avg_rtt AS f3, 1.0 / (1.0 + exp(-(-5.0 + {linear}))) AS f4,
               CAST({S.stump('failed_count')} AS DOUBLE) AS f5 FROM ({SPLIT_SQL}))
, t AS (SELECT * FROM x WHERE split = 'train')
, k AS (SELECT greatest(1, least(20, COUNT(*) - 1)) AS k FROM t)
, dt AS (SELECT q.user_id AS q, t.user_id AS o, sqrt({gap}) AS d,
                row_number() OVER (PARTITION BY q.user_id ORDER BY sqrt({gap}), t.user_id) AS n FROM t q JOIN t ON q.user_id <> t.user_id)
, nt AS (SELECT q, o, d FROM dt, k WHERE n <= k)
, kd AS (SELECT q, MAX(d) AS kdist FROM nt GROUP BY q)
, lt AS (SELECT nt.q, 1.0 / (AVG(greatest(d, kdist)) + 1e-10) AS lrd FROM nt JOIN kd ON kd.q = nt.o GROUP BY nt.q)
, ft AS (SELECT nt.q, AVG(o.lrd) / MAX(s.lrd) AS lof FROM nt JOIN lt o ON o.q = nt.o JOIN lt s ON s.q = nt.q GROUP BY nt.q)
, cut AS (SELECT quantile_disc(-lof, 0.05) AS c FROM ft)
, da AS (SELECT q.user_id AS q, t.user_id AS o, sqrt({gap}) AS d,
                row_number() OVER (PARTITION BY q.user_id ORDER BY sqrt({gap}), t.user_id) AS n FROM x q, t)
, na AS (SELECT q, o, d FROM da, k WHERE n <= k)
, la AS (SELECT na.q, 1.0 / (AVG(greatest(d, kdist)) + 1e-10) AS lrd FROM na JOIN kd ON kd.q = na.o GROUP BY na.q)
, fa AS (SELECT na.q, AVG(o.lrd) / MAX(s.lrd) AS lof FROM na JOIN lt o ON o.q = na.o JOIN la s ON s.q = na.q GROUP BY na.q)
SELECT fa.q AS user_id, round(lof, 6) AS lof, CAST(-lof < c AS INTEGER) AS lof_pred, is_attack_ip
FROM fa JOIN x ON x.user_id = fa.q, cut"""


register("local_outlier_factor", _lof_sql(), FAM)(lambda spark, d: _lof(spark, d).withColumn("lof", F.round("lof", 6)))


def _fixed_scores(spark, d):
    feats = FT.universal_features(login_events(spark, d))
    return feats.select("user_id", "failed_count", "is_attack_ip", SC.logistic_score([F.col("failed_count")]).alias("score"),
                        SC.stump_vote("failed_count").alias("vote"))


# F18 on fixed scores: rows above the 95th percentile of the score.
register("percentile_cut", """{LE}
, s AS (SELECT user_id, {LOGISTIC} AS score FROM uf), c AS (SELECT quantile_disc(score, 0.95) AS cut FROM s)
SELECT user_id, CAST(score > cut AS INTEGER) AS outlier FROM s, c""".replace("{LE}", SQ.with_le(UF_SQL)).replace("{LOGISTIC}", SQ.logistic("failed_count")), FAM)(
    lambda spark, d: IF.cut_flags(_fixed_scores(spark, d), _fixed_scores(spark, d), "score", 0.05, "outlier").select("user_id", "outlier"))

# T7 and S11 on fixed scores.
register("top_risk_fixed", SQ.with_le(UF_SQL) + f"""
SELECT user_id, round({SQ.logistic("failed_count")}, 6) AS score, is_attack_ip FROM uf
ORDER BY failed_count DESC, user_id ASC LIMIT 100""", FAM)(
    lambda spark, d: A.top_k(_fixed_scores(spark, d), 100, col="failed_count").select("user_id", F.round("score", 6).alias("score"), "is_attack_ip"))

register("unsupervised_publish_fixed", SQ.with_le(UF_SQL) + f"""
, v AS (SELECT user_id, {SQ.stump("failed_count")} AS vote, is_attack_ip FROM uf)
SELECT user_id, vote AS iso_pred, CASE WHEN CAST(user_id AS BIGINT) % 3 = 0 THEN 0 ELSE 1 - vote END AS lof_pred, is_attack_ip FROM v""", FAM)(
    lambda spark, d: (lambda s: SK.publish_unsupervised(
        s.select("user_id", F.col("vote").alias("iso_pred"), "is_attack_ip").join(
            s.where(F.col("user_id").cast("bigint") % 3 != 0).select("user_id", (1 - F.col("vote")).alias("lof_pred")), "user_id", "full_outer")))(
        _fixed_scores(spark, d)))


def _unsup(spark, d):
    feats = _six_trained(spark, d)
    tidy(spark)
    iso = _iforest(spark, d, feats).select("user_id", "iso_pred", "is_attack_ip")
    tidy(spark)
    lof = _lof(spark, d, feats).select("user_id", "lof_pred")
    return SK.publish_unsupervised(iso.join(lof, "user_id", "full_outer"))


register("unsupervised_publish", None, FAM)(_unsup)


def _unsup_metrics(spark, d):
    return EV.metrics(EV.confusion(_unsup(spark, d), "is_attack_ip", ["iso_pred", "lof_pred"]))


register("unsupervised_metrics", None, FAM)(_unsup_metrics)


def _top_risk(spark, d):
    return A.top_k(_iforest(spark, d, _six_trained(spark, d)), 100, col="if_score")


register("top_risk_targets", None, FAM)(_top_risk)


def _cert_trials(spark, d):
    train, test = _split(spark, d)
    return T.supervised_trials(M.smote(train, FEATS), test, "cert")


register("hyperparameter_trials", None, FAM)(_cert_trials)


def _cert_unsupervised(spark, d):
    rows = _six_trained(spark, d)
    return T.unsupervised_trials(rows.where("split = 'train'").drop("split"), rows.drop("split"), "cert", SIX)


register("unsupervised_trials", None, FAM)(_cert_unsupervised)


def _cert_boosting(spark, d):
    """On the meta model's 17 inputs, the base probabilities among them."""
    rows = M.materialise(FT.split_flag(_meta_inputs(spark, d), seed=7))
    return T.boosting_trials(rows.where("split = 'train'"), rows.where("split = 'test'"), "cert", META_FEATURES)


register("boosting_trials", None, FAM)(_cert_boosting)


def _linux_trials(spark, d):
    rows = M.materialise(FT.split_flag(_linux_aug(spark, d)))
    train, test = rows.where("split = 'train'").drop("split"), rows.where("split = 'test'").drop("split")
    fit_on = M.smote(train, FEATS)
    return T.supervised_trials(fit_on, test, "linux").unionByName(T.boosting_trials(fit_on, test, "linux")) \
        .unionByName(T.unsupervised_trials(train, test, "linux"))


register("linux_trials", None, FAM)(_linux_trials)


def _meta_comparison(spark, d):
    """The meta-model block of the metrics comparison: the top-100 stored
    results by failed count, exact ``meta_pred`` and the DP variant
    (Laplace b = 1/250 on ``meta_prob``, re-thresholded at 0.1)."""
    top = A.top_k(_meta(spark, d), 100, col="failed_count")
    dp = SC.dp_probability(top, "meta_prob", 42, "meta|latest", 250.0, 0.1).withColumnRenamed("noisy_pred", "meta_dp_pred")
    return EV.metrics(EV.confusion(dp, "is_attack_ip", ["meta_pred", "meta_dp_pred"]))


register("meta_metrics_comparison", None, FAM)(_meta_comparison)


def _linux_evaluation(spark, d):
    """The Linux auth-log evaluation, computed honestly: per-IP features with
    overlap noise, 70/30 split, SMOTE, then LR (balanced), RF (100 trees,
    depth 3, balanced), RF+LR stacking, isolation forest (contamination =
    attack share, fit on the test rows as the reference does) and novelty
    LOF (fit on train); every model also with randomised-response flips."""
    feats = _linux_aug(spark, d)
    contamination = EV.contamination(feats).first()[0]
    split = M.materialise(FT.split_flag(feats))
    train, test = split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split")
    fit_on = M.smote(train, FEATS)
    lr, rf = M.parallel(lambda job: job(), [lambda: M.fit_logistic(fit_on, FEATS),
                                            lambda: M.fit_forest(fit_on, FEATS, n_trees=100, max_depth=3)])
    scored = M.predict_proba(rf, M.predict_proba(lr, test, FEATS, "lr"), FEATS, "rf")
    stack = M.stacking(fit_on, test, FEATS).select("user_id", "stack_pred")
    iso = IF.isolation_forest(test, test, FEATS, contamination=contamination).select("user_id", "iso_pred")
    lof = LOF.lof_scores(train, test, "user_id", FEATS, k=20, contamination=contamination) \
        .select("user_id", "lof_pred")
    allp = scored.join(stack, "user_id").join(iso, "user_id").join(lof, "user_id")
    preds = ["lr_pred", "rf_pred", "stack_pred", "iso_pred", "lof_pred"]
    for p in preds:
        allp = SC.flip_predictions(allp, p, 42, 0.0003, out_col=p.replace("_pred", "_dp_pred"))
    names = preds + [p.replace("_pred", "_dp_pred") for p in preds]
    return EV.metrics(EV.confusion(allp, "is_attack_ip", names))


register("linux_evaluation", None, FAM)(_linux_evaluation)


def _unsup_report(spark, d):
    return EV.classification_report(EV.confusion(_unsup(spark, d), "is_attack_ip", ["iso_pred", "lof_pred"]))


register("unsupervised_report", None, FAM)(_unsup_report)


def _meta_report(spark, d):
    meta = _meta_scored(spark, d).where("split = 'test'").withColumn("meta_pred_05", (F.col("meta_prob") >= 0.5).cast("int"))
    return EV.classification_report(EV.confusion(meta, "is_attack_ip", ["meta_pred_05", "meta_pred"]))


register("meta_classification_report", None, FAM)(_meta_report)


def _metrics_comparison(spark, d):
    """The whole metrics comparison, every block computed (none literal):
    rule / DP / fixed-model detectors on the top-100 users, the meta model
    and its DP variant on the stored results, and the Linux evaluation,
    merged by model name (J5; a later table wins on a clash)."""
    from gatewatch.operators import anomaly as N

    rules = EV.metrics(EV.confusion(N.detector_flags(login_events(spark, d), 100, 42), "is_attack_ip", N.DETECTORS))
    meta = _meta_comparison(spark, d)
    linux = _linux_evaluation(spark, d).withColumn("detector", F.concat(F.lit("linux_"), F.col("detector")))
    return EV.merge_metrics(rules, meta, linux)


register("metrics_comparison", None, FAM)(_metrics_comparison)
