"""Catalog: z-score, fixed scorers, score noise, detector flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewatch.operators import anomaly as N
from gatewatch.operators import audit as A
from gatewatch.operators import scoring as SC
from gatewatch.plans import sqlgen as S
from gatewatch.plans.catalog import register
from gatewatch.plans.sqlgen import FAILED, LOGONS, with_le
from gatewatch.sources import login_events

FAM = "detect"


def _r6(df, *cols):
    """Doubles to six places, for the comparison only."""
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _z_sql(base_cte: str, t: float, top: int | None = None) -> str:
    src = "c" if top is None else "b"
    extra = "" if top is None else f", b AS (SELECT * FROM c ORDER BY count DESC, user_id ASC LIMIT {top})"
    return with_le(base_cte) + extra + f"""
, s AS (SELECT avg(count) AS m, stddev_pop(count) AS sd FROM {src})
, z AS (SELECT user_id, count, CASE WHEN sd IS NULL OR sd = 0 THEN 0.0 ELSE (count - m) / sd END AS z
        FROM {src}, s)
SELECT user_id, count, round(z, 6) AS zscore, abs(z) >= {float(t)} AS anomalous FROM z"""


register("zscore_flags", _z_sql(FAILED, 2.0), FAM)(
    lambda spark, d: _r6(N.zscore_flags(A.failed_per_user(login_events(spark, d)), 2.0), "zscore"))
register("zscore_logons", _z_sql(LOGONS, 1.5), FAM)(
    lambda spark, d: _r6(N.zscore_flags(A.logons_per_user(login_events(spark, d)), 1.5), "zscore"))
register("top_zscore", _z_sql(FAILED, 1.5, 50), FAM)(
    lambda spark, d: _r6(N.zscore_flags(A.failed_per_user(login_events(spark, d)), 1.5, top_n=50), "zscore"))

register("fixed_logistic", with_le(FAILED) + f"""
SELECT user_id, CAST(count AS DOUBLE) AS failed_count, round({S.logistic('count')}, 6) AS prob_attack,
       {S.logistic('count')} >= 0.5 AS predicted_attack FROM c""", FAM)(
    lambda spark, d: _r6(SC.fixed_logistic(A.failed_per_user(login_events(spark, d))), "prob_attack"))

register("fixed_stumps", with_le(FAILED) + f"""
SELECT user_id, CAST(count AS DOUBLE) AS failed_count, {S.stump('count')} = 1 AS predicted_attack FROM c""", FAM)(
    lambda spark, d: SC.fixed_stumps(A.failed_per_user(login_events(spark, d))))


def _noisy_sql(method: str) -> str:
    if method == "gaussian":
        return f"(count + {S.std_normal('user_id', 42, 'score.gaussian|failed|all|1.0')} * sqrt(2.0 * ln(1.25 / 0.00001)))"
    return f"(count + {S.laplace('user_id', 1.0, 42, 'score.laplace|failed|all|1.0')})"


for _m in ("laplace", "gaussian"):
    _x = _noisy_sql(_m)
    register(f"dp_logistic_{_m}", with_le(FAILED) + f"""
, n AS (SELECT user_id, {_x} AS x FROM c)
SELECT user_id, round(x, 6) AS failed_count_noisy, round({S.logistic('x')}, 6) AS prob_attack,
       {S.logistic('x')} >= 0.5 AS predicted_attack FROM n""", FAM)(
        (lambda m: lambda spark, d: _r6(SC.dp_logistic(A.failed_per_user(login_events(spark, d)), 42, "failed|all", m), "failed_count_noisy", "prob_attack"))(_m))
    register(f"dp_stumps_{_m}", with_le(FAILED) + f"""
, n AS (SELECT user_id, {_x} AS x FROM c)
SELECT user_id, round(x, 6) AS failed_count_noisy, {S.stump('x')} = 1 AS predicted_attack FROM n""", FAM)(
        (lambda m: lambda spark, d: _r6(SC.dp_stumps(A.failed_per_user(login_events(spark, d)), 42, "failed|all", m), "failed_count_noisy"))(_m))


def _scores(spark, d):
    return SC.fixed_logistic(A.failed_per_user(login_events(spark, d)))


register("dp_probability", with_le(FAILED) + f"""
, p AS (SELECT user_id, CAST(count AS DOUBLE) AS failed_count, {S.logistic('count')} AS prob_attack,
               {S.logistic('count')} >= 0.5 AS predicted_attack FROM c)
, n AS (SELECT *, prob_attack + {S.laplace('user_id', 250.0, 42, 'prob.laplace|failed|all|250.0')} AS np FROM p)
SELECT user_id, failed_count, round(prob_attack, 6) AS prob_attack, predicted_attack, round(np, 6) AS noisy_prob,
       CAST(np >= 0.1 AS INTEGER) AS noisy_pred FROM n""", FAM)(
    lambda spark, d: _r6(SC.dp_probability(_scores(spark, d), "prob_attack", 42, "failed|all", 250.0, 0.1),
                               "prob_attack", "noisy_prob"))

register("flip_predictions", with_le(FAILED) + f"""
, p AS (SELECT user_id, {S.stump('count')} AS pred FROM c)
SELECT user_id, CAST(CASE WHEN {S.uniform('user_id', 42, 'flip|pred|0.3')} < 0.3 THEN 1 - pred ELSE pred END AS INTEGER) AS pred
FROM p""", FAM)(
    lambda spark, d: SC.flip_predictions(
        A.failed_per_user(login_events(spark, d)).select("user_id", SC.stump_vote("count").alias("pred")),
        "pred", 42, p=0.3))

_EPS = (50.0, 100.0, 150.0, 200.0, 300.0, 400.0)
_EPS_VALUES = ", ".join(f"({i}, {e!r})" for i, e in enumerate(_EPS))


def _fliprate_sql() -> str:
    key = "concat_ws('|', user_id, CAST(eps_idx AS VARCHAR))"
    u = f"(0.5 - {S.uniform(key, 42, 'fliprate')})"
    return with_le(FAILED) + f"""
, p AS (SELECT user_id, {S.logistic('count')} AS prob_attack FROM c)
, e AS (SELECT * FROM (VALUES {_EPS_VALUES}) t(eps_idx, epsilon))
, x AS (SELECT epsilon, CAST(((prob_attack + (1.0 / epsilon) * sign({u}) * ln(1.0 - 2.0 * abs({u}))) >= 0.1)
                              <> (prob_attack >= 0.1) AS INTEGER) AS flip
        FROM p, e)
SELECT CAST(epsilon AS DOUBLE) AS epsilon, COUNT(*) AS n, CAST(SUM(flip) AS BIGINT) AS flips,
       round(AVG(flip), 6) AS flip_rate FROM x GROUP BY epsilon"""


register("noise_flip_rate", _fliprate_sql(), FAM)(
    lambda spark, d: _r6(SC.noise_flip_rate(_scores(spark, d), "prob_attack", _EPS, 0.1, 42), "flip_rate"))


def flags_ctes(limit: int = 100, sfx: str = "") -> str:
    """CTEs (after the ``le`` adapter) ending in ``fl{sfx}``: per top-N user,
    every detector flag."""
    key = f"concat_ws('|', {'j' + sfx}.user_id, gw_state)"
    lap = S.laplace(key, 1.0, 42, "detectors.laplace|failed|1.0")
    gau = S.std_normal(key, 42, "detectors.gaussian|failed|1.0")
    ml = S.laplace(key, 1.0, 42, "detectors.ml|failed|1.0")
    u, f, s, j, x = (n + sfx for n in ("u", "f", "s", "j", "x"))
    return f"""{S.state_cte(name="st" + sfx)},
{u} AS (SELECT user_id, COUNT(*) AS total, COALESCE(BOOL_OR(is_attack), false) AS is_attack_ip
      FROM le GROUP BY user_id ORDER BY total DESC, user_id ASC LIMIT {limit}),
{f} AS (SELECT user_id, COUNT(*) AS count FROM le WHERE NOT success GROUP BY user_id
      ORDER BY count DESC, user_id ASC LIMIT {limit}),
{s} AS (SELECT avg(count) AS m, stddev_pop(count) AS sd FROM {f}),
{j} AS (SELECT {u}.user_id, {u}.is_attack_ip, CAST(COALESCE({f}.count, 0) AS DOUBLE) AS cnt
        FROM {u} LEFT JOIN {f} ON {u}.user_id = {f}.user_id),
{x} AS (SELECT {j}.*, cnt + {lap} AS lap, cnt + {gau} AS gau,
               CASE WHEN {s}.sd IS NULL OR {s}.sd = 0 THEN 0.0 ELSE (cnt - {s}.m) / {s}.sd END AS z,
               cnt + {ml} AS dpc
        FROM {j}, {s}, st{sfx}),
fl{sfx} AS (SELECT user_id, is_attack_ip, lap >= 3 AS laplace_anomaly, gau >= 3 AS gaussian_anomaly,
       abs(z) >= 2 AS zscore_anomaly, lap >= 5 AS anomaly_detection_5, lap >= 10 AS anomaly_detection_10,
       {S.logistic('cnt')} >= 0.5 AS logreg_pred, {S.stump('cnt')} = 1 AS rf_pred,
       {S.logistic('dpc')} >= 0.5 AS logreg_dp_pred, {S.stump('dpc')} = 1 AS rf_dp_pred
FROM {x})"""


def _flags_sql(limit: int = 100) -> str:
    return with_le(flags_ctes(limit)) + "SELECT * FROM fl"


register("detector_flags", _flags_sql(100), FAM)(
    lambda spark, d: N.detector_flags(login_events(spark, d), 100, 42))
