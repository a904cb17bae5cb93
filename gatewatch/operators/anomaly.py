"""Rule detectors and DP releases of per-user counts.

Noise is a projection *above* the aggregate, so a raw count is never an
output column of a DP operator. Global statistics (mean / population sd)
are a one-row aggregate cross-joined as a broadcast: the broadcast side is
provably one row regardless of data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch.functions.noise import gaussian_noise, laplace_noise, release_stream, std_normal
from gatewatch.functions.scalar import half_up
from gatewatch.operators import audit as A
from gatewatch.operators.releases import epoch_us, log_state, row_digest, state_of
from gatewatch.operators.scoring import logistic_score, stump_vote

USER = A.USER


def zscore_flags(counts: DataFrame, threshold: float, top_n: int | None = None,
                 col: str = "count") -> DataFrame:
    """Population-sd z-score, z = 0 when sd = 0, flag ``|z| >= t``.

    ``top_n`` restricts both the rows and the statistics to the top-N by
    count first (the RBA variant computes mean/sd over the top rows only)."""
    base = A.top_k(counts, top_n, col=col) if top_n else counts
    stats = base.agg(F.avg(col).alias("gw_mean"), F.stddev_pop(col).alias("gw_sd"))
    z = F.when(F.col("gw_sd").isNull() | (F.col("gw_sd") == 0), F.lit(0.0)) \
        .otherwise((F.col(col) - F.col("gw_mean")) / F.col("gw_sd"))
    return (base.crossJoin(F.broadcast(stats))
            .withColumn("gw_z", z)
            .select(USER, col, F.col("gw_z").alias("zscore"),
                    (F.abs(F.col("gw_z")) >= F.lit(float(threshold))).alias("anomalous")))


def dp_counts(counts: DataFrame, epsilon: float, seed, release: str, col: str = "count") -> DataFrame:
    """Half-up rounded Laplace-noised count per user. ``release`` names
    what is released (statistic, window, as-of): with the epsilon it is part
    of the draw, so the noise of two releases never cancels."""
    noisy = half_up(F.col(col) + laplace_noise(USER, epsilon, seed, release_stream("laplace", release, epsilon)))
    return counts.select(USER, noisy.alias("noisy_count"))


def dp_gaussian_counts(counts: DataFrame, epsilon: float, delta: float, seed, release: str,
                       col: str = "count") -> DataFrame:
    """P2 applied to counts: half-up rounded Gaussian-noised count."""
    noisy = half_up(F.col(col) + gaussian_noise(USER, epsilon, delta, seed, release_stream("gaussian", release, epsilon)))
    return counts.select(USER, noisy.alias("noisy_count"))


def dp_threshold(counts: DataFrame, epsilon: float, threshold, seed, release: str,
                 col: str = "count") -> DataFrame:
    """P5: noisy count and ``noisy >= t`` flag."""
    return dp_counts(counts, epsilon, seed, release, col).withColumn(
        "anomalous", F.col("noisy_count") >= F.lit(threshold))


def dp_recent(le: DataFrame, epsilon: float, threshold, width: str, seed, as_of: str | None = None,
              logons: bool = False, all_activity: bool = False) -> DataFrame:
    """P5 over the max-anchored recent window (A3 or A4). The state of the
    log is part of the draw: derived from the log (``releases.log_state``), or
    named by ``as_of``. Either way another state is another release, so the
    noise of today's and yesterday's does not cancel."""
    counts = (A.recent_logons_per_user(le, width, all_activity) if logons
              else A.recent_failed_per_user(le, width))
    what = ("activity" if all_activity else "logons") if logons else "failed"
    if as_of is not None:
        return dp_threshold(counts, epsilon, threshold, seed, f"{what}|{width}|{as_of}")
    noise = laplace_noise([USER, "gw_state"], epsilon, seed, release_stream("laplace", f"{what}|{width}", epsilon))
    return counts.crossJoin(F.broadcast(log_state(le))).select(USER, half_up(F.col("count") + noise).alias("noisy_count")) \
        .withColumn("anomalous", F.col("noisy_count") >= F.lit(threshold))


def detector_flags(le: DataFrame, limit: int, seed, ml_epsilon: float = 1.0, as_of: str | None = None) -> DataFrame:
    """P9 + fixed scorers: per top-``limit`` user, every detector's flag.

    Laplace (b=1) >= 3 / >= 5 / >= 10 share one draw; Gaussian (sd=1) >= 3;
    z-score >= 2 with mean/sd over the top-``limit`` failed counts; the
    fixed logistic and stump models on the exact count and on a separate
    Laplace(eps=``ml_epsilon``) draw. The state of the log is part of every
    draw: derived from the log, or named by ``as_of``. The log is read once,
    by one aggregate per user that is written and cut twice."""
    act = A.written_activity(le, latest=F.max(epoch_us()), digest=F.sum(row_digest()))
    joined = A.users_with_failed_from(act, limit)
    failed_top = A.top_failed_from(act, limit)
    stats = failed_top.agg(F.avg("count").alias("gw_mean"), F.stddev_pop("count").alias("gw_sd"))
    state = act.agg(state_of(F.max("latest"), F.sum("total"), F.sum("digest")).alias("gw_state")) if as_of is None else \
        le.sparkSession.createDataFrame([(as_of,)], "gw_state string")
    cnt, key = F.col("count").cast("double"), [USER, "gw_state"]
    lap = cnt + laplace_noise(key, 1.0, seed, release_stream("detectors.laplace", "failed", 1.0))
    gau = cnt + std_normal(key, seed, release_stream("detectors.gaussian", "failed", 1.0))
    z = F.when(F.col("gw_sd").isNull() | (F.col("gw_sd") == 0), F.lit(0.0)) \
        .otherwise((cnt - F.col("gw_mean")) / F.col("gw_sd"))
    dp_cnt = cnt + laplace_noise(key, ml_epsilon, seed, release_stream("detectors.ml", "failed", ml_epsilon))
    return (joined.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(state))
            .select(USER, F.col("is_attack_ip"),
                    (lap >= 3).alias("laplace_anomaly"),
                    (gau >= 3).alias("gaussian_anomaly"),
                    (F.abs(z) >= 2).alias("zscore_anomaly"),
                    (lap >= 5).alias("anomaly_detection_5"),
                    (lap >= 10).alias("anomaly_detection_10"),
                    (logistic_score([cnt]) >= 0.5).alias("logreg_pred"),
                    (stump_vote(cnt) == 1).alias("rf_pred"),
                    (logistic_score([dp_cnt]) >= 0.5).alias("logreg_dp_pred"),
                    (stump_vote(dp_cnt) == 1).alias("rf_dp_pred")))


DETECTORS = ["laplace_anomaly", "gaussian_anomaly", "zscore_anomaly", "anomaly_detection_5",
             "anomaly_detection_10", "logreg_pred", "rf_pred", "logreg_dp_pred", "rf_dp_pred"]
