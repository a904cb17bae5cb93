"""Fixed-parameter scorers and score-level noise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewatch.functions.noise import gaussian_noise, laplace_noise, release_stream, uniform

# Fixed values that must equal the reference's shipped "pre-trained" models.
# Logistic weights: bias, then failed_count, login_freq, unique_ips, 4th feature.
LOGISTIC_WEIGHTS = (-5.0, 0.5, 0.2, 0.1, 0.05)
# Stumps on feature 0: (threshold, class if <= threshold, class if > threshold).
STUMP_TREES = ((9.0, 0, 1), (25.0, 0, 1), (11.0, 1, 0))

USER = "user_id"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def logistic_score(features: Sequence, weights: Sequence[float] = LOGISTIC_WEIGHTS) -> Column:
    """F16: ``sigmoid(w0 + sum w_i x_i)``; absent features count as 0."""
    z = F.lit(float(weights[0]))
    for w, x in zip(weights[1:], features):
        z = z + F.lit(float(w)) * _c(x).cast("double")
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def stump_vote(x, trees=STUMP_TREES) -> Column:
    """majority vote of threshold stumps on one feature; a tie goes to
    the smaller class (0)."""
    v = _c(x)
    ones = sum((F.when(v <= F.lit(float(t)), F.lit(le)).otherwise(F.lit(gt)) for t, le, gt in trees),
               F.lit(0))
    return F.when(ones * 2 > F.lit(len(trees)), F.lit(1)).otherwise(F.lit(0))


def fixed_logistic(counts: DataFrame, col: str = "count") -> DataFrame:
    p = logistic_score([F.col(col)])
    return counts.select(USER, F.col(col).cast("double").alias("failed_count"),
                         p.alias("prob_attack"), (p >= 0.5).alias("predicted_attack"))


def fixed_stumps(counts: DataFrame, col: str = "count") -> DataFrame:
    return counts.select(USER, F.col(col).cast("double").alias("failed_count"),
                         (stump_vote(F.col(col)) == 1).alias("predicted_attack"))


def _noisy(col: str, method: str, epsilon: float, delta: float, seed, release: str) -> Column:
    stream = release_stream(f"score.{method}", release, epsilon)
    if method == "gaussian":
        return F.col(col) + gaussian_noise(USER, epsilon, delta, seed, stream)
    return F.col(col) + laplace_noise(USER, epsilon, seed, stream)


def dp_logistic(counts: DataFrame, seed, release: str, method: str = "laplace", epsilon: float = 1.0,
                delta: float = 1e-5, col: str = "count") -> DataFrame:
    """Unrounded noisy count -> fixed logistic -> ``p >= 0.5``."""
    noisy = _noisy(col, method, epsilon, delta, seed, release)
    p = logistic_score([noisy])
    return counts.select(USER, noisy.alias("failed_count_noisy"),
                         p.alias("prob_attack"), (p >= 0.5).alias("predicted_attack"))


def dp_stumps(counts: DataFrame, seed, release: str, method: str = "laplace", epsilon: float = 1.0,
              delta: float = 1e-5, col: str = "count") -> DataFrame:
    """Unrounded noisy count -> stump vote."""
    noisy = _noisy(col, method, epsilon, delta, seed, release)
    return counts.select(USER, noisy.alias("failed_count_noisy"),
                         (stump_vote(noisy) == 1).alias("predicted_attack"))


def dp_probability(scores: DataFrame, prob_col: str, seed, release: str, epsilon: float = 250.0,
                   threshold: float = 0.1, key: str = USER) -> DataFrame:
    """P10: Laplace(b = 1/eps) on a probability, re-thresholded."""
    noisy = F.col(prob_col) + laplace_noise(key, epsilon, seed, release_stream("prob.laplace", release, epsilon))
    return scores.withColumn("noisy_prob", noisy) \
        .withColumn("noisy_pred", (noisy >= F.lit(threshold)).cast("int"))


def flip_predictions(df: DataFrame, pred_col: str, seed, p: float = 0.0003, key: str = USER,
                     out_col: str | None = None) -> DataFrame:
    """Randomised response -- flip each 0/1 prediction independently
    with probability ``p`` (eps = ln((1-p)/p)); each prediction column has
    its own draw."""
    flipped = F.when(uniform(key, seed, release_stream("flip", pred_col, p)) < F.lit(p), F.lit(1) - F.col(pred_col)) \
        .otherwise(F.col(pred_col))
    return df.withColumn(out_col or pred_col, flipped.cast("int"))


def noise_flip_rate(scores: DataFrame, prob_col: str, epsilons: Sequence[float],
                    threshold: float, seed, key: str = USER) -> DataFrame:
    """Share of scored rows whose ``>= t`` decision changes under P10,
    per epsilon. The epsilon list is a literal array exploded per row (a
    Generate, not a join); one aggregate per epsilon."""
    eps_arr = F.array(*[F.lit(float(e)) for e in epsilons])
    exploded = scores.select(key, prob_col, F.posexplode(eps_arr).alias("eps_idx", "epsilon"))
    b = F.lit(1.0) / F.col("epsilon")
    u = F.lit(0.5) - uniform([F.col(key), F.col("eps_idx")], seed, "fliprate")
    noisy = F.col(prob_col) + b * F.signum(u) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(u))
    flip = ((noisy >= threshold) != (F.col(prob_col) >= threshold)).cast("int")
    return (exploded.withColumn("flip", flip)
            .groupBy("epsilon")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("flip").cast("bigint").alias("flips"),
                 F.avg("flip").alias("flip_rate")))
