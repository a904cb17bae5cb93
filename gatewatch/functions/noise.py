"""Deterministic, partition-independent randomness and DP noise.

``rand()`` depends on partitioning and may be re-drawn when a stage is
retried after an executor loss, which would release two different noisy
answers for one query. Every draw here is a keyed hash instead:

    U = (int(sha256(seed | stream | key)[0:13], 16) + 0.5) / 2**52

so a draw depends only on (seed, stream, key), survives retries, and is
reproducible in the SQL oracle. ``U`` lies strictly inside (0, 1).
The seed is a secret that every release takes as an argument, and what is
released (``release_stream``) is part of the draw, so the noise of two
releases of overlapping data is independent and does not cancel.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2 ** 52)


def _cols(keys) -> list[Column]:
    if isinstance(keys, (str, Column)):
        keys = [keys]
    return [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]


def uniform_bits(keys, seed, stream: str | None = None) -> Column:
    """The 52 bits of the draw, as a bigint."""
    parts = [F.lit(str(seed))]
    if stream is not None:
        parts.append(F.lit(str(stream)))
    parts += _cols(keys)
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint")


def uniform(keys, seed, stream: str | None = None) -> Column:
    return (uniform_bits(keys, seed, stream).cast("double") + F.lit(0.5)) / F.lit(TWO_52)


def release_stream(mechanism: str, release: str, epsilon: float) -> str:
    """The draw of one release: mechanism, what is released, privacy budget."""
    return f"{mechanism}|{release}|{float(epsilon)!r}"


def laplace_noise(keys, epsilon, seed, stream: str = "laplace",
                  sensitivity: float = 1.0) -> Column:
    """``b * sign(u) * ln(1 - 2|u|)`` with ``u = 0.5 - U`` and ``b = s/eps``."""
    if not isinstance(epsilon, Column):
        _validate_eps(epsilon)
    u = F.lit(0.5) - uniform(keys, seed, stream)
    b = F.lit(float(sensitivity)) / (epsilon if isinstance(epsilon, Column) else F.lit(float(epsilon)))
    return b * F.signum(u) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(u))


def std_normal(keys, seed, stream: str = "normal") -> Column:
    """Box-Muller on two independent hash draws."""
    u1 = uniform(keys, seed, f"{stream}.1")
    u2 = uniform(keys, seed, f"{stream}.2")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def gaussian_sigma(epsilon: float, delta: float, sensitivity: float = 1.0) -> float:
    """Classic Gaussian mechanism scale (proved for eps < 1)."""
    if not (epsilon > 0 and 0 < delta < 1):
        raise ValueError("need epsilon > 0 and 0 < delta < 1")
    return math.sqrt(2.0 * math.log(1.25 / delta)) * sensitivity / epsilon


def gaussian_noise(keys, epsilon: float, delta: float, seed,
                   stream: str = "gaussian", sensitivity: float = 1.0) -> Column:
    return std_normal(keys, seed, stream) * F.lit(gaussian_sigma(epsilon, delta, sensitivity))


def noisy_display(value, keys, epsilon: float, seed, method: str = "laplace",
                  delta: float = 1e-5, cap: int = 200000) -> Column:
    """Display-only noise: the scale ``clamp(v/1000, 1, 10)`` depends on the
    value itself, so this is *not* an eps-DP release. Half-up rounded and
    clamped to ``[0, cap]``."""
    from gatewatch.functions.scalar import clamp, half_up

    v = F.col(value) if isinstance(value, str) else value
    scale = clamp(v / F.lit(1000.0), 1.0, 10.0)
    if method == "gaussian":
        noise = std_normal(keys, seed, "display.gaussian") * F.lit(gaussian_sigma(epsilon, delta)) * scale
    else:
        u = F.lit(0.5) - uniform(keys, seed, "display.laplace")
        noise = (scale / F.lit(float(epsilon))) * F.signum(u) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(u))
    return clamp(half_up(v + noise), 0, cap)


def _validate_eps(eps: float) -> None:
    if eps <= 0:
        raise ValueError("epsilon must be > 0")


def hmac_blocks(key: bytes) -> tuple[str, str]:
    """RFC 2104 inner/outer padded key blocks (hex) for SHA-256."""
    import hashlib

    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\x00")
    ipad = bytes(b ^ 0x36 for b in key).hex()
    opad = bytes(b ^ 0x5C for b in key).hex()
    return ipad, opad


def pseudonymise(df, col: str, key: bytes, out_col: str | None = None):
    """HMAC-SHA256 hex of ``col`` (F15), fully native.

    The padded key blocks travel in a one-row broadcast table rather than
    as literals, so the key does not appear in plan text / event logs.
    One key per run keeps tokens joinable across datasets.
    """
    ipad, opad = hmac_blocks(key)
    spark = df.sparkSession
    pads = spark.createDataFrame([(ipad, opad)], "gw_ipad string, gw_opad string").select(
        F.unhex("gw_ipad").alias("gw_ipad"), F.unhex("gw_opad").alias("gw_opad"))
    inner = F.sha2(F.concat(F.col("gw_ipad"), F.encode(F.col(col), "UTF-8")), 256)
    token = F.sha2(F.concat(F.col("gw_opad"), F.unhex(inner)), 256)
    out = out_col or col
    cols = [token.alias(out) if c == out else F.col(c) for c in df.columns]
    if out not in df.columns:
        cols.append(token.alias(out))
    return df.crossJoin(F.broadcast(pads)).select(*cols)
