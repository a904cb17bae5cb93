"""Catalog: keyed-hash randomness, DP releases, pseudonyms."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewatch.functions.noise import noisy_display, pseudonymise, uniform
from gatewatch.operators import anomaly as N
from gatewatch.operators import audit as A
from gatewatch.operators import releases as RL
from gatewatch.plans import sqlgen as S
from gatewatch.plans.catalog import register
from gatewatch.plans.sqlgen import FAILED, LOGONS, with_le
from gatewatch.session import scratch_path
from gatewatch.sources import login_events

FAM = "privacy"
DEMO_KEY = b"gatewatch-demo-hmac-key-32bytes!"

register("hash_uniform", with_le() + f"""
SELECT event_id, round({S.uniform('event_id', 42, 'u')}, 9) AS u FROM le""", FAM)(
    lambda spark, d: login_events(spark, d).select(
        "event_id", F.round(uniform("event_id", 42, "u"), 9).alias("u")))

register("dp_failed_counts", with_le(FAILED) + f"""
SELECT user_id, {S.half_up('count + ' + S.laplace('user_id', 0.5, 42, 'laplace|failed|all|0.5'))} AS noisy_count FROM c""", FAM)(
    lambda spark, d: N.dp_counts(A.failed_per_user(login_events(spark, d)), 0.5, 42, "failed|all"))

register("dp_gaussian_counts", with_le(FAILED) + f"""
SELECT user_id, {S.half_up('count + ' + S.std_normal('user_id', 42, 'gaussian|failed|all|0.5') + ' * (sqrt(2.0 * ln(1.25 / 0.00001)) / 0.5)')} AS noisy_count FROM c""", FAM)(
    lambda spark, d: N.dp_gaussian_counts(A.failed_per_user(login_events(spark, d)), 0.5, 1e-5, 42, "failed|all"))

register("dp_threshold", with_le(FAILED) + f"""
, n AS (SELECT user_id, {S.half_up('count + ' + S.laplace('user_id', 1.0, 42, 'laplace|failed|all|1.0'))} AS noisy_count FROM c)
SELECT user_id, noisy_count, noisy_count >= 12 AS anomalous FROM n""", FAM)(
    lambda spark, d: N.dp_threshold(A.failed_per_user(login_events(spark, d)), 1.0, 12, 42, "failed|all"))

register("dp_logon_threshold", with_le(LOGONS) + f"""
, n AS (SELECT user_id, {S.half_up('count + ' + S.laplace('user_id', 1.0, 42, 'laplace|logons|all|1.0'))} AS noisy_count FROM c)
SELECT user_id, noisy_count, noisy_count >= 30 AS anomalous FROM n""", FAM)(
    lambda spark, d: N.dp_threshold(A.logons_per_user(login_events(spark, d)), 1.0, 30, 42, "logons|all"))

def _recent_sql(what: str, width: str, epsilon: float, rel: str = "le", sfx: str = "") -> str:
    """CTEs up to ``n``: the noisy recent counts of one state of the log."""
    rows = "NOT success" if what == "failed" else "activity = 'Logon'"
    noise = S.laplace("concat_ws('|', user_id, gw_state)", epsilon, 42, f"laplace|{what}|{width}|{epsilon}")
    return f"""c{sfx} AS (SELECT user_id, COUNT(*) AS count FROM {rel}
      WHERE {rows} AND event_time >= (SELECT MAX(event_time) FROM {rel}) - INTERVAL {width} GROUP BY user_id),
{S.state_cte(rel, "st" + sfx)},
n{sfx} AS (SELECT user_id, count, {S.half_up('count + ' + noise)} AS noisy_count FROM c{sfx}, st{sfx})"""


register("dp_recent_failed", with_le(_recent_sql("failed", "7 days", 1.0)) + """
SELECT user_id, noisy_count, noisy_count >= 4 AS anomalous FROM n""", FAM)(
    lambda spark, d: N.dp_recent(login_events(spark, d), 1.0, 4, "7 days", 42))

register("dp_recent_logons", with_le(_recent_sql("logons", "7 days", 2.0)) + """
SELECT user_id, noisy_count, noisy_count >= 7 AS anomalous FROM n""", FAM)(
    lambda spark, d: N.dp_recent(login_events(spark, d), 2.0, 7, "7 days", 42, logons=True))


def _day_before(le):
    """The log as it was a day before its latest event."""
    latest = le.agg(F.max("event_time").alias("gw_latest"))
    return le.crossJoin(F.broadcast(latest)).where(F.expr("event_time < gw_latest - INTERVAL 1 DAY")).drop("gw_latest")


def _state_difference(spark, d):
    """Noisy and exact change of the recent failures of a user between two states of the log."""
    le = login_events(spark, d)
    sides = []
    for name, log in (("now", le), ("before", _day_before(le))):
        counts = A.recent_failed_per_user(log, "7 days").withColumnRenamed("count", f"exact_{name}")
        noisy = N.dp_recent(log, 1.0, 4, "7 days", 42).select("user_id", F.col("noisy_count").alias(f"noisy_{name}"))
        sides.append(counts.join(noisy, "user_id"))
    both = sides[0].join(sides[1], "user_id")
    noisy, exact = F.col("noisy_now") - F.col("noisy_before"), F.col("exact_now") - F.col("exact_before")
    return both.agg(F.count(F.lit(1)).alias("users"), F.count_if(noisy == exact).alias("cancelled"),
                    (F.count_if(noisy == exact) * 2 < F.count(F.lit(1))).alias("noise_stays"))


register("dp_state_difference", with_le(
    "old AS (SELECT * FROM le WHERE event_time < (SELECT MAX(event_time) FROM le) - INTERVAL 1 DAY)",
    _recent_sql("failed", "7 days", 1.0), _recent_sql("failed", "7 days", 1.0, "old", "0")) + """
, j AS (SELECT n.noisy_count - n0.noisy_count AS noisy, n.count - n0.count AS exact FROM n JOIN n0 ON n.user_id = n0.user_id)
SELECT COUNT(*) AS users, CAST(COUNT_IF(noisy = exact) AS BIGINT) AS cancelled, COUNT_IF(noisy = exact) * 2 < COUNT(*) AS noise_stays FROM j""", FAM)(
    _state_difference)


def _ledger(spark, d):
    """Five requests to a ledger of budget 1.6: a release, the same again, another
    statistic, a later state, one too many; then the ledger and what each user's
    repeated answers differ by."""
    le = login_events(spark, d)
    old = _day_before(le)
    ledger = RL.Ledger(spark, scratch_path(spark, "ledger"), budget=1.6)
    first = RL.release_counts(old, ledger, 0.5, 42, "failed", "7 days")
    again = RL.release_counts(old, ledger, 0.5, 42, "failed", "7 days")
    RL.release_counts(old, ledger, 0.5, 42, "logons")
    RL.release_counts(le, ledger, 0.5, 42, "failed", "7 days")
    try:
        RL.release_counts(le, ledger, 0.5, 42, "logons")
        refused = 0
    except RL.BudgetSpent:
        refused = 1
    moved = first.join(again.withColumnRenamed("noisy_count", "b"), "user_id").agg(
        F.coalesce(F.sum(F.abs(F.col("noisy_count") - F.col("b"))), F.lit(0)).cast("bigint").alias("repeat_differs"))
    return ledger.table().select("entry", "mechanism", "statistic", F.col("window").alias("width"), "state", "epsilon") \
        .crossJoin(F.broadcast(moved)).withColumn("refused", F.lit(refused))


register("dp_release_ledger", with_le(
    "old AS (SELECT * FROM le WHERE event_time < (SELECT MAX(event_time) FROM le) - INTERVAL 1 DAY)", S.state_cte(), S.state_cte("old", "st0"),
    "asked AS (SELECT 1 AS entry, 'failed' AS statistic, '7 days' AS width, (SELECT gw_state FROM st0) AS state "
    "UNION ALL SELECT 2, 'logons', 'all', (SELECT gw_state FROM st0) UNION ALL SELECT 3, 'failed', '7 days', (SELECT gw_state FROM st))") + """
SELECT entry, 'laplace' AS mechanism, statistic, width, state, CAST(0.5 AS DOUBLE) AS epsilon, CAST(0 AS BIGINT) AS repeat_differs, 1 AS refused
FROM asked""", FAM)(_ledger)


def _display_sql(method: str) -> str:
    scale = "least(greatest(count / 1000.0, 1.0), 10.0)"
    if method == "gaussian":
        noise = f"({S.std_normal('user_id', 42, 'display.gaussian')} * sqrt(2.0 * ln(1.25 / 0.00001)) * {scale})"
    else:
        u = f"(0.5 - {S.uniform('user_id', 42, 'display.laplace')})"
        noise = f"(({scale} / 1.0) * sign({u}) * ln(1.0 - 2.0 * abs({u})))"
    return with_le(FAILED) + f"""
SELECT user_id, least(greatest({S.half_up('count + ' + noise)}, 0), 200000) AS display_count FROM c"""


for _m in ("laplace", "gaussian"):
    register(f"noisy_display_{_m}", _display_sql(_m), FAM)(
        (lambda m: lambda spark, d: A.failed_per_user(login_events(spark, d)).select(
            "user_id", noisy_display("count", "user_id", 1.0, 42, m).alias("display_count")))(_m))

# RFC 2104: the key padded to 64 bytes, xor 0x36 and xor 0x5c
_PADDED = DEMO_KEY + bytes(64 - len(DEMO_KEY))
_IPAD, _OPAD = ("".join(f"{b ^ x:02x}" for b in _PADDED) for x in (0x36, 0x5C))

register("pseudonymise_ip", with_le() + f"""
SELECT event_id, sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(ip)))) AS ip
FROM le""", FAM)(
    lambda spark, d: pseudonymise(login_events(spark, d).select("event_id", "ip"), "ip", DEMO_KEY))

register("pseudonym_cardinality", with_le() + f"""
SELECT COUNT(DISTINCT ip) AS distinct_ips,
       COUNT(DISTINCT sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(ip))))) AS distinct_tokens
FROM le""", FAM)(
    lambda spark, d: (lambda le: le.select(F.count_distinct("ip").alias("distinct_ips")).crossJoin(
        pseudonymise(le.select("ip"), "ip", DEMO_KEY, "tok").select(
            F.count_distinct("tok").alias("distinct_tokens"))))(login_events(spark, d)))
