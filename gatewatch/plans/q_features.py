"""Catalog: entity features, session windows, split / folds, augmentation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gatewatch.operators import audit as A
from gatewatch.operators import features as FT
from gatewatch.plans import sqlgen as S
from gatewatch.plans.catalog import REGISTRY, register
from gatewatch.plans.sqlgen import with_le
from gatewatch.sources import login_events

FAM = "features"

FAILED = "COALESCE(NOT success, false)"


def _uf_sql(key: str = "user_id", label: str = "mode") -> str:
    lab = ("CASE WHEN SUM(CAST(is_attack AS INTEGER)) * 2 > COUNT(is_attack) THEN 1 ELSE 0 END"
           if label == "mode" else "COALESCE(MAX(CAST(is_attack AS INTEGER)), 0)")
    return f"""SELECT {key} AS user_id, COUNT(*) AS login_freq, CAST(COUNT_IF(NOT success) AS BIGINT) AS failed_count,
       COUNT(DISTINCT ip) AS unique_ips,
       CAST(SUM(CAST(rtt_ms AS DECIMAL(18,6))) AS DOUBLE) / COUNT(rtt_ms) AS avg_rtt, {lab} AS is_attack_ip
FROM le WHERE {key} IS NOT NULL GROUP BY {key}"""


UF = f"uf AS ({_uf_sql()})"

register("universal_features", with_le() + _uf_sql(), FAM)(
    lambda spark, d: FT.universal_features(login_events(spark, d)))
register("universal_features_any", with_le() + _uf_sql(label="any"), FAM)(
    lambda spark, d: FT.universal_features(login_events(spark, d), label="any"))
register("universal_features_by_ip", with_le() + _uf_sql("ip", "any"), FAM)(
    lambda spark, d: FT.universal_features(login_events(spark, d), key="ip", label="any"))

_GAPS = UF.replace("uf AS (", "uf0 AS (")

register("impute_mean", with_le(_GAPS) + """
, uf AS (SELECT user_id, login_freq, failed_count, unique_ips, is_attack_ip,
                CASE WHEN CAST(user_id AS BIGINT) % 7 <> 0 THEN avg_rtt END AS avg_rtt FROM uf0)
, m AS (SELECT AVG(avg_rtt) AS fill FROM uf)
SELECT user_id, login_freq, failed_count, unique_ips, round(COALESCE(avg_rtt, fill), 6) AS avg_rtt, is_attack_ip
FROM uf, m""", FAM)(
    lambda spark, d: FT.impute_mean(FT.universal_features(login_events(spark, d).withColumn(
        "rtt_ms", F.when(F.col("user_id").cast("bigint") % 7 != 0, F.col("rtt_ms")))))
    .withColumn("avg_rtt", F.round("avg_rtt", 6)))

register("unique_devices", with_le() + """
SELECT user_id, COUNT(DISTINCT device) AS unique_devices FROM le GROUP BY user_id""", FAM)(
    lambda spark, d: FT.unique_devices(login_events(spark, d)))

_W1 = {"recent_failed_5m": 300, "recent_failed_30m": 1800, "recent_failed_24h": 86400}
_W1_SQL = ",\n".join(
    f"CAST(SUM(CASE WHEN {FAILED} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_time "
    f"RANGE BETWEEN INTERVAL {w} SECOND PRECEDING AND CURRENT ROW) AS BIGINT) AS {n}" for n, w in _W1.items())

register("recent_failed_counts", with_le() + f"SELECT event_id, user_id, {_W1_SQL} FROM le", FAM)(
    lambda spark, d: FT.recent_failed_counts(login_events(spark, d)))

register("recent_failed_counts_fine_buckets", with_le() + f"SELECT event_id, user_id, {_W1_SQL} FROM le", FAM)(
    lambda spark, d: FT.recent_failed_counts(login_events(spark, d), pieces=64))

W2_CTE = f"""o AS (SELECT user_id, {FAILED} AS f,
        row_number() OVER (PARTITION BY user_id ORDER BY event_time, event_id)
        - row_number() OVER (PARTITION BY user_id, {FAILED} ORDER BY event_time, event_id) AS g
      FROM le WHERE user_id IS NOT NULL),
r AS (SELECT user_id, f, g, COUNT(*) AS n FROM o GROUP BY user_id, f, g),
cf AS (SELECT user_id, CAST(COALESCE(MAX(CASE WHEN f THEN n END), 0) AS BIGINT) AS consecutive_failed_attempts
       FROM r GROUP BY user_id)"""

register("consecutive_failed", with_le(W2_CTE) + "SELECT * FROM cf", FAM)(
    lambda spark, d: FT.consecutive_failed(login_events(spark, d)))
register("consecutive_failed_hour_chunks", with_le(W2_CTE) + "SELECT * FROM cf", FAM)(
    lambda spark, d: FT.consecutive_failed(login_events(spark, d), pieces=64))

W3_CTE = f"""fl AS (SELECT user_id, epoch_us(event_time) AS us,
               lag(epoch_us(event_time)) OVER (PARTITION BY user_id ORDER BY event_time, event_id) AS p
        FROM le WHERE {FAILED} AND user_id IS NOT NULL),
gs AS (SELECT user_id, SUM(floor((us - p) / 60000000)) AS tot, COUNT(p) AS n FROM fl GROUP BY user_id),
gu AS (SELECT DISTINCT user_id FROM le WHERE user_id IS NOT NULL),
ag AS (SELECT gu.user_id, CASE WHEN COALESCE(n, 0) = 0 THEN 0.0 ELSE tot / n END AS avg_failed_gap
       FROM gu LEFT JOIN gs ON gu.user_id IS NOT DISTINCT FROM gs.user_id)"""

register("avg_failed_gap", with_le(W3_CTE) + "SELECT * FROM ag", FAM)(
    lambda spark, d: FT.avg_failed_gap(login_events(spark, d)))
register("avg_failed_gap_hour_chunks", with_le(W3_CTE) + "SELECT * FROM ag", FAM)(
    lambda spark, d: FT.avg_failed_gap(login_events(spark, d), pieces=64))

W4_SQL = """SELECT event_id, user_id,
  CAST(row_number() OVER (PARTITION BY user_id, ip ORDER BY event_time, event_id) = 1 AS INTEGER) AS is_new_ip,
  CAST(row_number() OVER (PARTITION BY user_id, device ORDER BY event_time, event_id) = 1 AS INTEGER) AS is_new_device
FROM le"""

register("first_sightings", with_le() + W4_SQL, FAM)(
    lambda spark, d: FT.first_sightings(login_events(spark, d)))

LAST_CTE = f"""w4 AS (SELECT event_id, user_id, event_time,
               CASE WHEN hour(event_time) < 6 OR hour(event_time) > 22 THEN 1 ELSE 0 END AS uh,
               CAST(row_number() OVER (PARTITION BY user_id, ip ORDER BY event_time, event_id) = 1 AS INTEGER) AS is_new_ip,
               CAST(row_number() OVER (PARTITION BY user_id, device ORDER BY event_time, event_id) = 1 AS INTEGER) AS is_new_device
        FROM le WHERE user_id IS NOT NULL),
lw AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, event_id DESC) AS rr FROM w4),
lf AS (SELECT user_id, uh AS unusual_login_hour, is_new_ip, is_new_device FROM lw WHERE rr = 1)"""

register("last_event_flags", with_le(LAST_CTE) + "SELECT * FROM lf", FAM)(
    lambda spark, d: FT.last_event_flags(login_events(spark, d)))

SPLIT_SQL = f"""SELECT uf.*, CASE WHEN row_number() OVER (PARTITION BY is_attack_ip ORDER BY {S.uniform('user_id', 42, 'split')}, user_id)
                 <= floor(0.7 * COUNT(*) OVER (PARTITION BY is_attack_ip) + 0.5) THEN 'train' ELSE 'test' END AS split FROM uf"""

register("split_flag", with_le(UF) + SPLIT_SQL, FAM)(
    lambda spark, d: FT.split_flag(FT.universal_features(login_events(spark, d))))


def _split_shares(spark, d):
    """The contract of W5 and W6: rows of each label by split and by fold."""
    feats = FT.universal_features(login_events(spark, d))
    both = FT.split_flag(FT.fold_ids(feats))
    off = F.greatest(*[F.count_if(F.col("fold") == i) for i in range(5)]) - F.least(*[F.count_if(F.col("fold") == i) for i in range(5)])
    train = F.count_if(F.col("split") == "train")
    return both.groupBy("is_attack_ip").agg(F.count(F.lit(1)).alias("n"), (F.abs(train - F.count(F.lit(1)) * 0.7) < 1).alias("train_is_70_percent"),
                                            (off <= 1).alias("folds_are_even"))


register("split_shares", with_le(UF) + """
SELECT is_attack_ip, COUNT(*) AS n, true AS train_is_70_percent, true AS folds_are_even FROM uf GROUP BY is_attack_ip""", FAM)(_split_shares)

register("fold_ids", with_le(UF) + f"""
SELECT * EXCLUDE (r, n), CAST((CASE WHEN (1 * n) // 5 < r THEN 1 ELSE 0 END) + (CASE WHEN (2 * n) // 5 < r THEN 1 ELSE 0 END)
       + (CASE WHEN (3 * n) // 5 < r THEN 1 ELSE 0 END) + (CASE WHEN (4 * n) // 5 < r THEN 1 ELSE 0 END) AS INTEGER) AS fold
FROM (SELECT *, row_number() OVER (PARTITION BY is_attack_ip ORDER BY {S.uniform('user_id', 42, 'fold')}, user_id) AS r,
             COUNT(*) OVER (PARTITION BY is_attack_ip) AS n FROM uf)""", FAM)(
    lambda spark, d: FT.fold_ids(FT.universal_features(login_events(spark, d))))


def _aug_sql() -> str:
    def normal(stream, mu, sd):
        return f"({float(mu)} + {float(sd)} * {S.std_normal('user_id', 42, stream)})"
    u = S.uniform("user_id", 42, "aug.ips")
    knots = [sum(math.exp(-2.0) * 2.0 ** i / math.factorial(i) for i in range(k + 1)) for k in range(30)]
    pois = " + ".join(f"(CASE WHEN {S.dbl(c)} < {u} THEN 1 ELSE 0 END)" for c in knots)
    return with_le(UF) + f"""
SELECT user_id,
       CAST(floor(greatest(login_freq + {normal('aug.login', 10, 15)}, 0.0)) AS BIGINT) AS login_freq,
       CAST(floor(greatest(failed_count + {normal('aug.failed', 10, 15)}, 0.0)) AS BIGINT) AS failed_count,
       CAST(unique_ips + ({pois}) AS BIGINT) AS unique_ips,
       round(greatest(avg_rtt + {normal('aug.rtt', 50, 100)}, 0.1), 6) AS avg_rtt,
       is_attack_ip
FROM uf"""


register("augment_overlap", _aug_sql(), FAM)(
    lambda spark, d: FT.augment_overlap(FT.universal_features(login_events(spark, d)))
    .withColumn("avg_rtt", F.round("avg_rtt", 6)))

register("class_weights", with_le(UF) + """
, cc AS (SELECT is_attack_ip, COUNT(*) AS nc FROM uf GROUP BY is_attack_ip)
, tt AS (SELECT SUM(nc) AS n, COUNT(*) AS k FROM cc)
SELECT uf.*, n / (k * nc) AS weight FROM uf JOIN cc USING (is_attack_ip), tt""", FAM)(
    lambda spark, d: FT.class_weights(FT.universal_features(login_events(spark, d))))

SESSION_CTE = ",\n".join([UF, W2_CTE, W3_CTE, LAST_CTE, f"""w1 AS (SELECT event_id, user_id, {_W1_SQL} FROM le),
rc AS (SELECT user_id, MAX(recent_failed_5m) AS recent_failed_5m, MAX(recent_failed_30m) AS recent_failed_30m,
              MAX(recent_failed_24h) AS recent_failed_24h FROM w1 GROUP BY user_id),
ud AS (SELECT user_id, COUNT(DISTINCT device) AS unique_devices FROM le GROUP BY user_id)"""])

register("session_features", with_le(SESSION_CTE) + """
SELECT uf.user_id, uf.login_freq - uf.failed_count AS success_count,
       uf.failed_count / CASE WHEN uf.login_freq - uf.failed_count = 0 THEN 1
                              ELSE uf.login_freq - uf.failed_count END AS failed_success_ratio,
       lf.unusual_login_hour, lf.is_new_ip, lf.is_new_device, cf.consecutive_failed_attempts,
       rc.recent_failed_5m, rc.recent_failed_30m, rc.recent_failed_24h, ag.avg_failed_gap, ud.unique_devices
FROM uf LEFT JOIN lf USING (user_id) LEFT JOIN cf USING (user_id) LEFT JOIN rc USING (user_id)
        LEFT JOIN ag USING (user_id) LEFT JOIN ud USING (user_id)""", FAM)(
    lambda spark, d: FT.session_features(login_events(spark, d)))

register("top_scored_users", with_le(UF) + """
SELECT * FROM uf ORDER BY failed_count DESC, user_id ASC LIMIT 100""", FAM)(
    lambda spark, d: A.top_k(FT.universal_features(login_events(spark, d)), 100, col="failed_count"))


def _coerced(spark, d):
    feats = FT.universal_features(login_events(spark, d))
    n = F.col("user_id").cast("bigint") % 5
    as_text = feats.select("user_id", "failed_count", "login_freq",
                           F.when(n == 0, "n/a").when(n == 1, "").otherwise(F.col("unique_ips").cast("string")).alias("unique_ips"),
                           F.when(n == 2, None).otherwise(F.col("avg_rtt").cast("string")).alias("avg_rtt"))
    as_text = as_text.withColumns({c: F.col(c).cast("string") for c in ("failed_count", "login_freq")})
    return FT.coerce_and_drop(as_text, ["failed_count", "login_freq", "unique_ips", "avg_rtt"])


register("coerce_features", with_le(UF) + """
SELECT user_id, CAST(failed_count AS DOUBLE) AS failed_count, CAST(login_freq AS DOUBLE) AS login_freq,
       CAST(unique_ips AS DOUBLE) AS unique_ips, avg_rtt FROM uf
WHERE avg_rtt IS NOT NULL AND CAST(user_id AS BIGINT) % 5 NOT IN (0, 1, 2)""", FAM)(_coerced)

register("given_success_count", with_le(UF) + """
SELECT user_id, login_freq - 1 AS success_count,
       failed_count / CASE WHEN login_freq - 1 = 0 THEN 1 ELSE login_freq - 1 END AS failed_success_ratio FROM uf""", FAM)(
    lambda spark, d: FT.success_ratio(FT.universal_features(login_events(spark, d))
                                      .withColumn("success_count", F.col("login_freq") - 1))
    .select("user_id", "success_count", "failed_success_ratio"))


def _given_arrays(spark, d):
    k = F.regexp_extract("ip", r"(\d+)$", 1).cast("int")
    before = F.array(*[F.concat(F.lit("10.0.0."), ((k * m) % 100).cast("string")) for m in (3, 11, 51)])
    return login_events(spark, d).select("event_id", FT.is_new("ip", before).alias("is_new_ip"))


register("given_arrays", with_le() + """
, kk AS (SELECT event_id, ip, CAST(regexp_extract(ip, '(\\d+)$', 1) AS INTEGER) AS k FROM le)
SELECT event_id, CASE WHEN list_contains(['10.0.0.' || (k * 3) % 100, '10.0.0.' || (k * 11) % 100, '10.0.0.' || (k * 51) % 100], ip)
       THEN 0 ELSE 1 END AS is_new_ip FROM kk""", FAM)(_given_arrays)

register("session_features_hour_chunks", REGISTRY["session_features"].sql, FAM)(
    lambda spark, d: FT.session_features(login_events(spark, d), pieces=64))
