"""Catalog: audit aggregates, windows, top-k, lookup join, paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewatch.operators import audit as A
from gatewatch.operators import paging
from gatewatch.plans.catalog import REGISTRY, register
from gatewatch.plans.sqlgen import with_le
from gatewatch.sources import login_events

FAM = "audit"

register("failed_per_user", with_le() + """
SELECT user_id, COUNT(*) AS count FROM le WHERE NOT success GROUP BY user_id""", FAM)(
    lambda spark, d: A.failed_per_user(login_events(spark, d)))

register("logons_per_user", with_le() + """
SELECT user_id, COUNT(*) AS count FROM le WHERE activity = 'Logon' GROUP BY user_id""", FAM)(
    lambda spark, d: A.logons_per_user(login_events(spark, d)))

register("recent_failed_per_user", with_le() + """
SELECT user_id, COUNT(*) AS count FROM le
WHERE NOT success AND event_time >= (SELECT MAX(event_time) FROM le) - INTERVAL 24 HOUR
GROUP BY user_id""", FAM)(
    lambda spark, d: A.recent_failed_per_user(login_events(spark, d), "24 hours"))

register("recent_failed_as_of", with_le() + """
SELECT user_id, COUNT(*) AS count FROM le
WHERE NOT success AND event_time >= TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 7 DAY
GROUP BY user_id""", FAM)(
    lambda spark, d: A.recent_failed_per_user(login_events(spark, d), "7 days",
                                              as_of="2024-01-29 00:00:00"))

register("recent_logons_per_user", with_le() + """
SELECT user_id, COUNT(*) AS count FROM le
WHERE activity = 'Logon' AND event_time >= (SELECT MAX(event_time) FROM le) - INTERVAL 7 DAY
GROUP BY user_id""", FAM)(
    lambda spark, d: A.recent_logons_per_user(login_events(spark, d), "7 days"))

register("recent_activity_per_user", with_le() + """
SELECT user_id, COUNT(*) AS count FROM le
WHERE event_time >= (SELECT MAX(event_time) FROM le) - INTERVAL 24 HOUR
GROUP BY user_id""", FAM)(
    lambda spark, d: A.recent_logons_per_user(login_events(spark, d), "24 hours", all_activity=True))

register("threshold_flag", with_le() + """
SELECT user_id, COUNT(*) AS count, COUNT(*) >= 15 AS anomalous
FROM le WHERE NOT success GROUP BY user_id""", FAM)(
    lambda spark, d: A.threshold_flag(A.failed_per_user(login_events(spark, d)), 15))

register("logon_threshold_flag", with_le() + """
SELECT user_id, COUNT(*) AS count, COUNT(*) >= 30 AS anomalous
FROM le WHERE activity = 'Logon' GROUP BY user_id""", FAM)(
    lambda spark, d: A.threshold_flag(A.logons_per_user(login_events(spark, d)), 30))

register("count_distinct_users", with_le() + """
SELECT COUNT(DISTINCT user_id) AS distinct_users FROM le""", FAM)(
    lambda spark, d: A.count_distinct_users(login_events(spark, d)))

register("attack_labels", with_le() + """
SELECT is_attack AS is_attack_ip FROM le""", FAM)(
    lambda spark, d: A.attack_labels(login_events(spark, d)))

register("top_failed", with_le() + """
SELECT user_id, COUNT(*) AS count FROM le WHERE NOT success GROUP BY user_id
ORDER BY count DESC, user_id ASC LIMIT 100""", FAM)(
    lambda spark, d: A.top_failed(login_events(spark, d), 100))

register("top_failed_offset", with_le() + """
SELECT user_id, COUNT(*) AS count FROM le WHERE NOT success GROUP BY user_id
ORDER BY count DESC, user_id ASC LIMIT 20 OFFSET 10""", FAM)(
    lambda spark, d: A.top_failed(login_events(spark, d), 20, 10))

register("top_recent", with_le() + """
SELECT user_id, COUNT(*) AS count FROM le
WHERE NOT success AND event_time >= (SELECT MAX(event_time) FROM le) - INTERVAL 7 DAY
GROUP BY user_id ORDER BY count DESC, user_id ASC LIMIT 10""", FAM)(
    lambda spark, d: A.top_recent(login_events(spark, d), 10, "7 days"))

register("top_anomalies", with_le() + """
SELECT user_id, COUNT(*) AS count, COUNT(*) >= 15 AS anomalous
FROM le WHERE NOT success GROUP BY user_id
ORDER BY count DESC, user_id ASC LIMIT 25 OFFSET 5""", FAM)(
    lambda spark, d: A.top_anomalies(login_events(spark, d), 15, 25, 5))

register("top_active_users", with_le() + """
SELECT user_id, COUNT(*) AS total, COALESCE(BOOL_OR(is_attack), false) AS is_attack_ip
FROM le GROUP BY user_id ORDER BY total DESC, user_id ASC LIMIT 100""", FAM)(
    lambda spark, d: A.top_active_users(login_events(spark, d), 100))

register("outlier_suppression", with_le() + """
SELECT user_id, COUNT(*) AS count FROM le WHERE NOT success GROUP BY user_id
HAVING COUNT(*) < 20""", FAM)(
    lambda spark, d: A.suppress_outliers(A.failed_per_user(login_events(spark, d)), 20))

register("threshold_floor_flag", with_le() + """
SELECT user_id, COUNT(*) AS count, COUNT(*) >= 10 AS anomalous
FROM le WHERE NOT success GROUP BY user_id""", FAM)(
    lambda spark, d: A.threshold_flag(A.failed_per_user(login_events(spark, d)),
                                      A.threshold_floor(3)))

_TOP_USERS = """
u AS (SELECT user_id, COUNT(*) AS total, COALESCE(BOOL_OR(is_attack), false) AS is_attack_ip
      FROM le GROUP BY user_id ORDER BY total DESC, user_id ASC LIMIT {n}),
f AS (SELECT user_id, COUNT(*) AS count FROM le WHERE NOT success GROUP BY user_id
      ORDER BY count DESC, user_id ASC LIMIT {n})"""

register("users_with_failed", with_le(_TOP_USERS.format(n=100)) + """
SELECT u.user_id, u.total, u.is_attack_ip, CAST(COALESCE(f.count, 0) AS BIGINT) AS count
FROM u LEFT JOIN f ON u.user_id = f.user_id""", FAM)(
    lambda spark, d: A.users_with_failed(login_events(spark, d), 100))

register("users_with_failed_truncated", with_le(_TOP_USERS.format(n=40)) + """
SELECT u.user_id, u.total, u.is_attack_ip, CAST(COALESCE(f.count, 0) AS BIGINT) AS count
FROM u LEFT JOIN f ON u.user_id = f.user_id""", FAM)(
    lambda spark, d: A.users_with_failed(login_events(spark, d), 40))

register("page_failed_counts", with_le("""
c AS (SELECT user_id, COUNT(*) AS count FROM le WHERE NOT success GROUP BY user_id)""") + """
SELECT user_id, count, (SELECT COUNT(*) FROM c) AS total
FROM c ORDER BY count DESC, user_id ASC LIMIT 10 OFFSET 10""", FAM)(
    lambda spark, d: paging.page(A.failed_per_user(login_events(spark, d)),
                                 ["count", "user_id"], page=2, size=10, descending=[True, False]))

register("page0_failed_counts", with_le("""
c AS (SELECT user_id, COUNT(*) AS count FROM le WHERE NOT success GROUP BY user_id)""") + """
SELECT user_id, count, (SELECT COUNT(*) FROM c) AS total_elements,
       CAST(ceil((SELECT COUNT(*) FROM c) / 10.0) AS BIGINT) AS total_pages,
       3 AS page_number, 10 AS page_size
FROM c ORDER BY user_id ASC LIMIT 10 OFFSET 30""", FAM)(
    lambda spark, d: paging.page0(A.failed_per_user(login_events(spark, d)), page=3, size=10))


def _jump(spark, d):
    index = paging.build_index(A.failed_per_user(login_events(spark, d)), ["count", "user_id"], [True, False], ranges=16)
    return index.page(page=4, size=10)


register("page_jump_failed_counts", with_le("""
c AS (SELECT user_id, COUNT(*) AS count FROM le WHERE NOT success GROUP BY user_id)""") + """
SELECT user_id, count, (SELECT COUNT(*) FROM c) AS total
FROM c ORDER BY count DESC, user_id ASC LIMIT 10 OFFSET 30""", FAM)(_jump)


def _keyset(spark, d):
    """The second page of the counts by count alone, where most rows tie."""
    counts = A.failed_per_user(login_events(spark, d))
    first = paging.page_after(counts, "count", None, 10).agg(F.max("count")).first()[0]
    return paging.page_after(counts, "count", first, 10)


register("page_after_failed_counts", with_le("""
c AS (SELECT user_id, COUNT(*) AS count FROM le WHERE NOT success GROUP BY user_id)""") + """
, e AS (SELECT MAX(count) AS last FROM (SELECT count FROM c ORDER BY count LIMIT 10))
, g AS (SELECT MAX(count) AS last2 FROM (SELECT count FROM c, e WHERE count > last ORDER BY count LIMIT 10))
SELECT user_id, count FROM c, e, g WHERE count > last AND count <= last2""", FAM)(_keyset)


def _partitioned_recent(spark, d):
    from gatewatch.session import scratch_path
    from gatewatch.sources import readers, sinks

    path = scratch_path(spark, "event-log")
    sinks.write_event_log(login_events(spark, d), path, mode="overwrite")
    return A.recent_failed_per_user(readers.read_event_log(spark, path), "24 hours")


register("recent_failed_partitioned_log", REGISTRY["recent_failed_per_user"].sql, FAM)(_partitioned_recent)
