"""Catalog: account actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewatch.operators import accounts as AC
from gatewatch.operators import anomaly as N
from gatewatch.operators import audit as A
from gatewatch.plans.catalog import register
from gatewatch.sources.tables import load_table

FAM = "accounts"

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
ACTS = f"""acts AS (
  SELECT event_id AS seq, action, trim(name) AS username, role FROM (
    SELECT event_id,
           CASE WHEN event_type = 'signup' THEN 'register' WHEN event_type = 'error' THEN 'suspend'
                WHEN event_type = 'click' THEN 'activate'
                WHEN event_type = 'purchase' AND {K} < 10 THEN 'delete'
                WHEN event_type = 'purchase' THEN 'change_role' END AS action,
           CASE WHEN {K} % 17 = 0 THEN '  ' || CAST(user_id AS VARCHAR) || ' ' ELSE CAST(user_id AS VARCHAR) END AS name,
           CASE WHEN {K} % 2 = 0 THEN 'ANALYST' ELSE 'USER' END AS role
    FROM events) t
  WHERE action IS NOT NULL AND NOT (action = 'delete' AND trim(name) = 'admin')),
ld AS (SELECT username, MAX(CASE WHEN action = 'delete' THEN seq END) AS last_d FROM acts GROUP BY username),
reg AS (SELECT a.username, MIN(CASE WHEN action = 'register' AND (last_d IS NULL OR seq > last_d) THEN seq END) AS reg_seq
        FROM acts a JOIN ld USING (username) GROUP BY a.username),
cr AS (SELECT username, arg_max(role, seq) AS cr_role, MAX(seq) AS cr_seq FROM acts WHERE action = 'change_role' GROUP BY username),
su AS (SELECT username, arg_max(action = 'suspend', seq) AS su_v, MAX(seq) AS su_seq FROM acts
       WHERE action IN ('suspend', 'activate') GROUP BY username),
fr AS (SELECT MIN(seq) AS first_reg FROM acts WHERE action = 'register'),
final AS (
  SELECT reg.username,
         CASE WHEN cr.cr_seq > reg.reg_seq THEN cr.cr_role
              WHEN reg.reg_seq = fr.first_reg THEN 'ADMIN' ELSE 'USER' END AS role,
         CASE WHEN su.su_seq > reg.reg_seq THEN su.su_v ELSE false END AS suspended
  FROM reg LEFT JOIN cr USING (username) LEFT JOIN su USING (username), fr
  WHERE reg.reg_seq IS NOT NULL)"""


def _users(spark, d):
    le = load_table(spark, d, "events")
    empty = spark.createDataFrame([], AC.USERS_SCHEMA)
    return AC.apply_user_actions(empty, AC.actions_from_events(le))


register("apply_user_actions", f"WITH {ACTS}\nSELECT * FROM final", FAM)(_users)


def _hashed_users(spark, d):
    """The customers as a users table that holds password hashes."""
    return load_table(spark, d, "customer").select(
        F.col("c_custkey").cast("bigint").alias("user_id"), F.col("c_name").alias("username"),
        F.concat("c_name", F.lit("@example.com")).alias("email"), F.sha2("c_name", 256).alias("password_hash"),
        F.lit("USER").alias("role"), (F.col("c_custkey") % 5 == 0).alias("suspended"))


register("list_users", """
SELECT CAST(c_custkey AS BIGINT) AS user_id, c_name AS username, c_name || '@example.com' AS email, 'USER' AS role,
       c_custkey % 5 = 0 AS suspended FROM customer""", FAM)(lambda spark, d: AC.list_users(_hashed_users(spark, d)))


def _candidates(spark, d):
    from gatewatch.sources import login_events

    flags = N.zscore_flags(A.failed_per_user(login_events(spark, d)), 1.0) \
        .withColumnRenamed("user_id", "username")
    return AC.suspension_candidates(flags, _users(spark, d))


register("suspension_candidates", f"""WITH {ACTS},
le AS (SELECT CAST(user_id AS VARCHAR) AS user_id, event_type <> 'error' AS success FROM events),
c AS (SELECT user_id, COUNT(*) AS count FROM le WHERE NOT success GROUP BY user_id),
s AS (SELECT avg(count) AS m, stddev_pop(count) AS sd FROM c),
fl AS (SELECT user_id AS username FROM c, s
       WHERE abs(CASE WHEN sd IS NULL OR sd = 0 THEN 0.0 ELSE (count - m) / sd END) >= 1.0)
SELECT final.* FROM final JOIN fl USING (username) WHERE NOT suspended""", FAM)(_candidates)
