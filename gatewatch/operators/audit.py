"""Login-audit aggregates, recent windows, top-k and the top-N lookup join.

F1-F7, A1-A6, A19, T1-T6, J1. Inputs are canonical ``login_event`` frames.
Per-user counts are partial+final hash aggregates: a user holding a third
of all rows is combined map-side before the shuffle, so no task ever sees
the raw rows of one hot user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewatch.session import write_once

USER = "user_id"


def _interval(width: str) -> Column:
    return F.expr(f"INTERVAL {width}")


# ---------------------------------------------------------------- filters
def failed_only(le: DataFrame) -> DataFrame:
    """``success = false``; NULL success is excluded, as in SQL."""
    return le.where(~F.col("success"))


def logons_only(le: DataFrame) -> DataFrame:
    """``activity = 'Logon'``."""
    return le.where(F.col("activity") == F.lit("Logon"))


def _prune(le: DataFrame, start: Column) -> DataFrame:
    """On a log partitioned by ``event_date`` add the implied date bound, so
    only the partitions that can hold recent rows are listed and read."""
    if "event_date" in le.columns:
        return le.where(F.col("event_date") >= F.to_date(start))
    return le


def since(le: DataFrame, as_of, width: str = "30 minutes",
          time_col: str = "event_time") -> DataFrame:
    """``time >= as_of - width`` with no upper bound (as the reference)."""
    start = F.lit(as_of).cast("timestamp_ntz") - _interval(width)
    return _prune(le, start).where(F.col(time_col) >= start)


def since_max(le: DataFrame, width: str = "30 minutes",
              time_col: str = "event_time") -> DataFrame:
    """anchored at ``MAX(time)`` of the *unfiltered* input.

    The max is an uncorrelated scalar subquery: Spark runs it once and
    filters with the resulting literal (no join, no broadcast of data)."""
    if "event_date" in le.columns and time_col == "event_time":
        # date-partitioned log: the max lies in the newest date partition, so
        # the anchor reads one partition instead of the whole time column
        last_day = le.select(F.max("event_date")).scalar()
        anchor = le.where(F.col("event_date") == last_day).select(F.max(time_col)).scalar()
    else:
        anchor = le.select(F.max(time_col)).scalar()
    return _prune(le, anchor - _interval(width)).where(F.col(time_col) >= anchor - _interval(width))


def suppress_outliers(counts: DataFrame, cap: int = 50000, col: str = "count") -> DataFrame:
    """drop rows whose count is ``>= cap`` (dashboard outlier rule)."""
    return counts.where(F.col(col) < F.lit(cap))


def threshold_floor(t, minimum: int = 10):
    """the UI clamps the threshold to at least ``minimum``."""
    return max(minimum, t)


# ----------------------------------------------------------- aggregates
def count_per_user(rows: DataFrame, name: str = "count") -> DataFrame:
    return rows.groupBy(USER).agg(F.count(F.lit(1)).alias(name))


def failed_per_user(le: DataFrame) -> DataFrame:
    """A1: failed attempts per user; users without failures are absent.
    A NULL user is its own group (SQL GROUP BY semantics)."""
    return count_per_user(failed_only(le))


def logons_per_user(le: DataFrame) -> DataFrame:
    """A2: ``Logon`` rows per user."""
    return count_per_user(logons_only(le))


def recent_failed_per_user(le: DataFrame, width: str = "30 minutes", as_of=None) -> DataFrame:
    """A3: failed attempts in ``[as_of - width, ...)``; ``as_of=None`` anchors
    on ``MAX(event_time)`` of the whole log (F4) instead of wall-clock now."""
    recent = since_max(le, width) if as_of is None else since(le, as_of, width)
    return failed_per_user(recent)


def recent_logons_per_user(le: DataFrame, width: str = "30 minutes",
                           all_activity: bool = False) -> DataFrame:
    """A4: max-anchored window on the logon log; ``all_activity`` drops the
    ``Logon`` filter (the repository variant counts every activity)."""
    recent = since_max(le, width)
    return count_per_user(recent if all_activity else logons_only(recent))


def threshold_flag(counts: DataFrame, threshold, col: str = "count") -> DataFrame:
    """``count >= t AS anomalous`` (inclusive)."""
    return counts.withColumn("anomalous", F.col(col) >= F.lit(threshold))


def count_distinct_users(le: DataFrame, approx: bool = False) -> DataFrame:
    """Exact distinct users (NULL not counted); ``approx`` uses HLL++."""
    agg = F.approx_count_distinct(USER) if approx else F.count_distinct(USER)
    return le.agg(agg.alias("distinct_users"))


def attack_labels(le: DataFrame) -> DataFrame:
    """One label per event, no order."""
    return le.select(F.col("is_attack").alias("is_attack_ip"))


def label_any(le: DataFrame) -> Column:
    """A10 aggregate: ``BOOL_OR`` with a NULL result read as false."""
    return F.coalesce(F.bool_or("is_attack"), F.lit(False))


# ---------------------------------------------------------------- top-k
def top_k(df: DataFrame, limit: int = 100, offset: int = 0, col: str = "count",
          tiebreak: str = USER) -> DataFrame:
    """``ORDER BY col DESC LIMIT n OFFSET m``. The reference leaves ties
    undefined; the key tiebreak makes the result deterministic. Planned as
    ``TakeOrderedAndProject`` -- each task keeps only its local top n+m."""
    ordered = df.orderBy(F.col(col).desc(), F.col(tiebreak).asc_nulls_last())
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(limit)


def top_failed(le: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return top_k(failed_per_user(le), limit, offset)


def top_recent(le: DataFrame, limit: int = 100, width: str = "30 minutes", as_of=None) -> DataFrame:
    """T2."""
    return top_k(recent_failed_per_user(le, width, as_of), limit)


def top_anomalies(le: DataFrame, threshold, limit: int = 100, offset: int = 0) -> DataFrame:
    """T3 (offset honoured, unlike the reference endpoint)."""
    return top_k(threshold_flag(failed_per_user(le), threshold), limit, offset)


def activity_with_label(le: DataFrame) -> DataFrame:
    """Per-user event total and ``BOOL_OR`` attack label."""
    return le.groupBy(USER).agg(F.count(F.lit(1)).alias("total"),
                                label_any(le).alias("is_attack_ip"))


def top_active_users(le: DataFrame, limit: int = 100) -> DataFrame:
    """T5: top ``limit`` users by total events, with the any-label."""
    return top_k(activity_with_label(le), limit, col="total")


def user_activity(le: DataFrame, **more: Column) -> DataFrame:
    """Events, failures and the any-label per user (and ``more`` aggregates)."""
    return le.groupBy(USER).agg(F.count(F.lit(1)).alias("total"),
                                F.count_if(~F.col("success")).alias("failed"),
                                label_any(le).alias("is_attack_ip"), *[c.alias(n) for n, c in more.items()])


def written_activity(le: DataFrame, **more: Column) -> DataFrame:
    """``user_activity`` written once: what is cut from it more than once reads
    the log once."""
    return write_once(user_activity(le, **more), "activity")


def top_failed_from(activity: DataFrame, limit: int = 100) -> DataFrame:
    """T1 on a ``user_activity`` frame (users without failures are absent)."""
    return top_k(activity.where(F.col("failed") > 0).select(USER, F.col("failed").alias("count")), limit)


def users_with_failed_from(activity: DataFrame, limit: int = 100) -> DataFrame:
    """J1 on a written ``user_activity``."""
    users = top_k(activity.select(USER, "total", "is_attack_ip"), limit, col="total")
    failed = top_failed_from(activity, limit)
    return (users.join(F.broadcast(failed), USER, "left")
            .select(USER, "total", "is_attack_ip",
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def users_with_failed(le: DataFrame, limit: int = 100) -> DataFrame:
    """Top-N users by activity LEFT JOIN top-N users by failures.

    Both sides are truncated separately, so a user outside the second top-N
    counts as 0. The right side is at most ``limit`` rows -- a proven bound --
    so broadcasting it is safe at any data size. Both are cut from one aggregate
    that is written, so the log is read once."""
    return users_with_failed_from(written_activity(le), limit)
