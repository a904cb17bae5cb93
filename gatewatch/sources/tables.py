"""Driver tables and the adapter onto the canonical ``login_event`` schema.

Canonical ``login_event``::

    event_id bigint, user_id string, ip string, device string,
    success boolean, activity string, event_time timestamp_ntz,
    rtt_ms double, is_attack boolean, source string

Adapter from ``events`` (fixed mapping, mirrored by the oracle SQL):

* ``success``  = ``event_type <> 'error'`` (an ``error`` is a failed login)
* ``activity`` = ``'Logon'`` for view/click, ``'Logoff'`` otherwise
* ``ip``       = ``'10.0.0.' || k``, ``device`` = ``'d' || (k % 10)``,
  where ``k`` is the ``props`` JSON field
* ``is_attack`` = ``user_id % 10 = 0 AND k < 60`` (synthetic label)

Only expressions -- Catalyst prunes unused ones, so a query that needs
``success`` and ``user_id`` scans just ``event_type`` and ``user_id``, and
``~success`` becomes a pushed ``event_type = 'error'`` parquet filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ``props`` is a flat JSON object ``{"k": <int>}``. A regex on the key, anchored
# at the object's start or a comma, reads it ~25x faster than a JSON parser (no Jackson per row); the
# oracle SQL parses real JSON, so the two readings are checked against
# each other on the data.
K_PATTERN = r'[{,]\s*"k"\s*:\s*(-?\d+)'


def props_k(col: str = "props") -> Column:
    return F.regexp_extract(F.col(col), K_PATTERN, 1).try_cast("int")


def _k() -> Column:
    return props_k()


def adapt_events(events: DataFrame) -> DataFrame:
    """``events`` -> canonical ``login_event``."""
    k = _k()
    return events.select(
        F.col("event_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("10.0.0."), k.cast("string")).alias("ip"),
        F.concat(F.lit("d"), (k % 10).cast("string")).alias("device"),
        (F.col("event_type") != F.lit("error")).alias("success"),
        F.when(F.col("event_type").isin("view", "click"), F.lit("Logon"))
        .otherwise(F.lit("Logoff")).alias("activity"),
        F.col("ts").alias("event_time"),
        F.col("value").alias("rtt_ms"),
        ((F.col("user_id") % 10 == 0) & (k < 60)).alias("is_attack"),
        F.lit("events").alias("source"),
    )


def login_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt_events(load_table(spark, sf_dir, "events"))

