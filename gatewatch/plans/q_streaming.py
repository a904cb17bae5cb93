"""Catalog: streaming windows and alerts (run to completion, read back)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewatch.plans.catalog import register
from gatewatch.session import scratch_path
from gatewatch.sources.tables import load_table, props_k
from gatewatch.streaming import alerts as ST

FAM = "streaming"


def _windows_sql(threshold: int | None = None) -> str:
    having = f"HAVING COUNT(*) >= {threshold}" if threshold else ""
    return f"""WITH f AS (SELECT CAST(user_id AS VARCHAR) AS user_id, ts FROM events WHERE event_type = 'error'),
w AS (SELECT user_id, time_bucket(INTERVAL 5 MINUTE, ts) - j * INTERVAL 5 MINUTE AS ws FROM f, range(6) r(j)),
c AS (SELECT user_id, ws AS window_start, ws + INTERVAL 30 MINUTE AS window_end, COUNT(*) AS count
      FROM w GROUP BY user_id, ws {having})
SELECT * FROM c WHERE window_end <= (SELECT MAX(ts) FROM f) - INTERVAL 10 MINUTE"""


def _stream_windows(spark, d):
    out = scratch_path(spark, "stream-windows")
    counts = ST.windowed_failed_counts(ST.login_stream(spark, d))
    ST.run_available(counts, out, scratch_path(spark, "stream-windows-ckpt"))
    return spark.read.parquet(out)


register("stream_failed_windows", _windows_sql(), FAM)(_stream_windows)


def _stream_alerts(spark, d):
    path = ST.run_alerts(spark, d, threshold=2)
    return ST.read_alerts(spark, path).drop("batch_id")


ATTEMPTS = "event_id bigint, username string, ip_address string, success boolean"


def _attempts(spark, d, replay: bool):
    """Raw attempts (every fifth address missing) as JSON files; with ``replay``
    every tenth is sent again, in files of its own."""
    src = scratch_path(spark, "attempts")
    k = props_k()
    rows = load_table(spark, d, "events").select(
        "event_id", F.col("user_id").cast("string").alias("username"),
        F.when(k % 5 != 0, F.concat(F.lit("10.0.0."), k.cast("string"))).alias("ip_address"),
        (F.col("event_type") != "error").alias("success"))
    rows.write.json(src)
    if replay:
        rows.where("event_id % 10 = 0").write.mode("append").json(src)
    return src


def _ingest(spark, d):
    """Every attempt with a stamp of its arrival that is not before the run began."""
    out = scratch_path(spark, "ingested")
    began = spark.sql("SELECT current_timestamp() AS t").first()["t"]
    ST.ingest_login_attempts(spark, _attempts(spark, d, False), ATTEMPTS, out)
    logged = spark.read.schema(ATTEMPTS + ", created_at timestamp_ntz").parquet(out)
    return logged.withColumn("stamped", ST.ntz_to_ts("created_at") >= F.lit(began)).drop("created_at")


_INGEST_SQL = """
SELECT event_id, CAST(user_id AS VARCHAR) AS username,
       CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 = 0 THEN 'UNKNOWN'
            ELSE '10.0.0.' || json_extract_string(props, '$.k') END AS ip_address,
       event_type <> 'error' AS success, true AS stamped FROM events"""

register("ingest_login_attempts", _INGEST_SQL, FAM)(_ingest)


def _ingest_replayed(spark, d):
    """Attempts of which every tenth comes twice, over several micro-batches: the
    log holds each once, and the run says how many were dropped."""
    out = scratch_path(spark, "ingested")
    said = ST.ingest_login_attempts(spark, _attempts(spark, d, True), ATTEMPTS, out, key="event_id", max_files_per_trigger=2)
    return spark.read.schema(ATTEMPTS + ", created_at timestamp_ntz").parquet(out).agg(
        F.count(F.lit(1)).alias("logged"), F.count_distinct("event_id").alias("attempts"), F.count("created_at").alias("stamped"),
        F.count_if(F.col("ip_address") == "UNKNOWN").alias("unknown")).withColumn("replays", F.lit(said["replays"]).cast("bigint"))


register("ingest_replayed_attempts", """
SELECT COUNT(*) AS logged, COUNT(DISTINCT event_id) AS attempts, COUNT(*) AS stamped,
       CAST(COUNT_IF(CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 = 0) AS BIGINT) AS unknown,
       CAST(COUNT_IF(event_id % 10 = 0) AS BIGINT) AS replays FROM events""", FAM)(_ingest_replayed)

register("stream_threshold_alerts", _windows_sql(2), FAM)(_stream_alerts)
