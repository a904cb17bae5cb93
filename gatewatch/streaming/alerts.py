"""Structured Streaming forms of the recent-window detector.

* ``login_stream``: a file-source stream of ``events`` adapted to the
  canonical login event, with ``event_time`` as a time-zone independent
  ``timestamp`` (watermarks need ``timestamp``, not ``timestamp_ntz``).
* R1 ``windowed_failed_counts``: failed attempts per user per sliding window,
  watermark-bounded state, append mode (a window is emitted once, final,
  after the watermark passes its end; later rows are dropped).
* R2 ``threshold_alerts``: R1 rows with ``count >= t``, delivered by an
  idempotent ``foreachBatch`` sink (a replayed batch overwrites its own
  partition, so a retried micro-batch never duplicates alerts).
* S14 ``ingest_login_attempts``: raw attempts -> Parquet log, stamped with their
  arrival, ``ip`` NULL -> ``'UNKNOWN'``, attempts sent again dropped by key,
  exactly-once via the checkpoint.

Checkpoints live under the shared folder (``spark.checkpoint.dir``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewatch.session import scratch_path
from gatewatch.sources.tables import adapt_events


def ntz_to_ts(col: str) -> Column:
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})"))


def ts_to_ntz(c: Column) -> Column:
    """``timestamp`` -> ``timestamp_ntz`` with the same UTC wall clock."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def login_stream(spark: SparkSession, table_dir: str, table: str = "events",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """The table may be one file or a folder of part files: a pattern that
    only it matches stands for both (a plain path must be a folder)."""
    base = table_dir.rstrip("/")
    r = spark.readStream.schema(spark.read.parquet(f"{base}/{table}.parquet").schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return adapt_events(r.parquet(f"{base}/{table}[.]parquet")).withColumn("event_ts", ntz_to_ts("event_time"))


def windowed_failed_counts(stream: DataFrame, window: str = "30 minutes", slide: str = "5 minutes",
                           watermark: str = "10 minutes") -> DataFrame:
    """R1."""
    return (stream.where(~F.col("success"))
            .withWatermark("event_ts", watermark)
            .groupBy(F.window("event_ts", window, slide), "user_id")
            .agg(F.count(F.lit(1)).alias("count"))
            .select("user_id", ts_to_ntz(F.col("window.start")).alias("window_start"),
                    ts_to_ntz(F.col("window.end")).alias("window_end"), "count"))


def threshold_alerts(counts: DataFrame, threshold: int) -> DataFrame:
    """R2: windows whose count reaches the threshold."""
    return counts.where(F.col("count") >= F.lit(threshold))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Process everything available now into a Parquet sink, then stop; the ended query."""
    q = (df.writeStream.outputMode(mode).format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def idempotent_batch_sink(path: str):
    """foreachBatch writer: each micro-batch overwrites only its own
    ``batch_id`` partition, so a replay after a failure is harmless."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))
    return write


def run_alerts(spark: SparkSession, table_dir: str, threshold: int, out: str | None = None,
               window: str = "30 minutes", slide: str = "5 minutes", watermark: str = "10 minutes") -> str:
    """R1 + R2 end to end with the foreachBatch sink; returns the alert path."""
    out = out or scratch_path(spark, "alerts")
    counts = windowed_failed_counts(login_stream(spark, table_dir), window, slide, watermark)
    q = (threshold_alerts(counts, threshold).writeStream.outputMode("append")
         .foreachBatch(idempotent_batch_sink(out))
         .option("checkpointLocation", scratch_path(spark, "alerts-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out


ALERT_SCHEMA = "user_id string, window_start timestamp_ntz, window_end timestamp_ntz, count bigint, batch_id int"


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alerts written by the batch sink; a sink that never received a row
    (no window reached the threshold) reads as an empty table."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return spark.createDataFrame([], ALERT_SCHEMA)
    return spark.read.schema(ALERT_SCHEMA).parquet(path)


def ingest_login_attempts(spark: SparkSession, src_dir: str, schema: str, out: str,
                          checkpoint: str | None = None, fmt: str = "json", key: str | None = None,
                          replay_horizon: str = "1 day", max_files_per_trigger: int | None = None) -> dict[str, int]:
    """Every attempt is logged (success or not) with ``created_at``, the time
    of its arrival; NULL ip -> 'UNKNOWN'.

    With ``key`` (an attempt's own id) an attempt that was sent again within
    ``replay_horizon`` of its first arrival is logged once. The horizon is a
    watermark on the arrival time, so an attempt that took place long ago is
    logged like any other, and the state holds the keys of one horizon. Returns
    the attempts read, replays dropped and attempts logged by this run."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    logged = reader.load(src_dir).withColumn("ip_address", F.coalesce(F.col("ip_address"), F.lit("UNKNOWN"))) \
        .withColumn("gw_arrival", F.current_timestamp())
    if key:
        logged = logged.withWatermark("gw_arrival", replay_horizon).dropDuplicatesWithinWatermark([key])
    logged = logged.withColumn("created_at", ts_to_ntz(F.col("gw_arrival"))).drop("gw_arrival")
    return _counted(run_available(logged, out, checkpoint or scratch_path(spark, "ingest-ckpt")))


def _counted(query) -> dict[str, int]:
    """Rows read, replays dropped and rows too late for their windows, over the
    progress reports that Spark keeps (``spark.sql.streaming.numRecentProgressUpdates``)."""
    read = replays = late = 0
    for p in query.recentProgress:
        read += p["numInputRows"]
        for op in p["stateOperators"]:
            replays += int(op["customMetrics"].get("numDroppedDuplicateRows", 0))
            late += int(op["numRowsDroppedByWatermark"])
    return {"read": read, "replays": replays, "late": late, "logged": read - replays}
