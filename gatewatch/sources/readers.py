"""Source readers (S1-S5): explicit schemas, no inference."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewatch.sources.tables import props_k
from pyspark.sql import types as T

from gatewatch.functions.noise import uniform
from gatewatch.sources.json_documents import read_documents

APP_LOG_SCHEMA = "id bigint, username string, ip_address string, success boolean, created_at timestamp_ntz"
RBA_LOG_SCHEMA = APP_LOG_SCHEMA + ", is_attack_ip boolean"
CERT_LOG_SCHEMA = ("id bigint, cert_event_id string, event_time timestamp_ntz, username string, "
                   "pc string, activity string")
LINUX_RAW_SCHEMA = ("timestamp string, source_ip string, server string, username string, service string, "
                    "attempts string, status string, port string, protocol string, comment string, "
                    "anomaly_label string, delta_t double")

RESULT_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()), T.StructField("failed_count", T.LongType()),
    T.StructField("login_freq", T.LongType()), T.StructField("unique_ips", T.LongType()),
    T.StructField("avg_rtt", T.DoubleType()), T.StructField("logreg_prob", T.DoubleType()),
    T.StructField("logreg_pred", T.IntegerType()), T.StructField("rf_prob", T.DoubleType()),
    T.StructField("rf_pred", T.IntegerType()), T.StructField("is_attack_ip", T.IntegerType()),
])


def _read(spark: SparkSession, path: str, schema: str, fmt: str) -> DataFrame:
    r = spark.read.schema(schema)
    return r.option("header", True).csv(path) if fmt == "csv" else r.format(fmt).load(path)


def read_app_logs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S1 -> canonical ``login_event``; a NULL ip is stored as ``UNKNOWN``."""
    df = _read(spark, path, APP_LOG_SCHEMA, fmt)
    return df.select(F.col("id").alias("event_id"), F.col("username").alias("user_id"),
                     F.coalesce("ip_address", F.lit("UNKNOWN")).alias("ip"),
                     F.lit(None).cast("string").alias("device"), "success",
                     F.lit(None).cast("string").alias("activity"),
                     F.col("created_at").alias("event_time"), F.lit(None).cast("double").alias("rtt_ms"),
                     F.lit(None).cast("boolean").alias("is_attack"), F.lit("app").alias("source"))


def read_cert_logs(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Insider-threat logon log -> canonical (``pc`` as the device)."""
    df = _read(spark, path, CERT_LOG_SCHEMA, fmt)
    return df.select(F.col("id").alias("event_id"), F.col("username").alias("user_id"),
                     F.lit(None).cast("string").alias("ip"), F.col("pc").alias("device"),
                     F.lit(None).cast("boolean").alias("success"), "activity", "event_time",
                     F.lit(None).cast("double").alias("rtt_ms"), F.lit(None).cast("boolean").alias("is_attack"),
                     F.lit("cert").alias("source"))


def normalise_header(name: str) -> str:
    """lower-case, spaces -> underscores (``Round-Trip Time [ms]`` ->
    ``round-trip_time_[ms]``)."""
    return re.sub(" ", "_", name.strip().lower())


def _bool01(c: str):
    """Boolean or 0/1 text -> boolean."""
    s = F.lower(F.trim(F.col(c).cast("string")))
    return F.when(s.isin("true", "1", "1.0"), F.lit(True)).when(s.isin("false", "0", "0.0"), F.lit(False))


def read_rba(spark: SparkSession, path: str) -> DataFrame:
    """S3: risk-based login CSV with any header spelling -> canonical."""
    raw = spark.read.option("header", True).csv(path)
    df = raw.toDF(*[normalise_header(c) for c in raw.columns])
    return normalise_rba(df)


def normalise_rba(df: DataFrame) -> DataFrame:
    """``event_id`` is a hash of the row and, among equal rows, its number, so
    it does not depend on how the file is read."""
    content = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    nth = F.row_number().over(Window.partitionBy("gw_row_hash").orderBy("gw_row_hash"))
    df = df.withColumn("gw_row_hash", content)
    return df.select(F.xxhash64("gw_row_hash", nth).alias("event_id"),
                     F.col("user_id").cast("string").alias("user_id"),
                     F.col("ip_address").alias("ip"), F.lit(None).cast("string").alias("device"),
                     _bool01("login_successful").alias("success"), F.lit(None).cast("string").alias("activity"),
                     F.lit(None).cast("timestamp_ntz").alias("event_time"),
                     F.expr("try_cast(`round-trip_time_[ms]` AS DOUBLE)").alias("rtt_ms"),
                     _bool01("is_attack_ip").alias("is_attack"), F.lit("rba").alias("source"))


def normalise_linux(raw: DataFrame, seed=42, key: str = "gw_row") -> DataFrame:
    """Raw Linux auth log -> normalised RBA columns.

    ``login_successful := status = 'success'`` (NULL -> false);
    ``is_attack_ip := label <> 'normal'`` with a NULL label counted as an
    attack; rtt = ``coalesce(delta_t, U(10, 200)) * 100`` with U a keyed-hash
    draw (``key`` names a stable row id column)."""
    fill = F.lit(10.0) + F.lit(190.0) * uniform(key, seed, "linux.rtt")
    return raw.select(
        F.col("username").alias("user_id"), F.col("source_ip").alias("ip_address"),
        F.coalesce(F.col("status") == "success", F.lit(False)).alias("login_successful"),
        (F.coalesce(F.col("delta_t"), fill) * F.lit(100.0)).alias("round-trip_time_[ms]"),
        F.when(F.col("anomaly_label").eqNullSafe("normal"), F.lit(0)).otherwise(F.lit(1)).alias("is_attack_ip"))


def linux_raw_from_events(events: DataFrame) -> DataFrame:
    """The driver's events as a raw Linux auth log (fixed mapping)."""
    k = props_k()
    return events.select(
        F.col("event_id").alias("gw_row"), F.col("ts").cast("string").alias("timestamp"),
        F.concat(F.lit("10.0.0."), k.cast("string")).alias("source_ip"), F.lit("srv1").alias("server"),
        F.col("user_id").cast("string").alias("username"), F.lit("sshd").alias("service"),
        F.lit("1").alias("attempts"),
        F.when(F.col("event_type") == "error", F.lit("failure")).otherwise(F.lit("success")).alias("status"),
        F.lit("22").alias("port"), F.lit("ssh2").alias("protocol"), F.lit(None).cast("string").alias("comment"),
        F.when((F.col("user_id") % 10 == 0) & (k < 60), F.lit("attack")).otherwise(F.lit("normal"))
        .alias("anomaly_label"),
        F.when(k % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("value") / F.lit(100.0)).alias("delta_t"))


def read_results_json(spark: SparkSession, path: str, schema: T.StructType = RESULT_SCHEMA) -> DataFrame:
    """Results as JSON lines, bare arrays or ``{"results": [...]}``
    documents, any number of them in a file, each on a line or over several.
    What is no document is left out here; ``read_documents`` also returns it. A
    missing path gives an empty frame with the schema."""
    return read_documents(spark, path, schema)[0]


def load_metrics_json(spark: SparkSession, path: str) -> DataFrame:
    """Metrics as JSON lines with a ``detector`` field, or one object
    ``{model: {accuracy, precision, ...}}``; -> one row per model. A bad file
    raises (errors are not swallowed)."""
    df = spark.read.option("multiLine", True).json(path)
    if "detector" in df.columns:
        return spark.read.json(path)
    models = df.columns
    fields = sorted({f.name for c in models for f in df.schema[c].dataType.fields})
    cols = [F.struct(F.lit(m).alias("detector"),
                     *[(F.col(f"`{m}`.`{f}`") if f in df.schema[m].dataType.fieldNames()
                        else F.lit(None)).cast("double").alias(f) for f in fields]) for m in models]
    return df.select(F.inline(F.array(*cols)))


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """A log written by ``sinks.write_event_log`` (keeps ``event_date``)."""
    return spark.read.parquet(path)


def read_jdbc_logs(spark: SparkSession, url: str, table: str, properties: dict,
                   partition_column: str = "id", num_partitions: int | None = None,
                   lower_bound: int | None = None, upper_bound: int | None = None,
                   kind: str = "app") -> DataFrame:
    """S1/S2 from a relational database: a partitioned JDBC read (one range of
    ``partition_column`` per task, so no single connection pulls the table),
    with Spark pushing the log filters and the column projection into SQL.
    Without bounds the table is read as one partition -- fine for small
    tables only. ``kind`` picks the app or the insider-threat column mapping.

    Not exercised in this repository's tests: no database may run here."""
    opts = dict(properties)
    if num_partitions and lower_bound is not None and upper_bound is not None:
        df = spark.read.jdbc(url, table, column=partition_column, lowerBound=lower_bound,
                             upperBound=upper_bound, numPartitions=num_partitions, properties=opts)
    else:
        df = spark.read.jdbc(url, table, properties=opts)
    if kind == "cert":
        return df.select(F.col("id").alias("event_id"), F.col("username").alias("user_id"),
                         F.lit(None).cast("string").alias("ip"), F.col("pc").alias("device"),
                         F.lit(None).cast("boolean").alias("success"), "activity",
                         F.col("event_time").cast("timestamp_ntz").alias("event_time"),
                         F.lit(None).cast("double").alias("rtt_ms"),
                         F.lit(None).cast("boolean").alias("is_attack"), F.lit("cert").alias("source"))
    attack = F.col("is_attack_ip") if "is_attack_ip" in df.columns else F.lit(None).cast("boolean")
    return df.select(F.col("id").alias("event_id"), F.col("username").alias("user_id"),
                     F.coalesce("ip_address", F.lit("UNKNOWN")).alias("ip"),
                     F.lit(None).cast("string").alias("device"), "success",
                     F.lit(None).cast("string").alias("activity"),
                     F.col("created_at").cast("timestamp_ntz").alias("event_time"),
                     F.lit(None).cast("double").alias("rtt_ms"), attack.alias("is_attack"),
                     F.lit(kind).alias("source"))
