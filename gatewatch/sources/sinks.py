"""Result sinks and publishers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

META_RESULT_COLUMNS = ["user_id", "failed_count", "login_freq", "unique_ips", "avg_rtt",
                       "meta_prob", "meta_pred", "is_attack_ip"]


def append_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append (meta results accumulate on each post)."""
    df.write.mode("append").format(fmt).save(path)


def replace_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Delete-all then insert == overwrite."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_split(df: DataFrame, path: str, fmt: str = "parquet", split_col: str = "split") -> None:
    """Persist both sides, partitioned by the split flag (CSV keeps a header)."""
    w = df.write.mode("overwrite").partitionBy(split_col)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def publish_meta(df: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Result-table schema; ``user_id`` as text; ``meta_pred`` is
    re-derived as ``meta_prob >= threshold`` (0.1 when published)."""
    return df.select(F.col("user_id").cast("string").alias("user_id"),
                     F.col("failed_count").cast("int"), F.col("login_freq").cast("int"),
                     F.col("unique_ips").cast("int"), F.col("avg_rtt").cast("double"),
                     F.col("meta_prob").cast("double"),
                     (F.coalesce(F.col("meta_prob"), F.lit(0.0)) >= F.lit(threshold)).cast("int").alias("meta_pred"),
                     F.col("is_attack_ip").cast("int"))


def publish_unsupervised(df: DataFrame) -> DataFrame:
    """``user_id, iso_pred, lof_pred, is_attack_ip`` with 0 defaults."""
    return df.select(F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("user_id"),
                     *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c)
                       for c in ("iso_pred", "lof_pred", "is_attack_ip")])


def write_event_log(le: DataFrame, path: str, mode: str = "append", files_per_date: int = 8) -> None:
    """Canonical login log partitioned by ``event_date``: recent-window
    filters (F3/F4) then prune to the last few date partitions. Rows are dealt
    by date and a salt first, so a date has at most ``files_per_date`` files."""
    (le.withColumn("event_date", F.to_date("event_time"))
     .repartition("event_date", F.pmod(F.xxhash64("event_id"), F.lit(files_per_date)))
     .write.mode(mode).partitionBy("event_date").parquet(path))
