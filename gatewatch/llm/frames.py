"""Small DataFrame helpers of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gatewatch.session import scratch_path


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the cluster's shared folder: cuts the
    lineage, and survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
