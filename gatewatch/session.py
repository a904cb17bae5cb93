"""SparkSession helpers shared by tests, bench and the query catalog."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "gatewatch") -> SparkSession:
    """Local/test session. On a cluster the launcher supplies its own session;
    operators never depend on anything set here except the UTC time zone."""
    master = master or os.environ.get("GATEWATCH_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GATEWATCH_DRIVER_MEMORY", "8g"))
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (what the cluster names). Only when it
    is unset on a ``local[...]`` master -- local runs and tests -- a fresh
    scratch folder is created and registered; on a cluster an unset value is
    an error, so lineage cuts never land on a machine-local disk.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc_dir = spark.sparkContext.getCheckpointDir()
    path = sc_dir or conf_dir
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                               "(checkpoints and intermediate tables must survive executor loss)")
        path = tempfile.mkdtemp(prefix="gatewatch-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not sc_dir:
        spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared folder for one written table."""
    import uuid

    base = shared_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def write_once(df, name: str):
    """``df`` as a Parquet table in the shared folder, read back: whatever uses it
    more than once computes it once, and a lost executor costs no more than a read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Lets go of what earlier work left on the driver: Spark drops the shuffles
    and broadcasts of frames that nothing refers to once the JVM has collected them,
    and the JVM gives back heap and compiled plans that it no longer needs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Shared:
    """A broadcast whose value may hold objects of this package. Spark pickles
    broadcasts by reference, so workers would need the package on their path;
    here the value travels by value, as functions do, and each worker builds it
    once, whatever the number of tasks."""

    def __init__(self, spark: SparkSession, value) -> None:
        self._sent = spark.sparkContext.broadcast({"raw": cloudpickle.dumps(value)})

    @property
    def value(self):
        held = self._sent.value
        if "value" not in held:
            held["value"] = cloudpickle.loads(held["raw"])
            del held["raw"]
        return held["value"]
