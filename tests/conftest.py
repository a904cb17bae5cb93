import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from gatewatch.session import build_session, shared_dir

    s = build_session("local[4]", 8, app_name="gatewatch-tests")
    shared_dir(s)
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="gw-test-")


def canonical(spark, rows):
    """Small literal login_event frame: rows of
    (event_id, user_id, ip, success, event_time str, is_attack)."""
    from pyspark.sql import functions as F

    schema = "event_id bigint, user_id string, ip string, success boolean, t string, is_attack boolean"
    df = spark.createDataFrame(rows, schema)
    return df.select("event_id", "user_id", "ip", F.lit("d0").alias("device"), "success",
                     F.lit("Logon").alias("activity"), F.col("t").cast("timestamp_ntz").alias("event_time"),
                     F.lit(10.0).alias("rtt_ms"), "is_attack", F.lit("test").alias("source"))
