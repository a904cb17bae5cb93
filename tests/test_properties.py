"""Property-based tests (hypothesis) on the pure-expression operators."""

import hashlib
import hmac
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gatewatch.functions.noise import pseudonymise, uniform
from gatewatch.functions.scalar import half_up
from gatewatch.operators import features as FT
from tests.conftest import canonical

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(st.lists(st.text(min_size=0, max_size=30), min_size=1, max_size=8), st.binary(min_size=1, max_size=80))
def test_hmac_matches_stdlib(spark, texts, key):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, ip string")
    got = [r[0] for r in pseudonymise(df, "ip", key).orderBy("i").select("ip").collect()]
    assert got == [hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts]


@SETTINGS
@given(st.lists(st.floats(min_value=-1e9, max_value=1e9, allow_nan=False), min_size=1, max_size=20))
def test_half_up_is_floor_plus_half(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    assert [r[0] for r in df.select(half_up("x")).collect()] == [math.floor(x + 0.5) for x in xs]


@SETTINGS
@given(st.lists(st.text(min_size=1, max_size=12), min_size=1, max_size=20, unique=True))
def test_uniform_strictly_inside_unit_interval(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    us = [r[0] for r in df.select(uniform("k", 42, "p")).collect()]
    assert all(0.0 < u < 1.0 for u in us)


@SETTINGS
@given(st.lists(st.sampled_from([True, False, None]), min_size=1, max_size=60),
       st.sampled_from([None, 1, 2, 5, 30]))
def test_longest_run_fold_equals_sequential_scan(spark, outcomes, pieces):
    rows = [(i, "u", "i", ok, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", False) for i, ok in enumerate(outcomes)]
    best = cur = 0
    for ok in outcomes:
        cur = cur + 1 if ok is False else 0
        best = max(best, cur)
    got = FT.consecutive_failed(canonical(spark, rows), pieces).collect()
    assert got[0]["consecutive_failed_attempts"] == best
