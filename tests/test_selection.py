"""Ranks found by refining histograms equal those of a sort."""
import random

import pytest

from gatewatch.operators import features as FT


@pytest.mark.parametrize("step_bits,bucket_rows", [(16, 200_000), (3, 5), (13, 1)])
def test_selection_equals_sorting(spark, step_bits, bucket_rows):
    rng = random.Random(step_bits)
    rows = [(f"k{i}", rng.choice(["a", "b", None]), rng.randrange(1 << 52) >> rng.choice([0, 20, 40])) for i in range(600)]
    df = spark.createDataFrame(rows, "id string, gw_l string, gw_v long").repartition(5)
    wanted = lambda n: [0, 1, n // 3, n // 3, n]
    got = FT.select_ranks(df, "id", wanted, step_bits, bucket_rows)
    for lab in ("a", "b", None):
        mine = sorted((v, k) for k, x, v in rows if x == lab)
        assert got[lab] == [None if r == 0 else mine[r - 1] for r in wanted(len(mine))]
    assert FT.select_ranks(df.limit(0), "id", wanted) == {}


def test_split_and_folds_rank_no_row(spark):
    df = spark.range(3000).selectExpr("CAST(id AS STRING) AS user_id", "IF(id % 10 = 0, NULL, CAST(id % 3 = 0 AS INT)) AS is_attack_ip",
                                      "id AS gw_below_", "1 AS split_")
    for out in (FT.split_flag(df), FT.fold_ids(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Exchange hashpartitioning" not in plan and out.columns[:-1] == df.columns
    folds = FT.fold_ids(df, k=7).groupBy("is_attack_ip", "fold").count().collect()
    for lab in {r.is_attack_ip for r in folds}:
        sizes = [r["count"] for r in folds if r.is_attack_ip == lab]
        assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1
    assert FT.split_flag(df.limit(0)).collect() == [] and FT.fold_ids(df.limit(0)).collect() == []
    assert [r.split for r in FT.split_flag(df.limit(1)).collect()] == ["train"]
