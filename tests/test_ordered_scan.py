"""Scans in time order: any number of pieces, hot users, ties across borders."""
import random

import numpy as np
import pytest

from gatewatch.operators import features as FT
from gatewatch.operators import ordered_scan as scan
from tests.conftest import canonical

DAY = 86_400_000_000
WIDTHS = {"w1": 60, "w2": 3600, "w3": 86400}


def brute_recent(rows, widths):
    """(user, event) -> counts, for rows (user, event, us, f)."""
    out = {}
    for u, e, t, _ in rows:
        mine = [x for v, _, x, f in rows if v == u and f]
        out[u, e] = tuple(sum(t - w * 1_000_000 <= x <= t for x in mine) for w in widths.values())
    return out


def made(seed, n=500, users="ab", span=DAY, step=1):
    rng = random.Random(seed)
    return [(rng.choice([*users, None]), i, rng.randrange(0, span, step), rng.random() < 0.4) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_id string, event_id long, us long, f boolean").repartition(4)


@pytest.mark.parametrize("pieces", [None, 1, 2, 9, 40])
@pytest.mark.parametrize("case", ["spread", "ties", "dense", "two days"])
def test_recent_counts_equal_brute_force(spark, pieces, case):
    rows = {"spread": made(1), "ties": made(2, step=DAY // 6), "dense": made(3, span=90_000_000), "two days": made(4, span=3 * DAY)}[case]
    got = {(r.user_id, r.event_id): (r.w1, r.w2, r.w3) for r in scan.recent_counts(frame(spark, rows), WIDTHS, pieces).collect()}
    want = brute_recent(rows, WIDTHS)
    assert got == want
    tops = {r.user_id: (r.w1, r.w2, r.w3) for r in scan.recent_counts(frame(spark, rows), WIDTHS, pieces, (), peaks=True).collect()}
    assert tops == {u: tuple(max(c[i] for (v, _), c in want.items() if v == u) for i in range(3)) for u in ["a", "b", None]}


def test_one_user_of_one_day_is_spread_over_all_tasks(spark):
    rng = random.Random(5)
    rows = [("u", i, rng.randrange(DAY), rng.random() < 0.5) for i in range(8000)]
    df = frame(spark, rows)
    runs = scan.run_summaries(df, 16).collect()
    assert len({r.part for r in runs}) == 16 and max(r.len for r in runs) < 8000 / 16 * 3
    got = {r.event_id: (r.w1, r.w2, r.w3) for r in scan.recent_counts(df, WIDTHS, 16).collect()}
    t = np.array([r[2] for r in rows])
    fails = np.sort(t[[r[3] for r in rows]])
    for i, x in enumerate(t.tolist()):
        upto = np.searchsorted(fails, x, "right")
        assert got[i] == tuple(int(upto - np.searchsorted(fails, x - w * 1_000_000)) for w in WIDTHS.values())


def test_one_user_of_one_instant(spark):
    rows = [("u", i, 5, i % 3 > 0) for i in range(900)] + [("v", 1000, 5, True)]
    got = {r.event_id: (r.w1, r.w2, r.w3) for r in scan.recent_counts(frame(spark, rows), WIDTHS, 8).collect()}
    assert got == {**{i: (600, 600, 600) for i in range(900)}, 1000: (1, 1, 1)}


def test_empty_and_timeless(spark):
    assert scan.recent_counts(frame(spark, []), WIDTHS).collect() == []
    assert scan.run_summaries(frame(spark, [])).collect() == []
    le = canonical(spark, [(1, "a", "i", False, None, False), (2, "a", "i", False, "2024-01-01 00:00:00", False)])
    got = {r.event_id: r.recent_failed_5m for r in FT.recent_failed_counts(le).collect()}
    assert got == {1: None, 2: 1}
    assert [tuple(r) for r in FT.consecutive_failed(le).collect()] == [("a", 2)]
    assert [tuple(r) for r in FT.avg_failed_gap(le).collect()] == [("a", 0.0)]


def test_keys_of_far_apart_times():
    """Users whose spans do not fit one key space together."""
    far = 1 << 61
    t = np.array([0, 5, far, 0, far, 3, 4], np.int64)
    start = np.array([0, 3, 5])
    f = np.array([True, True, True, True, True, False, True])
    (n,) = scan.count_before(t, f, start, [t + 1])
    assert n.tolist() == [1, 2, 3, 1, 2, 0, 1]
