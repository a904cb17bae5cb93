"""The release ledger: repeats are free and equal, states never share a draw, overspending raises."""
import pytest

from gatewatch.operators import anomaly as N
from gatewatch.operators import audit as A
from gatewatch.operators import releases as RL
from gatewatch.session import scratch_path
from tests.conftest import canonical


@pytest.fixture()
def log(spark):
    return canonical(spark, [(i, f"u{i % 40}", "i", i % 3 == 0, f"2024-01-{1 + i % 20:02d} 00:00:00", False) for i in range(2000)])


def noisy(df):
    return {r.user_id: r.noisy_count for r in df.collect()}


def test_repeat_is_free_and_equal_and_overspending_raises(spark, log):
    ledger = RL.Ledger(spark, scratch_path(spark, "ledger"), 1.0)
    assert ledger.spent() == 0.0 and ledger.table().collect() == []
    a, b = RL.release_counts(log, ledger, 0.5, 7), RL.release_counts(log, ledger, 0.5, 7)
    assert noisy(a) == noisy(b) and ledger.spent() == 0.5
    c = RL.release_counts(log, ledger, 0.5, 7, mechanism="gaussian", delta=1e-5)
    assert noisy(c) != noisy(a) and ledger.spent() == 1.0
    with pytest.raises(RL.BudgetSpent):
        RL.release_counts(log, ledger, 0.25, 7)
    assert noisy(RL.release_counts(log, ledger, 0.5, 7)) == noisy(a)  # what was bought stays
    assert RL.Ledger(spark, ledger.path, 1.0).spent() == 1.0
    with pytest.raises(ValueError):
        ledger.charge("laplace", "failed", "all", "s", 0.0)


def test_any_change_of_the_log_is_another_state(spark, log):
    states = [RL.state_name(x) for x in (
        log, log.where("event_id <> 5"), log.selectExpr("event_id", "if(event_id = 5, 'x', user_id) AS user_id", "ip", "device", "success",
                                                        "activity", "event_time", "rtt_ms", "is_attack", "source"),
        log.withColumn("success", log.success | (log.event_id == 1)), log.limit(0))]
    assert len(set(states)) == 5 and states[4] == "0|0|0"
    assert RL.state_name(log.repartition(7)) == states[0]


def test_noise_of_two_states_does_not_cancel(spark, log):
    old = log.where("event_time < '2024-01-20'")
    diff = []
    for x in (log, old):
        exact = {r.user_id: r["count"] for r in A.recent_failed_per_user(x, "60 days").collect()}
        got = noisy(N.dp_recent(x, 1.0, 3, "60 days", 42))
        diff.append({u: got[u] - exact[u] for u in exact})
    same = [u for u in diff[0] if u in diff[1] and diff[0][u] == diff[1][u]]
    assert len(same) < len(diff[1]) / 2
    flags = [{r.user_id: tuple(r) for r in N.detector_flags(x, 100, 42).collect()} for x in (log, log.repartition(5), old)]
    assert flags[0] == flags[1] and set(flags[2]) < set(flags[0])


def test_an_entry_that_another_driver_took_is_not_written_over(spark):
    ledger = RL.Ledger(spark, scratch_path(spark, "ledger"), 10.0)
    ledger.charge("laplace", "failed", "all", "s1", 1.0)
    real, calls = ledger.table, []

    def stale():  # the first look misses an entry that a second driver has just made
        calls.append(1)
        if len(calls) == 1:
            before = real().limit(0)
            return before
        return real()

    ledger.table = stale
    assert ledger.charge("laplace", "failed", "all", "s2", 1.0) == "failed|all|s2"
    assert sorted((r.entry, r.state) for r in real().collect()) == [(1, "s1"), (2, "s2")]
