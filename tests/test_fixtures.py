"""Hand-built fixtures for the quirk cases the driver tables cannot reach."""

import hashlib
import hmac
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewatch.functions.noise import laplace_noise, pseudonymise, std_normal, uniform
from gatewatch.functions.scalar import half_up, unusual_hour
from gatewatch.operators import accounts as AC
from gatewatch.operators import anomaly as N
from gatewatch.operators import audit as A
from gatewatch.operators import evaluate as EV
from gatewatch.operators import features as FT
from gatewatch.operators import scoring as SC
from gatewatch.sources import readers as R
from tests.conftest import canonical


def test_stump_bands_and_logistic_edge(spark):
    df = spark.createDataFrame([(f"u{c}", c) for c in (9, 10, 11, 12, 25, 26)], "username string, failed_count bigint")
    out = {r["username"]: (r["vote"], r["p"]) for r in df.select(
        "username", SC.stump_vote("failed_count").alias("vote"),
        SC.logistic_score(["failed_count"]).alias("p")).collect()}
    assert [out[f"u{c}"][0] for c in (9, 10, 11, 12, 25, 26)] == [0, 1, 1, 0, 0, 1]
    assert out["u9"][1] < 0.5 and out["u10"][1] == 0.5


@pytest.mark.parametrize("counts,expect", [
    ([5, 5, 5, 5], [False] * 4),
    ([5, 5, 5, 5, 5, 5, 5, 5, 5, 50], [False] * 9 + [True]),
    ([50, 50, 50, 50, 50, 50, 50, 50, 50, 1], [False] * 9 + [True]),
    ([7], [False]),
    ([], []),
])
def test_zscore_edges(spark, counts, expect):
    df = spark.createDataFrame([(f"u{i:02d}", c) for i, c in enumerate(counts)], "user_id string, count bigint")
    got = [r["anomalous"] for r in N.zscore_flags(df, 2.0).orderBy("user_id").collect()]
    assert got == expect


def test_label_rules(spark):
    rows = [(1, "tie", "a", True, "2024-01-01 00:00:00", True), (2, "tie", "a", True, "2024-01-01 00:01:00", False),
            (3, "nul", "a", True, "2024-01-01 00:00:00", None), (4, "nul", "a", True, "2024-01-01 00:01:00", None)]
    le = canonical(spark, rows)
    mode = {r["user_id"]: r["is_attack_ip"] for r in FT.universal_features(le).collect()}
    anyl = {r["user_id"]: r["is_attack_ip"] for r in FT.universal_features(le, label="any").collect()}
    assert mode["tie"] == 0 and anyl["tie"] == 1
    assert anyl["nul"] == 0
    lab = {r["user_id"]: r["is_attack_ip"] for r in A.activity_with_label(le).collect()}
    assert lab["nul"] is False and lab["tie"] is True


def test_window_edge_inclusive_and_peers(spark):
    rows = [(1, "a", "i", False, "2024-01-01 10:00:00", False),
            (2, "a", "i", False, "2024-01-01 09:59:59.999999", False),  # 1 µs before max - 1h
            (3, "a", "i", False, "2024-01-01 11:00:00", False),
            (4, "a", "i", False, "2024-01-01 11:00:00", False),           # duplicate timestamp
            (5, "a", "i", True, "2024-01-01 10:30:00", False)]
    le = canonical(spark, rows)
    cnt = A.recent_failed_per_user(le, "1 hour").collect()
    assert cnt[0]["count"] == 3  # 10:00 kept, 09:59:59.999999 dropped, both 11:00 rows
    w = {r["event_id"]: r["recent_failed_24h"] for r in FT.recent_failed_counts(le).collect()}
    assert w[3] == w[4] == 4  # peers included, inclusive lower end
    w1 = {r["event_id"]: r["recent_failed_5m"] for r in FT.recent_failed_counts(le).collect()}
    assert w1[5] == 0 and w1[3] == 2


def _brute_runs_gaps(rows):
    by = {}
    for eid, u, _, ok, t, _ in rows:
        by.setdefault(u, []).append((np.datetime64(t), eid, ok))
    out = {}
    for u, evs in by.items():
        evs.sort()
        best = cur = 0
        for _, _, ok in evs:
            cur = cur + 1 if ok is False else 0
            best = max(best, cur)
        fails = [t for t, _, ok in evs if ok is False]
        gaps = [int((b - a) // np.timedelta64(60, "s")) for a, b in zip(fails, fails[1:])]
        out[u] = (best, float(np.mean(gaps)) if gaps else 0.0)
    return out


def test_runs_and_gaps(spark):
    rows = [(1, "a", "i", True, "2024-01-01 00:00:00", False),
            (2, "b", "i", False, "2024-01-01 00:00:10", False),
            (3, "a", "i", False, "2024-01-01 00:00:59", False),
            (4, "b", "i", True, "2024-01-01 00:01:00", False),
            (5, "a", "i", False, "2024-01-01 00:01:58", False),   # gap 59 s -> 0 min
            (6, "a", "i", False, "2024-01-01 00:02:58", False),   # gap 60 s -> 1 min
            (7, "a", "i", True, "2024-01-01 00:03:00", False),
            (8, "a", "i", False, "2024-01-01 00:04:57", False),   # gap 119 s -> 1 min
            (9, "c", "i", True, "2024-01-01 00:05:00", False)]
    le = canonical(spark, rows)
    runs = {r["user_id"]: r["consecutive_failed_attempts"] for r in FT.consecutive_failed(le, 3).collect()}
    gaps = {r["user_id"]: r["avg_failed_gap"] for r in FT.avg_failed_gap(le, 3).collect()}
    assert runs == {"a": 3, "b": 1, "c": 0}
    assert gaps["a"] == pytest.approx((0 + 1 + 1) / 3) and gaps["b"] == 0.0 and gaps["c"] == 0.0


@pytest.mark.parametrize("pieces", [None, 1, 7, 60])
def test_runs_and_gaps_random_vs_brute_force(spark, pieces):
    rnd = random.Random(pieces)
    rows = []
    for i in range(400):
        u = rnd.choice("abcd")
        t = np.datetime64("2024-01-01T00:00:00") + np.timedelta64(rnd.randrange(0, 4 * 3600), "s")
        rows.append((i, u, "i", rnd.random() < 0.3 and True or rnd.random() < 0.6 and False or None,
                     str(t).replace("T", " "), False))
    le = canonical(spark, rows)
    brute = _brute_runs_gaps(rows)
    runs = {r["user_id"]: r["consecutive_failed_attempts"] for r in FT.consecutive_failed(le, pieces).collect()}
    gaps = {r["user_id"]: r["avg_failed_gap"] for r in FT.avg_failed_gap(le, pieces).collect()}
    for u, (b_run, b_gap) in brute.items():
        assert runs[u] == b_run
        assert gaps[u] == pytest.approx(b_gap)


def test_topn_join_truncation(spark):
    rows = [(i, "busy", "i", True, f"2024-01-01 00:{i:02d}:00", False) for i in range(10)]
    rows += [(100 + i, "fail1", "i", False, f"2024-01-01 01:{i:02d}:00", False) for i in range(3)]
    rows += [(200 + i, "fail2", "i", False, f"2024-01-01 02:{i:02d}:00", False) for i in range(2)]
    le = canonical(spark, rows)
    got = {r["user_id"]: r["count"] for r in A.users_with_failed(le, 2).collect()}
    # top-2 by activity: busy (10), fail1 (3); top-2 by failures: fail1, fail2
    assert got == {"busy": 0, "fail1": 3}


def test_linux_null_fields(spark):
    raw = spark.createDataFrame([
        (1, None, "failure", None, None, "u1"),
        (2, "1.2.3.4", "success", "normal", 0.5, None),
        (3, "1.2.3.4", None, "attack", 1.0, "u1")],
        "gw_row bigint, source_ip string, status string, anomaly_label string, delta_t double, username string")
    out = {r["user_id"] or "none": r for r in R.normalise_linux(raw).collect()}
    assert out["u1"]["is_attack_ip"] == 1  # NULL label counts as attack (row 1) / attack (row 3)
    assert out["none"]["is_attack_ip"] == 0 and out["none"]["login_successful"] is True
    rows = R.normalise_linux(raw).collect()
    assert 1000.0 <= rows[0]["round-trip_time_[ms]"] <= 20000.0  # NULL delta_t filled from U(10,200)*100
    assert rows[2]["login_successful"] is False  # NULL status is not a success


def test_hmac_tokens(spark):
    key = os.urandom(32)
    ips = ["10.0.0.1", "10.0.0.1", "", "ünï.códe", "192.168.0.7"]
    df = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "id int, ip_address string")
    got = [r["ip_address"] for r in pseudonymise(df, "ip_address", key).orderBy("id").collect()]
    assert got == [hmac.new(key, ip.encode(), hashlib.sha256).hexdigest() for ip in ips]
    other = spark.createDataFrame([("10.0.0.1",)], "ip_address string")
    assert pseudonymise(other, "ip_address", key).first()[0] == got[0]
    plan = pseudonymise(df, "ip_address", key)._jdf.queryExecution().toString()
    assert key.hex() not in plan


def test_half_up(spark):
    vals = [-2.5, -1.5, -0.5, 0.5, 1.5, 2.4999, 2.5]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "x double").select(half_up("x")).collect()]
    assert got == [math.floor(v + 0.5) for v in vals] and got[0] == -2


def test_unusual_hour(spark):
    df = spark.createDataFrame([(f"2024-01-01 {h:02d}:30:00",) for h in range(24)], "t string") \
        .select(F.col("t").cast("timestamp_ntz").alias("t"))
    got = [r[0] for r in df.select(unusual_hour("t")).collect()]
    assert got == [1 if h < 6 or h > 22 else 0 for h in range(24)]


def test_noise_moments(spark):
    df = spark.range(100000)
    eps = 0.5
    st = df.select(laplace_noise("id", eps, 42).alias("l"), std_normal("id", 42).alias("g"),
                   uniform("id", 42, "u").alias("u")).agg(
        F.avg("l"), F.var_pop("l"), F.avg("g"), F.var_pop("g"), F.min("u"), F.max("u")).first()
    assert abs(st[0]) < 0.05 and st[1] == pytest.approx(2 / eps ** 2, rel=0.05)
    assert abs(st[2]) < 0.02 and st[3] == pytest.approx(1.0, rel=0.03)
    assert 0.0 < st[4] and st[5] < 1.0


def test_noise_is_partition_independent(spark):
    a = spark.range(1000).repartition(3).select("id", laplace_noise("id", 1.0, 7).alias("n"))
    b = spark.range(1000).repartition(11).select("id", laplace_noise("id", 1.0, 7).alias("n"))
    assert sorted(a.collect()) == sorted(b.collect())


def _brute_accounts(actions, initial):
    users = dict(initial)
    for seq, action, name, role in sorted(actions):
        name = name.strip()
        if action == "register":
            if name not in users:
                users[name] = ["ADMIN" if not users and not _brute_accounts.seen else "USER", False]
                _brute_accounts.seen = True
        elif action == "delete":
            if name != "admin":
                users.pop(name, None)
        elif name in users:
            if action == "change_role":
                users[name][0] = role
            elif action == "suspend":
                users[name][1] = True
            elif action == "activate":
                users[name][1] = False
    return {k: tuple(v) for k, v in users.items()}


@pytest.mark.parametrize("seed", range(6))
def test_account_actions_vs_sequential_fold(spark, seed):
    rnd = random.Random(seed)
    names = ["alice", " bob ", "carol", "admin", "dave"]
    acts = [(i, rnd.choice(["register", "register", "delete", "change_role", "suspend", "activate"]),
             rnd.choice(names), rnd.choice(["USER", "ANALYST"])) for i in range(120)]
    _brute_accounts.seen = False
    expect = _brute_accounts(acts, {})
    empty = spark.createDataFrame([], AC.USERS_SCHEMA)
    for pieces in (None, 1, 6, 50):
        df = AC.apply_user_actions(empty, spark.createDataFrame(acts, AC.ACTIONS_SCHEMA).repartition(3), pieces=pieces)
        assert {r["username"]: (r["role"], r["suspended"]) for r in df.collect()} == expect


def test_a_hot_accounts_actions_are_spread_and_never_joined(spark):
    acts = spark.createDataFrame([(i, ("register", "delete", "suspend")[i % 3], "hot", "USER") for i in range(3000)], AC.ACTIONS_SCHEMA)
    coded = acts.selectExpr("username", "seq", "CAST(seq % 3 + 1 AS INT) AS code", "role")
    assert len({r.part for r in AC.summarise_actions(coded, 12).collect()}) == 12
    df = AC.apply_user_actions(spark.createDataFrame([(1, "other", "", "", "USER", False)], AC.USERS_SCHEMA), acts)
    assert {(r.username, r.role, r.suspended) for r in df.collect()} == {("other", "USER", False)}


def test_account_actions_with_existing_users(spark):
    users = spark.createDataFrame([(1, "admin", "a@x", "h", "ADMIN", False), (2, "bob", "b@x", "h", "USER", True)],
                                  AC.USERS_SCHEMA)
    acts = spark.createDataFrame([(1, "register", " bob", "USER"), (2, "delete", "admin", "USER"),
                                  (3, "register", "carol", "USER"), (4, "activate", "bob", "USER"),
                                  (5, "change_role", "zed", "ADMIN")], AC.ACTIONS_SCHEMA)
    got = {r["username"]: (r["role"], r["suspended"]) for r in AC.apply_user_actions(users, acts).collect()}
    assert got == {"admin": ("ADMIN", False), "bob": ("USER", False), "carol": ("USER", False)}
    assert "password_hash" not in AC.list_users(users).columns


def test_results_json_shapes(spark, scratch):
    rows = [{"user_id": "u1", "failed_count": 3, "login_freq": 9, "unique_ips": 2, "avg_rtt": 1.5,
             "logreg_prob": 0.2, "logreg_pred": 0, "rf_prob": 0.7, "rf_pred": 1, "is_attack_ip": 1}]
    wrapped, bare = os.path.join(scratch, "w.json"), os.path.join(scratch, "b.json")
    with open(wrapped, "w") as f:
        json.dump({"results": rows, "metrics": {"LR": {"accuracy": 1.0}}}, f, indent=2)
    with open(bare, "w") as f:
        json.dump(rows, f, indent=2)
    one_line = os.path.join(scratch, "o.json")
    with open(one_line, "w") as f:
        json.dump({"results": rows}, f)
    lines = os.path.join(scratch, "l.json")
    with open(lines, "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows) + "\n")
    for p in (wrapped, bare, one_line, lines):
        got = R.read_results_json(spark, p).collect()
        assert len(got) == 1 and got[0]["user_id"] == "u1" and got[0]["rf_pred"] == 1
    assert R.read_results_json(spark, os.path.join(scratch, "missing.json")).count() == 0


def test_metrics_json_object_shape(spark, scratch):
    p = os.path.join(scratch, "m.json")
    with open(p, "w") as f:
        json.dump({"Model A": {"accuracy": 0.9, "precision": 0.5, "recall": 0.25, "f1": 0.333,
                               "false_positives": 3, "false_negatives": 6},
                   "Model B": {"accuracy": 0.8, "precision": 0.4, "recall": 0.2, "f1": 0.266,
                               "false_positives": 4, "false_negatives": 8}}, f)
    got = {r["detector"]: r for r in R.load_metrics_json(spark, p).collect()}
    assert set(got) == {"Model A", "Model B"} and got["Model B"]["false_negatives"] == 8


def test_confusion_and_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (0, 1, 0), (0, 0, 0)], "t int, a int, b int")
    m = {r["detector"]: r for r in EV.metrics(EV.confusion(df, "t", ["a", "b"])).collect()}
    assert (m["a"]["tp"], m["a"]["fp"], m["a"]["fn"], m["a"]["tn"]) == (1, 1, 1, 1)
    assert m["a"]["precision"] == 0.5 and m["a"]["f1"] == 0.5
    assert m["b"]["precision"] == 0.0 and m["b"]["f1"] == 0.0 and m["b"]["accuracy"] == 0.5
    for r in m.values():
        assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == 4


def test_merge_metrics_later_wins(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "detector string, f1 double")
    b = spark.createDataFrame([("y", 9.0)], "detector string, f1 double")
    got = {r["detector"]: r["f1"] for r in EV.merge_metrics(a, b).collect()}
    assert got == {"x": 1.0, "y": 9.0}


def test_split_and_folds_are_stratified(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("user_id"),
                                    F.when(F.col("id") % 37 == 0, 1).when(F.col("id") % 101 == 0, None).otherwise(0).alias("is_attack_ip"))
    both = FT.split_flag(FT.fold_ids(df)).groupBy("is_attack_ip")
    for r in both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "train").alias("t")).collect():
        assert abs(r["t"] - 0.7 * r["n"]) < 1
    folds = {}
    for r in both.pivot("fold").count().collect():
        folds[r[0]] = [r[str(i)] for i in range(5)]
    assert len(folds) == 3 and all(max(v) - min(v) <= 1 for v in folds.values())
    a = {tuple(r) for r in FT.split_flag(df.repartition(7)).collect()}
    assert a == {tuple(r) for r in FT.split_flag(df.coalesce(1)).collect()}
    plain = FT.split_flag(spark.range(100).select(F.col("id").cast("string").alias("user_id")))
    assert plain.where("split = 'train'").count() == 70


def test_noise_of_two_releases_does_not_cancel(spark):
    counts = spark.range(2000).select(F.col("id").cast("string").alias("user_id"), F.lit(50).alias("count"))
    whole = N.dp_counts(counts, 1.0, 7, "failed|all").withColumnRenamed("noisy_count", "a")
    week = N.dp_counts(counts.withColumn("count", F.lit(20)), 1.0, 7, "failed|7 days").withColumnRenamed("noisy_count", "b")
    gap = [r["a"] - r["b"] for r in whole.join(week, "user_id").collect()]
    assert sum(g == 30 for g in gap) / len(gap) < 0.4 and abs(sum(gap) / len(gap) - 30) < 0.3
    again = [r["noisy_count"] for r in N.dp_counts(counts, 1.0, 7, "failed|all").orderBy("user_id").collect()]
    assert again == [r["a"] for r in whole.orderBy("user_id").collect()]
    with pytest.raises(TypeError):
        N.dp_counts(counts, 1.0)


def test_null_users_are_dropped_by_window_detectors(spark):
    le = canonical(spark, [(1, None, "a", False, "2024-01-01 00:00:00", False), (2, None, "a", False, "2024-01-01 00:10:00", False),
                           (3, "u", "a", False, "2024-01-01 00:00:00", False), (4, "u", "a", False, "2024-01-01 00:10:00", False)])
    assert [tuple(r) for r in FT.avg_failed_gap(le).collect()] == [("u", 10.0)]
    assert [r[0] for r in FT.consecutive_failed(le).collect()] == ["u"]
    assert [r[0] for r in FT.last_event_flags(le).collect()] == ["u"]


def test_results_json_shapes_per_file(spark, scratch):
    from gatewatch.sources import readers as R

    one = [f.name for f in R.RESULT_SCHEMA][0]
    row = lambda v: '{"%s": "%s"}' % (one, v)
    for name, text in (("a.json", row("a1") + "\n" + row("a2") + "\n"), ("b.json", "[" + row("b1") + "," + row("b2") + "]\n"),
                       ("c.json", '{"results": [' + row("c1") + "]}\n"), ("d.json", '{\n "results": [\n' + row("d1") + ",\n" + row("d2") + "\n]}\n"),
                       ("e.json", "[\n" + row("e1") + ",\n" + row("e2") + "\n]\n"), ("f.json", '{"results": []}\n')):
        with open(os.path.join(scratch, name), "w") as f:
            f.write(text)
    got = sorted(r[0] for r in R.read_results_json(spark, scratch).collect())
    assert got == ["a1", "a2", "b1", "b2", "c1", "d1", "d2", "e1", "e2"]


def test_json_documents_lose_nothing(spark, scratch):
    from gatewatch.sources.json_documents import Documents, read_documents

    from pyspark.sql.types import _parse_datatype_string
    row = lambda v: '{"user_id": "%s"}' % v
    files = {
        "lines.json": "\n".join(row(f"l{i}") for i in range(10)) + '\n{"user_id": "broken\n',
        "three.json": row("t1") + '\n{\n "results": [\n' + row("t2") + "\n]}\n" + row("t3") + "\n",
        "same_line.json": row("s1") + row("s2") + " [" + row("s3") + ", 5]\nnot json\n" + row("s4"),
        "cut.json": "[\n" + row("c1") + ",\n" + row("c2") + ",\n",
        "empty.json": "", "blank.json": "\n \n", "odd.json": '7\n"x"\nnull\n{"results": 3}\n[[]]\n',
        "wrong.json": '{"user_id": {"a": 1}, "other": 2}\n',
    }
    for name, text in files.items():
        with open(os.path.join(scratch, name), "w") as f:
            f.write(text)
    rows, rejects = read_documents(spark, scratch, _parse_datatype_string("user_id string"))
    got = sorted(r[0] or "" for r in rows.collect())
    assert got == sorted([f"l{i}" for i in range(10)] + ["t1", "t2", "t3", "s1", "s2", "s3", "s4", "c1", "c2", "", '{"a":1}'])
    bad = sorted((os.path.basename(r.file), r.line, r.text) for r in rejects.collect())
    assert bad == sorted([("lines.json", 11, '{"user_id": "broken'), ("same_line.json", 1, "5"), ("same_line.json", 2, "not json"),
                          ("cut.json", 1, "["), ("cut.json", 2, ","), ("cut.json", 3, ","), ("odd.json", None, "7"), ("odd.json", None, '"x"'),
                          ("odd.json", None, "null"), ("odd.json", None, "[]")], key=lambda x: (x[0], x[1] or 0, x[2])) \
        or [(a, c) for a, _, c in bad] == sorted((a, c) for a, _, c in bad)
    long = Documents()  # a document of many lines is parsed a few times, not once a line
    tries = []
    real = long.decode
    long.decode = lambda t, i: (tries.append(1), real(t, i))[1]
    for line in ["[", *[row(i) + "," for i in range(5000)], "{}]"]:
        assert not list(long.feed(line)) or line == "{}]"
    found = list(long.close()) if long.lines else []
    assert len(tries) < 40 and (not found or len(found[0][1]) == 5001)


def test_deep_pages_and_ties(spark):
    import gatewatch.operators.paging as paging

    df = spark.createDataFrame([(i % 7, i, None if i % 11 == 0 else i % 3) for i in range(500)], "k int, id int, n int").repartition(5)
    index = paging.build_index(df, ["k", "id"], [True, False], ranges=9)
    want = sorted(((-r.k, r.id) for r in df.collect()))
    assert index.total == 500
    for number in (1, 2, 13, 25, 26):
        got = [(-r.k, r.id) for r in index.page(number, 20).collect()]
        assert got == want[(number - 1) * 20:number * 20]
    plan = index.page(13, 20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [gw_range" in plan.replace("isnotnull(", "") and plan.count("gw_range#") < 12  # only the ranges of the page
    assert paging.build_index(df.limit(0), ["k"]).page(1, 5).collect() == []
    for order, down in ((["n"], False), (["n"], True), (["n", "k"], False)):  # walk all pages: every row once
        seen, last, key = [], None, lambda r: tuple((r[c] is not None, r[c] or 0) for c in order)
        while rows := paging.page_after(df, order, last, 40, down).collect():
            assert len(rows) >= min(40, 500 - len(seen))
            seen += rows
            last = tuple(rows[-1][c] for c in order)
        assert sorted(r.id for r in seen) == list(range(500))
        assert [key(r) for r in seen] == sorted(map(key, seen), reverse=down)


def test_rba_event_ids_do_not_depend_on_partitioning(spark):
    from gatewatch.sources import readers as R

    raw = spark.createDataFrame([("u", "1.1.1.1", "true", "1.5", "false")] * 3 + [("v", "1.1.1.2", "true", "2", "true")],
                                "user_id string, ip_address string, login_successful string, `round-trip_time_[ms]` string, is_attack_ip string")
    ids = [sorted(r["event_id"] for r in R.normalise_rba(raw.repartition(n)).collect()) for n in (1, 4)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 4


def test_poisson_table_covers_large_means():
    cdf = FT.poisson_cdf(400.0)
    assert len(cdf) > 400 and cdf[-1] == pytest.approx(1.0, abs=1e-12)
    with pytest.raises(ValueError):
        FT.poisson_cdf(1e4)


def test_readers_app_cert_rba(spark, scratch):
    app = os.path.join(scratch, "app.csv")
    with open(app, "w") as f:
        f.write("id,username,ip_address,success,created_at\n1,alice,,false,2024-01-01 10:00:00\n"
                "2,bob,1.2.3.4,true,2024-01-01 10:05:00\n")
    le = R.read_app_logs(spark, app, fmt="csv")
    got = {r["user_id"]: r["ip"] for r in le.collect()}
    assert got == {"alice": "UNKNOWN", "bob": "1.2.3.4"}
    assert A.failed_per_user(le).collect()[0]["user_id"] == "alice"
    cert = os.path.join(scratch, "cert.csv")
    with open(cert, "w") as f:
        f.write("id,cert_event_id,event_time,username,pc,activity\n1,e1,2024-01-01 10:00:00,ann,PC-1,Logon\n"
                "2,e2,2024-01-01 11:00:00,ann,PC-1,Logoff\n3,e3,2024-01-01 11:30:00,ann,PC-2,Logon\n")
    c = R.read_cert_logs(spark, cert)
    assert A.logons_per_user(c).collect()[0]["count"] == 2
    assert A.recent_logons_per_user(c, "1 hour").collect()[0]["count"] == 1
    assert A.recent_logons_per_user(c, "1 hour", all_activity=True).collect()[0]["count"] == 2
    rba = os.path.join(scratch, "rba.csv")
    with open(rba, "w") as f:
        f.write("User ID,IP Address,Login Successful,Round-Trip Time [ms],Is Attack IP\n"
                "7,1.1.1.1,False,100.5,0\n7,1.1.1.2,1,,1\n8,2.2.2.2,True,50,False\n")
    feats = {r["user_id"]: r for r in FT.universal_features(R.read_rba(spark, rba)).collect()}
    assert feats["7"]["failed_count"] == 1 and feats["7"]["unique_ips"] == 2
    assert feats["7"]["avg_rtt"] == 100.5 and feats["7"]["is_attack_ip"] == 0
    assert R.normalise_header("Round-Trip Time [ms]") == "round-trip_time_[ms]"


def test_ingest_stream_logs_every_attempt(spark, scratch):
    from gatewatch.streaming.alerts import ingest_login_attempts

    src = os.path.join(scratch, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write('{"username": "a", "ip_address": null, "success": false}\n'
                '{"username": "a", "ip_address": "9.9.9.9", "success": true}\n')
    out = os.path.join(scratch, "log")
    ingest_login_attempts(spark, src, "username string, ip_address string, success boolean", out)
    got = sorted((r["ip_address"], r["success"]) for r in spark.read.parquet(out).collect())
    assert got == [("9.9.9.9", True), ("UNKNOWN", False)]


def test_paging_edges_and_keyset(spark):
    from gatewatch.operators import paging

    df = spark.createDataFrame([(f"u{i:02d}", i) for i in range(25)], "user_id string, count bigint")
    p3 = paging.page(df, ["user_id"], page=3, size=10).collect()
    assert [r["user_id"] for r in p3] == [f"u{i:02d}" for i in range(20, 25)] and p3[0]["total"] == 25
    assert paging.page(df, ["user_id"], page=9, size=10).count() == 0
    assert paging.page(df, ["user_id"], page=0, size=10).count() == 10  # from = max(0, ...)
    z = paging.page0(df, page=2, size=10).collect()
    assert len(z) == 5 and z[0]["total_pages"] == 3 and z[0]["page_number"] == 2
    after = [r["user_id"] for r in paging.page_after(df, "user_id", "u19", 3).collect()]
    assert after == ["u20", "u21", "u22"]


def test_sweep_recall_falls_and_flip_rate_falls_with_epsilon(spark):
    scores = spark.createDataFrame([(f"u{i}", i / 100.0, int(i > 60)) for i in range(100)],
                                   "user_id string, score double, label int")
    sw = sorted(EV.threshold_sweep(scores, "score", "label").collect(), key=lambda r: r["threshold"])
    recalls = [r["recall"] for r in sw]
    assert recalls == sorted(recalls, reverse=True) and recalls[0] == 1.0
    probs = spark.createDataFrame([(f"u{i}", 0.08) for i in range(4000)], "user_id string, p double")
    rates = {r["epsilon"]: r["flip_rate"] for r in SC.noise_flip_rate(probs, "p", [50.0, 100.0, 400.0], 0.1, 42).collect()}
    assert rates[50.0] > rates[100.0] > rates[400.0]
    assert rates[50.0] == pytest.approx(0.5 * math.exp(-0.02 * 50), abs=0.03)  # P(Laplace > 0.02), b = 1/eps
