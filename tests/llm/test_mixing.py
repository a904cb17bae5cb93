import tracemalloc

import numpy as np
import pyarrow as pa

from gatewatch.llm import mixing

WORDS = {"a": "alpha beta gamma delta", "b": "uno dos tres cuatro"}


def made(spark, n=200):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        d = "a" if rng.random() < 0.7 else "b"
        rows.append((i, " ".join(rng.choice(WORDS[d].split(), rng.integers(5, 40))), d))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)


def replay(p, steps, least):
    """The rates of all documents after the steps, kept one by one."""
    r = was = np.ones(len(p))
    for *q, ahead in steps:
        r, was = np.maximum(least, r + ahead * (r - was) + p @ np.array(q)), r
    return r


def inverse_of(p, t):
    m = (p * t[:, None]).T @ p
    return np.linalg.inv(m + 1e-6 * np.trace(m) / p.shape[1] * np.eye(p.shape[1]))


def test_rates_meet_targets_and_equal_brute_force(spark):
    docs = made(spark)
    labelled = docs.selectExpr("doc_id", "lang AS domain").where("doc_id % 2 = 0")
    rows = mixing.document_rates(docs, labelled, {"a": 0.5, "b": 0.5}, least=1.0).toPandas().sort_values("doc_id")
    truth = dict(docs.select("doc_id", "lang").collect())
    assert all(rows.domain == [truth[i] for i in rows.doc_id])
    p, t = np.stack(rows.posterior), rows.n_tokens.to_numpy(float)
    totals = (rows.rate.to_numpy() * t) @ p
    assert abs(totals[0] / totals.sum() - 0.5) < 1e-3
    assert rows.rate.min() >= 1 and rows.copies.min() >= 1  # no document is thinned out
    target = np.full(2, 0.5) * (t @ p / 0.5).max()
    pull = p @ (inverse_of(p, t) @ (target - totals))
    assert (np.abs(pull[rows.rate > 1 + 1e-9]) < 1e-3).all()


def table_of(spark, seed, n=400):
    """Documents of four domains that the posteriors confuse."""
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.4] * 4, n).round(6)
    t = rng.integers(0, 500, n)
    rows = [(int(a), [float(x) for x in b]) for a, b in zip(t, p)]
    return p, t.astype(float), spark.createDataFrame(rows, "tokens long, posterior array<double>").repartition(3)


def test_projection_acts_and_the_optimum_holds(spark):
    """The conditions of the optimum: no pull on a rate above the bound, none upwards on one at it."""
    for seed, weights, share, least in ((1, [0.6, 0.4, 0.0, 0.0], 0.5, 0.0), (2, [0.7, 0.1, 0.1, 0.1], 0.8, 0.0), (3, [0.25, 0.25, 0.25, 0.25], 1.5, 1.0)):
        p, t, table = table_of(spark, seed)
        steps, info = mixing.fit_rates(table, weights, share * t.sum(), least, tolerance=1e-6, max_steps=30)
        got = table.select("tokens", "posterior", mixing.rate_of(table["posterior"], steps, least).alias("r")).toPandas()
        p, t, r = np.stack(got.posterior), got.tokens.to_numpy(float), got.r.to_numpy()
        assert np.allclose(r, replay(p, steps, least), atol=1e-9)
        target = np.array(weights) * share * t.sum()
        gap = lambda x: (target - (x * t) @ p) @ inverse_of(p, t) @ (target - (x * t) @ p)
        pull, low = p @ (inverse_of(p, t) @ (target - (r * t) @ p)), r <= least + 1e-9
        assert (np.abs(pull[~low]) < 0.02).all() and (pull[low] < 0.02).all(), (seed, np.abs(pull[~low]).max())
        assert gap(r) < 1e-2 * gap(np.ones(len(r)))
        if weights[-1] == 0:
            assert low.sum() > 100  # many rates reach 0


def test_resample_keeps_columns_and_counts(spark):
    docs = made(spark).selectExpr("doc_id", "text", "lang", "'x' AS _copy", "1 AS _TOKENS")
    labelled = docs.selectExpr("doc_id", "lang AS domain")
    got = mixing.resample(docs, labelled, {"a": 0.5, "b": 0.5})
    assert got.columns == docs.columns
    rates = mixing.document_rates(docs, labelled, {"a": 0.5, "b": 0.5}, least=1.0).select("doc_id", "copies").collect()
    assert dict(got.groupBy("doc_id").count().collect()) == {i: c for i, c in rates if c}
    again = mixing.resample(docs.repartition(7), labelled, {"a": 0.5, "b": 0.5})
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))


def test_nulls_empty_and_unlabelled(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (3, "alpha beta"), (3, "alpha beta")], "doc_id long, text string")
    none = spark.createDataFrame([(9, "a"), (None, "a"), (3, None)], "doc_id long, domain string")
    rows = mixing.document_rates(docs, none, {"a": 0.5, "b": 0.5}).collect()
    assert len(rows) == 4 and all(r.posterior == [0.5, 0.5] for r in rows)
    assert sorted(r.n_tokens for r in rows) == [0, 0, 2, 2]
    assert mixing.document_rates(docs.limit(0), none, {"a": 1.0}).collect() == []
    assert mixing.resample(docs.limit(0), none, {"a": 1.0}).collect() == []


def test_default_budget_keeps_documents_that_cannot_be_told_apart(spark):
    targets = {"a": 0.5, "b": 0.3, "c": 0.2}
    docs = made(spark, 60)
    none = spark.createDataFrame([(-1, "a")], "doc_id long, domain string")
    rows = mixing.document_rates(docs, none, targets).collect()
    assert len(rows) == 60 and all(r.rate == 1 and r.copies == 1 for r in rows)
    assert mixing.resample(docs, none, targets).count() == 60


def test_a_confused_domain_keeps_its_documents(spark):
    rows = [(100, [1.0, 0.0, 0.0])] * 5 + [(100, [0.0, 0.5, 0.5])] * 20 + [(100, [0.0, 0.45, 0.55]), (100, [0.0, 0.2, 0.8])]
    table = spark.createDataFrame(rows, "tokens long, posterior array<double>")
    steps, info = mixing.fit_rates(table, [0.5, 0.48, 0.02], least=1.0)
    got = table.select("tokens", "posterior", mixing.rate_of(table["posterior"], steps, 1.0).alias("r")).toPandas()
    p, t, r = np.stack(got.posterior), got.tokens.to_numpy(float), got.r.to_numpy()
    pull = p @ (inverse_of(p, t) @ (np.array(info["targets"]) - (r * t) @ p))
    assert r.min() >= 1 and (np.abs(pull[r > 1 + 1e-9]) < 0.05 * r.max()).all()  # b and c cannot be had apart: the optimum misses both
    assert info["totals"][0] / sum(info["totals"]) > 5 / 27


def test_many_short_texts_do_not_make_a_large_block():
    model = mixing.DomainModel(["a", "b"], np.random.default_rng(3).random(((1 << mixing.SLOT_BITS) + mixing.STATS, 2)), np.zeros(2))
    column = pa.array(["alpha beta", "uno dos tres"] * 5000 + [None, ""])
    tracemalloc.start()
    n, p = model.posteriors(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20
    assert n.tolist() == [2, 3] * 5000 + [0, 0]
    alone = [model.posteriors(pa.array([t]))[1][0] for t in ("alpha beta", "uno dos tres")]
    np.testing.assert_allclose(p[:10000].reshape(5000, 2, 2), np.broadcast_to(alone, (5000, 2, 2)), atol=1e-6)
