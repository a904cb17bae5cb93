import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gatewatch.llm import toxicity as tx
from gatewatch.llm.queries import may_learn


def made(spark, n=1500):
    rng = random.Random(2)
    rows, truth = [], {}
    for i in range(n):
        bad = rng.random() < 0.2
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(3, 60))]
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["scumX", "VILE", "xyzzy" + str(rng.randrange(99))])
        rows.append((i, " ".join(words)))
        truth[i] = int(bad)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, t) for i, t in truth.items() if i % 2], "doc_id long, toxic int")
    return docs, labels, truth


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels, truth = made(spark)
    model = tx.train(docs, labels, may_learn)
    rows = tx.score_toxicity(docs, model).withColumn("held", ~may_learn(F.col("doc_id"))).collect()
    held = [r for r in rows if r.held]
    assert sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held) / len(held) > 0.97
    flipped = labels.withColumn("toxic", F.when(may_learn(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    again = tx.score_toxicity(docs, tx.train(docs, flipped, may_learn)).collect()
    assert sorted(rows and [(r.doc_id, r.score) for r in rows]) == sorted((r.doc_id, r.score) for r in again)


def test_scores_equal_a_plain_sum():
    feature = np.full(1 << tx.SLOT_BITS, -1, np.int16)
    texts = ["Vile words, vile!", "nothing", "", None, "vileness" * 100_000]
    slots = [np.unique(s).tolist() for s in ([], [], [], [], [])]
    for n, row, slot in tx.word_slots(pa.array(["vile", "word"])):
        feature[slot[row == 0]] = 0
        feature[slot[row == 1]] = 1
    model = tx.ToxicModel(feature, np.array([2.0, 0.5]), -1.0)
    z = [2.0 + 0.5 - 1, -1, -1, -1, 2.0 - 1]  # "vile" and its beginnings share weight 0, "words" begins as "word" does
    assert slots and np.allclose(model.score(pa.array(texts)), 1 / (1 + np.exp(-np.array(z))))


def test_risk_is_not_fitted_below_zero():
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.3
    x = np.c_[(rng.random(2000) < np.where(y, 0.9, 0.05)), (rng.random(2000) < 0.5)].astype(float)
    w, b = tx.fit_nnpu(x[y][:300], x, 0.3)
    assert (((x @ w + b) > 0) == y).mean() > 0.9


def test_defined_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (None, "", 1), (3, "a b", 2), (3, "a b", 2)], "doc_id long, text string, score int")
    none = spark.createDataFrame([(1, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    rows = tx.score_toxicity(docs, tx.train(docs, none)).collect()
    assert [r.score for r in rows] == [0.0] * 4
    model = tx.train(docs, spark.createDataFrame([(3, 1), (3, 0)], "doc_id long, toxic int"))
    assert all(0 <= r.score <= 1 for r in tx.score_toxicity(docs, model).collect())
    assert tx.drop_toxic(docs, model, 2.0).collect() == docs.collect()
    assert tx.score_toxicity(docs.limit(0), tx.train(docs.limit(0), none)).collect() == []


def test_unlabelled_corpus_more_toxic_than_the_labels(spark):
    rng = random.Random(5)
    vile = ["scumX", "VILE", "rotter", "blaggard"]
    rows, labels = [], []
    for i in range(2400):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(10, 40))]
        bad = rng.random() < (0.1 if i < 1000 else 0.16)
        rows.append((i, " ".join(words + [rng.choice(vile)] if bad else words), bad))
        if i < 1000:
            labels.append((i, int(bad)))
    rows += [(10_000 + i, "w1 scumX w2", True) for i in range(400)]  # one hot toxic text
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    model = tx.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score >= 0.5 for r in tx.score_toxicity(docs, model).collect()}
    assert sum(got[i] for i, _, bad in rows if bad) > 0.95 * sum(bad for *_, bad in rows)
    assert sum(got[i] for i, _, bad in rows if not bad) < 0.02 * len(rows)
