import math
import random
import re

import numpy as np
import pytest

from gatewatch.llm import lexical_search as ls


def terms(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, top=20):
    bags = [(d, terms(t)) for d, t in docs]
    bags = [(d, w) for d, w in bags if w]
    n_docs, total = len(bags), sum(len(w) for _, w in bags)
    out = []
    for item, text in items:
        found = []
        for d, w in bags:
            score = 0
            m = 75 + 25 * len(w) * n_docs // total
            for t in terms(text):
                tf = w.count(t)
                df = sum(t in x for _, x in bags)
                if tf:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score > 0:
                found.append((-score, d is not None, d or 0))
        out += [(item, k, d if has else None, -s) for k, (s, has, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.fixture()
def tables(spark):
    rng = random.Random(3)
    some = ["alpha", "BETA", "gamma", "délta", "É", "x1", "zwölf", "of", "the", "日本"]
    text = lambda n: rng.choice([" ", "-", ". "]).join(rng.choice(some) for _ in range(n))
    docs = [(k, text(rng.randint(1, 12))) for k in range(300)]
    docs += [(1000 + k, "alpha beta gamma") for k in range(60)]  # more ties than the list is long
    docs += [(7, "alpha beta gamma"), (None, "alpha beta gamma"), (2000, None), (2001, ""), (2002, "?!"), (2003, "the of " * 5000)]
    items = [(0, text(6)), (1, "alpha alpha beta"), (2, None), (3, "?!"), (4, "no such words"), (None, "délta É"), (1, "gamma"), (5, "THE of")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "'i' AS item"), \
        spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 AS rank", "'d' AS doc_id")


def test_equals_brute_force(tables):
    docs, items, d, i = tables
    assert rows_of(ls.search(d, i)) == brute(docs, items)


def test_blocks_of_items_and_top(tables):
    docs, items, d, i = tables
    assert rows_of(ls.search(d.repartition(7), i, top=3, block_bytes=40)) == brute(docs, items, 3)


def test_small_tiles_and_partial_sums(tables, monkeypatch):
    docs, items, d, i = tables
    monkeypatch.setattr(ls, "EXACT", 1 << 36)  # nearly every term is a range of its own
    block = ls.read_items([(k, t) for k, t in items if t is not None])
    assert len(ls.exact_cuts(np.full(len(block.keys), 1 << 35))) == len(block.keys)
    with pytest.raises(ValueError):
        ls.exact_cuts(np.array([1 << 36]))
    assert ls.exact_cuts(np.ones(10, np.int64), 4) == [(0, 4), (4, 8), (8, 10)]


def test_partial_sums_are_exact():
    """Impacts and weights near their bounds: the float product equals integers."""
    rng = np.random.default_rng(1)
    n_terms = 3000
    block = ls.Items(["i"], np.arange(n_terms, dtype=np.uint64), [np.arange(n_terms)], [rng.integers(1, 2000, n_terms)])
    df = np.ones(n_terms, np.int64)
    tiles = ls.Tiles(block, df, 10 ** 9, 10 ** 11, 5)
    n, cut = np.array([50]), np.array([0, n_terms])
    tf = rng.integers(1, 1000, n_terms)
    impact = ls._impacts(np.full(n_terms, 50), tf, 10 ** 9, 10 ** 11)
    w = ls.weights(10 ** 9, df)
    want = sum(int(a) * int(b) * int(c) for a, b, c in zip(w, block.counts[0], impact))
    assert want > ls.EXACT and len(ls.exact_cuts(tiles.bound)) > 2
    assert int(tiles.scores(n, cut, np.arange(n_terms), tf)[0, 0]) == want


def test_impacts_beyond_64_bits():
    n, tf = np.array([10 ** 9, 10 ** 9]), np.array([3, 1 << 34])
    got = ls._impacts(n, tf, 10 ** 12, 10 ** 14)
    m = 75 + 25 * 10 ** 9 * 10 ** 12 // 10 ** 14
    assert got.tolist() == [1_000_000_000 * t // (1000 * t + 12 * m) for t in tf.tolist()]


def test_best_keeps_ties_by_order():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(0, 30)
        score = np.array([rng.randint(0, 4) for _ in range(n)], np.int64)
        order = np.array(rng.sample(range(100), n), np.int64)
        want = sorted((-s, o) for s, o in zip(score.tolist(), order.tolist()) if s > 0)[:5]
        assert [(-score[a], order[a]) for a in ls.best(score, order, 5)] == want


def test_empty_tables(tables):
    _, _, d, i = tables
    assert ls.search(d.limit(0), i).collect() == []
    assert ls.search(d, i.limit(0)).collect() == []
    assert ls.search(d.where("text IS NULL"), i).collect() == []
