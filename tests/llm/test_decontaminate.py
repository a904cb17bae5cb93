import random
import re

import pyarrow as pa
import pytest

from gatewatch.llm import decontaminate as dc


def words_of(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, window):
    d = words_of(text)
    hit, found = set(), set()
    for i, t in items:
        w = words_of(t)
        wins = {tuple(w[k:k + window]) for k in range(len(w) - window + 1)} or ({tuple(w)} if w else set())
        for win in wins:
            for k in range(len(d) - len(win) + 1):
                if tuple(d[k:k + len(win)]) == win:
                    found.add(str(i))
                    hit |= set(range(k, k + len(win)))
    return len(d), found, len(hit)


def test_automaton_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        letters, window = rng.choice(["ab", "abc", "abcdefghij"]), rng.choice([2, 3, 4])
        text = lambda n: rng.choice([" ", "-", ". "]).join(rng.choice(letters) for _ in range(n))
        items = [(k, text(rng.randint(0, 8))) for k in range(rng.randint(0, 5))]
        docs = [text(rng.randint(0, 30)) for _ in range(5)] + [None, "", "!?"]
        a = dc.build_automaton(items, window)
        for t, (n, ids, _, hit, _) in zip(docs, dc.scan(a, pa.array(docs, pa.string()))):
            assert (n, ids, hit) == brute(t, items, window)


ITEM = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture()
def tables(spark):
    docs = [(1, f"Before, {ITEM.upper()} after that come many clean words and they all stay here as they were", 3),
            (2, ITEM, 4), (3, None, 5), (4, "", None), (None, "short item! é ÉÉ", 6), (6, "nothing", 7), (6, "nothing", 7)]
    items = [(10, ITEM), (11, "short item"), (12, None), (13, "..."), (14, ITEM)]
    return (spark.createDataFrame(docs, "doc_id long, text string, n_chars long").selectExpr("*", "'x' AS spans", "1 AS N_HIT"),
            spark.createDataFrame(items, "item_id long, text string"))


def test_spans(tables):
    rows = dc.match_spans(*tables).collect()
    got = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple((s.start, s.end) for s in r.spans)) for r in rows}
    assert len(rows) == 7
    assert got == {(1, 27, 12, ("10", "14"), ((8, 8 + len(ITEM)),)), (2, 12, 12, ("10", "14"), ((0, len(ITEM)),)), (3, 0, 0, (), ()),
                   (4, 0, 0, (), ()), (None, 4, 2, ("11",), ((0, 10),)), (6, 1, 0, (), ())}


def test_cutting(tables):
    docs, items = tables
    out = dc.decontaminate(docs, items)
    assert out.schema == docs.schema
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    first = "Before,  after that come many clean words and they all stay here as they were"
    assert got == sorted([(1, first, len(first)), (3, None, 5), (4, "", None), (6, "nothing", 7), (6, "nothing", 7), (None, "! é ÉÉ", 6)], key=str)


def test_empty_tables(tables):
    docs, items = tables
    assert dc.match_spans(docs.limit(0), items).collect() == []
    assert all(r.n_hit == 0 for r in dc.match_spans(docs, items.limit(0)).collect())


@pytest.mark.parametrize("max_words", [1, 3, 12, 60])
def test_many_automata_equal_one(spark, max_words):
    """Items dealt to automata of a few words, long ones in pieces: the same hits, items and texts."""
    rng = random.Random(max_words)
    text = lambda n: rng.choice([" ", "-", ". "]).join(rng.choice("abcde") for _ in range(n))
    docs = spark.createDataFrame([(k, text(rng.randint(0, 60)), 5) for k in range(40)] + [(None, None, 0)], "doc_id long, text string, n_chars long") \
        .selectExpr("*", "'r' AS `_runs`")
    rows = [(k, text(rng.randint(0, 9))) for k in range(6)] + [(9, text(40)), (9, "e d"), (None, "a a b"), (11, None)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    got = {r.doc_id: (r.n_words, set(r["items"]), r.n_hit) for r in dc.match_spans(docs, items, 4, max_words).collect()}
    known = [(i, t) for i, t in rows if t is not None]
    assert got == {r.doc_id: brute(r.text, known, 4) for r in docs.collect()}
    whole = sorted((tuple(r) for r in dc.decontaminate(docs, items, 4).collect()), key=str)
    assert sorted((tuple(r) for r in dc.decontaminate(docs, items, 4, max_words=max_words).collect()), key=str) == whole
