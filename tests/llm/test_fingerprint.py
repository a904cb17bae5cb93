import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from gatewatch.llm import fingerprint as fp


def plain_level(sym):
    """One level by loops: symbols -> (start, end) of phrases in collapsed symbols."""
    label = []
    for i, s in enumerate(sym):
        d = s ^ sym[i - 1] if i else 1
        j = (d & -d).bit_length() - 1
        label.append(2 * j + (s >> j & 1))
    for _ in range(3):
        label = [plain_reduce(label, i) for i in range(len(label))]
    starts = [i for i in range(len(sym)) if i == 0 or (0 < i < len(sym) - 1 and label[i - 1] < label[i] > label[i + 1])]
    return list(zip(starts, [*starts[1:], len(sym)]))


def plain_reduce(label, i):
    d = label[i] ^ label[i - 1] if i else 1
    j = (d & -d).bit_length() - 1
    return 2 * j + (label[i] >> j & 1)


def test_level_equals_plain_loops():
    rng = random.Random(1)
    for _ in range(50):
        text = [rng.randrange(256) for _ in range(rng.randint(1, 80))]
        text = [s for i, s in enumerate(text) if i == 0 or s != text[i - 1]]  # no runs
        names, off = fp._level(np.array(text, np.uint8), np.array([0, len(text)]))
        want = plain_level(text)
        assert len(names) == len(want) == off[-1]
        phrases = [tuple(text[a:b]) for a, b in want]
        assert len(set(phrases)) == len(set(names.tolist()))
        assert len({(p, n) for p, n in zip(phrases, names.tolist())}) == len(set(phrases))


def test_texts_of_a_chunk_do_not_touch():
    texts = ["abcabdabe" * 30, "", None, "aaaa" * 50, "x", "abcabdabe" * 30, "é" * 4000]
    together = fp.sketches(pa.array(texts))
    alone = np.vstack([fp.sketches(pa.array([t], pa.string())) for t in texts])
    assert (together == alone).all() and (together[0] == together[5]).all()


def test_shared_interior_at_any_offset():
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    body = text(400)
    s = fp.sketches(pa.array([body, text(7) + body, text(400)]))
    assert fp.likeness(s[:1], s[1:2])[0] > 0.8 and fp.likeness(s[:1], s[2:])[0] < 0.1


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_edited_texts_equal_brute_force(spark, parts):
    rng = random.Random(3)
    docs = [(i * 3 % 101, "".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(500, None), (501, ""), (502, "z" * 5000)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS ghost", "'x' AS ID").repartition(4)
        rows = {r.doc_id: r for r in fp.compare_edited(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    order = [(i, t or "") for i, t in sorted(docs, reverse=True)]
    assert len(rows) == len(docs)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        e = t[:len(t) - n] + nxt[:n]
        s = fp.sketches(pa.array([t, e, nxt]))
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == tuple(fp._hex(s[:2]))
        assert (r.near_edited, r.near_next) == (fp.likeness(s[:1], s[1:2])[0], fp.likeness(s[:1], s[2:])[0])


def test_ties_nulls_single_and_empty(spark):
    df = spark.createDataFrame([(1, "abcabc"), (1, "abcabc"), (None, "x"), (None, None)], "doc_id long, text string")
    rows = fp.compare_edited(df).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None", "None"]
    (one,) = fp.compare_edited(df.where("text = 'x'")).collect()
    assert one.edited_sha256 == hashlib.sha256(b"x").hexdigest() and one.near_next == 1.0
    assert fp.compare_edited(df.limit(0)).collect() == []
    assert {r.fingerprint for r in fp.fingerprints(df.where("doc_id = 1")).collect()} == {fp._hex(fp.sketches(pa.array(["abcabc"])))[0]}
