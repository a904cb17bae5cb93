import json
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gatewatch.llm import pre_tokens as pt
from gatewatch.llm import queries as q
from gatewatch.llm import token_files as tf
from gatewatch.sources.tables import load_table
from tests.conftest import SF_SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows):
    """(doc_id, start, n_tokens, crc32) by encoding one text after the other."""
    tok, at, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("n,top", [(1, 0), (1, 9), (5, 3), (700, 100), (3000, 10 ** 6), (300, 1 << 60), (2000, 0)])
def test_elias_fano_round_trip(n, top):
    rng = random.Random(n)
    v = np.array(sorted(rng.randint(0, top) for _ in range(n)), np.uint64)
    e = tf.EliasFano.from_bytes(tf.EliasFano.encode(v).to_bytes())
    assert e.select(0, n).tolist() == v.tolist()
    for _ in range(50):
        i = rng.randrange(n)
        k = rng.randint(1, n - i)
        assert e.select(i, k).tolist() == v[i:i + k].tolist()
    assert 8 * (len(e.low) + len(e.high)) <= n * (3 + e.low_bits) + 16


def test_empty_sequence():
    e = tf.EliasFano.from_bytes(tf.EliasFano.encode(np.zeros(0, np.uint64)).to_bytes())
    assert e.n == 0 and e.select(0, 0).tolist() == []


def test_pre_tokens_give_the_ids_of_the_whole_text():
    with open(PATH, encoding="utf-8") as f:
        spec = f.read()
    tok, enc = Tokenizer.from_file(PATH), pt.Encoder(spec, 0, 2, pt.cuts_by_pre_tokens(json.loads(spec)), bits=15)
    assert enc.by_parts
    rng = random.Random(5)
    letters = ["a", "B", "é", "ß", "1", "²", "½", " ", "  ", "\n", "\t", "\r", "'s", "'ll", "'", "'re", "'", "r", "e", "l", "-", "_", "…", "—", "“", " ", "\u0085",
               "\x0b", "\x1c", "中", " ", "😀", "x" * 40, "×", "¹", "€", "<|endoftext|>"[:6], "́"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    plain = [x for x in letters if pt.PLAIN.fullmatch(x)]
    texts += ["".join(rng.choice(plain) for _ in range(rng.randint(0, 30))) for _ in range(20_000)]
    for at in range(0, len(texts), 100):
        for t, got in zip(texts[at:at + 100], enc.encode(texts[at:at + 100])):
            assert np.frombuffer(got, "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids + [0], repr(t)
    other = json.loads(spec) | {"normalizer": {"type": "Lowercase"}}
    assert not pt.cuts_by_pre_tokens(other)
    whole = pt.Encoder(json.dumps(other), 0, 2, False)
    assert np.frombuffer(whole.encode(["ABC d"])[0], "<u2").tolist() == tok.encode("abc d", add_special_tokens=False).ids + [0]


def test_memory_forgets_the_least_used(monkeypatch):
    rng = random.Random(7)
    m, known = pt.Memory(8, "<u2"), {}
    for _ in range(400):
        keys = {rng.randrange(1, 1 << 62) << 1 | 1 for _ in range(10)} | set(rng.sample(sorted(known), min(3, len(known))))
        a = np.array(sorted(keys), np.uint64)
        slot = m.find(a, a * np.uint64(3))
        for k, s in zip(a.tolist(), slot.tolist()):
            assert s < 0 or m.gather(np.array([s])).tolist() == known[k]
        new = a[slot < 0]
        ids = [np.array([rng.randrange(99) for _ in range(rng.randint(1, 4))], "<u2") for _ in new]
        known |= {k: i.tolist() for k, i in zip(new.tolist(), ids)}
        m.add(new, new * np.uint64(3), [i.tobytes() for i in ids])
        slot = m.find(a, a * np.uint64(3))
        assert m.n <= 128
        held = slot >= 0
        assert held[np.isin(a, new)].all()


def test_query_equals_encoding_one_by_one(spark):
    rows = [(r.doc_id, r.text) for r in load_table(spark, SF_SMALL, "documents").collect()]
    got = q.QUERIES["op11_token_files"](spark, SF_SMALL)
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(rows))


def test_nulls_repeats_long_texts_and_small_files(spark, monkeypatch):
    rows = [(5, "five"), (None, "no id"), (None, None), (3, ""), (3, None), (7, "word " * 60_000), (9, "tie"), (9, "tie"), (-4, "minus")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "'x' AS file", "2 AS `_row`")
    manifest = tf.write_token_files(docs, PATH, part_ids=4)
    out = tf.read_token_files(manifest, with_ids=True).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])
    want = brute(rows)
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in out], key=str) == sorted([(w[0], w[2], w[3]) for w in want], key=str)
    ahead = 0
    for r in sorted(out, key=lambda r: r.start):  # no gap, no overlap, ascending ids
        assert r.start == ahead and len(r.ids) == r.n_tokens and r.ids[-1] == 0
        ahead += r.n_tokens
    order = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert order == [None, None, -4, 3, 3, 5, 7, 9, 9]
    assert len(key(out[0])) == 4
    assert manifest.count() > 3
    some = tf.fetch(spark, manifest, [7, 5, 100])
    assert sorted(some) == [5, 7] and len(some[7]) > 60_000


def test_a_document_longer_than_a_read(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tf, "READ_IDS", 100)
    w = tf.TokenWriter(str(tmp_path / "a.tok"), 2)
    ids = np.arange(1, 1001, dtype="<u2")
    for d, k in ((1, 10), (2, 1000), (3, 1)):
        w.add(d, ids[:k].tobytes())
    w.close()
    r = tf.TokenReader(str(tmp_path / "a.tok"))
    assert [(f, o.tolist()) for f, o in r.runs(100)] == [(0, [0, 10]), (1, [10, 1010]), (2, [1010, 1011])]
    assert r.tokens(*r.offsets(1, 1).tolist()).tolist() == ids.tolist() and r.doc_ids(0, 3) == [1, 2, 3]


def test_empty_table_and_key_type(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tf.read_token_files(tf.write_token_files(docs, PATH)).collect() == []
    with pytest.raises(TypeError):
        tf.write_token_files(docs.selectExpr("'a' AS doc_id", "text"), PATH)


def test_a_run_of_texts_holds_little():
    with open(PATH, encoding="utf-8") as f:
        spec = f.read()
    enc = pt.Encoder(spec, 0, 2, pt.cuts_by_pre_tokens(json.loads(spec)), bits=15)
    rng = random.Random(5)
    texts = ["".join(rng.choice((" the", " of", " 12", ", and", "\n", " don't")) for _ in range(500)) for _ in range(1500)]
    tracemalloc.start()
    got = [ids for lo, hi in tf._runs_of_rows(pa.array(texts)) for ids in enc.encode(texts[lo:hi])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak - sum(map(len, got)) < 40 << 20
    tok = Tokenizer.from_file(PATH)
    assert [np.frombuffer(x, "<u2").tolist() for x in got[:20]] == [tok.encode(t, add_special_tokens=False).ids + [0] for t in texts[:20]]
