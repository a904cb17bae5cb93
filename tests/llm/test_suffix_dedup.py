import random

import pytest

from gatewatch.llm import suffix_dedup


def brute(docs, length):
    """(doc_id, text) rows -> per row (n_bytes, spans, kept)."""
    first = {}
    rows = [(suffix_dedup.LAST if i is None else i, (t or "").encode()) for i, t in docs]
    for i, b in rows:
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in rows:
        hit = [False] * len(b)
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < i:
                hit[p:p + length] = [True] * length
        spans = []
        for p, h in enumerate(hit):
            if h and (p == 0 or not hit[p - 1]):
                spans.append([p, p])
            if h:
                spans[-1][1] = p + 1
        out.append((i, len(b), [tuple(s) for s in spans], bytes(x for x, h in zip(b, hit) if not h)))
    return sorted(out)


def run(spark, docs, length, gram):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = suffix_dedup.repeated_passages(df, length, gram).collect()
    return sorted((suffix_dedup.LAST if r.doc_id is None else r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept))
                  for r in rows)


def made(seed, n=60):
    rng = random.Random(seed)
    words = [rng.choice("abcdeé") * rng.randint(1, 4) for _ in range(12)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 20))) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 15)))
                 for _ in range(rng.randint(0, 6))]
        docs.append((i, " ".join(parts)))
    docs += [(n, None), (n + 1, ""), (n + 2, "a" * 300), (n + 3, "a" * 90), (None, docs[3][1] + "x" * 40), (None, "x" * 60)]
    docs += [docs[5], (7, docs[9][1])]  # repeated rows; one id with two texts
    return docs


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("hot", [32, 1])
def test_equals_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    docs = made(seed)
    for length, gram in ((12, 5), (30, 12)):
        assert run(spark, docs, length, gram) == brute(docs, length)


def test_empty_table(spark):
    assert run(spark, [], 50, 20) == []


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "x" * 80, 1, "k"), (2, "y" + "x" * 60, 2, "k")], "doc_id long, text string, spans int, KEPT string")
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.repeated_passages(df, 50).collect()}
    assert got == {1: b"x" * 80, 2: b"y"}


def test_missing_and_reused_ids_with_one_checksum(spark):
    """Texts under one id, or none, are told apart by numbers of their own and not by a hash."""
    import zlib
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh") for _ in range(60))
    tail = {}
    while True:  # two tails after which the texts have equal 31-bit checks
        t = "".join(rng.choice("qrstuvwxyz") for _ in range(37))
        for key, text in (("p", passage + t), ("o", t + "unrelated" + t)):
            seen = tail.setdefault(key, {})
            seen[zlib.crc32(text.encode()) & 0x7FFFFFFF] = text
        same = tail["p"].keys() & tail["o"].keys()
        if same or len(tail["p"]) > 150_000:
            break
    pairs = [(tail["p"][k], tail["o"][k]) for k in same] or [(passage + "q", "unrelated" * 9)]
    for twice in (None, 5):
        docs = [(1, passage + "!")] + [(twice, t) for pair in pairs for t in pair] + [(twice, pairs[0][0])] * 30
        assert run(spark, docs, 50, 20) == brute(docs, 50)
