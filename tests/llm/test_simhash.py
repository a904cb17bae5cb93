import random
import re

import pytest
import xxhash

from gatewatch.llm import simhash
from gatewatch.llm.components import components


def print_of(text, size=3):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, max_bits):
    """(doc_id, fp) rows -> smallest doc_id in reach of each."""
    seen, out = set(), [None] * len(fps)
    for i in range(len(fps)):
        if i in seen:
            continue
        todo, member = [i], {i}
        while todo:
            a = todo.pop()
            for b in range(len(fps)):
                if b not in member and (bin(fps[a][1] ^ fps[b][1]).count("1") <= max_bits):
                    member.add(b)
                    todo.append(b)
        seen |= member
        low = min((fps[m][0] for m in member if fps[m][0] is not None), default=None)
        for m in member:
            out[m] = low
    return out


def made():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["É", "x\u00a0y"]
    docs = []
    for i in range(120):
        if docs and rng.random() < 0.5:
            old = (rng.choice(docs)[1] or "").split(" ")
            old[rng.randrange(len(old))] = rng.choice(words)
            docs.append((i, " ".join(old)))
        else:
            docs.append((i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 40, 200, 400])))))
    return docs + [(120, None), (121, " \t\n"), (122, "One"), (123, "one"), (None, "one"), (None, "zz yy"), (5, docs[5][1])]


@pytest.mark.parametrize("max_bits", [2, 3])
def test_equals_brute_force(spark, max_bits):
    docs = made()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(df, 3, max_bits).collect()), key=str)
    fps = [(i, print_of(t)) for i, t in docs]
    assert got == sorted(((i, f, g) for (i, f), g in zip(fps, groups(fps, max_bits))), key=str)


def test_links_of_close_fingerprints(spark):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for _ in range(4):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 3)):
                g ^= 1 << b
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r.u, r.v) for r in simhash.near_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(20)] + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(20)}}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_keep_one(spark):
    docs = made()
    df = spark.createDataFrame([(*d, "x", k) for k, d in enumerate(docs)], "doc_id long, text string, _n string, N_CHARS int")
    kept = simhash.keep_one(df).collect()
    fps = [print_of(t) for _, t in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):  # links once each; the smaller number is the root
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                x, y = root[i], root[j]
                root = [y if r == x else r for r in root]
    by = {}
    for (i, t), r in zip(docs, root):
        by.setdefault(r, []).append((i is None, i or 0, t or ""))
    got = {}
    for r in kept:
        got.setdefault(root[r.N_CHARS], []).append((r.doc_id is None, r.doc_id or 0))
    assert got == {r: [min(rows)[:2]] for r, rows in by.items()}
    assert simhash.keep_one(df.limit(0)).collect() == []


def test_keep_one_with_reused_and_missing_ids(spark):
    """A text goes only for a near text that stays, whatever the ids."""
    a, b, c = ("one two three four five six seven", "alpha beta gamma delta epsilon zeta", "ein zwei drei vier fuenf sechs")
    rows = [(1, a), (1, b), (2, a), (None, b), (None, c), (None, c), (3, None), (4, ""), (1, a)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(1, a), (1, b), (0, c), (3, "")])
