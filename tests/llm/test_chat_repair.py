import hashlib
import itertools
import random
import re
import zlib

import pytest

from gatewatch.llm import chat_repair as cr
from gatewatch.llm import queries as q
from gatewatch.sources.tables import load_table
from tests.conftest import SF_SMALL

BLANK = " \t\n\x0b\x0c\r"


def exhaustive(rows):
    """Every sequence of edits over at most three (initial, gone, truncated)."""
    best = None
    for inserts in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
        for edits in itertools.product(["K", "Ru", "Ra", "D"], repeat=len(rows)):
            cost, audit, roles = 3 * len(inserts[0]), "I" * len(inserts[0]), inserts[0]
            for (initial, gone, cut), e, more in zip(rows, edits, inserts[1:]):
                if gone and e != "D":
                    break
                cost += {"K": 0, "R": 3, "D": 4}[e[0]] + (3 if cut and e != "D" else 0) + 3 * len(more)
                audit += e[0] + "I" * len(more)
                roles += {"K": initial or "?", "D": ""}.get(e, e[1:]) + more
            else:
                if re.fullmatch("(s?(ua)+)?", roles):
                    best = min(best or (99, ""), (cost, audit))
    return best


def dp(rows):
    """The same by (cost, audit string) pairs: (state -> pair)."""
    after = {"": "u", "s": "u", "a": "u", "u": "a"}

    def insert(b):
        for _ in range(4):
            for state, (c, a) in list(b.items()):
                b[after[state]] = min(b.get(after[state], (1e9, "")), (c + 3, a + "I"))
        return b

    b = insert({"": (0, "")})
    for initial, gone, cut in rows:
        new = {}
        for state, (c, a) in b.items():
            ways = [(state, c + 4, "D")]
            if not gone:
                extra = 3 if cut else 0
                if (initial == after[state]) or (initial == "s" and state == ""):
                    ways.append((initial, c + extra, "K"))
                ways.append((after[state], c + 3 + extra, "R"))
            for to, cost, letter in ways:
                new[to] = min(new.get(to, (1e9, "")), (cost, a + letter))
        b = insert(new)
    return min(b[s] for s in ("", "a") if s in b)


def mine(rows):
    b = cr.entered(cr.START).insert()
    for r in rows:
        b = cr.step(b, *r)
    return b.cost[b.end()], b.audit[b.end()].text()


def some_rows(rng, n):
    return [(rng.choice("ssuuuaaatU") if rng.random() > 0.03 else "", rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]


def test_dp_equals_all_edit_sequences():
    rng = random.Random(1)
    for _ in range(25):
        rows = some_rows(rng, rng.randint(0, 3))
        assert mine(rows) == exhaustive(rows) == dp(rows), rows


def test_dp_equals_string_dp_on_long_conversations():
    rng = random.Random(2)
    for n in [*range(1, 60), 500]:
        rows = some_rows(rng, n)
        assert mine(rows) == dp(rows), rows


def test_hash_collisions_are_verified(monkeypatch):
    monkeypatch.setattr(cr, "PRIME", 3)  # nearly all prefixes collide
    rng = random.Random(3)
    for n in range(1, 60):
        rows = some_rows(rng, n)
        assert mine(rows) == dp(rows), rows
    nodes = [cr.EMPTY]
    for _ in range(300):
        nodes.append(cr.Audit(rng.choice(nodes[-40:]), rng.choice(["K", "D", "KD", "DK", "KK"])))
    for _ in range(2000):
        x, y = rng.choice(nodes), rng.choice(nodes)
        assert cr.before(x, y) == (x.text() < y.text())


def test_comparing_audits():
    rng = random.Random(4)
    nodes = [cr.EMPTY]
    for _ in range(2000):
        nodes.append(cr.Audit(nodes[-1] if rng.random() < 0.8 else rng.choice(nodes), rng.choice(["K", "D", "I", "KD", "D" * 5])))
    for _ in range(5000):
        x, y = rng.choice(nodes), rng.choice(nodes)
        assert cr.before(x, y) == (x.text() < y.text())
        assert x.back(x.depth // 2).text() == "".join(x.segments()[:x.depth // 2])


# --- whole tables -----------------------------------------------------------

def brute(rows):
    """The numbered query's rows by a plain loop over (conv_id, turn, role, text)."""
    out, by = [], {}
    space = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kept = by.setdefault(conv, [])
        role, text = space(role), space(text)
        k = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        if k:
            kept += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    for conv, kept in by.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in kept:
            last = text.strip(BLANK)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
            seen.add((role, text))
        starts = [r[1][:1] for r in kept]
        cost, audit = dp([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(starts, faults)])
        state, left, said = "", iter(kept), []
        for e in audit:
            _, role, text = (None, "", "") if e == "I" else next(left)
            if e != "D":
                state = role[:1] if e == "K" else {"u": "a"}.get(state, "u")
                said.append(f"{role if e == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in said))
        turns = [r[0] for r in kept if r[0] is not None]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:])), cost, audit,
                    hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {t for _, t in df.dtypes[1:7]} == {"bigint"}
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in load_table(spark, SF_SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(q.QUERIES["op12_chat_repair"](spark, SF_SMALL)) == brute(rows)


def odd_rows():
    rng = random.Random(9)
    said = ["Yes.", "No!", "why", "", "  \n", "cut off", "end.  ", "end. x", None, "é", "done? ", "done?\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice(said))
            for c in [*range(40), None] for t in rng.sample([*range(9), None], rng.randint(1, 9))]
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"text {t}." if rng.random() < 0.9 else "same.") for t in range(700)]  # a hot one
    rows += [(600, 5, "user", "again.")] * 50 + [(601, t, None, None) for t in range(30)]
    rows += [(700, 0, "user", "long " * 100_000 + "."), (700, 1, "assistant", "ok.")]
    return rows


@pytest.mark.parametrize("piece_rows", [1, 7, 4096])
def test_odd_rows_in_pieces_of_any_size(spark, piece_rows):
    turns = spark.createDataFrame(odd_rows(), "conv_id long, turn long, role string, text string").repartition(5) \
        .selectExpr("*", "'x' AS cost", "1 AS part", "2 AS uid")
    got = rows_of(cr.summary(turns, cr.damage(turns), piece_rows))
    assert got == brute(odd_rows())


def test_repaired_rows_are_legal_and_split(spark):
    turns = spark.createDataFrame(odd_rows(), "conv_id long, turn long, role string, text string").repartition(5)
    repaired = cr.repair(cr.find_faults(turns), piece_rows=50)
    assert repaired.where("conv_id = 500").count() >= 700 // 50
    by = {}
    for r in cr.repaired_rows(repaired).orderBy("part", "seq", "place").collect():
        by.setdefault(r.conv_id, []).append(r.role[:1])
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in by.values())


def test_empty_table(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.summary(turns, cr.damage(turns)).collect() == []
