import hashlib
import random

import pyarrow as pa
import pytest

from gatewatch.llm import chat_format as cf


def made():
    rng = random.Random(4)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "<\\/s>", "\\", "<", "[", "\n", "é", "plain words", "<s>user\n", "%0A", "[\\\\INST]"]
    rows = []
    for c in range(30):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "a%\nb"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))))
    rows += [(31, 0, None, None), (31, None, "assistant", ""), (None, 1, "assistant", "</s>"), (32, 1, "user", "b"), (32, 1, "user", "a"),
             (32, 1, "user", "a"), (33, 0, "assistant", "x" * 300_000)]
    rows += [(40, t, "assistant" if t % 2 else "user", f"turn {t} </s>") for t in range(500)]
    return rows


def brute(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"),
                sha("".join(x for r, x in t if r == "assistant"))) for c, t in out.items()}


@pytest.mark.parametrize("part_bytes", [cf.PART_BYTES, 200])
def test_round_trip(spark, part_bytes):
    rows = made()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "'x' AS Formatted").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        parts = cf.format_conversations(df, part_bytes)
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cf.read_back(parts).collect()}
        chars = {}
        for r in parts.collect():
            chars[r.conv_id] = chars.get(r.conv_id, 0) + len(r.formatted)
            for s in r.loss:
                assert r.formatted[:s.start].endswith("<s>assistant\n") and r.formatted[s.end:].startswith("</s>\n")
        assert {r.conv_id: r.formatted_chars for r in cf.read_back(parts).collect()} == chars
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows)


def test_escape_is_reversible_and_leaves_no_control_string():
    rng = random.Random(0)
    for _ in range(2000):
        t = "".join(rng.choice(["<", "[", "\\", "/", "s>", "INST]", "</s>", "x", "\n"]) for _ in range(rng.randint(0, 12)))
        (e,) = cf.escape(pa.array([t])).to_pylist()
        assert cf.unescape(e) == t
        assert not any(c in e for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_assemble_is_plain_concatenation():
    roles, texts = pa.array(["user", None, "assistant"]), pa.array(["é</s>", None, "b"])
    out, end, before, chars = cf.assemble(roles, texts)
    assert out.tobytes().decode() == "<s>user\né<\\/s></s>\n<s>\n</s>\n<s>assistant\nb</s>\n"
    assert (before.tolist(), chars.tolist(), end[-1]) == ([8, 4, 13], [6, 0, 1], len(out))


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cf.read_back(cf.format_conversations(df)).collect() == []
