import random
import re

from pyspark.sql import functions as F

from gatewatch.llm import secrets


def made(spark):
    rng = random.Random(1)
    rows, planted = [], set()
    for i in range(150):
        words = ["".join(rng.choice("aeinrst") for _ in range(rng.choice([2, 3, 5, 8, 18]))) for _ in range(30)]
        if i % 3 == 0:
            s = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            words[10:10] = ["token", "=", f'"{s}"']
            planted.add((i, s))
        rows.append((i, " ".join(words), "src/a"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), planted, rows


def test_candidates_equal_brute_force(spark):
    docs, _, rows = made(spark)
    rows = rows + [(900, None, None), (901, "", "x"), (902, "a/b_c-d+e0123456789,ffffffffffffffffffff  end", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS word_no", "'c' AS Candidate")
    got = {(r.doc_id, r.word_no, r.nth, r.candidate, r.before, r.after) for r in secrets.candidates(docs.select("doc_id", "text", "source")).collect()}
    want = set()
    for i, t, _ in rows:
        words = re.split(r"\s+", t or "")
        for k, w in enumerate(words):
            for n, c in enumerate(re.findall(r"[A-Za-z0-9+/_\-]{16,}", w)):
                want.add((i, k, n, c, words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else ""))
    assert got == want


def test_planted_secrets_are_found_and_words_left(spark):
    docs, planted, _ = made(spark)
    rows = secrets.scan(docs).collect()
    assert {(r.doc_id, r.candidate) for r in rows if r.is_secret} == planted
    assert len(rows) > len(planted)


def test_no_python_in_the_plan(spark):
    docs, _, _ = made(spark)
    plan = secrets.scan(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_reviewed_findings_as_labels(spark):
    docs, planted, _ = made(spark)
    known = spark.createDataFrame([(d, c) for d, c in planted if d % 2], "d long, c string")
    reviewed = lambda found: found.where("doc_id % 2 = 1").join(known, (F.col("doc_id") == F.col("d")) & (F.col("candidate") == F.col("c")), "left") \
        .withColumn("secret", F.col("c").isNotNull().cast("int")).drop("c", "d")
    rows = secrets.scan(docs, reviewed).collect()
    assert {(r.doc_id, r.candidate) for r in rows if r.is_secret} == planted


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, "x" * 40), (2, "y " * 5)], "doc_id long, text string")
    (r,) = secrets.scan(docs, path=None).collect()
    assert (r.doc_id, r.score, r.is_secret) == (None, 0.0, False)
    assert secrets.scan(docs.limit(0)).collect() == []


def test_rare_secrets_are_learnt(spark):
    docs, planted, _ = made(spark)
    rows = secrets.scan(docs, max_labelled=20).collect()  # of 20 smallest hashes over both kinds few are secrets
    assert {(r.doc_id, r.candidate) for r in rows if r.is_secret} == planted
    features = spark.range(3000).selectExpr(
        *[f"CAST(IF(id = 7, 9, 1) AS double) AS {x}" for x in secrets.FEATURES], "CAST(id = 7 AS int) AS secret",
        "CAST(id AS string) AS candidate", "id AS doc_id", "1 AS word_no", "0 AS nth")
    model = secrets.train(features, max_labelled=100)
    assert [r.doc_id for r in secrets.score(features, model).where("is_secret").collect()] == [7]


def test_short_values_after_a_naming_word(spark):
    text = 'the password = "hunter2!" and pwd=p@ss,w0rd; then API_TOKEN: ab$9 x=short12 plain word: other'
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r.candidate for r in secrets.candidates(docs).orderBy("word_no").collect()] == ["hunter2!", "p@ss,w0rd", "ab$9"]
    assert len(secrets.scan(docs, path=None).collect()) == 3


PUBLIC = ["see commit 9fceb02d0ae598e95dc970b74767f19372d61af8 for details", "session 123e4567-e89b-12d3-a456-426614174000 was closed",
          "deployed build-20240311-a1b2c3d to production today", "read /articles/2024/03/winter-travel-guide/ next",
          "the file src/main/java/util/StringHelper2 was moved", "sha256: e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855 ok",
          "version: release_2024_03_11_candidate7 is out"]


def test_public_strings_are_not_flagged(spark):
    _, planted, rows = made(spark)
    extra = [(1000 + i, t, "src/a") for i, t in enumerate(PUBLIC)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, source string")
    got = secrets.scan(docs).collect()
    assert {r.doc_id for r in got if r.doc_id >= 1000} == {r[0] for r in extra}
    assert [(r.candidate, r.score) for r in got if r.doc_id >= 1000 and r.is_secret] == []
    assert {(r.doc_id, r.candidate) for r in got if r.is_secret} == planted


def test_a_very_long_word_is_linear(spark):
    import time
    _, _, rows = made(spark)
    long = "".join(random.Random(3).choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1_000_000))
    docs = spark.createDataFrame(rows + [(2000, f"data {long} end", None)], "doc_id long, text string, source string")
    began = time.time()
    got = [r for r in secrets.scan(docs).collect() if r.doc_id == 2000]
    assert len(got) == 1 and len(got[0].candidate) == 1_000_000 and time.time() - began < 60
