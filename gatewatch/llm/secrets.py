"""Secret scans: candidates by pattern, false positives removed by a random forest.

DataFrame functions only. A candidate is a run of ``MIN_LENGTH`` or more key
characters inside a white-space-separated word; a word without one is a
candidate if it is, or holds, a value of ``MIN_VALUE`` or more characters of any
kind after a naming word and an assignment (``pwd=..``, ``password: ..``). Its features are its length,
character transitions (class changes, and the mean log-odds of its character
pairs between labelled secrets and labelled false findings), dictionary
coverage (share of its four-letter pieces that occur in frequent words of the
corpus), the path (separators in the word, and what the document's path says),
and the neighbouring words (a naming word, an assignment, quotes). A random
forest is trained on labelled findings and scores every candidate.

Where there are no reviewed findings the labels come from formats and from words
next to a candidate, and hard negatives (hashes, UUIDs, build numbers, paths, encoded
text) are made from the corpus's own words, so that the forest has to tell what
a secret looks like *in its place*.

Word counts cover all documents. Sampling bounds: the forest is fitted on at
most ``max_labelled`` labelled findings of each kind, secrets and false ones,
those with the smallest hash, weighted back to the numbers of their kind (a
kind counts for a hundredth of all at least, so that rare secrets are not
outweighed); the
dictionary keeps the ``dictionary`` most frequent words (its pieces, at most
nine a word, and the character pairs, at most 39 * 39, are what is broadcast).

Defined results: null and empty text have no candidates; a missing neighbour
is the empty word; equal candidates in different places are findings each;
without labelled findings of both kinds the score is the share of secrets
among the labelled (0 without any); repeated rows repeat their findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewatch.llm.frames import written

MIN_LENGTH = 16
CANDIDATE = rf"[A-Za-z0-9+/_\-]{{{MIN_LENGTH},}}"
MIN_VALUE = 4
NAMING = r"(?i)(key|token|secret|passw|pwd|auth|bearer|credential|api)"
#: a value in the word of its naming word, and what does not belong to a value
INSIDE = NAMING + r"[A-Za-z0-9_\-]*[\"'`]?[=:]+>?[\"'`]?(.+)$"
EDGES = r"^[=:>\"'`(]+|[\"'`,;)]+$"
#: formats and words that tell what a string is
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
PATH = r"^[/.]?([A-Za-z0-9_\-.]{1,24}/)+[A-Za-z0-9_\-.]{0,40}$"
PUBLIC = r"(?i)(^|[^a-z])(commit|sha[0-9]*|checksum|digest|hash|uuid|guid|etag|md5|build|version|revision|release|path|file|href|url|link)[^a-z ]*$"
#: parts that the findings of one candidate are dealt to
SALTS = 16
FEATURES = ["length", "digits", "capitals", "hexes", "distinct", "changes", "pairs", "covered", "separators", "sample_path",
            "naming", "assigned", "quoted", "after_word"]


def _value(word: Column, before: Column, before2: Column) -> Column:
    """The value after a naming word and an assignment, or the empty word."""
    long = (F.length(word) >= MIN_LENGTH) & word.rlike(CANDIDATE)
    after = (before.rlike("[=:]$") & F.concat_ws(" ", before2, before).rlike(NAMING)) | (word.rlike("^[=:]") & before.rlike(NAMING))
    value = F.when(after, word).when(word.rlike("[=:]"), F.regexp_extract(word, INSIDE, 2)).otherwise("")
    return F.when(long, "").otherwise(F.regexp_replace(value, EDGES, ""))


def candidates(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """doc_id, path, word_no, nth (in the word), word, candidate, before2, before, after."""
    where = F.col(path).cast("string") if path and path in docs.columns else F.lit(None).cast("string")
    words = docs.select("doc_id", F.coalesce(where, F.lit("")).alias("path"), F.split(F.coalesce("text", F.lit("")), r"\s+").alias("words"))
    near = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    long = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("word_no"), _value(w, near(i - 1), near(i - 2)).alias("value"))),
                    lambda x: (F.length(x["value"]) >= MIN_VALUE) | (F.length(x["word"]) >= MIN_LENGTH) & x["word"].rlike(CANDIDATE))
    found = F.transform(long, lambda x: F.struct(x["word_no"].alias("word_no"), x["word"].alias("word"), x["value"].alias("value"), near(x["word_no"] - 2).alias("before2"),
                                                 near(x["word_no"] - 1).alias("before"), near(x["word_no"] + 1).alias("after")))
    return words.select("doc_id", "path", F.explode(found).alias("f")).select("doc_id", "path", "f.*") \
        .select("*", F.posexplode(F.when(F.length("value") >= MIN_VALUE, F.array("value"))
                                  .otherwise(F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0)))).alias("nth", "candidate")).drop("value")


def _share(pattern: str) -> Column:
    c = F.col("candidate")
    return F.length(F.regexp_replace(c, f"[^{pattern}]", "")) / F.length(c)


def _key() -> Column:
    """128 bits that stand for a candidate wherever its pieces are counted."""
    return F.unhex(F.md5(F.col("candidate").cast("binary")))


def _overlapping(text: Column, n: int) -> Column:
    """All runs of ``n`` characters, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1))


def _pairs(strings: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and each character pair of ``candidate``, lower-cased, digits as 0."""
    c = F.regexp_replace(F.lower("candidate"), "[0-9]", "0")
    return strings.select(*keep, F.explode(_overlapping(c, 2)).alias("pair"))


def frequent_words(docs: DataFrame, most: int) -> DataFrame:
    """w, n: the most frequent words of 4 to 12 letters of the whole corpus."""
    word = F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z]+")).alias("w")
    return docs.select(word).where(F.length("w").between(4, 12)).groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(most)


def corpus_pieces(words: DataFrame) -> DataFrame:
    """Four-letter pieces of the frequent words."""
    return words.select(F.explode(_overlapping(F.col("w"), 4)).alias("piece")).distinct()


def pair_odds(labelled: DataFrame) -> DataFrame:
    """pair, odds: log-odds of labelled secrets (1) against false findings (0), smoothed."""
    n = _pairs(labelled.select("candidate", "secret").distinct(), "secret").groupBy("pair") \
        .agg(F.sum("secret").alias("s"), F.sum(1 - F.col("secret")).alias("f"))
    total = n.agg(F.sum("s").alias("s"), F.sum("f").alias("f")).first()
    share = lambda c: F.log((F.col(c) + 1) / F.lit(float((total[c] or 0) + 1500)))
    return n.select("pair", (share("s") - share("f")).alias("odds"))


def with_features(found: DataFrame, pieces: DataFrame, odds: DataFrame) -> DataFrame:
    """What is counted per distinct candidate (by its key) comes back by a join
    that is salted, as one candidate may hold a third of all findings."""
    strings = found.select("candidate").distinct().withColumn("ck", _key())
    pairs = _pairs(strings, "ck").join(F.broadcast(odds), "pair", "left").groupBy("ck").agg(F.avg(F.coalesce("odds", F.lit(0.0))).alias("pairs"))
    piece = strings.select("ck", F.explode(_overlapping(F.lower("candidate"), 4)).alias("piece"))
    known = piece.join(F.broadcast(pieces.withColumn("hit", F.lit(1.0))), "piece", "left") \
        .groupBy("ck").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("covered"))
    facts = pairs.join(known, "ck").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    keyed = found.withColumns({"ck": _key(), "salt": F.pmod(F.xxhash64("doc_id", "word_no", "nth"), F.lit(SALTS))})
    c = F.col("candidate")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    flag = lambda x: x.cast("double")
    before = F.concat_ws(" ", "before2", "before")
    return keyed.join(facts, ["ck", "salt"]).drop("ck", "salt").withColumns({
        "length": F.length(c).cast("double"), "digits": _share("0-9"), "capitals": _share("A-Z"), "hexes": _share("0-9a-fA-F"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        "changes": F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) / F.length(c),
        "separators": F.length(F.regexp_replace("word", r"[^/.\\]", "")).cast("double"),
        "sample_path": flag(F.col("path").rlike("(?i)(test|example|sample|doc|fixture)")),
        "naming": flag(before.rlike(NAMING) | F.regexp_replace("word", CANDIDATE, "").rlike(NAMING)),
        "assigned": flag(F.concat("before", "word").rlike("[=:]")), "quoted": flag(F.col("word").rlike("[\"'`]")),
        "after_word": flag(F.col("after").rlike("^[a-z]+$")),
    })


def train(features: DataFrame, max_labelled: int = 20_000, trees: int = 20, depth: int = 6):
    """The forest, or the constant score if the labelled findings are not of both kinds.
    ``features``: FEATURES and ``secret`` (0 or 1)."""
    order = F.xxhash64("candidate", "doc_id", "word_no", "nth")
    n = features.agg(F.count(F.lit(1)).alias("n"), F.sum("secret").alias("s")).first()
    if not n["n"] or n["s"] in (0, n["n"]):
        return float((n["s"] or 0) / max(n["n"], 1))
    rows = features.select(*FEATURES, "secret", order.alias("o"))
    each = [rows.where(F.col("secret") == k).orderBy("o").limit(max_labelled) for k in (0, 1)]
    use = written(each[0].unionByName(each[1]), "findings")
    share = [max(x / n["n"], 0.01) for x in (n["n"] - n["s"], n["s"])]
    weight = [x / min(y, max_labelled) * n["n"] for x, y in zip(share, (n["n"] - n["s"], n["s"]))]
    least = min(weight)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(use.coalesce(1).sortWithinPartitions("o")) \
        .select("x", F.col("secret").cast("double"), F.when(F.col("secret") == 1, weight[1] / least).otherwise(weight[0] / least).alias("weight"))
    return RandomForestClassifier(featuresCol="x", labelCol="secret", weightCol="weight", numTrees=trees, maxDepth=depth, seed=7).fit(rows)


def score(features: DataFrame, model) -> DataFrame:
    """``features`` with ``score`` and ``is_secret``."""
    if isinstance(model, float):
        out = features.withColumn("score", F.lit(model))
    else:
        out = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(features))
        out = out.withColumn("score", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")
    return out.withColumn("is_secret", F.col("score") >= 0.5)


def weak_labels(found: DataFrame) -> DataFrame:
    """Labelled findings by what surrounds and fills a candidate, for corpora
    without reviewed findings: 0 if its format says what it is (a UUID, a path, a
    string of one kind of sign) or a word before names it as something public
    (commit, checksum, version, ..); else 1 if a naming word and an assignment come
    before a digit-and-letter string. Others get none."""
    c, before = F.col("candidate"), F.concat_ws(" ", "before2", "before")
    mixed = c.rlike("[0-9]") & c.rlike("[A-Za-z]")
    public = c.rlike(UUID) | (c.rlike(PATH) & c.rlike("/")) | before.rlike(PUBLIC) | ~mixed
    return found.withColumn("secret", F.when(public, 0).when(before.rlike(NAMING) & F.concat("before", "word").rlike("[=:]"), 1)) \
        .where("secret IS NOT NULL")


def hard_negatives(words: DataFrame, like: DataFrame) -> DataFrame:
    """Findings that look like secrets and are none, made from the corpus's own
    frequent words: hashes, checksums, UUIDs, build numbers, encoded text, paths and
    slugs, between ordinary words and after words that name them. ``like`` gives the
    columns; ``secret`` is 0."""
    every = words.agg(F.sort_array(F.collect_list("w")).alias("ws"), F.count(F.lit(1)).alias("k"))  # one row of at most ``dictionary`` words
    base = words.crossJoin(F.broadcast(every))
    pick = lambda i: F.get("ws", F.pmod(F.xxhash64("w") + F.lit(i), F.col("k")).cast("int"))
    text = F.concat_ws(" ", "w", pick(1), pick(2), pick(3), pick(4))
    digits = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10)
    made = [(F.sha1("w"), "commit"), (F.sha2("w", 256), "sha256:"), (F.md5("w"), "etag:"),
            (F.regexp_replace(F.md5("w"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), "uuid:"),
            (F.concat(F.lit("build-"), digits, F.lit("-"), F.substring(F.md5("w"), 9, 7)), "version:"),
            (F.concat(F.lit("release_"), digits, F.lit("_"), F.col("w")), "build:"),
            (F.regexp_replace(F.base64(text.cast("binary")), "=+$", ""), "data:"),
            (F.concat(F.lit("/"), F.concat_ws("/", "w", pick(1), F.substring(digits, 1, 4), pick(2))), "path:"),
            (F.concat_ws("/", F.lit("src"), "w", pick(3), F.concat(pick(4), F.lit("_"), F.substring(digits, 1, 2))), "file:"),
            (F.concat_ws("-", "w", pick(1), pick(2), F.substring(digits, 1, 4)), "link:")]
    rows = []
    for i, (candidate, name) in enumerate(made):
        for before2, before in ((pick(5), pick(6)), (pick(7), F.lit(name)), (pick(8), F.concat(pick(9), F.lit(":")))):
            rows.append(F.struct(F.lit(i).alias("word_no"), candidate.alias("candidate"), before2.alias("before2"), before.alias("before")))
    out = base.select(F.explode(F.array(*rows)).alias("f"), pick(10).alias("after")).select("f.*", "after") \
        .where(F.length("candidate") >= MIN_LENGTH).withColumns({"word": F.col("candidate"), "nth": F.lit(0), "path": F.lit("")})
    return out.select(*[(F.col(c) if c in out.columns else F.lit(None)).cast(like.schema[c].dataType).alias(c) for c in like.columns]) \
        .withColumn("secret", F.lit(0))


def scan(docs: DataFrame, labelled=weak_labels, path: str | None = "source", dictionary: int = 5000,
         max_labelled: int = 20_000, hard: int = 300) -> DataFrame:
    """doc_id, word_no, nth, candidate, score, is_secret of every candidate of ``docs``.

    ``labelled``: candidates -> candidates with ``secret``, the labelled findings.
    ``hard``: so many of the most frequent words are made into hard negatives,
    if there are any labelled secrets.
    """
    found = written(candidates(docs, path), "candidates")
    words = written(frequent_words(docs, dictionary), "words")
    known = labelled(found)
    if hard and not known.where("secret = 1").isEmpty():
        made = written(hard_negatives(words.orderBy(F.desc("n"), "w").limit(hard), found), "hard_negatives")
    else:
        made = found.limit(0).withColumn("secret", F.lit(0))
    pieces = written(corpus_pieces(words), "pieces")
    odds = written(pair_odds(known.select(*found.columns, F.col("secret").cast("int")).unionByName(made)), "pairs")
    features = written(with_features(found, pieces, odds), "features")
    taught = labelled(features).withColumn("secret", F.col("secret").cast("int")) \
        .unionByName(with_features(made, pieces, odds).withColumn("secret", F.lit(0)))
    model = train(taught, max_labelled)
    return score(features, model).select("doc_id", "word_no", "nth", "candidate", "score", "is_secret")
