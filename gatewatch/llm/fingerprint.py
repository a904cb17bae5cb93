"""Document fingerprints from locally consistent parsing.

A text is parsed into a hierarchy of phrases by deterministic coin tossing.
On each level runs of one symbol become one symbol; every symbol is labelled
by the lowest bit in which it differs from the one before it, and that label
again by the labels' own lowest differing bit, until there are six labels; a
phrase starts at each label larger than both neighbours. Its name, a hash of
its symbols, is a symbol of the next level. Where a phrase starts depends on a
few symbols around it, so equal substrings share the names in their interior
wherever they stand. A phrase has about 3 symbols, so names of the third and
fourth level stand for about 27 and 80 bytes.

The fingerprint is a sketch of the set of these names: ``BINS`` bins by hash,
the smallest 16-bit value in each, as hex digits. The likeness of two is the
share of equal bins among those that are not empty in both.

Defined results: null is the empty text, which has no names; two empty
fingerprints are alike (1); equal texts have equal fingerprints. The next
document is the one before in ascending doc_id order; null ids come last in
descending order, rows that share an id follow each other by text hash, and
after the last comes the first, so a single row is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch.llm.textbytes import as_binary, mix64, powers, text_chunks

U64 = np.uint64
BINS = 64
LEVELS = (3, 4)
EMPTY = 0xFFFF
MULT = 0xD1342543DE82EF95
NULL_ID = -(1 << 63)


def _reduce(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the lowest bit in which a label differs from the one before, plus that bit."""
    prev = np.empty_like(label)
    prev[1:] = label[:-1]
    prev[first] = label[first] ^ label.dtype.type(1)
    d = label ^ prev
    j = np.bitwise_count((d & (~d + label.dtype.type(1))) - label.dtype.type(1))
    return (2 * j + ((label >> j.astype(label.dtype)) & label.dtype.type(1)).astype(np.uint8)).astype(np.uint8)


def _level(sym: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of several texts -> names of their phrases, and the texts' new offsets."""
    n = len(sym)
    head = off[:-1][off[:-1] < off[1:]]
    new = np.empty(n, bool)
    new[1:] = sym[1:] != sym[:-1]
    new[head] = True
    at = np.flatnonzero(new)
    run = np.diff(np.r_[at, n])
    one = sym[at]
    named = one.astype(U64) + U64(1)
    long = run > 1
    named[long] = mix64(named[long] + run[long].astype(U64) * U64(MULT))
    off = np.searchsorted(at, off)
    first = off[:-1][off[:-1] < off[1:]]
    label = _reduce(one if one.dtype == np.uint8 else named, first)
    for _ in range(3):
        label = _reduce(label, first)
    start = np.empty(len(at), bool)
    start[1:] = label[1:] > label[:-1]
    start[:-1] &= label[:-1] > label[1:]
    last = off[1:][off[:-1] < off[1:]] - 1
    start[last] = False
    start[first] = True
    b = np.flatnonzero(start)
    e = np.r_[b[1:], len(at)]
    total = np.zeros(len(at) + 1, U64)
    np.cumsum(named * powers(MULT, len(at)), out=total[1:])
    back = powers(pow(MULT, -1, 1 << 64), len(at))
    return mix64((total[e] - total[b]) * back[b] + (e - b).astype(U64)), np.searchsorted(b, off)


def sketches(column: pa.Array) -> np.ndarray:
    """rows x BINS of 16-bit values."""
    out = np.full((len(column), BINS), EMPTY, np.uint16)
    for lo, hi, buf, off in text_chunks(column):
        sym = buf
        for level in range(1, max(LEVELS) + 1):
            if not len(sym):
                break
            sym, off = _level(sym, off)
            if level in LEVELS:
                h = mix64(sym + U64(level))
                row = np.repeat(np.arange(lo, hi), np.diff(off))
                value = np.minimum(h & U64(0xFFFF), U64(EMPTY - 1)).astype(np.uint16)
                np.minimum.at(out.reshape(-1), row * BINS + (h >> U64(58)).astype(np.int64), value)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    some = (a != EMPTY) | (b != EMPTY)
    n = some.sum(axis=1)
    return np.where(n > 0, ((a == b) & some).sum(axis=1) / np.maximum(n, 1), 1.0)


def _hex(s: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in s.astype(">u2")]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint per row of ``docs``. No shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_hex(sketches(b.column(1))), pa.string())], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Texts dealt to ranges of doc_id and sorted: id (``NULL_ID`` for null),
    text, ghost. Every range ends with a copy of the row that comes after it (ghost).

    Bounds are approximate quantiles of doc_id, one per shuffle partition; the
    only other thing the driver sees is the first id of each range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("id"), "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.select(F.col("id").cast("double")).approxQuantile("id", [i / n for i in range(1, n)], 1 / (10 * n)) if n > 1 else []
    edge = spark.sparkContext.broadcast(np.unique(np.array(bounds or [], np.float64)))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        """0 for the largest ids."""
        return pd.Series(len(edge.value) - np.searchsorted(edge.value, ids.to_numpy().astype(np.float64), "left")).astype("int32")

    heads = {r["part"]: r["id"] for r in rows.select("id", part_of("id").alias("part")).groupBy("part").agg(F.max("id").alias("id")).collect()}
    order = sorted(heads)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    ghosts = spark.sparkContext.broadcast({heads[p]: before[p] for p in order})

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, part: pd.Series) -> pd.Series:
        """The row's range and, for the first row of a range, the range before (as -1 - range)."""
        return pd.Series([[p] if i not in ghosts.value else [p, -1 - ghosts.value[i]] for i, p in zip(ids, part)])

    dealt = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.explode(places("id", part_of("id"))))
    dealt = dealt.select("id", "text", "tie", (F.col("place") < 0).alias("ghost"),
                         F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("part"))
    return dealt.repartitionById(n, "part").sortWithinPartitions("ghost", F.desc("id"), "tie").select("id", "text", "ghost")


def compare_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next per row of ``docs``: the edited text has its last
    third replaced by the first as many code points of the next document."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, until its next one is here: id, text, ghost, sketch
        for b in batches:
            if not b.num_rows:
                continue
            ids, ghost = b.column(0).to_pylist(), b.column(2).to_pylist()
            texts = [t.decode() for t in as_binary(b.column(1)).to_pylist()]
            own = sketches(b.column(1))
            if held:
                ids, texts, ghost, own = [held[0], *ids], [held[1], *texts], [held[2], *ghost], np.vstack([held[3], own])
            held = ids[-1], texts[-1], ghost[-1], own[-1:]
            real = [i for i in range(len(ids) - 1) if not ghost[i]]
            if not real:
                continue
            edited = [texts[i][:len(texts[i]) - len(texts[i]) // 3] + texts[i + 1][:len(texts[i]) // 3] for i in real]
            other = sketches(pa.array(edited, pa.large_string()))
            mine, following = own[real], own[[i + 1 for i in real]]
            yield pa.RecordBatch.from_arrays([
                pa.array([None if ids[i] == NULL_ID else ids[i] for i in real], pa.int64()), pa.array([len(texts[i]) for i in real], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(_hex(mine)), pa.array(_hex(other)),
                pa.array(likeness(mine, other)), pa.array(likeness(mine, following))], names)

    return with_next(docs).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                                           "edited_fingerprint string, near_edited double, near_next double")
