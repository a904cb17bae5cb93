"""SimHash near-duplicates with pivot distance tables.

A fingerprint bit is set if it is set in over half of the XXH64 (seed 42)
hashes of a text's word shingles, repeats included. Texts link when their
fingerprints differ in ``max_bits`` or fewer bits.

Every distinct fingerprint gets a row of the pivot table: its Hamming
distances to ``PIVOTS`` fixed reference fingerprints. Two fingerprints within
``max_bits`` differ by no more than that in every coordinate, so a pair is
discarded by its largest coordinate difference, and only survivors have their
own distance taken. So that pairs are met without comparing everything: the
64 bits are cut into ``max_bits + 2`` blocks, any ``2`` of which must be equal
for a link (a pigeonhole, nothing is lost), and the first pivot's distance is
cut into cells of ``CELL`` that overlap by ``max_bits``. A cell and two equal
blocks are the join key. Equal fingerprints are one row, so a group of copies
costs one row; a fingerprint has at most 2,080 others within two bits.

Defined results: null or wordless text has fingerprint zero and links like any
other; fewer words than a shingle make one shingle; a null doc_id gets its
group's component, which is null if no id is in reach; repeated rows come out
as often as they went in.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewatch.llm.components import components
from gatewatch.llm.frames import spare, written
from gatewatch.llm.textbytes import as_binary, mix64, slices

PIVOTS = 12
CELL = 8
SEED = 42
_STEP = 4096


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every ``size``-word shingle; ``bytes.lower`` and ``bytes.split``
    are A-Z and ``[\\x20\\x09-\\x0D]`` exactly."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    last = ends[size - 1:] if len(words) >= size else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s:e], SEED) for s, e in zip(starts.tolist(), last.tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _STEP):
        part = hashes[i:i + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = votes * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and fp (the 64 bits as a signed long) per row of ``docs``. No shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, len(keep)):
            fp = [fingerprint(shingle_hashes(t.as_py(), size)) for t in as_binary(b.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.array(fp, np.uint64).view(np.int64))], [*keep, "fp"])

    rows = docs.select(*keep, "text")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())]))


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints, from a rule: the mixed numbers 1..n, signed."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64)).view(np.int64).tolist()


def pivot_table(fps: DataFrame) -> DataFrame:
    """``fps`` (fp) with the distance to each pivot, p0, p1, ..."""
    return fps.withColumns({f"p{i}": F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))) for i, p in enumerate(pivots())})


def _block_keys(max_bits: int) -> list[Column]:
    """One key for each pair of blocks: the bits of both, the rest cleared."""
    blocks = max_bits + 2
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    mask = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edge, edge[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [F.struct(F.lit(i).cast("tinyint").alias("t"), F.col("fp").bitwiseAND(F.lit(signed(x | y))).alias("k"))
            for i, (x, y) in enumerate(combinations(mask, 2))]


def near_fingerprints(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Distinct ``fp`` -> every pair (u, v), u < v, that differ in 1..max_bits bits."""
    rows = pivot_table(fps).withColumn("b", F.explode(F.array(*_block_keys(max_bits)))) \
        .select("fp", "b.t", "b.k", *[f"p{i}" for i in range(PIVOTS)])
    cell = lambda c: F.floor(c / CELL).cast("int")
    left = rows.withColumn("c", cell(F.col("p0")))
    right = rows.withColumn("c", F.explode(F.array_distinct(F.array(cell(F.col("p0") - max_bits), cell(F.col("p0") + max_bits)))))
    left, right = left.alias("l"), right.alias("r")
    gap = F.greatest(*[F.abs(F.col(f"l.p{i}") - F.col(f"r.p{i}")) for i in range(PIVOTS)])
    near = [F.col("l.t") == F.col("r.t"), F.col("l.k") == F.col("r.k"), F.col("l.c") == F.col("r.c"),
            F.col("l.fp") < F.col("r.fp"), gap <= max_bits,
            F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= max_bits]
    return left.join(right, reduce(Column.__and__, near)).select(F.col("l.fp").alias("u"), F.col("r.fp").alias("v")).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id in reach) per row of ``docs``."""
    fps = written(fingerprints(docs, size), "fingerprints")
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp_first")
    found = components(near_fingerprints(reps.select("fp"), max_bits))
    linked = reps.join(found, reps["fp"] == found["node"], "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    low = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    group = linked.join(low, "root").select("fp", "component_id")
    return fps.join(group, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, size: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` (all its columns), one row of each group: that of its smallest
    doc_id (rows without one come last), then of its smallest content key.

    Groups are of texts and not of ids: every row takes part by a 128-bit key of
    its doc_id and text, so rows without an id and unlike texts under one id are
    kept or dropped by their own fingerprints. Of rows that repeat doc_id and
    text one stays."""
    key, n = spare(docs, "_key"), spare(docs, "_n")
    own = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.coalesce("text", F.lit(""))).cast("binary"))
    keyed = docs.withColumn(key, F.unhex(own))
    fps = written(fingerprints(keyed, size, ("doc_id", key)), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("key")))
    reps = written(fps.groupBy("fp").agg(first.alias("first")), "fp_first")
    found = components(near_fingerprints(reps.select("fp"), max_bits))
    linked = reps.join(found, reps["fp"] == found["node"], "left").select("first", F.coalesce("root", "fp").alias("root"))
    stay = linked.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias(key))
    again = Window.partitionBy(key).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return keyed.join(stay, key, "left_semi").withColumn(n, F.row_number().over(again)).where(F.col(n) == 1).drop(key, n)
