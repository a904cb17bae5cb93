"""Repeated-passage removal by distributed prefix doubling on sampled positions.

A byte goes if a ``length``-byte string that covers it also starts in a
document with a smaller doc_id. Spark sorts (rank, next rank, document,
position) rows and ranks them anew over growing lengths until a position is
unique or past the threshold:

1. Length ``gram``: the positions are the smallest ``gram``-byte hashes of every
   ``length``-byte window, so each window holds at least one of them, and equal
   windows hold the same. A rank found in one document only is unique: it goes.
2. Length ``gram`` plus the next ranks on both sides, as far as any window with
   this position reaches: a position whose pair also stands in a smaller
   document is past the threshold, every window over it repeats. Of each pair
   only its first document goes on, and only if its rank has several pairs.
3. Length ``length``: the windows of those positions, sorted within their rank.

Only round 1 handles a row per sampled position (about 2 in ``length - gram + 2``
bytes). Pairs repeated within a batch are ranked there before the shuffle. A
rank with more than ``HOT`` pairs in a batch leaves its first pair as a sign;
the others, and in round 3 all positions of that rank, are ranked window by
window, each window once per batch, so no sorted group holds all of a hot
passage. Round 1's rows travel as packed columns, one blob per batch and
partition, and are rows again before Spark sorts them. Texts are shuffled once,
compressed, by document.

Defined results: null text is empty; texts shorter than ``length`` keep all;
a null doc_id sorts after all others, and rows without one do not cover each
other; rows that share a doc_id do not cover each other either; repeated rows
come out as often as they went in. Spans are byte offsets, end exclusive; a
cut may fall inside a character, so the rest is returned as binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch.llm.frames import written
from gatewatch.llm.textbytes import as_binary, mix64, powers, text_chunks

U64 = np.uint64
GRAM = 20
HOT = 256
#: ranks keep so many bits: a rank shared by chance only sends more rows on to be compared
RANK_BITS = 48
#: text bytes that a task works on at once
SLICE_BYTES = 8 << 20
LAST = (1 << 63) - 1
#: odd multipliers of the two rolling hashes and their inverses modulo 2**64
MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BACK = tuple(pow(m, -1, 1 << 64) for m in MULT)
#: what the ranking says of a row
COVERED, WINDOWS, HOT_WINDOWS = 0, 1, 2
#: kinds of rows that go into it: ranked here already, plain, with the sign of a hot rank
DONE, HOT_ROW, PLAIN, SIGN = 0, 1, 2, 3


def byte_table(seed: int) -> np.ndarray:
    return mix64(np.arange(256, dtype=U64) + U64(1 + 256 * seed))


def _lists(col: pa.Array, names: list[str] | None = None) -> Iterator[list[np.ndarray]]:
    """The numbers, or structs by field, of each row of a list column; null is empty."""
    at = col.value_lengths().fill_null(0).to_numpy()
    ends = np.cumsum(at)
    flat = col.flatten()
    cols = [flat.field(n).to_numpy() for n in names] if names else [flat.to_numpy()]
    for lo, hi in zip((ends - at).tolist(), ends.tolist()):
        yield [c[lo:hi] for c in cols]


class Rolling:
    """Hashes of any substrings of one buffer."""

    def __init__(self, buf: np.ndarray, which: int) -> None:
        self.back = powers(BACK[which], len(buf) + 1)
        self.sum = np.zeros(len(buf) + 1, U64)
        np.cumsum(byte_table(which)[buf] * powers(MULT[which], len(buf)), out=self.sum[1:])

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix64((self.sum[hi] - self.sum[lo]) * self.back[lo])

    def grams(self, k: int) -> np.ndarray:
        h = (self.sum[k:] - self.sum[:-k]) * self.back[:len(self.sum) - k]
        h ^= h >> U64(29)
        h *= U64(0xBF58476D1CE4E5B9)
        return h


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` over each run of ``w`` neighbours."""
    s = 1
    while 2 * s <= w:
        x = pick(x[:-s], x[s:])
        s *= 2
    return pick(x[:len(x) - (w - s)], x[w - s:]) if s < w else x


def sampled(h: np.ndarray, off: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Positions whose gram hash is the smallest of some window that lies in one text."""
    w = length - gram + 1
    if len(h) < w:
        return np.zeros(0, np.int64)
    low = _sliding(h, w, np.minimum)  # of the window that starts here
    n = off[-1]
    for e in off[1:-1].tolist():  # windows over an end
        low[max(0, e - length + 1):min(e, n)] = 0
    wide = np.zeros(len(h) + w - 1, U64)
    wide[w - 1:w - 1 + len(low)] = low
    return np.flatnonzero((_sliding(wide, w, np.maximum) == h) & (h > 0))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal (sorted) keys starts."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _first_of(new: np.ndarray) -> np.ndarray:
    """For every row the index at which its run starts."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _positions(key: np.ndarray, check: np.ndarray, text: pa.Array, length: int, gram: int) -> tuple:
    """rank, pair, row and position of all sampled positions of a batch, and every row's document and text number."""
    out = []
    reach = length - gram
    for lo, hi, buf, off in text_chunks(text):
        if len(buf) < length:
            continue
        a, b = Rolling(buf, 0), Rolling(buf, 1)
        h = a.grams(gram)
        at = sampled(h, off, length, gram)
        row = np.searchsorted(off, at, "right") - 1
        left, right = np.maximum(off[row], at - reach), np.minimum(off[row + 1], at + length)
        pair = b(left, right) + mix64(((at - left) << 16 | (right - at)).astype(U64))
        out.append(((h[at] >> U64(64 - RANK_BITS)).view(np.int64), pair.view(np.int64), row + lo, at - off[row]))
    found = tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(4))
    return *found, key, check


def _spread(*keys: np.ndarray) -> np.ndarray:
    """A key that is almost surely a row's own, and no rank."""
    h = np.zeros(len(keys[0]), U64)
    for k in keys:
        h = mix64(h + k.view(U64) + U64(0x9E3779B97F4A7C15))
    return (h >> U64(2) | U64(1 << 62)).view(np.int64)


def _local(rank: np.ndarray, pair: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sort key and the kind of every row, ranked within the batch as far as possible."""
    kind = np.full(len(rank), PLAIN, np.int8)
    by = np.argsort(rank, kind="stable")
    new = _runs(rank[by])
    size = np.diff(np.r_[np.flatnonzero(new), len(by)])
    some = by[np.repeat(size > 1, size)]
    some = some[np.lexsort((doc[some], pair[some], rank[some]))]
    r, p, d = rank[some], pair[some], doc[some]
    new_rank, new_pair = _runs(r), _runs(r, p)
    first = d[_first_of(new_pair)] == d
    kind[some[~first]] = DONE
    pairs = np.add.reduceat(new_pair.astype(np.int64), np.flatnonzero(new_rank)) if len(some) else np.zeros(0, np.int64)
    hot = np.repeat(pairs > HOT, np.diff(np.r_[np.flatnonzero(new_rank), len(some)]))
    if hot.any():
        at = some[hot & first]
        at = at[np.lexsort((place[at], doc[at], rank[at]))]
        kind[at] = HOT_ROW
        kind[at[_runs(rank[at])]] = SIGN
    own = kind <= HOT_ROW
    return np.where(own, _spread(doc, place), rank), kind


def _slices(b: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about ``SLICE_BYTES`` of text (column ``at``)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy().astype(np.int64))
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE_BYTES, "right")))
        yield b.slice(lo, hi - lo)
        lo = hi


def _planes(a: np.ndarray) -> bytes:
    """An array's bytes, first all lowest ones: neighbours alike pack well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def _unplane(raw: bytes, at: int, n: int, kind: type) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    a = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
    return np.ascontiguousarray(a.T).reshape(-1).view(kind), at + n * size


def _blobs(parts: int, rank, pair, row, pos, docs, checks) -> tuple[list[int], list[bytes]]:
    """Rows of a batch by the partition of their key: (partitions, packed columns)."""
    key, kind = _local(rank, pair, docs[row], checks[row] << 32 | pos)
    part = mix64(key.view(U64)) % U64(parts)
    by = np.lexsort((key, part))
    part, key, pair, row, pos, kind = part[by], key[by], pair[by], row[by], pos[by], kind[by]
    head = np.flatnonzero(_runs(part))
    pack = zstandard.ZstdCompressor(level=1, write_checksum=False)
    out = []
    for lo, hi in zip(head.tolist(), [*head[1:].tolist(), len(part)]):
        used = np.unique(row[lo:hi])
        out.append(pack.compress(b"".join([
            np.array([hi - lo, len(used)], np.int64).tobytes(), _planes(np.diff(key[lo:hi], prepend=0)), _planes(pair[lo:hi]),
            _planes(np.searchsorted(used, row[lo:hi]).astype(np.uint32)), _planes(pos[lo:hi].astype(np.uint32)), kind[lo:hi].tobytes(),
            _planes(np.diff(docs[used], prepend=0)), _planes(checks[used].astype(np.uint32))])))
    return part[head].astype(np.int64).tolist(), out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed columns -> rows to sort: key, pair, doc, place (text check << 32 | position), kind."""
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        for blob in b.column(0):
            raw = unpack.decompress(blob.as_py())
            n, m = np.frombuffer(raw, np.int64, 2).tolist()
            key, at = _unplane(raw, 16, n, np.int64)
            pair, at = _unplane(raw, at, n, np.int64)
            row, at = _unplane(raw, at, n, np.uint32)
            pos, at = _unplane(raw, at, n, np.uint32)
            kind = np.frombuffer(raw, np.int8, n, at)
            docs, at = _unplane(raw, at + n, m, np.int64)
            checks, _ = _unplane(raw, at, m, np.uint32)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.cumsum(key)), pa.array(pair), pa.array(np.cumsum(docs)[row]),
                pa.array(checks[row].astype(np.int64) << 32 | pos), pa.array(kind)], ["key", "pair", "doc", "place", "kind"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list]:
    """Sorted batches as lists of columns, cut where the first ``keys`` columns change."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b])
        ends = [t.column(i).combine_chunks().to_numpy(zero_copy_only=False) for i in range(keys)]
        cut = int(np.flatnonzero(_runs(*ends))[-1]) if t.num_rows else 0
        rest = t.slice(cut)
        if cut:
            yield [c.combine_chunks() for c in t.slice(0, cut).columns]
    if rest is not None and rest.num_rows:
        yield [c.combine_chunks() for c in rest.columns]


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, pair, doc, place, kind, ...) -> doc, place, said, rank."""
    for cols in _groups(batches, 1):
        key, pair, doc, place, kind = (c.to_numpy() for c in cols[:5])
        new, new_pair = _runs(key), _runs(key, pair)
        start = np.flatnonzero(new)
        size = np.diff(np.r_[start, len(key)])
        several = np.repeat(np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start), size)
        pairs = np.repeat(np.add.reduceat(new_pair.astype(np.int64), start) > 1, size)
        hot = np.repeat(np.maximum.reduceat(kind, start) == SIGN, size)
        own = kind <= HOT_ROW
        first = doc[_first_of(new_pair)] == doc
        said = np.full(len(key), -1, np.int8)
        said[several & ~first] = COVERED
        said[several & first & pairs] = WINDOWS
        said[first & hot] = HOT_WINDOWS
        said[own] = np.where(kind[own] == DONE, COVERED, HOT_WINDOWS)
        on = said >= 0
        yield pa.RecordBatch.from_arrays([pa.array(doc[on]), pa.array(place[on]), pa.array(said[on]),
                                          pa.array(np.where(said[on] == WINDOWS, key[on], 0))], ["doc", "place", "said", "rank"])


def _contexts(length: int, gram: int):
    """Documents with what was said of their positions -> rows of round 3:
    g1, g2 (sort group), doc, place (start of ``ctx``, or of one window), done, ctx."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in (s.slice(i, 1000) for s in batches for i in range(0, s.num_rows, 1000)):
            cold, hot = [], []
            for doc, check, packed, (place, rank) in zip(*(b.column(i).to_pylist() for i in range(3)), _lists(b.column(4), ["pos", "rank"])):
                if not len(place):
                    continue
                text = unpack.decompress(packed)
                for pos, rank in zip(place.tolist(), rank.tolist()):
                    lo, hi = max(0, pos - reach), min(len(text), pos + length)
                    (cold if rank >= 0 else hot).append((rank, doc, check << 32 | lo, text[lo:hi]))
            rows = []
            if cold:
                rank, doc, place, ctx = zip(*cold)
                rows.append(pa.RecordBatch.from_arrays([
                    pa.array(rank, pa.int64()), pa.array(np.zeros(len(rank), np.int64)), pa.array(doc, pa.int64()),
                    pa.array(place, pa.int64()), pa.array(np.zeros(len(rank), bool)), pa.array(ctx, pa.binary())], _ROUND3))
            if hot:
                _, doc, place, ctx = zip(*hot)
                g1, g2, row, at = _windows(pa.array(ctx, pa.binary()), length)
                d, p = np.array(doc, np.int64)[row], np.array(place, np.int64)[row] + at
                by = np.lexsort((p, d, g2, g1))
                g1, g2, d, p = g1[by], g2[by], d[by], p[by]
                keep = _runs(g1, g2, d, p)  # neighbouring positions share windows
                g1, g2, d, p = g1[keep], g2[keep], d[keep], p[keep]
                done = d[_first_of(_runs(g1, g2))] != d
                rows.append(pa.RecordBatch.from_arrays([
                    pa.array(np.where(done, _spread(d, p), g1)), pa.array(g2), pa.array(d), pa.array(p), pa.array(done),
                    pa.nulls(len(d), pa.binary())], _ROUND3))
            yield from rows
    return run


_ROUND3 = ["g1", "g2", "doc", "place", "done", "ctx"]


def _windows(ctx: pa.Array, length: int) -> tuple:
    """(hash, other hash, row, offset) of every window of every context."""
    out = []
    for lo, hi, buf, off in text_chunks(ctx):
        count = np.maximum(np.diff(off) - length + 1, 0)
        row = np.repeat(np.arange(hi - lo), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        s = off[row] + at
        out.append((Rolling(buf, 0)(s, s + length).view(np.int64), Rolling(buf, 1)(s, s + length).view(np.int64), row + lo, at))
    return tuple(np.concatenate(x) for x in zip(*out))


def _rank_windows(length: int):
    """Sorted rows of round 3 -> doc, check, start, end of what is covered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g1, g2, doc, place, done, ctx in _groups(batches, 2):
            g1, g2, doc, place = (c.to_numpy() for c in (g1, g2, doc, place))
            done, single = done.to_numpy(zero_copy_only=False), ctx.is_null().to_numpy(zero_copy_only=False)
            group = _runs(g1, g2)
            covered = single & (done | (doc[_first_of(group)] != doc))
            d, s = [doc[covered]], [place[covered]]
            if not single.all():
                rows = np.flatnonzero(~single)
                h, h2, row, at = _windows(ctx.take(pa.array(rows)), length)
                row = rows[row]
                gid = np.cumsum(group)[row]
                by = np.lexsort((doc[row], h2, h, gid))
                row, at = row[by], at[by]
                on = doc[row][_first_of(_runs(gid[by], h[by], h2[by]))] != doc[row]
                d.append(doc[row[on]])
                s.append(place[row[on]] + at[on])
            d, s = np.concatenate(d), np.concatenate(s)
            by = np.lexsort((s, d))
            d, s = d[by], s[by]
            new = _runs(d, s - np.arange(len(s)))  # runs of neighbouring starts
            head = np.flatnonzero(new)
            tail = np.r_[head[1:], len(s)][:len(head)] - 1
            yield pa.RecordBatch.from_arrays([pa.array(d[head]), pa.array(s[head] >> 32), pa.array(s[head] & 0xFFFFFFFF),
                                              pa.array((s[tail] & 0xFFFFFFFF) + length)], ["doc", "check", "start", "end"])
    return run


def _cut(length: int, gram: int):
    """Whole texts with everything known of them -> doc_id, n_bytes, spans, kept."""
    reach = length - gram
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in (s.slice(i, 1000) for s in batches for i in range(0, s.num_rows, 1000)):
            sizes, found, kept = [], [], []
            for packed, (at,), (more,) in zip(b.column(1).to_pylist(), _lists(b.column(2)), _lists(b.column(3))):
                text = unpack.decompress(packed)
                at = at.astype(np.int64)
                lo = np.r_[np.maximum(at - reach, 0), more >> 32]
                hi = np.r_[np.minimum(at + length, len(text)), more & 0xFFFFFFFF]
                sizes.append(len(text))
                if not len(lo):
                    found.append([])
                    kept.append(text)
                    continue
                by = np.argsort(lo, kind="stable")
                lo, hi = lo[by], np.maximum.accumulate(hi[by])
                new = np.r_[True, lo[1:] > hi[:-1]]
                lo, hi = lo[new].tolist(), hi[np.r_[np.flatnonzero(new)[1:] - 1, len(hi) - 1]].tolist()
                found.append([{"start": x, "end": y} for x, y in zip(lo, hi)])
                kept.append(b"".join(text[x:y] for x, y in zip([0, *hi], [*lo, len(text)])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(found, spans), pa.array(kept, pa.binary()), b.column(5)],
                                             ["doc_id", "n_bytes", "spans", "kept", "copies"])
    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, check, copies -> doc_id, doc, check, copies, packed text."""
    pack = zstandard.ZstdCompressor(level=5, write_checksum=False)
    for b in (s for b in batches for s in _slices(b, 1)):
        texts = as_binary(b.column(1)).to_pylist()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(0).fill_null(LAST), b.column(2), b.column(3),
                                          pa.array([pack.compress(t) for t in texts], pa.binary())], ["doc_id", "doc", "check", "copies", "packed"])


def _numbered(text: DataFrame) -> DataFrame:
    """doc_id, text, check, copies: every distinct (doc_id, text) once, where ids
    are missing or used again; ``check`` tells the texts under one doc_id apart.
    It is 0 for a doc_id of one row, and else a number that no other text has."""
    shared = written(text.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id IS NULL OR n > 1").select("doc_id"), "shared_ids")
    plain = text.withColumns({"check": F.lit(0).cast("bigint"), "copies": F.lit(1).cast("bigint")})
    if shared.isEmpty():
        return plain
    odd = text.join(shared, text["doc_id"].eqNullSafe(shared["doc_id"]), "left_semi")
    once = written(odd.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
                   .withColumn("at", F.monotonically_increasing_id()), "shared_texts")
    part = F.shiftright("at", 33)
    before, ahead = [], 1
    for p, n in sorted(once.groupBy(part.alias("p")).count().collect()):
        before.append((p, ahead))
        ahead += n
    if ahead > 1 << 31:
        raise ValueError("more than 2**31 distinct texts without a doc_id of their own")
    first = text.sparkSession.createDataFrame(before, "p bigint, ahead bigint")
    number = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("ahead")
    once = once.join(F.broadcast(first), part == F.col("p")).select("doc_id", "text", number.alias("check"), "copies")
    return plain.join(shared, text["doc_id"].eqNullSafe(shared["doc_id"]), "left_anti").unionByName(once)


def repeated_passages(docs: DataFrame, length: int = 50, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, spans (removed), kept (the other bytes) per row of ``docs``."""
    if not 0 < gram <= length < 1 << 15:
        raise ValueError("0 < gram <= length < 32768")
    text = _numbered(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for b in batches for s in _slices(b, 1)):
            part, blob = _blobs(parts, *_positions(b.column(0).fill_null(LAST).to_numpy(), b.column(2).to_numpy(), b.column(1), length, gram))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blob, pa.binary())], ["part", "blob"])

    ranked = text.mapInArrow(positions, "part int, blob binary").repartitionById(parts, "part").select("blob") \
        .mapInArrow(_rows, "key bigint, pair bigint, doc bigint, place bigint, kind tinyint") \
        .sortWithinPartitions("key", "pair", "doc", "place") \
        .mapInArrow(_rank, "doc bigint, place bigint, said tinyint, rank bigint")
    pos = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    rank = F.when(F.col("said") == WINDOWS, F.col("rank")).otherwise(F.lit(-1))
    by_doc = ranked.groupBy("doc", F.shiftright("place", 32).alias("check")).agg(
        F.collect_list(F.when(F.col("said") == COVERED, pos)).alias("covered"),
        F.collect_list(F.when(F.col("said") != COVERED, F.struct(pos.alias("pos"), rank.alias("rank")))).alias("open"))
    packed = text.mapInArrow(_pack, "doc_id bigint, doc bigint, check bigint, copies bigint, packed binary")
    known = packed.join(by_doc.hint("merge"), ["doc", "check"], "left")
    windows = known.select("doc", "check", "packed", "covered", "open", "doc_id", "copies") \
        .mapInArrow(_contexts(length, gram), "g1 bigint, g2 bigint, doc bigint, place bigint, done boolean, ctx binary") \
        .repartition("g1").sortWithinPartitions("g1", "g2", "doc") \
        .mapInArrow(_rank_windows(length), "doc bigint, check bigint, start bigint, end bigint") \
        .groupBy("doc", "check").agg(F.collect_list(F.shiftleft("start", 32).bitwiseOR(F.col("end"))).alias("more"))
    # ``open`` is asked for here too, so that both uses read one shuffle
    return known.join(windows.hint("merge"), ["doc", "check"], "left").select("doc_id", "packed", "covered", "more", "open", "copies") \
        .mapInArrow(_cut(length, gram), "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary, copies bigint") \
        .select("doc_id", "n_bytes", "spans", "kept", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("col")
