"""Scans of each user's events in time order, however hot the user.

Rows are dealt to ranges of (user, time, event id) and sorted. So a partition
holds a run of whole users, except that its first and its last user may go on in
the neighbours: a user with a third of all rows, all of one day, is spread over a
third of the partitions. What a partition must know of the others is carried as
one *edge* per partition and end (first and last time, failures), a table that
grows with the partitions and not with the rows.

* ``run_summaries``: per (user, partition) the summary of an associative fold
  (runs of failures, gaps between failures), to be folded per user.
* ``recent_counts``: per event the failures of its user in ``[t - w, t]``. With
  F(p) the user's failures before p that is ``F(t + 1) - F(t - w)``. Both are
  known inside the partition for all events but those near its ends. Of these
  the edges settle every p that falls between two partitions or outside the
  user's rows; for the others the p are merged with the failures of the users
  that span partitions, dealt to ranges once more, and counted through.

Times are whole microseconds. A partition's rows of one user are held as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gatewatch.session import Shared, write_once

USER = "user_id"
MINUTE = 60_000_000
#: the key space of one search; users are taken in groups that fit
KEYS = 1 << 62


def in_ranges(rows: DataFrame, order: list[Column], pieces: int | None) -> DataFrame:
    """``rows`` in ranges of ``order``, sorted; ``pieces`` ranges, by default as many as Spark finds fit."""
    dealt = rows.repartitionByRange(pieces, *order) if pieces else rows.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order)


def _heads(users: pa.Array) -> np.ndarray:
    """Where a new user starts (null is a user)."""
    a, b = users[1:], users[:-1]
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.r_[True, ~same.to_numpy(zero_copy_only=False)] if len(users) else np.zeros(0, bool)


def whole_users(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, bool, bool]]:
    """(rows, start of each user, holds the partition's first user, its last) of whole users, column 0 being the user."""
    held: list[pa.RecordBatch] = []
    first = True
    for b in batches:
        if not b.num_rows:
            continue
        head = _heads(b.column(0))
        goes_on = bool(held) and not _heads(pa.concat_arrays([held[-1].column(0)[-1:], b.column(0)[:1]]))[1]
        cut = np.flatnonzero(head)[1:] if goes_on or not held else np.flatnonzero(head)
        if len(cut):
            t = pa.Table.from_batches([*held, b.slice(0, int(cut[-1]))]).combine_chunks()
            yield t, np.flatnonzero(_heads(t.column(0).chunk(0))), first, False
            held, first = [], False
            b = b.slice(int(cut[-1]))
        held.append(b)
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.zeros(1, np.int64), first, True


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _groups_of_users(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of users whose time spans fit one key space."""
    a, have = 0, 0
    for u, span in enumerate((hi - lo).tolist()):
        if u > a and have + span + 2 > KEYS:
            yield a, u
            a, have = u, 0
        have += span + 2
    if len(lo):
        yield a, len(lo)


def count_before(t: np.ndarray, on: np.ndarray, start: np.ndarray, probes: list[np.ndarray]) -> list[np.ndarray]:
    """For sorted users' rows (times ``t``, users from ``start``): per row and probe
    the rows of its user with ``on`` and a time before the probe."""
    n = len(t)
    end = np.r_[start[1:], n]
    lo, hi = t[start], t[end - 1]
    out = [np.zeros(n, np.int64) for _ in probes]
    for a, b in _groups_of_users(lo, hi):
        x, y = int(start[a]), int(end[b - 1])
        size = end[a:b] - start[a:b]
        base = np.cumsum(hi[a:b] - lo[a:b] + 2) - (hi[a:b] - lo[a:b] + 2)
        low, top, key0 = (np.repeat(c, size) for c in (lo[a:b], hi[a:b] + 1, base))
        keys = (key0 + t[x:y] - low)[on[x:y]]
        ahead = np.searchsorted(keys, key0)
        for o, p in zip(out, probes):
            o[x:y] = np.searchsorted(keys, key0 + np.clip(p[x:y], low, top) - low) - ahead
    return out


# --- runs and gaps ----------------------------------------------------------

RUNS = ("part int, len bigint, prefix bigint, suffix bigint, maxrun bigint, full boolean, gsum bigint, gcnt bigint, "
        "first_fail bigint, last_fail bigint")


def summarise(t: np.ndarray, f: np.ndarray, known: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
    """Per user: rows, leading, trailing and longest run of failures, gaps between
    neighbouring failures in whole minutes, first and last failure. Rows without a
    time (``known`` is false; they come first) are in the runs, not in the gaps."""
    n = len(t)
    end = np.r_[start[1:], n]
    at = np.arange(n)
    begin = np.repeat(start, end - start)
    last_ok = np.maximum.accumulate(np.where(f, begin - 1, at))  # the row before a user's first counts as one
    last_ok = np.maximum(last_ok, begin - 1)
    first_ok = np.minimum.reduceat(np.where(f, n, at), start)
    first_ok = np.minimum(first_ok, end)
    tail = np.maximum.reduceat(np.where(f, begin - 1, at), start)
    fails = np.flatnonzero(f & known)
    who = np.searchsorted(start, fails, "right") - 1
    same = who[1:] == who[:-1]
    gap = np.where(same, (t[fails[1:]] - t[fails[:-1]]) // MINUTE, 0)
    gsum, gcnt = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    np.add.at(gsum, who[1:], gap)
    np.add.at(gcnt, who[1:], same)
    edge = np.searchsorted(who, np.arange(len(start) + 1))
    some = edge[1:] > edge[:-1]
    first_fail = np.where(some, t[fails[np.minimum(edge[:-1], max(len(fails) - 1, 0))]] if len(fails) else 0, 0)
    last_fail = np.where(some, t[fails[edge[1:] - 1]] if len(fails) else 0, 0)
    return {"len": end - start, "prefix": first_ok - start, "suffix": end - 1 - tail,
            "maxrun": np.maximum.reduceat(np.where(f, at - last_ok, 0), start), "full": first_ok == end, "gsum": gsum, "gcnt": gcnt,
            "first_fail": np.ma.masked_array(first_fail, ~some), "last_fail": np.ma.masked_array(last_fail, ~some)}


def _masked(x: np.ndarray) -> pa.Array:
    return pa.array(x.data, mask=x.mask) if isinstance(x, np.ma.MaskedArray) else pa.array(x)


def run_summaries(rows: DataFrame, pieces: int | None = None) -> DataFrame:
    """``rows`` (user_id, event_id, us, f) -> user_id and ``RUNS`` per (user, partition), in the order of ``part``."""
    names = [x.split()[0] for x in RUNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for t, start, _, _ in whole_users(batches):
            us = t.column("us").combine_chunks()
            s = summarise(us.fill_null(0).to_numpy(), _numbers(t, "f"), us.is_valid().to_numpy(zero_copy_only=False), start)
            yield pa.RecordBatch.from_arrays([t.column(0).chunk(0).take(pa.array(start)), pa.array(np.full(len(start), part, np.int32)),
                                              *(_masked(s[c]) for c in names[1:])], [USER, *names])

    kind = rows.schema[USER].dataType.simpleString()
    ranged = in_ranges(rows.select(USER, "us", "event_id", "f"), [F.col(USER), F.col("us"), F.col("event_id")], pieces)
    return ranged.select(USER, "us", "f").mapInArrow(run, f"{USER} {kind}, {RUNS}")


# --- counts of recent failures ------------------------------------------------

def recent_counts(rows: DataFrame, widths: Mapping[str, int], pieces: int | None = None, keep: tuple[str, ...] = ("event_id",),
                  peaks: bool = False) -> DataFrame:
    """``rows`` (user_id, event_id, us without nulls, f) -> user_id, the columns ``keep`` and
    one count per width (seconds), per row; with ``peaks`` the greatest counts of each
    user instead (no ``keep`` then)."""
    spark = rows.sparkSession
    names = list(widths)
    ahead = [int(w * 1_000_000) for w in widths.values()]
    user, kept = rows.schema[USER], [] if peaks else [rows.schema[c] for c in keep]
    order = [F.col(USER), F.col("us"), F.col("event_id")]
    columns = [c.name for c in kept]
    wanted = list(dict.fromkeys([USER, "us", "f", *columns]))
    # kind 0: settled; 1: near an end, its counts are before p inside the partition (null: not known there); 2: an edge
    schema = T.StructType([T.StructField("kind", T.IntegerType()), user, *kept, T.StructField("part", T.IntegerType()),
                           T.StructField("at", T.LongType()), T.StructField("us", T.LongType()),
                           *(T.StructField(c, T.LongType()) for c in (*names, "upto"))])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def emit(**values) -> pa.RecordBatch:
        n = len(values["kind"])
        return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) if f.name in values else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for t, start, is_first, is_last in whole_users(batches):
            us, f = _numbers(t, "us"), _numbers(t, "f")
            n = len(us)
            end = np.r_[start[1:], n]
            probes = [us + 1, *(us - a for a in ahead)]
            upto, *before = count_before(us, f, start, probes)
            near = np.zeros(n, bool)
            unknown = [np.zeros(n, bool) for _ in probes]
            if is_first:
                for p, x in zip(probes, unknown):
                    x[:end[0]] |= p[:end[0]] <= us[0]
            if is_last:
                for p, x in zip(probes, unknown):
                    x[start[-1]:] |= p[start[-1]:] > us[-1]
            for x in unknown:
                near |= x
            users = t.column(0).chunk(0)
            settled = np.flatnonzero(~near)
            if len(settled) and peaks:
                who = np.searchsorted(start, settled, "right") - 1
                head = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                yield emit(kind=np.zeros(len(head), np.int32), user_id=users.take(pa.array(settled[head])),
                           **{c: np.maximum.reduceat((upto - b)[settled], head) for c, b in zip(names, before)})
            elif len(settled):
                yield emit(kind=np.zeros(len(settled), np.int32), user_id=users.take(pa.array(settled)),
                           **{c: t.column(c).chunk(0).take(pa.array(settled)) for c in columns},
                           **{c: (upto - b)[settled] for c, b in zip(names, before)})
            rest = np.flatnonzero(near)
            if len(rest):
                yield emit(kind=np.ones(len(rest), np.int32), user_id=users.take(pa.array(rest)), part=np.full(len(rest), part, np.int32),
                           at=seen + rest, us=us[rest], **{c: t.column(c).chunk(0).take(pa.array(rest)) for c in columns if c != USER},
                           **{c: pa.array(b[rest], mask=x[rest]) for c, b, x in zip(("upto", *names), (upto, *before), unknown)})
            edges = sorted({0} if is_first else set()) + ([len(start) - 1] if is_last and (len(start) > 1 or not is_first) else [])
            if edges:  # first and last time and the failures of the users at the partition's ends
                fails = np.add.reduceat(f.astype(np.int64), start)
                yield emit(kind=np.full(len(edges), 2, np.int32), user_id=users.take(pa.array(start[edges])), part=np.full(len(edges), part, np.int32),
                           at=us[start[edges]], us=us[end[edges] - 1], upto=fails[edges])
            seen += n

    scanned = write_once(in_ranges(rows.select(*dict.fromkeys([*wanted, "event_id"])), order, pieces).select(*wanted).mapInArrow(scan, schema), "recent")
    out = [F.col(USER), *(F.col(f"`{c}`") for c in columns), *(F.col(c) for c in names)]
    settled = scanned.where("kind = 0").select(*out)
    spans: dict = {}
    for e in scanned.where("kind = 2").select("part", USER, "at", "us", "upto").orderBy("part", "at").collect():
        spans.setdefault(e[USER], []).append((e["part"], e["at"], e["us"], e["upto"]))
    held = {}
    for u, pieces_of in spans.items():
        part, lo, hi, n = (np.array(c, np.int64) for c in zip(*pieces_of))
        held[u] = part, lo, hi, np.r_[0, np.cumsum(n)]
    shared = Shared(spark, held)
    probe = T.StructType([*schema.fields, T.StructField("ask", T.ArrayType(T.LongType()))])
    settled_names = ("upto", *names)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts from the user's first row on; what the edges do not tell is asked for."""
        for b in batches:
            us, part = b.column(b.schema.get_field_index("us")).to_pylist(), b.column(b.schema.get_field_index("part")).to_pylist()
            local = [b.column(b.schema.get_field_index(c)).to_pylist() for c in settled_names]
            asks = []
            for i, u in enumerate(b.column(b.schema.get_field_index(USER)).to_pylist()):
                parts, lo, hi, total = shared.value[u]
                ask = []
                for c, p in zip(local, (us[i] + 1, *(us[i] - a for a in ahead))):
                    if c[i] is not None:
                        c[i] += int(total[np.searchsorted(parts, part[i])])
                        ask.append(None)
                        continue
                    j = int(np.searchsorted(hi, p))  # the first piece that is not all before p
                    inside = j < len(parts) and p > lo[j]
                    c[i] = None if inside else int(total[j])
                    ask.append(p if inside else None)
                asks.append(ask)
            columns = list(b.columns)
            for c, values in zip(settled_names, local):
                columns[b.schema.get_field_index(c)] = pa.array(values, pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(asks, pa.list_(pa.int64()))], [*b.schema.names, "ask"])

    near = write_once(scanned.where("kind = 1").mapInArrow(settle, probe), "recent_ends")
    asked = near.select("part", "at", USER, F.posexplode("ask").alias("which", "p")).where("p IS NOT NULL")
    told = near.select("part", "at").limit(0).withColumns({c: F.lit(None).cast("bigint") for c in (f"t{i}" for i in range(len(names) + 1))})
    wide = [u for u, x in held.items() if len(x[0]) > 1]
    if wide and not asked.isEmpty():
        who = spark.createDataFrame([(u,) for u in wide], T.StructType([T.StructField("gw_u", user.dataType)]))
        fails = rows.where("f").join(F.broadcast(who), F.col(USER).eqNullSafe(F.col("gw_u")), "left_semi").select(USER, F.col("us").alias("p"))
        told = _ranks(asked, fails, pieces).groupBy("part", "at").agg(*[F.max(F.when(F.col("which") == i, F.col("n"))).alias(f"t{i}")
                                                                      for i in range(len(names) + 1)])
    told = told.select(F.col("part").alias("gw_part"), F.col("at").alias("gw_at"), *[f"t{i}" for i in range(len(names) + 1)])
    full = near.join(told, (F.col("part") == F.col("gw_part")) & (F.col("at") == F.col("gw_at")), "left")
    upto = F.coalesce("upto", "t0")
    ends = full.select(F.col(USER), *(F.col(f"`{c}`") for c in columns),
                       *((upto - F.coalesce(c, f"t{i}")).alias(c) for i, c in enumerate(names, 1)))
    every = settled.unionByName(ends)
    return every.groupBy(USER).agg(*[F.max(c).alias(c) for c in names]) if peaks else every


def _ranks(asked: DataFrame, fails: DataFrame, pieces: int | None) -> DataFrame:
    """part, at, which and n: the failures of the user before ``p``."""
    user = asked.schema[USER].dataType
    both = asked.select(USER, "p", F.lit(0).alias("is_fail"), "part", "at", "which").unionByName(
        fails.select(USER, "p", F.lit(1).alias("is_fail")), allowMissingColumns=True)
    order = [F.col(USER), F.col("p"), F.col("is_fail"), F.col("part"), F.col("at"), F.col("which")]
    schema = T.StructType([T.StructField("edge", T.BooleanType()), T.StructField(USER, user), T.StructField("piece", T.IntegerType()),
                           *(T.StructField(c, T.LongType()) for c in ("part", "at", "which", "n"))])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId()
        for t, start, is_first, is_last in whole_users(batches):
            f = _numbers(t, "is_fail") == 1
            so_far = np.cumsum(f)
            size = np.diff(np.r_[start, len(f)])
            n = so_far - np.repeat(so_far[start] - f[start], size)
            users = t.column(0).chunk(0)
            ask = np.flatnonzero(~f)
            if len(ask):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(len(ask), bool)), users.take(pa.array(ask)), pa.array(np.full(len(ask), piece, np.int32)),
                    *(t.column(c).chunk(0).take(pa.array(ask)).cast(pa.int64()) for c in ("part", "at", "which")), pa.array(n[ask])], schema=arrow)
            ends = sorted(({0} if is_first else set()) | ({len(start) - 1} if is_last else set()))
            if ends:
                total = np.add.reduceat(f.astype(np.int64), start)[ends]
                empty = pa.nulls(len(ends), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.ones(len(ends), bool)), users.take(pa.array(start[ends])), pa.array(np.full(len(ends), piece, np.int32)),
                    empty, empty, empty, pa.array(total)], schema=arrow)

    found = write_once(in_ranges(both, order, pieces).mapInArrow(run, schema), "ranks")
    carried, ahead = [], {}
    for e in found.where("edge").select("piece", USER, "n").orderBy("piece").collect():
        if ahead.get(e[USER]):
            carried.append((e["piece"], e[USER], ahead[e[USER]]))
        ahead[e[USER]] = ahead.get(e[USER], 0) + e["n"]
    carry = asked.sparkSession.createDataFrame(carried, T.StructType([T.StructField("gw_piece", T.IntegerType()), T.StructField("gw_u", user),
                                                                      T.StructField("gw_n", T.LongType())]))
    return found.where("NOT edge").join(F.broadcast(carry), (F.col("piece") == F.col("gw_piece")) & F.col(USER).eqNullSafe(F.col("gw_u")), "left") \
        .select("part", "at", "which", (F.col("n") + F.coalesce("gw_n", F.lit(0))).alias("n"))
