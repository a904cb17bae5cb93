"""Repair of conversation structure by a persistent audit DP.

A conversation is legal when its role initials read ``(s?(ua)+)?``. Edits make
it so: K keeps a row, R gives it the role user or assistant, D deletes it (blank
and duplicate rows must go), I inserts an empty user or assistant row. The
cheapest edits win; among these the audit (the edits' letters) that is least in
ASCII. Given the audit the roles are determined, as they alternate.

The DP runs over the rows with a state for what came last: nothing, s, u or a.
An audit is a linked node: a prefix (its parent) and one more letter, so states
share their prefixes. A node has ancestors 1, 2, 4, ... steps back and a rolling
hash of its whole string. Two audits of equal cost are compared at their longest
common prefix, found by walking the ancestors down while the hashes differ; that
the prefixes below are equal is then verified up to the node they share, and a
hash collision falls back to comparing the strings.

One conversation may hold a third of all rows. So rows are dealt by ranges of
their order, each task cuts its rows into pieces of at most ``PIECE_ROWS`` rows
and ``PIECE_BYTES`` of text, and a piece's DP is run from each state in which it
may be entered. The pieces of a conversation are then chained: nodes now hold a
piece's string of letters. Which piece is entered in which state goes back to
the pieces, which repair their rows side by side. Only the chained letters of a
conversation are ever in one task, never its texts.

Defined results: null role and text are one space; rows with equal turn are
ordered by role and the first ``TIE_CHARS`` characters of text; null turns come
first; repeated rows are duplicates but for the first; a null conv_id is a
conversation; roles count by their first character, so an empty role is never
legal; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gatewatch.llm.frames import written

PIECE_ROWS = 4096
PIECE_BYTES = 4 << 20
TIE_CHARS = 64
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
PRIME, RADIX = (1 << 61) - 1, 1_000_003
#: states: nothing yet, s, u, a came last; legal ends are nothing and a
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: state -> the state that a row of this initial leads to
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: state -> the state after a user or assistant row of ours
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
#: neighbouring initials that are not illegal
LEGAL = {"su", "ua", "au"}


# --- audits as linked nodes -------------------------------------------------

class Audit:
    """A string as its parent's string and a segment; never changed once made."""
    __slots__ = ("up", "segment", "depth", "hash")

    def __init__(self, parent: Audit | None, segment: str):
        self.segment = segment
        if parent is None:
            self.up, self.depth, self.hash = [], 0, 0
            return
        self.depth = parent.depth + 1
        h = parent.hash
        for c in segment:
            h = (h * RADIX + ord(c)) % PRIME
        self.hash = h
        up, k, node = [parent], 0, parent
        while k < len(node.up):
            node = node.up[k]
            up.append(node)
            k += 1
        self.up = up

    def back(self, depth: int) -> Audit:
        """The ancestor at ``depth``."""
        node, away = self, self.depth - depth
        k = 0
        while away:
            if away & 1:
                node = node.up[k]
            away >>= 1
            k += 1
        return node

    def segments(self, after: int = 0) -> list[str]:
        """Segments below depth ``after``, first to last."""
        out, node = [], self
        while node.depth > after:
            out.append(node.segment)
            node = node.up[0]
        return out[::-1]

    def text(self, after: int = 0) -> str:
        return "".join(self.segments(after))


EMPTY = Audit(None, "")


def _agree(x: Audit, y: Audit) -> bool:
    """Whether two nodes of one depth hold equal segments, up to the node they share."""
    while x is not y:
        if x.segment != y.segment:
            return False
        x, y = x.up[0], y.up[0]
    return True


def before(x: Audit, y: Audit) -> bool:
    """Whether x's string is less than y's, in ASCII order."""
    depth = min(x.depth, y.depth)
    a, b = x.back(depth), y.back(depth)
    if a is b:
        return x.text(depth) < y.text(depth)
    if a.hash == b.hash:
        if _agree(a, b):
            return x.text(depth) < y.text(depth)
        return x.text() < y.text()
    for k in range(len(a.up) - 1, -1, -1):  # the first depth at which the prefixes differ
        if k < len(a.up) and a.up[k].hash != b.up[k].hash:
            a, b = a.up[k], b.up[k]
    if not _agree(a.up[0], b.up[0]):  # different prefixes of one hash, or of other segments
        return x.text() < y.text()
    p, q = a.segment, b.segment
    if p.startswith(q) or q.startswith(p):
        return x.text(a.depth - 1) < y.text(b.depth - 1)
    return p < q


class Best:
    """State -> (cost, audit): the cheapest way there, ties ASCII-least."""

    def __init__(self):
        self.cost: list = [None] * 4
        self.audit: list = [None] * 4

    def offer(self, state: int, cost: int, parent: Audit, segment: str) -> bool:
        have = self.cost[state]
        if have is not None and have < cost:
            return False
        node = Audit(parent, segment)
        if have is None or cost < have or before(node, self.audit[state]):
            self.cost[state], self.audit[state] = cost, node
            return True
        return False

    def insert(self) -> Best:
        """Inserted rows wherever they help; an inserted row costs, so this ends."""
        changed = True
        while changed:
            changed = False
            for state, to in NEXT.items():
                if self.cost[state] is not None:
                    changed |= self.offer(to, self.cost[state] + INSERT, self.audit[state], "I")
        return self

    def end(self) -> int:
        """The best legal end. Deleting all rows ends in ``START``, so there is one."""
        if self.cost[ASSISTANT] is None or self.cost[START] < self.cost[ASSISTANT]:
            return START
        if self.cost[START] == self.cost[ASSISTANT] and before(self.audit[START], self.audit[ASSISTANT]):
            return START
        return ASSISTANT


def entered(state: int) -> Best:
    b = Best()
    b.cost[state], b.audit[state] = 0, EMPTY
    return b


def step(b: Best, initial: str, gone: bool, truncated: bool) -> Best:
    """One row further: delete it, keep it or give it a role, then insert."""
    out = Best()
    more = TRUNCATED if truncated else 0
    for state in range(4):
        cost, audit = b.cost[state], b.audit[state]
        if cost is None:
            continue
        out.offer(state, cost + DELETE, audit, "D")
        if gone:
            continue
        to = KEEP.get(initial, {}).get(state)
        if to is not None:
            out.offer(to, cost + more, audit, "K")
        else:
            out.offer(NEXT[state], cost + REROLE + more, audit, "R")
    return out.insert()


def piece_paths(initials: list[str], gone: list[bool], truncated: list[bool], opens: bool) -> list[dict]:
    """Every (entry, exit) of a piece with its cost and audit. A piece that opens
    its conversation is entered from nothing, inserts before its first row included."""
    out = []
    for entry in (START,) if opens else range(4):
        b = entered(entry)
        if opens:
            b.insert()
        for row in zip(initials, gone, truncated):
            b = step(b, *row)
        out += [{"entry": entry, "exit": s, "cost": b.cost[s], "audit": b.audit[s].text()} for s in range(4) if b.cost[s] is not None]
    return out


def apply_edits(edits: str, entry: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts of a piece after its edits; ``entry`` is the state before it."""
    state, rows, new_roles, new_texts = entry, iter(zip(roles, texts)), [], []
    for e in edits:
        role, text = ("", "") if e == "I" else next(rows)
        if e == "D":
            continue
        if e == "K":
            state = KEEP[role[:1]][state]
        else:
            state = NEXT[state]
            role = NAMES[state]
        new_roles.append(role)
        new_texts.append(text)
    return new_roles, new_texts


# --- on Spark ---------------------------------------------------------------

_SAID = r"[^\x20\x09-\x0D]"
_PATHS = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _last_sign(text: Column) -> Column:
    return F.regexp_extract(text, rf"({_SAID})[\x20\x09-\x0D]*\z", 1)


def find_faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) -> the same and ``uid``, ``fault``
    (blank, duplicate, truncated or null). The first row of equal (conv_id, role,
    text) is a grouped minimum and comes back by the unique ``uid``, so neither a
    hot conversation nor a hot text is one task's."""
    kept = written(rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
                   .withColumn("uid", F.monotonically_increasing_id()), "turns")
    first = kept.groupBy("conv_id", "role", F.sha2("text", 256)) \
        .agg(F.min(F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("t"), F.col("turn").isNotNull().alias("has"), "uid")).alias("m")) \
        .select(F.col("m.uid").alias("uid"), F.lit(True).alias("first"))
    fault = F.when(~F.col("text").rlike(_SAID), "blank").when(F.col("first").isNull(), "duplicate") \
        .when(~_last_sign(F.col("text")).isin(".", "!", "?"), "truncated")
    return kept.join(first, "uid", "left").withColumn("fault", fault).drop("first")


def cut_pieces(faults: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Written: part, seq, conv_id, roles, texts, paths, illegal (pairs inside),
    head and tail (first and last initial). (part, seq) is the order of all rows."""
    kind = faults.schema["conv_id"].dataType
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("conv_id", to_arrow_type(kind)), ("roles", pa.list_(pa.string())),
                        ("texts", pa.list_(pa.string())), ("paths", _PATHS), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        now, rows, size = None, [], 0  # (conv_id,), its rows held, their bytes
        opens = False  # whether the piece held is known to open its conversation

        def piece() -> dict:
            initials = [r[0][:1] for r in rows]
            paths = piece_paths(initials, [r[2] in ("blank", "duplicate") for r in rows], [r[2] == "truncated" for r in rows], opens)
            return {"part": part, "seq": seq, "conv_id": now[0], "roles": [r[0] for r in rows], "texts": [r[1] for r in rows],
                    "paths": paths, "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
                    "head": initials[0], "tail": initials[-1]}

        for b in batches:
            done, held = [], 0
            for conv, *row in zip(*(c.to_pylist() for c in b.columns)):
                if now is not None and (now != (conv,) or len(rows) >= piece_rows or size >= piece_bytes):
                    done.append(piece())
                    opens, held = now != (conv,), held + size
                    rows, size, seq = [], 0, seq + 1
                    if held > piece_bytes:
                        yield pa.RecordBatch.from_pylist(done, schema)
                        done, held = [], 0
                now = (conv,)
                rows.append(row)
                size += len(row[1])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if rows:
            yield pa.RecordBatch.from_pylist([piece()], schema)

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, TIE_CHARS),
             F.xxhash64("text"), F.col("uid")]
    rows = faults.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text", "fault")
    return written(rows.mapInArrow(run, f"part int, seq bigint, conv_id {kind.simpleString()}, roles array<string>, texts array<string>, "
                                        "paths array<struct<entry:int,exit:int,cost:bigint,audit:string>>, illegal bigint, head string, tail string"), "pieces")


def chain(pieces: DataFrame) -> DataFrame:
    """part, seq, conv_id, entry, edits of every piece, and cost and illegal of its conversation."""
    kind = pieces.schema["conv_id"].dataType
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("conv_id", to_arrow_type(kind)), ("entry", pa.int32()),
                        ("edits", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())])

    def close(conv: object, places: list, b: Best, ways: list, illegal: int) -> list[dict]:
        end = b.end()
        entries, state = [], end
        for way in reversed(ways):
            state = way[state]
            entries.append(state)
        return [{"part": p, "seq": s, "conv_id": conv, "entry": e, "edits": x, "cost": b.cost[end], "illegal": illegal}
                for (p, s), e, x in zip(places, reversed(entries), b.audit[end].segments())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # (conv_id,)
        for batch in batches:
            done = []
            for part, seq, conv, paths, illegal, head, tail in zip(*(c.to_pylist() for c in batch.columns)):
                new, way = Best(), [None] * 4
                if now != (conv,):
                    if now is not None:
                        done += close(now[0], places, b, ways, total)
                    now, places, ways, total, last = (conv,), [], [], 0, None
                    lead = entered(START)
                    if len({p["entry"] for p in paths}) > 1:  # cut without knowing that it opens the conversation
                        lead.insert()
                    for p in paths:
                        e = p["entry"]
                        if lead.cost[e] is not None and new.offer(p["exit"], lead.cost[e] + p["cost"], EMPTY, lead.audit[e].text() + p["audit"]):
                            way[p["exit"]] = START
                else:
                    for p in paths:
                        e = p["entry"]
                        if b.cost[e] is not None and new.offer(p["exit"], b.cost[e] + p["cost"], b.audit[e], p["audit"]):
                            way[p["exit"]] = e
                b = new
                ways.append(way)
                places.append((part, seq))
                total += illegal + (last is not None and last + head not in LEGAL)
                last = tail
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist(close(now[0], places, b, ways, total), schema)

    rows = pieces.select("part", "seq", "conv_id", "paths", "illegal", "head", "tail").repartition("conv_id") \
        .sortWithinPartitions("conv_id", "part", "seq")
    return rows.mapInArrow(run, f"part int, seq bigint, conv_id {kind.simpleString()}, entry int, edits string, cost bigint, illegal bigint")


def repair(faults: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Repaired pieces: part, seq, conv_id, edits, cost and illegal (of the whole
    conversation), roles and texts after the edits."""
    pieces = cut_pieces(faults, piece_rows, piece_bytes)
    both = pieces.select("part", "seq", "roles", "texts").join(chain(pieces), ["part", "seq"])
    kind = faults.schema["conv_id"].dataType
    names = ["part", "seq", "conv_id", "edits", "cost", "illegal", "roles", "texts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles, texts = [], []
            for r, t, entry, edits in zip(*(b.column(c).to_pylist() for c in ("roles", "texts", "entry", "edits"))):
                new = apply_edits(edits, entry, r, t)
                roles.append(new[0])
                texts.append(new[1])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:6]), pa.array(roles, pa.list_(pa.string())),
                                              pa.array(texts, pa.list_(pa.string()))], names)

    return both.mapInArrow(run, f"part int, seq bigint, conv_id {kind.simpleString()}, edits string, cost bigint, illegal bigint, "
                                "roles array<string>, texts array<string>")


def repaired_rows(repaired: DataFrame) -> DataFrame:
    """conv_id, part, seq, place, role, text: the repaired rows, in the order of the first four."""
    return repaired.select("conv_id", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "r")) \
        .select("conv_id", "part", "seq", "place", F.col("r.roles").alias("role"), F.col("r.texts").alias("text"))


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, illegal, cost, audit, repaired_sha256: a digest is sequential, so
    a conversation's pieces pass one task, one piece at a time."""
    kind = repaired.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
                        ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # conv_id, illegal, cost, letters, digest, whether a row came before
        close = lambda x: dict(zip(schema.names, [x[0], x[1], x[2], "".join(x[3]), x[4].hexdigest()]))
        for b in batches:
            done = []
            for conv, illegal, cost, edits, roles, texts in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(close(now))
                    now = [conv, illegal, cost, [], hashlib.sha256(), False]
                now[3].append(edits)
                for role, text in zip(roles, texts):
                    now[4].update((("\n" if now[5] else "") + role + ":" + text).encode())
                    now[5] = True
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([close(now)], schema)

    rows = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq") \
        .select("conv_id", "illegal", "cost", "edits", "roles", "texts")
    return rows.mapInArrow(run, f"conv_id {kind.simpleString()}, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """The damage that the numbered query repairs: by crc32(conv_id:turn) % 20 a row
    is dropped (0), emptied (1), loses its ``.!?`` (2), is repeated (3) or said by user (4)."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), kind.alias("k")).where("k <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def summary(turns: DataFrame, damaged: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per conv_id of ``turns``: gaps, faults, illegal pairs, cost, audit and digest of ``damaged`` after repair."""
    faults = written(find_faults(damaged), "faults")
    is_fault = lambda f: F.count(F.when(F.col("fault") == f, 1)).alias(f)
    # two steps, so a conversation's distinct turns are not one task's set
    turn = faults.groupBy("conv_id", "turn").agg(*(is_fault(f) for f in ("blank", "duplicate", "truncated")))
    counts = turn.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        *(F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")))
    found = digests(repair(faults, piece_rows))
    out = turns.select("conv_id").distinct()
    for part in (counts, found):
        part = part.withColumnRenamed("conv_id", "c")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select("conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
