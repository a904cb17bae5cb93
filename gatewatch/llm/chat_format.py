"""Chat formatting by columnar byte assembly.

A turn becomes ``<s>role\\ntext</s>\\n``. Lengths, cumulative offsets and
scatter indices of all segments of a batch (opening, role, line end, text,
closing) are computed in numpy, and all bytes are copied into one preallocated
buffer that becomes the Arrow string column; a conversation's string is a
slice of it. The loss mask is a list of code point spans: each assistant text.

Control strings in a text are escaped by one more backslash after their first
character (``</s>`` -> ``<\\/s>``, ``<\\/s>`` -> ``<\\\\/s>``), which ``unescape``
takes away, so the marking can be read back whatever a text holds.

Rows are dealt by conversation and sorted by turn. A conversation whose
formatted turns exceed ``part_bytes`` comes in parts (part 0, 1, ...), each of
whole turns, so memory is bounded by a part and not by a conversation; parts
depend on the conversation alone.

Defined results: null text and null role are empty; turns with equal number
sort by role and text, null turns come first; repeated rows are turns of their
own; a null conv_id is a conversation; an empty table has no rows. Line ends
and ``%`` in a role are percent-coded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from gatewatch.llm.textbytes import as_binary

OPEN, MIDDLE, CLOSE = b"<s>", b"\n", b"</s>\n"
#: first characters and rests of the control strings <s> </s> [INST] [/INST]
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"
TURN = re.compile(r"<s>([^\n]*)\n(.*?)</s>\n", re.DOTALL)
PART_BYTES = 4 << 20


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, CONTROL, r"\1\\\2\3")


def unescape(text: str) -> str:
    return re.sub(ESCAPED, r"\1\2\3", text)


def role_code(roles: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(pc.fill_null(roles, ""), "%", "%25"), "\n", "%0A")


def role_name(code: str) -> str:
    return code.replace("%0A", "\n").replace("%25", "%")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted string."""
    return [(role_name(r), unescape(t)) for r, t in TURN.findall(formatted)]


def _bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = as_binary(col)
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], np.diff(off)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, end of each turn in bytes, code points before and of each text, code points of each turn)."""
    n = len(texts)
    texts = escape(pc.fill_null(texts, ""))
    segments = [(np.tile(np.frombuffer(OPEN, np.uint8), n), np.full(n, len(OPEN))), _bytes_of(role_code(roles)),
                (np.tile(np.frombuffer(MIDDLE, np.uint8), n), np.full(n, len(MIDDLE))), _bytes_of(texts),
                (np.tile(np.frombuffer(CLOSE, np.uint8), n), np.full(n, len(CLOSE)))]
    length = np.stack([size for _, size in segments], axis=1)
    end = np.cumsum(length.ravel()).reshape(length.shape)
    out = np.empty(int(end[-1, -1]) if n else 0, np.uint8)
    for j, (raw, size) in enumerate(segments):
        start = end[:, j] - size
        own = np.cumsum(size) - size  # where the segment starts in its column
        out[np.arange(len(raw)) + np.repeat(start - own, size)] = raw
    before = len(OPEN) + pc.utf8_length(role_code(roles)).to_numpy().astype(np.int64) + len(MIDDLE)
    chars = pc.utf8_length(texts).to_numpy().astype(np.int64)
    return out, end[:, -1] if n else np.zeros(0, np.int64), before, chars


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_NAMES = ["conv_id", "part", "formatted", "n_turns", "loss"]


def _emit(t: pa.Table, conv: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """Rows of whole (conversation, part) groups -> one formatted row per group."""
    roles, texts = (t.column(c).combine_chunks() for c in ("role", "text"))
    out, end, before, chars = assemble(roles, texts)
    head = np.flatnonzero(np.r_[True, (conv[1:] != conv[:-1]) | (part[1:] != part[:-1])])
    last = np.r_[head[1:], len(conv)] - 1
    turn = before + chars + len(CLOSE)
    ahead = np.cumsum(turn) - turn
    group = np.repeat(np.arange(len(head)), last - head + 1)
    start = ahead - ahead[head][group] + before
    loss = pc.fill_null(pc.equal(roles, "assistant"), False).to_numpy(zero_copy_only=False)
    spans = pa.StructArray.from_arrays([pa.array(start[loss]), pa.array((start + chars)[loss])], ["start", "end"])
    per = np.r_[0, np.cumsum(np.bincount(group[loss], minlength=len(head)))]
    text = pa.LargeStringArray.from_buffers(len(head), pa.py_buffer(np.r_[0, end[last]].astype(np.int64)), pa.py_buffer(out))
    return pa.RecordBatch.from_arrays([
        t.column("conv_id").combine_chunks().take(pa.array(head)), pa.array(part[head]), text.cast(pa.string()),
        pa.array(last - head + 1), pa.ListArray.from_arrays(pa.array(per, pa.int32()), spans)], _NAMES)


def _numbers(t: pa.Table) -> np.ndarray:
    """0, 0, 1, ...: runs of equal conv_id (null equals null)."""
    ids = t.column("conv_id").combine_chunks()
    a, b = ids[1:], ids[:-1]
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.r_[0, np.cumsum(~same.to_numpy(zero_copy_only=False))].astype(np.int64)


def _format(part_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, before = None, 0  # rows held back: one (conversation, part); bytes of the conversation before them
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b])
            conv = _numbers(t)
            size = pc.add(pc.binary_length(pc.fill_null(t.column("text"), "")), len(OPEN + CLOSE)).combine_chunks().to_numpy().astype(np.int64)
            ahead = np.cumsum(size) - size
            ahead -= ahead[np.searchsorted(conv, conv)]
            ahead[conv == 0] += before
            part = ahead // part_bytes
            keep = int(np.searchsorted(conv * (part.max() + 1) + part, conv[-1] * (part.max() + 1) + part[-1]))
            rest, before = t.slice(keep), int(ahead[keep])
            if keep:
                yield _emit(t.slice(0, keep), conv[:keep], part[:keep])
            last = part[keep:]
        if rest is not None:
            yield _emit(rest, np.zeros(rest.num_rows, np.int64), last)
    return run


def format_conversations(turns: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) -> conv_id, part, formatted, n_turns, loss (code point spans).

    The parts of a conversation follow each other in order within a partition.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id") \
        .sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(_format(part_bytes), f"conv_id {kind}, part bigint, formatted string, n_turns bigint, "
                                                "loss array<struct<start:bigint,end:bigint>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation, read from the formatted parts: conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Parts must
    be in the order ``format_conversations`` leaves them in; no shuffle."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # conv_id, turns, hash of turns, loss characters, hash of losses, characters
        close = lambda x: [x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]]
        for b in batches:
            done = []
            for conv, part, text, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss"))):
                if part == 0:
                    if now:
                        done.append(close(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for s in loss:
                    said = unescape(text[s["start"]:s["end"]])
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(close(now), types)], names)

    types = [to_arrow_type(formatted.schema["conv_id"].dataType), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return formatted.select("conv_id", "part", "formatted", "loss").mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
