"""Ids of many texts from the ids of their distinct pre-tokens.

A byte-level BPE cuts a text into pre-tokens and encodes each for itself. Here
the cuts of a chunk of texts are found in numpy, every pre-token is looked up by
a 128-bit hash in a memory of bounded size, and only those that are not there go
to the tokenizers library, as lines of one text. The ids of the chunk are then
gathered in one step.

Only texts of ``PLAIN`` characters are cut so: their classes are the same in
every Unicode version that the library may use. Other texts, and texts of other
kinds of tokenizers, are given to the library as they are.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

from gatewatch.llm.textbytes import BASE, BASE_INV, mix64, powers

U64 = np.uint64
BASE_2 = 0xD1342543DE82EF95
BASE_2_INV = pow(BASE_2, -1, 1 << 64)
SLOT_BITS = 20
LINES = 200

_SIGNS = [*range(0x21, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]
PLAIN = re.compile(rf"[ \t\n\r{''.join(re.escape(chr(x)) for x in _SIGNS)}]*")
SPACE, LETTER, NUMBER, OTHER = range(4)
#: how a contraction goes on after its apostrophe (fixed by the byte-level kind of tokenizer)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def cuts_by_pre_tokens(spec: dict) -> bool:
    """Whether this tokenizer's ids of a text are those of its pre-tokens, one after the other."""
    pre = spec.get("pre_tokenizer") or {}
    return (spec.get("normalizer") is None and spec.get("truncation") is None and spec.get("padding") is None
            and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
            and all(t["special"] for t in spec.get("added_tokens", [])))


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of an ASCII byte, and of a two-byte character by (lead, next)."""
    one, two = np.full(256, OTHER, np.uint8), np.full(1 << 16, OTHER, np.uint8)
    one[[9, 10, 13, 32]] = SPACE
    for x in _SIGNS:
        k = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(x))[0], OTHER)
        raw = chr(x).encode()
        if len(raw) == 1:
            one[raw[0]] = k
        elif len(raw) == 2:
            two[raw[0] << 8 | raw[1]] = k
    return one, two


def cut_starts(buf: np.ndarray, off: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of a chunk of plain texts start (rows between ``off``)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    kind = one[buf]
    lead = np.flatnonzero((buf >= 0xC2) & (buf < 0xE0))
    kind[lead] = kind[lead + 1] = two[buf[lead].astype(np.int64) << 8 | buf[lead + 1]]
    row = np.zeros(n + 1, bool)  # a text starts here (or the chunk ends)
    row[off] = True
    run = row[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = np.r_[run, True]
    # the last of several spaces goes with what follows if it is a blank, and stands alone if not
    after = np.flatnonzero(run[1:] & (kind[:-1] == SPACE) & ~row[1:n]) + 1
    start[after - 1] = True
    start[after[buf[after - 1] == 32]] = False
    # an apostrophe that starts a pre-token, followed by a contraction's letters
    sign = np.flatnonzero((buf[:-1] == 39) & start[:n - 1] & run[:n - 1] & run[1:n] & ~row[1:n])
    sign = sign[kind[sign + 1] == LETTER]
    if len(sign):
        padded = np.r_[buf, np.zeros(2, np.uint8)]
        for tail in CONTRACTIONS:
            raw = tail.encode()
            fits = np.ones(len(sign), bool)
            for k, c in enumerate(raw):
                fits &= padded[sign + 1 + k] == c
                if k:
                    fits &= ~row[np.minimum(sign + 1 + k, n)]
            start[sign[fits] + 1] = False
            start[sign[fits] + 1 + len(raw)] = True
    return np.flatnonzero(start[:n])


def _hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each stretch; the first is never 0."""
    out = []
    wide = buf.astype(U64) + U64(1)
    for base, inverse in ((BASE, BASE_INV), (BASE_2, BASE_2_INV)):
        total = np.zeros(len(buf) + 1, U64)
        np.cumsum(wide * powers(base, len(buf)), out=total[1:])
        out.append(mix64((total[end] - total[start]) * powers(inverse, len(buf))[start] + (end - start).astype(U64) * U64(base)))
    return out[0] | U64(1), out[1]


class Memory:
    """Hash pairs -> runs of ids, in an open table of 2**bits places, half of them used at most."""

    def __init__(self, bits: int, kind: str):
        self.bits, self.kind = bits, kind
        self._clear()

    def _clear(self) -> None:
        size = 1 << self.bits
        self.first, self.second, self.slot = np.zeros(size, U64), np.zeros(size, U64), np.zeros(size, np.int32)
        self.begin, self.count, self.hits = (np.zeros(size // 2, t) for t in (np.int64, np.int32, np.int32))
        self.n, self.ids = 0, np.zeros(0, self.kind)
        self.used = 0

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each pair, -1 if unknown."""
        out = np.full(len(a), -1, np.int64)
        at = (a >> U64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(a))
        while len(left):
            here = self.first[at]
            same = (here == a[left]) & (self.second[at] == b[left])
            out[left[same]] = self.slot[at[same]]
            on = ~same & (here != 0)
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, a: np.ndarray, b: np.ndarray, runs: list[bytes]) -> None:
        """New pairs, each once, with their ids."""
        if self.n + len(a) > len(self.begin):
            self._shrink(max(0, len(self.begin) // 4))
        if len(a) > len(self.begin) - self.n:
            raise ValueError("more new pre-tokens in one call than the memory holds")
        width = np.dtype(self.kind).itemsize
        count = np.fromiter(map(len, runs), np.int64, len(runs)) // width
        self._append(a, b, count, np.frombuffer(b"".join(runs), self.kind))

    def _append(self, a: np.ndarray, b: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            grown = np.zeros(2 * (self.used + len(ids)), self.kind)
            grown[:self.used] = self.ids[:self.used]
            self.ids = grown
        self.ids[self.used:self.used + len(ids)] = ids
        new = slice(self.n, self.n + len(a))
        self.begin[new], self.count[new] = self.used + np.cumsum(count) - count, count
        self.used += len(ids)
        at = (a >> U64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(a))
        while len(left):
            free = self.first[at] == 0
            mine, place = left[free], at[free]
            self.first[place], self.second[place] = a[mine], b[mine]
            won = (self.first[place] == a[mine]) & (self.second[place] == b[mine])  # one of those that met here
            self.slot[place[won]] = self.n + mine[won]
            free[np.flatnonzero(free)[~won]] = False
            left, at = left[~free], (at[~free] + 1) & ((1 << self.bits) - 1)
        self.n += len(a)

    def _shrink(self, most: int) -> None:
        """Keeps the ``most`` entries used most often since the last time."""
        place = np.flatnonzero(self.first)
        slot = self.slot[place]
        keep = np.argsort(-self.hits[slot], kind="stable")[:most]
        a, b, slot = self.first[place[keep]], self.second[place[keep]], slot[keep]
        count, ids = self.count[slot].astype(np.int64), self.gather(slot)
        self._clear()
        self._append(a, b, count, ids)

    def gather(self, slot: np.ndarray) -> np.ndarray:
        """The ids of these slots, one after the other."""
        count = self.count[slot].astype(np.int64)
        ahead = np.cumsum(count) - count
        return self.ids[np.repeat(self.begin[slot] - ahead, count) + np.arange(int(count.sum()))]


class Encoder:
    """Texts -> their ids as little-endian bytes, the end id behind."""

    def __init__(self, spec: str, end_id: int, width: int, by_parts: bool, bits: int = SLOT_BITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.encode_special_tokens = True
        self.kind, self.end = f"<u{width}", np.array([end_id], f"<u{width}").tobytes()
        self.memory, self.tables = Memory(bits, self.kind), _classes()
        self.gap = self._ids("\n")
        self.by_parts = by_parts and len(self.gap) == 1  # a line end is one id: words can be encoded as lines

    def _ids(self, text: str) -> np.ndarray:
        (found,) = self.tok.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, self.kind)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        out = [b""] * len(words)
        lines = []
        for i, w in enumerate(words):
            if w.isspace():
                out[i] = self._ids(w).tobytes()
            else:
                lines.append(i)
        for lo in range(0, len(lines), LINES):
            some = lines[lo:lo + LINES]
            ids = self._ids("\n".join([words[i] for i in some]) + "\n")
            cut = np.flatnonzero(ids == self.gap[0])
            if len(cut) != len(some):
                raise RuntimeError("a word holds the id of a line end")
            raw, size = ids.tobytes(), ids.itemsize
            begin = [0, *((cut[:-1] + 1) * size).tolist()]
            for i, x, y in zip(some, begin, (cut * size).tolist()):
                out[i] = raw[x:y]
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        off = np.r_[0, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))]
        buf = np.frombuffer(b"".join(raw), np.uint8)
        start = cut_starts(buf, off, *self.tables)
        end = np.r_[start[1:], len(buf)] if len(start) else start
        a, b = _hashes(buf, start, end)
        if self.memory.n > len(self.memory.begin) // 4 * 3:
            self.memory._shrink(len(self.memory.begin) // 4)
        slot = self.memory.find(a, b)
        new = np.flatnonzero(slot < 0)
        if len(new):
            _, at = np.unique(a[new], return_index=True)
            once = new[at]
            data = buf.tobytes()
            words = [data[x:y].decode() for x, y in zip(start[once].tolist(), end[once].tolist())]
            for lo in range(0, len(words), len(self.memory.begin) // 8):  # a very long text
                part = slice(lo, lo + len(self.memory.begin) // 8)
                if self.memory.n + len(words[part]) > len(self.memory.begin):
                    return [self._ids(t).tobytes() for t in texts]
                self.memory.add(a[once[part]], b[once[part]], self._encode_words(words[part]))
            slot[new] = self.memory.find(a[new], b[new])
            if (slot[new] < 0).any():  # two pre-tokens of one 64-bit hash
                return [self._ids(t).tobytes() for t in texts]
        self.memory.hits[:self.memory.n] += np.bincount(slot, minlength=self.memory.n).astype(np.int32)
        ids = self.memory.gather(slot).tobytes()
        size = self.end and len(self.end)
        ends = np.r_[0, np.cumsum(self.memory.count[slot].astype(np.int64))][np.searchsorted(start, off)] * size
        return [ids[x:y] for x, y in zip(ends.tolist(), ends[1:].tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [i for i, t in enumerate(texts) if self.by_parts and PLAIN.fullmatch(t)]
        out = [b""] * len(texts)
        for i, ids in zip(plain, self._plain([texts[i] for i in plain])):
            out[i] = ids + self.end
        for i in sorted(set(range(len(texts))).difference(plain)):
            out[i] = self._ids(texts[i]).tobytes() + self.end
        return out
