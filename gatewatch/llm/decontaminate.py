"""Benchmark decontamination with a generalised suffix automaton of test items.

The automaton over the items' word sequences is built on the driver and shipped
to the tasks. Each task streams the words of its documents through it, tracking
the longest match that ends at each word; matches of ``window`` words, and whole
items that are shorter, are hits. No shuffle: one pass over the documents.

An automaton holds about ``max_words`` words. A larger benchmark is dealt by a
hash to several: an item longer than that is cut into pieces that overlap by
``window - 1`` words, so every window is in one piece. Each automaton takes one
pass, which adds its hits to those of the passes before (written in between),
so memory is that of one automaton whatever the size of the benchmark.

Stretches that cannot hold a match are skipped exactly: every two neighbouring
words of a match of two or more words are neighbours in some item, so the
automaton only runs where enough such neighbours follow each other.

Defined results: null or wordless text has no words and no hits; null or
wordless items are no windows; equal items count as one window but as items
each; repeated documents are judged row by row; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewatch.llm.frames import spare, written
from gatewatch.llm.textbytes import as_binary, slices, text_chunks, word_table, words
from gatewatch.session import Shared

#: words of one automaton, which takes about a kilobyte a word while it is built
MAX_WORDS = 200_000
BIGRAM_BITS = 22
PAIR = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Automaton:
    """States: ``link``, ``length`` (longest string), ``step`` (word hash -> state).

    ``items[s]``: items in which the state's strings occur, kept for states
    whose strings include one of ``window`` words. ``whole[s]``: lengths and
    items of short items that are a suffix of the state's strings.
    """
    window: int
    link: list = field(default_factory=lambda: [-1])
    length: list = field(default_factory=lambda: [0])
    step: list = field(default_factory=lambda: [{}])
    items: dict = field(default_factory=dict)
    whole: dict = field(default_factory=dict)
    least: int = 0
    pairs: np.ndarray | None = None
    single: frozenset = frozenset()

    def _state(self, length: int, link: int, step: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state for the strings of ``q`` no longer than ``length[p] + 1``."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.step[last].get(w)
        if q is not None:  # a string of an earlier item
            return self._split(last, w, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.step[p][w])
        return new

    def walk(self, seq: list) -> Iterator[tuple[int, int]]:
        """(state, longest match length) after each word, from the empty match."""
        s, n = 0, 0
        step, link, length = self.step, self.link, self.length
        for w in seq:
            t = step[s].get(w)
            while t is None and s:
                s = link[s]
                n = length[s]
                t = step[s].get(w)
            if t is None:
                s, n = 0, 0
            else:
                s, n = t, n + 1
            yield s, n

    def hits(self, seq: list) -> Iterator[tuple[int, int, frozenset]]:
        """(end word exclusive, matched words, items) of every window in ``seq``."""
        for j, (s, n) in enumerate(self.walk(seq)):
            if n >= self.window:
                u = s
                while self.length[self.link[u]] >= self.window:
                    u = self.link[u]
                yield j + 1, self.window, self.items[u]
            for m, ids in self.whole.get(s, ()):
                if m <= n:
                    yield j + 1, m, ids


def item_words(texts: list[str | None]) -> list[list[int]]:
    table, out = word_table(), []
    for lo, hi, buf, off in text_chunks(pa.array(texts, pa.string())):
        _, _, row, h = words(buf, off, table)
        per = np.searchsorted(row, np.arange(hi - lo + 1))
        out += [h[a:b].tolist() for a, b in zip(per[:-1], per[1:])]
    return out


def build_automaton(items: list[tuple[object, str | None]], window: int = 10) -> Automaton:
    a = Automaton(window)
    seqs = [(str(i), s) for (i, _), s in zip(items, item_words([t for _, t in items])) if s]
    for _, s in seqs:
        last = 0
        for w in s:
            last = a._extend(last, w)
    items_of, whole = {}, {}
    for i, s in seqs:
        states = list(a.walk(s))
        for st, n in states:
            if n >= window:
                while a.length[a.link[st]] >= window:
                    st = a.link[st]
                items_of.setdefault(st, set()).add(i)
        if len(s) < window:
            whole.setdefault(tuple(s), (states[-1][0], set()))[1].add(i)
    a.items = {s: frozenset(x) for s, x in items_of.items()}
    ends: dict[int, list] = {}
    for s, (st, ids) in whole.items():
        ends.setdefault(st, []).append((len(s), frozenset(ids)))
    if ends:  # a state's suffixes are on its chain of links
        for st in sorted(range(len(a.link)), key=a.length.__getitem__):
            found = ends.get(st, []) + (list(a.whole.get(a.link[st], ())) if st else [])
            if found:
                a.whole[st] = tuple(found)
    a.least = min([window, *(len(s) for _, s in seqs)]) if seqs else 0
    a.pairs = np.zeros(1 << BIGRAM_BITS, bool)
    for _, s in seqs:
        h = np.array(s, np.uint64)
        a.pairs[_pair_slot(h)] = True
    a.single = frozenset(s[0] for _, s in seqs if len(s) == 1)
    return a


def _pair_slot(h: np.ndarray) -> np.ndarray:
    return ((h[:-1] * PAIR + h[1:]) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(64 - BIGRAM_BITS)).astype(np.int64)


def _stretches(a: Automaton, h: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges (within one row each) outside of which nothing can match."""
    if not a.least or not len(h):
        return []
    on = np.zeros(len(h) + 1, bool)
    on[1:-1] = a.pairs[_pair_slot(h)] & (row[:-1] == row[1:])
    edge = np.flatnonzero(on[1:] != on[:-1])
    begin, end = edge[::2], edge[1::2] + 1
    need = max(2, a.least)
    long = end - begin >= need
    out = list(zip(begin[long].tolist(), end[long].tolist()))
    if a.single:  # one-word items: words outside such stretches count too
        seen = np.isin(h, np.array(sorted(a.single), np.uint64))
        for b, e in out:
            seen[b:e] = False
        out = sorted(out + [(j, j + 1) for j in np.flatnonzero(seen).tolist()])
    return out


def scan(a: Automaton, column: pa.Array, before: list | None = None) -> Iterator[tuple[int, set, list, int, list]]:
    """Per row: words, items that occur, hit runs as byte spans, hit words, and
    hit runs as word numbers (first, end, first, end, ...). ``before`` holds, per
    row, the runs and items that another automaton found."""
    table = word_table()
    for lo, hi, buf, off in text_chunks(column):
        start, end, row, h = words(buf, off, table)
        n_words = np.bincount(row, minlength=hi - lo)
        ahead = np.cumsum(n_words) - n_words
        mark = np.zeros(len(h) + 1, np.int32)
        found: dict[int, set] = {}
        for b, e in _stretches(a, h, row):
            for j, m, ids in a.hits(h[b:e].tolist()):
                mark[b + j - m] += 1
                mark[b + j] -= 1
                found.setdefault(int(row[b]), set()).update(ids)
        for r in range(hi - lo) if before else ():
            runs, items = before[lo + r]
            if runs:
                np.add.at(mark, ahead[r] + np.array(runs[::2]), 1)
                np.add.at(mark, ahead[r] + np.array(runs[1::2]), -1)
                found.setdefault(r, set()).update(items)
        hit = np.cumsum(mark[:-1]) > 0
        n_hit = np.bincount(row[hit], minlength=hi - lo) if len(h) else np.zeros(hi - lo, np.int64)
        spans: dict[int, list] = {}
        places: dict[int, list] = {}
        at = np.flatnonzero(hit)
        if len(at):
            new = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (np.diff(row[at]) > 0)])
            for x, y in zip(at[new].tolist(), at[np.r_[new[1:] - 1, len(at) - 1]].tolist()):
                r = int(row[x])
                spans.setdefault(r, []).append((int(start[x] - off[r]), int(end[y] - off[r])))
                places.setdefault(r, []).extend((int(x - ahead[r]), int(y + 1 - ahead[r])))
        for r in range(hi - lo):
            yield int(n_words[r]), found.get(r, set()), spans.get(r, []), int(n_hit[r]), places.get(r, [])


def item_pieces(benchmark: DataFrame, window: int, max_words: int) -> DataFrame:
    """item (string), text, n words: items of up to ``max_words`` words whole, longer ones in overlapping pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, step = word_table(), max(max_words - window + 1, 1)
        for b in batches:
            ids, at = b.column(0).to_pylist(), 0
            for lo, hi, buf, off in text_chunks(b.column(1)):
                start, end, row, _ = words(buf, off, table)
                edge = np.searchsorted(row, np.arange(hi - lo + 1)).tolist()
                out: tuple[list, list, list] = ([], [], [])
                for r, (x, y) in enumerate(zip(edge[:-1], edge[1:])):
                    for k in range(x, max(y - window + 1, x + 1) if y > x else x, step):
                        last = min(y, k + step + window - 1)
                        for column, value in zip(out, (ids[at + r], buf[start[k]:end[last - 1]].tobytes().decode(), last - k)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int64()))], ["item", "text", "n"])
                at += hi - lo

    return benchmark.select(F.col("item_id").cast("string"), "text").where("text IS NOT NULL") \
        .mapInArrow(run, "item string, text string, n bigint")


def automata(benchmark: DataFrame, window: int, max_words: int) -> Iterator[Automaton]:
    """One automaton of about ``max_words`` words at a time; at least one."""
    pieces = item_pieces(benchmark, window, max_words)
    parts = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // max_words))
    if parts > 1:
        pieces = written(pieces, "items")
    for k in range(parts):
        rows = pieces if parts == 1 else pieces.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        yield build_automaton(sorted((str(r["item"]), r["text"]) for r in rows.select("item", "text").collect()), window)


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, max_words: int) -> tuple[Automaton, DataFrame, str, str]:
    """The last automaton, and ``docs`` with what all others found: columns of runs and of items, if there are others."""
    runs, items = spare(docs, "_runs"), spare(docs, "_items")
    every = automata(benchmark, window, max_words)
    a = next(every)
    for later in every:
        docs, a = written(_add_hits(docs, a, runs, items), "hits"), later
    return a, docs, runs, items


def _before(b: pa.RecordBatch, runs: str, items: str) -> list | None:
    if runs not in b.schema.names:
        return None
    return list(zip(b.column(runs).to_pylist(), b.column(items).to_pylist()))


def _add_hits(docs: DataFrame, a: Automaton, runs: str, items: str) -> DataFrame:
    shared = Shared(docs.sparkSession, a)
    at = docs.columns.index("text")
    names = [c for c in docs.columns if c not in (runs, items)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            rows = list(scan(shared.value, b.column(at), _before(b, runs, items)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([r[4] for r in rows], pa.list_(pa.int32())),
                                              pa.array([sorted(r[1]) for r in rows], pa.list_(pa.string()))], [*names, runs, items])

    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(runs, T.ArrayType(T.IntegerType())),
                           T.StructField(items, T.ArrayType(T.StringType()))])
    return docs.mapInArrow(run, schema)


def match_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted strings), spans (byte offsets, end exclusive) per row of ``docs``."""
    a, docs, was_runs, was_items = _passes(docs.select("doc_id", "text"), benchmark, window, max_words)
    shared = Shared(docs.sparkSession, a)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            rows = list(scan(shared.value, b.column(1), _before(b, was_runs, was_items)))
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
                pa.array([sorted(r[1]) for r in rows], pa.list_(pa.string())),
                pa.array([[{"start": x, "end": y} for x, y in r[2]] for r in rows], spans)],
                ["doc_id", "n_words", "n_hit", "items", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5,
                  max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` (all its columns) with hit spans cut out of ``text``.

    A document of which more than ``max_coverage`` of the words are hit goes;
    of the others the bytes from the first to the last word of each hit run go,
    and ``n_chars``, if there is one, is counted anew. Untouched rows stay as they are.
    """
    schema, names = docs.schema, docs.columns
    a, docs, was_runs, was_items = _passes(docs, benchmark, window, max_words)
    shared = Shared(docs.sparkSession, a)
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            rows = list(scan(shared.value, b.column(at), _before(b, was_runs, was_items)))
            b = b.select(names)
            cut = {i: r[2] for i, r in enumerate(rows) if r[3]}
            if cut:
                raw = as_binary(b.column(at).take(pa.array(list(cut)))).to_pylist()
                new = {}
                for (i, spans), text in zip(cut.items(), raw):
                    edges = [0, *(x for s in spans for x in s), len(text)]
                    new[i] = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2])).decode()
                mask = pa.array([i in new for i in range(b.num_rows)])
                cols = b.columns
                cols[at] = pc.replace_with_mask(cols[at], mask, pa.array(list(new.values()), cols[at].type))
                if chars is not None:
                    cols[chars] = pc.replace_with_mask(cols[chars], mask, pa.array([len(x) for x in new.values()], cols[chars].type))
                b = pa.RecordBatch.from_arrays(cols, schema=b.schema)
                b = b.filter(pa.array([r[3] <= max_coverage * r[0] for r in rows]))
            yield b

    return docs.mapInArrow(run, schema)
