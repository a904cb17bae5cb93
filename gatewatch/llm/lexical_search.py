"""Ranked lexical search by dense blocked matrix multiplication.

The query items are taken in blocks of a bounded size. The terms of a block's
items are its vocabulary; an item is a row of weights over it (a term's weight
times its repeats in the item), a document a column of impacts. Scores are the
products of the two matrices, computed by BLAS in float64, tile by tile: only
the vocabulary that a tile of documents holds is multiplied, and the vocabulary
is cut where the greatest possible partial sum would reach 2**53, so every
partial sum is an exact integer; partial sums are added as 64-bit integers.

Two passes. The first reads each text once and writes the document's postings
(its length, the item terms it holds and how often); corpus counts are grouped
sums of those. The second multiplies: each task keeps, per item, the best
``top`` of its tiles. A tile's cut is safe for ties: every document that equals
the last score kept competes by its doc_id. The tasks' lists are ranked per
item in two steps, so no item's candidates are one group.

Terms are met by a 64-bit hash of their bytes together with their length.

Defined results: null text has no terms; a document without terms is not
counted; null and repeated item_ids are items each; repeated documents are
ranked each; null doc_ids come before others at equal scores; items without
terms and empty tables return no rows; only scores above 0 are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from gatewatch.llm.frames import written
from gatewatch.llm.textbytes import text_chunks, word_table, words

#: bytes of item text in one block, documents and vocabulary terms in one tile
BLOCK_BYTES = 1 << 20
TILE_DOCS = 1024
TILE_TERMS = 2048
EXACT = 1 << 53
SALTS = 64


@dataclass
class Items:
    """One block of items: sorted term keys, and per item its terms and their repeats."""
    ids: list
    keys: np.ndarray
    terms: list
    counts: list


def term_keys(start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A term's key: its hash, and its length mixed in."""
    return h ^ (np.uint64(0x9E3779B97F4A7C15) * (end - start).astype(np.uint64))


def terms_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, row of each term, key of each term) for chunks of whole texts."""
    table = word_table()
    for lo, hi, buf, off in text_chunks(column):
        start, end, row, h = words(buf, off, table)
        yield hi - lo, row, term_keys(start, end, h)


def read_items(rows: list[tuple]) -> Items:
    """Rows (item_id, text), a block that fits the driver."""
    per: list[np.ndarray] = []
    for n, row, key in terms_of(pa.array([t for _, t in rows], pa.string())):
        cut = np.searchsorted(row, np.arange(n + 1))
        per += [key[a:b] for a, b in zip(cut[:-1], cut[1:])]
    keys = np.unique(np.concatenate(per)) if per else np.zeros(0, np.uint64)
    found = [np.unique(np.searchsorted(keys, k), return_counts=True) for k in per]
    return Items([i for i, _ in rows], keys, [t for t, _ in found], [c for _, c in found])


def postings(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n (terms of the document), terms and tf (item terms it holds) of
    every document with a term. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(items.keys)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        for b in batches:
            at = 0
            for rows, row, key in terms_of(b.column(1)):
                n = np.bincount(row, minlength=rows)
                place = np.searchsorted(keys, key)
                hit = np.flatnonzero(keys[np.minimum(place, len(keys) - 1)] == key) if len(keys) else np.zeros(0, np.int64)
                pair, tf = np.unique(row[hit].astype(np.int64) << 32 | place[hit], return_counts=True)
                cut = np.searchsorted(pair >> 32, np.arange(rows + 1)).astype(np.int32)
                out = pa.RecordBatch.from_arrays([
                    b.column(0).slice(at, rows), pa.array(n.astype(np.int64)),
                    pa.ListArray.from_arrays(cut, pa.array((pair & 0xFFFFFFFF).astype(np.int32))),
                    pa.ListArray.from_arrays(cut, pa.array(tf.astype(np.int64)))], ["doc_id", "n", "terms", "tf"])
                yield out.filter(pa.array(n > 0))
                at += rows

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, n bigint, terms array<int>, tf array<bigint>")


def corpus_counts(post: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each item term: sums per task, then grouped."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(n_terms, np.int64), 0, 0
        for b in batches:
            docs, total = docs + b.num_rows, total + (pc.sum(b.column(0)).as_py() or 0)
            df += np.bincount(b.column(1).flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, at]), pa.array(np.r_[docs, total, df[at]])], ["term", "n"])

    sums = dict(post.select("n", "terms").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect())
    df = np.zeros(n_terms, np.int64)
    for t, n in sums.items():
        if t >= 0:
            df[t] = n
    return sums.get(-2, 0), sums.get(-1, 0), df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def exact_cuts(bound: np.ndarray, tile_terms: int = TILE_TERMS) -> list[tuple[int, int]]:
    """Ranges of vocabulary columns. ``bound[t]``: the most that column t can add
    to any score; in a range the bounds sum to less than 2**53."""
    out, lo, have = [], 0, 0
    for t, b in enumerate(bound.tolist()):
        if b >= EXACT:
            raise ValueError("one term alone may exceed 2**53: too many repeats in an item")
        if t > lo and (have + b >= EXACT or t - lo >= tile_terms):
            out.append((lo, t))
            lo, have = t, 0
        have += b
    return out + [(lo, len(bound))] if len(bound) else []


def _impacts(n: np.ndarray, tf: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """(1000000000 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L, in integers."""
    if 25 * int(n.max(initial=0)) * n_docs < 1 << 63 and int(tf.max(initial=0)) < 1 << 33:
        m = 75 + (25 * n * n_docs) // total
        return (1_000_000_000 * tf) // (1000 * tf + 12 * m)
    m = [75 + (25 * x * n_docs) // total for x in n.tolist()]
    return np.array([(1_000_000_000 * t) // (1000 * t + 12 * x) for t, x in zip(tf.tolist(), m)], np.int64)


def best(score: np.ndarray, order: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores above 0, ties by ascending ``order``:
    all places above the last score kept, then the first of those that equal it."""
    at = np.flatnonzero(score > 0)
    if len(at) > top:
        cut = np.partition(score[at], len(at) - top)[len(at) - top]
        above, equal = at[score[at] > cut], at[score[at] == cut]
        equal = equal[np.argsort(order[equal], kind="stable")[:top - len(above)]]
        at = np.r_[above, equal]
    return at[np.lexsort((order[at], -score[at]))]


class Tiles:
    """Multiplies the block's item matrix with tiles of documents and keeps each item's best."""

    def __init__(self, items: Items, df: np.ndarray, n_docs: int, total: int, top: int, tile_terms: int = TILE_TERMS):
        w = weights(n_docs, df)
        self.items, self.n_docs, self.total, self.top, self.tile_terms = items, n_docs, total, top, tile_terms
        self.matrix = np.zeros((len(items.keys), len(items.ids)))  # terms x items
        for i, (t, c) in enumerate(zip(items.terms, items.counts)):
            self.matrix[t, i] = w[t] * c
        # an impact is under 1000000000 tf / (1000 tf) = 1000000
        most = np.zeros(len(items.keys), np.int64)
        for t, c in zip(items.terms, items.counts):
            most[t] = np.maximum(most[t], w[t] * c)
        self.bound = most * 1_000_000
        self.held: list = [None] * len(items.ids)  # per item: (scores, doc_ids)

    def scores(self, n: np.ndarray, cut: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """documents x items, exact."""
        doc = np.repeat(np.arange(len(n)), np.diff(cut))
        impact = _impacts(n[doc], tf, self.n_docs, self.total)
        present, column = np.unique(terms, return_inverse=True)
        out = np.zeros((len(n), len(self.items.ids)), np.int64)
        for lo, hi in exact_cuts(self.bound[present], self.tile_terms):
            on = (column >= lo) & (column < hi)
            tile = np.zeros((len(n), hi - lo))
            tile[doc[on], column[on] - lo] = impact[on]
            out += (tile @ self.matrix[present[lo:hi]]).astype(np.int64)
        return out

    def add(self, doc_ids: pa.Array, n: np.ndarray, cut: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> None:
        rank = np.empty(len(doc_ids), np.int64)
        rank[pc.sort_indices(doc_ids, null_placement="at_start").to_numpy()] = np.arange(len(doc_ids))
        found = self.scores(n, cut, terms, tf)
        floor = np.array([0 if h is None or len(h[0]) < self.top else h[0][-1] for h in self.held], np.int64)
        for i in np.flatnonzero((found >= np.maximum(floor, 1)).any(axis=0)).tolist():
            at = best(found[:, i], rank, self.top)
            score, ids = found[at, i], doc_ids.take(pa.array(at))
            if self.held[i] is not None:
                score, ids = np.r_[self.held[i][0], score], pa.concat_arrays([self.held[i][1], ids])
                order = np.empty(len(ids), np.int64)
                order[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
                at = best(score, order, self.top)
                score, ids = score[at], ids.take(pa.array(at))
            self.held[i] = score, ids


def _search_block(docs: DataFrame, items: Items, top: int) -> DataFrame:
    spark = docs.sparkSession
    post = written(postings(docs, items), "postings")
    n_docs, total, df = corpus_counts(post, len(items.keys))
    shared = spark.sparkContext.broadcast((items.ids, items.keys, items.terms, items.counts, df, n_docs, total))
    kind = docs.schema["doc_id"].dataType
    arrow_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, terms, counts, df, n_docs, total = shared.value
        tiles = Tiles(Items(ids, keys, terms, counts), df, n_docs, total, top)
        for whole in batches:
            for lo in range(0, whole.num_rows, TILE_DOCS):
                b = whole.slice(lo, TILE_DOCS)
                size = pc.list_value_length(b.column(2)).to_numpy()
                tiles.add(b.column(0), b.column(1).to_numpy(), np.r_[0, np.cumsum(size)],
                          b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy())
        for i, held in enumerate(tiles.held):
            if held is not None and len(held[0]):
                n = len(held[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i), pa.int32()), held[1].cast(arrow_kind), pa.array(held[0])],
                                                 ["item", "doc_id", "score"])

    found = post.mapInArrow(run, f"item int, doc_id {kind.simpleString()}, score bigint")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    for keys in (["item", "salt"], ["item"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        found = found.withColumn("salt", salt).withColumn("rank", rank).where(F.col("rank") <= top)
    return found.select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, benchmark: DataFrame, top: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` documents.

    ``benchmark`` (item_id, text) is cut by a hash into blocks of about
    ``block_bytes`` of text; each block takes two passes over ``docs`` (doc_id,
    text), so what is broadcast is bounded whatever the number of items.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // block_bytes)
    kind = benchmark.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint")
    for b in range(blocks):
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        if not rows:
            continue
        block = read_items(sorted(rows, key=lambda r: (r[0] is not None, str(r[0]), r[1])))
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kind}")
        out = out.unionByName(_search_block(docs, block, top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
