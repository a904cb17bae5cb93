"""Toxicity scores by non-negative positive-unlabelled learning.

A linear model on the presence of words and word beginnings learns from confirmed toxic texts (P) and
unlabelled texts (U) with the class-prior-corrected risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

whose second part is kept from going negative (there the step is turned
round). Words, and their first 3 to 8 bytes, are hashed to 2**20 slots; the
slots used are all whose share in P exceeds that in U by ``min_z`` standard
errors; what they are worth against clean text is left to the fit.

Equal texts count once, in P, in U and in the prior; a text is toxic if one
label of one of its documents says so.

Sampling bounds (the only sampled part): at most ``max_positive`` toxic and
``max_unlabelled`` unlabelled texts, those with the smallest text hash. Whole
texts are used, and every document is scored in one pass without a shuffle.

Defined results: null text is empty; empty text gets the model's bias;
documents without any confirmed toxic example, or with no unlabelled text,
score 0; a doc_id that is labelled more than once is toxic if one label says
so; null labels are no labels; repeated documents score alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewatch.llm.frames import written
from gatewatch.llm.textbytes import slices, text_chunks, word_table, words
from gatewatch.session import Shared

SLOT_BITS = 20
BEGINNINGS = (3, 4, 5, 6, 7, 8)


@dataclass
class ToxicModel:
    """``feature[slot]`` is the slot's weight index or -1."""
    feature: np.ndarray
    weight: np.ndarray
    bias: float
    empty: bool = False

    def score(self, column: pa.Array) -> np.ndarray:
        out = []
        for n, row, slot in word_slots(column):
            if self.empty:
                out.append(np.zeros(n))
                continue
            f = self.feature[slot].astype(np.int64)
            row, f = row[f >= 0], f[f >= 0]
            key = np.unique(row * len(self.weight) + f)
            z = self.bias + np.bincount(key // len(self.weight), self.weight[key % len(self.weight)], minlength=n)
            out.append(1 / (1 + np.exp(-np.clip(z, -60, 60))))
        return np.concatenate(out) if out else np.zeros(0)


def word_slots(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per chunk: rows, and row and slot of every word and word beginning."""
    table = word_table()
    for lo, hi, buf, off in text_chunks(column):
        _, _, row, h, parts = words(buf, off, table, BEGINNINGS)
        h = np.concatenate([h, *(x for _, x in parts)])
        row = np.concatenate([row, *(row[at] for at, _ in parts)])
        yield hi - lo, row, (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05,
             ridge: float | None = None) -> tuple[np.ndarray, float]:
    """``fit_entries`` of 0/1 rows."""
    return fit_entries((len(pos), *np.nonzero(pos)), (len(unl), *np.nonzero(unl)), pos.shape[1], prior, steps, rate, ridge)


def fit_entries(pos: tuple, unl: tuple, k: int, prior: float, steps: int = 300, rate: float = 0.05,
                ridge: float | None = None) -> tuple[np.ndarray, float]:
    """Adam on the non-negative PU logistic risk of 0/1 rows with ``k`` features,
    given as (rows, row and feature of every 1). Features are
    evidence for the positive class, so weights stay at 0 or more; the mean of
    the later half of the steps is taken, as turned steps make single ones jump."""
    def at(x: tuple, w: np.ndarray) -> np.ndarray:
        return np.bincount(x[1], w[x[2]], minlength=x[0]) + w[-1]

    def back(x: tuple, per_row: np.ndarray) -> np.ndarray:
        return np.r_[np.bincount(x[2], per_row[x[1]], minlength=k), per_row.sum()] / x[0]

    w = np.zeros(k + 1)
    m, v, mean = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
    keep = np.r_[np.full(k, 0.1 / pos[0] if ridge is None else ridge), 0.0]
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        zp, zu = at(pos, w), at(unl, w)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        gain = -prior * back(pos, 1 - sp)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        slope = back(unl, su) - prior * back(pos, sp)
        g = (gain + slope if negative >= 0 else -slope) + keep * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
        w[:-1] = np.maximum(w[:-1], 0)
        if t > steps // 2:
            mean += w / (steps - steps // 2)
    return mean[:-1], float(mean[-1])


def _with_slots(rows: DataFrame, side: int) -> DataFrame:
    """side, h and the distinct slots of each of a bounded number of whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, row, slot in word_slots(b.column(1)):
                key = np.unique(row << SLOT_BITS | slot)
                per = np.searchsorted(key >> SLOT_BITS, np.arange(n + 1))
                out += [(key[x:y] & ((1 << SLOT_BITS) - 1)).astype(np.int32) for x, y in zip(per[:-1], per[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), side), pa.int32()), b.column(0),
                                              pa.array([x.tobytes() for x in out], pa.binary())], ["side", "h", "slots"])

    return rows.select("h", "text").mapInArrow(run, "side int, h bigint, slots binary")


def fit_slots(slots: list[list[np.ndarray]], prior: float, min_z: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots used, their weights, bias) from the slots of every toxic and every unlabelled text."""
    share = [np.zeros(1 << SLOT_BITS, np.int32) for _ in slots]
    for count, found in zip(share, slots):
        for row in found:  # a text's slots are distinct
            count[row] += 1
    n_p, n_u = len(slots[0]), len(slots[1])
    both = (share[0] + share[1] + 1) / (n_p + n_u + 2)
    z = (share[0] / n_p - share[1] / n_u) / np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u))
    best = np.argsort(-z, kind="stable")
    best = best[:(z > min_z).sum() or 16]
    feature = np.full(1 << SLOT_BITS, -1, np.int32)
    feature[best] = np.arange(len(best))
    x = []
    for found in slots:
        f = [feature[row] for row in found]
        f = [y[y >= 0] for y in f]
        x.append((len(f), np.repeat(np.arange(len(f)), [len(y) for y in f]), np.concatenate(f)))
    return best, *fit_entries(*x, len(best), prior)


def train(docs: DataFrame, labels: DataFrame, may_learn: Callable[[Column], Column] | None = None,
          prior: float | None = None, max_positive: int = 4000, max_unlabelled: int = 8000, min_z: float = 5.0) -> ToxicModel:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    ``may_learn`` says for a doc_id whether its label may be used. ``prior``
    is the share of toxic texts; by default their share among labelled texts.
    The fit runs in one task over the bounded sample, in the order of the text
    hashes; only the weights come to the driver.
    """
    none = ToxicModel(np.full(1 << SLOT_BITS, -1, np.int32), np.zeros(1), 0.0, empty=True)
    use = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    use = (use if may_learn is None else use.where(may_learn(F.col("doc_id")))) \
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    mine = docs.where("doc_id IS NOT NULL") if may_learn is None else docs.where(may_learn(F.col("doc_id")))
    mine = mine.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64(F.lit("nnpu"), "text"))
    texts = written(mine.select("doc_id", "h").join(use, "doc_id", "left").groupBy("h").agg(F.max("toxic").alias("toxic")), "texts")
    sums = texts.agg(F.count("toxic").alias("n"), F.sum("toxic").alias("p")).first()
    if not sums["p"]:
        return none
    prior = sums["p"] / sums["n"] if prior is None else prior
    prior = min(max(prior, 1e-3), 0.9)
    sides = []
    for side, (rows, most) in enumerate(((texts.where("toxic = 1"), max_positive), (texts, max_unlabelled))):
        few = rows.select("h").orderBy("h").limit(most)
        sides.append(_with_slots(mine.select("h", "text").join(F.broadcast(few), "h", "left_semi").dropDuplicates(["h"]), side))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: list[list[np.ndarray]] = [[], []]
        for b in batches:
            for side, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                slots[side].append(np.frombuffer(raw, np.int32))
        if slots[0] and slots[1]:
            best, weight, bias = fit_slots(slots, prior, min_z)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, best], pa.int64()), pa.array(np.r_[bias, weight])], ["slot", "weight"])

    found = sides[0].union(sides[1]).repartition(1).sortWithinPartitions("side", "h") \
        .mapInArrow(fit, "slot bigint, weight double").collect()
    if not found:
        return none
    feature, used = np.full(1 << SLOT_BITS, -1, np.int32), [r for r in found if r["slot"] >= 0]
    feature[[r["slot"] for r in used]] = np.arange(len(used))
    return ToxicModel(feature, np.array([r["weight"] for r in used]), next(r["weight"] for r in found if r["slot"] < 0))


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, score per row of ``docs``."""
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(b.column(1)), pa.float64())],
                                             ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    """``docs`` (all its columns) without the rows that score ``threshold`` or more."""
    shared = Shared(docs.sparkSession, model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            yield b.filter(pa.array(shared.value.score(b.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)
