"""Soft-membership mixing: document rates whose expected domain token totals meet targets.

A softmax classifier, trained on labelled rows, gives every document posteriors
over the domains. With the expected totals ``e(r) = sum_i r_i tokens_i p_i`` and
the targets ``g = weight * budget`` the rates minimise

    (e(r) - g) . W (e(r) - g) / 2    subject to    r_i >= least

by projected gradient steps from r = 1 (``least`` is 0, or 1 where every document
is to stay). W is the inverse of ``sum_i tokens_i p_i p_i'``, so gaps are measured
by how hard a domain's total is to move; the gradient is taken per token, for
which 1 is the reciprocal of the largest curvature and thus the step length. A
step is ``r_i = max(least, y_i + p_i . q)`` for one vector ``q = W (g - e(y))``, where y
goes a share of the last move beyond r (acceleration, begun anew when the objective
rises). So a document's rate is replayed from the list of steps: one small table of
tokens and posteriors is written, and a step is one sum over it. Sums are of fixed-point
integers, so they do not depend on order. At the optimum ``p_i . q`` is 0 for every
document above ``least`` and not above 0 for the others.

Sampling bound (the only sampled part): the classifier is fitted on at most
``max_labelled`` labelled texts, those with the smallest id hash.

Defined results: null or empty text has no tokens; its posterior is the
classifier's bias and its rate follows from it; where all documents have one
posterior (no usable labelled row) and there is no budget, all rates are 1; an
empty table gives no rates; repeated rows have equal rates; a target domain that
no document can belong to stays unmet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewatch.llm.frames import spare, written
from gatewatch.llm.textbytes import slices, text_chunks, word_table, words
from gatewatch.session import Shared

SLOT_BITS = 11
STATS = 6
#: fixed-point units of a token in the sums
UNIT = 1000
#: texts of one dense block of features, 16 KB each: short texts must not make it large
BLOCK_ROWS = 256
#: steps after which the rates are written
KEEP = 5


@dataclass
class DomainModel:
    domains: list[str]
    weight: np.ndarray
    bias: np.ndarray

    def posteriors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, rows x domains); rounded, so that equal texts are equal on any machine."""
        tokens, p = [], []
        for n, x in features(column):
            z = x @ self.weight + self.bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p.append(np.round(e / e.sum(axis=1, keepdims=True), 6))
            tokens.append(n)
        if not p:
            return np.zeros(0, np.int64), np.zeros((0, len(self.domains)))
        return np.concatenate(tokens), np.concatenate(p)


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per chunk: word counts and a feature row per text: unit-length hashed
    word counts, and shares of digits, capitals, marks, non-ASCII bytes, line
    ends and the mean word length."""
    table = word_table()
    kind = np.zeros((256, STATS - 1), np.float64)
    kind[0x30:0x3A, 0] = kind[0x41:0x5B, 1] = kind[0x80:, 3] = kind[0x0A, 4] = 1
    kind[0x21:0x30, 2] = kind[0x3A:0x41, 2] = kind[0x5B:0x61, 2] = kind[0x7B:0x7F, 2] = 1
    for lo, hi, buf, off in text_chunks(column, rows=BLOCK_ROWS):
        n = hi - lo
        start, end, row, h = words(buf, off, table)
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        count = np.bincount(row << SLOT_BITS | slot, minlength=n << SLOT_BITS).reshape(n, -1).astype(np.float64)
        count /= np.maximum(np.sqrt((count * count).sum(axis=1, keepdims=True)), 1)
        size = np.maximum(np.diff(off), 1)[:, None]
        byte = np.bincount(np.repeat(np.arange(n) << 8, np.diff(off)) | buf, minlength=n << 8).reshape(n, 256)
        tokens = np.bincount(row, minlength=n)
        mean = np.bincount(row, end - start, minlength=n) / np.maximum(tokens, 1) / 10
        yield tokens, np.c_[count, byte @ kind / size * 5, mean]


def fit_softmax(x: np.ndarray, y: np.ndarray, k: int, steps: int = 300, rate: float = 0.1,
                ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    x = np.concatenate([x.astype(np.float32, copy=False), np.ones((len(x), 1), np.float32)], axis=1)
    w = np.zeros((x.shape[1], k), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    hot = np.eye(k, dtype=np.float32)[y]
    for t in range(1, steps + 1):
        z = x @ w
        e = np.exp(z - z.max(axis=1, keepdims=True))
        g = x.T @ (e / e.sum(axis=1, keepdims=True) - hot) / len(x) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1].astype(np.float64), w[-1].astype(np.float64)


def train_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], max_labelled: int = 4000) -> DomainModel:
    """``labelled``: doc_id, domain; rows of other domains are not used. A
    doc_id with several domains counts as the smallest of them."""
    width = (1 << SLOT_BITS) + STATS
    use = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()) \
        .groupBy("doc_id").agg(F.min("domain").alias("domain"))
    use = use.orderBy(F.xxhash64(F.lit("mix"), F.col("doc_id"))).limit(max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [r for _, f in features(b.column(1)) for r in f.astype(np.float32)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["domain", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = [], []
        for b in batches:
            y += [domains.index(d) for d in b.column(0).to_pylist()]
            x += [np.frombuffer(raw, np.float32) for raw in b.column(1).to_pylist()]
        if x:
            w, bias = fit_softmax(np.stack(x), np.array(y), len(domains))
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias.tobytes()], pa.binary())], ["w", "bias"])

    rows = docs.select("doc_id", "text").join(F.broadcast(use), "doc_id").select("domain", "text").mapInArrow(run, "domain string, x binary")
    # one task fits the bounded sample, in an order of its own; the driver sees the weights
    got = rows.repartition(1).sortWithinPartitions("domain", "x").mapInArrow(fit, "w binary, bias binary").collect()
    if not got:
        return DomainModel(domains, np.zeros((width, len(domains))), np.zeros(len(domains)))
    return DomainModel(domains, np.frombuffer(got[0]["w"]).reshape(width, len(domains)), np.frombuffer(got[0]["bias"]))


def with_posteriors(docs: DataFrame, model: DomainModel, tokens: str, posterior: str) -> DataFrame:
    """``docs`` and two more columns: word count and posteriors. No shuffle."""
    shared = Shared(docs.sparkSession, model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            n, p = shared.value.posteriors(b.column(at))
            ends = pa.array(np.arange(len(n) + 1) * p.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))],
                                             [*b.schema.names, tokens, posterior])

    from pyspark.sql import types as T
    schema = T.StructType([*docs.schema, T.StructField(tokens, T.LongType()), T.StructField(posterior, T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(run, schema)


def _replay(posterior: Column, steps: list[list[float]], least: float, rate: Column | None = None, was: Column | None = None) -> Column:
    """(rate, the rate before) after the given steps ``[*q, ahead]``, from 1 or from the rates given."""
    k = len(steps[0]) - 1
    every = F.array(*[F.array(*[F.lit(float(x)) for x in q]) for q in steps])
    one = F.struct((F.lit(1.0) if rate is None else rate).alias("r"), (F.lit(1.0) if was is None else was).alias("was"))

    def step(s: Column, q: Column) -> Column:
        at = s["r"] + q[k] * (s["r"] - s["was"])
        move = reduce(Column.__add__, [posterior[d] * q[d] for d in range(k)])
        return F.struct(F.greatest(F.lit(float(least)), at + move).alias("r"), s["r"].alias("was"))
    return F.aggregate(every, one, step)


def rate_of(posterior: Column, steps: list[list[float]], least: float = 0.0) -> Column:
    """The rate after the given steps: from 1, each goes a share ``ahead`` of the
    last move on, adds p . q and stops at ``least``."""
    return _replay(posterior, steps, least)["r"] if steps else F.lit(1.0)


def fit_rates(posteriors: DataFrame, weights: list[float], budget: float | None = None, least: float = 0.0, tolerance: float = 1e-4,
              max_steps: int = 30) -> tuple[list[list[float]], dict]:
    """Steps for ``rate_of`` from a written table (tokens, posterior).

    ``weights`` are scaled to sum to 1. ``budget`` is the wanted token total; by
    default the smallest for which no wanted domain has to shrink, the greatest
    of ``e_d(1) / weight_d``. Steps end when a step moves no total by more than
    ``tolerance`` of the budget. The second result has the totals and the targets.
    """
    k = len(weights)
    w = np.array(weights, float) / sum(weights)
    p = [F.col("posterior")[d] for d in range(k)]
    whole = lambda c: F.sum(F.round(c * UNIT).cast("bigint").cast("decimal(38,0)"))
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    row = posteriors.agg(*[whole(F.col("tokens") * p[a] * p[b]).alias(f"m{a}_{b}") for a, b in pairs],
                         *[whole(F.col("tokens") * x).alias(f"e{d}") for d, x in enumerate(p)],
                         *[(F.max(F.when(F.col("tokens") > 0, x)) - F.min(F.when(F.col("tokens") > 0, x))).alias(f"r{d}")
                           for d, x in enumerate(p)]).first()
    m = np.zeros((k, k))
    for a, b in pairs:
        m[a, b] = m[b, a] = float(row[f"m{a}_{b}"] or 0) / UNIT
    totals = np.array([float(row[f"e{d}"] or 0) / UNIT for d in range(k)])
    if m.sum() <= 0:
        return [], {"totals": [0.0] * k, "targets": [0.0] * k}
    if budget is None and k > 1 and all(row[f"r{d}"] <= 2e-6 for d in range(k)):
        return [], {"totals": totals.tolist(), "targets": (w * totals.sum()).tolist()}
    inverse = np.linalg.inv(m + 1e-6 * np.trace(m) / k * np.eye(k))
    target = w * (budget if budget is not None else (totals[w > 0] / w[w > 0]).max())
    steps: list[list[float]] = []
    state, kept = posteriors.select("tokens", "posterior", F.lit(1.0).alias("rate"), F.lit(1.0).alias("was")), 0
    ahead, pace, last = 0.0, 1.0, np.inf
    while True:
        gap = target - totals
        if gap @ inverse @ gap > last and ahead:  # went too far: from the last rates again
            ahead, pace = 0.0, 1.0
            totals = _totals(state, steps[kept:], 0.0, least, k)
            gap = target - totals
        last = gap @ inverse @ gap
        q = inverse @ gap
        if len(steps) >= max_steps:
            break
        steps.append([*q.tolist(), ahead])
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, pace = (pace - 1) / faster, faster
        before, totals = totals, _totals(state, steps[kept:], ahead, least, k)
        if len(steps) - kept == KEEP:  # a pass replays few steps
            state, kept = _advanced(state, steps[kept:], least), len(steps)
        if np.abs(totals - before).max() <= tolerance * target.sum():
            break
    return steps, {"totals": totals.tolist(), "targets": target.tolist()}


def _moved(state: DataFrame, steps: list[list[float]], least: float) -> DataFrame:
    """tokens, posterior, rate, was after some more steps."""
    if not steps:
        return state
    s = F.col("gw_s")
    return state.withColumn("gw_s", _replay(F.col("posterior"), steps, least, F.col("rate"), F.col("was"))) \
        .select("tokens", "posterior", s["r"].alias("rate"), s["was"].alias("was"))


def _advanced(state: DataFrame, steps: list[list[float]], least: float) -> DataFrame:
    return written(_moved(state, steps, least), "rates")


def _totals(state: DataFrame, steps: list[list[float]], ahead: float, least: float, k: int) -> np.ndarray:
    """Expected domain totals at the rates after ``steps`` and a share ``ahead`` of the last move."""
    at = F.col("rate") + F.lit(float(ahead)) * (F.col("rate") - F.col("was"))
    row = _moved(state, steps, least).select("posterior", (F.col("tokens") * at * UNIT).alias("t")) \
        .agg(*[F.sum(F.round(F.col("t") * F.col("posterior")[d]).cast("bigint").cast("decimal(38,0)")) for d in range(k)]).first()
    return np.array([float(x or 0) / UNIT for x in row])


def copies_of(rate: Column, key: Column) -> Column:
    """Whole copies with the rate as their mean, drawn by a hash of ``key``."""
    draw = F.pmod(F.xxhash64(F.lit("copies"), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")


def document_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | None = None,
                   least: float = 0.0, max_labelled: int = 4000) -> DataFrame:
    """doc_id, domain (the likeliest), n_tokens, posterior, rate, copies per row of ``docs``."""
    model = train_domains(docs, labelled, list(targets), max_labelled)
    table = written(with_posteriors(docs.select("doc_id", "text"), model, "tokens", "posterior").drop("text"), "posteriors")
    steps, _ = fit_rates(table, list(targets.values()), budget, least)
    rate = rate_of(F.col("posterior"), steps, least)
    names = F.array(*[F.lit(d) for d in targets])
    return table.select("doc_id", names[F.array_position("posterior", F.array_max("posterior")).cast("int") - 1].alias("domain"),
                        F.col("tokens").alias("n_tokens"), "posterior", rate.alias("rate"),
                        copies_of(rate, F.col("doc_id")).alias("copies"))


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | None = None,
             least: float = 1.0, max_labelled: int = 4000) -> DataFrame:
    """``docs`` (all its columns), every row as often as its rate says: at least
    once, unless ``least`` is lower."""
    model = train_domains(docs, labelled, list(targets), max_labelled)
    t, p, c = (spare(docs, x) for x in ("_tokens", "_posterior", "_copy"))
    table = written(with_posteriors(docs.select("text"), model, t, p).drop("text"), "posteriors")
    steps, _ = fit_rates(table.select(F.col(t).alias("tokens"), F.col(p).alias("posterior")), list(targets.values()), budget, least)
    n = copies_of(rate_of(F.col(p), steps, least), F.col("doc_id"))
    each = with_posteriors(docs, model, t, p).withColumn(c, F.explode(F.array_repeat(F.lit(1), n)))
    return each.select(*[F.col(f"`{x}`") for x in docs.columns])
