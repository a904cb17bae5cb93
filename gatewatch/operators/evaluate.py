"""Detector evaluation.

Confusion counts for many detectors are one pass: a single global
aggregate of conditional counts (partial per task, one-row final), then
the one-row result is reshaped with ``stack``. No row expansion, no
per-detector scans.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _b(c) -> Column:
    """0/1 or boolean column -> boolean (NULL stays NULL and counts nowhere)."""
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("int") == 1


def confusion(df: DataFrame, truth: str, preds: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``detector, tp, fp, fn, tn`` (optionally per ``by`` group)."""
    t = _b(truth)
    aggs = []
    for p in preds:
        q = _b(p)
        aggs += [F.count_if(q & t).alias(f"{p}__tp"), F.count_if(q & ~t).alias(f"{p}__fp"),
                 F.count_if(~q & t).alias(f"{p}__fn"), F.count_if(~q & ~t).alias(f"{p}__tn")]
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    stack = ", ".join(f"'{p}', `{p}__tp`, `{p}__fp`, `{p}__fn`, `{p}__tn`" for p in preds)
    return wide.select(*by, F.expr(f"stack({len(preds)}, {stack}) AS (detector, tp, fp, fn, tn)"))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def metrics(conf: DataFrame) -> DataFrame:
    """Precision / recall / F1 / accuracy, 0 when a denominator is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p = _ratio(tp, tp + fp)
    r = _ratio(tp, tp + fn)
    return (conf.withColumn("precision", p).withColumn("recall", r)
            .withColumn("f1", _ratio(F.lit(2.0) * F.col("precision") * F.col("recall"),
                                     F.col("precision") + F.col("recall")))
            .withColumn("accuracy", _ratio(tp + tn, tp + tn + fp + fn)))


def accuracy_percent(conf: DataFrame) -> DataFrame:
    """``round(100 * correct / total)`` half-up, 0 when total is 0;
    plus the ground-truth split (attack / benign) for charting."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    pct = F.when(total == 0, F.lit(0)).otherwise(F.floor(F.lit(100.0) * (tp + tn) / total + F.lit(0.5)))
    return conf.select("detector", pct.cast("bigint").alias("accuracy_pct"),
                       (tp + fn).alias("attack"), (fp + tn).alias("benign"))


def class_distribution(df: DataFrame, label: str = "is_attack_ip") -> DataFrame:
    """A15."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def classification_report(conf: DataFrame) -> DataFrame:
    """Per class (0 / 1) precision, recall, F1, support; macro and
    support-weighted averages; one row per (detector, class_label)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def cls(name, t_p, f_p, f_n, support):
        p = _ratio(t_p, t_p + f_p)
        r = _ratio(t_p, t_p + f_n)
        return F.struct(F.lit(name).alias("class_label"), p.alias("precision"), r.alias("recall"),
                        _ratio(F.lit(2.0) * p * r, p + r).alias("f1"), support.alias("support"))

    per = conf.select("detector", F.array(cls("1", tp, fp, fn, tp + fn),
                                          cls("0", tn, fn, fp, tn + fp)).alias("c"))
    c1, c0 = F.col("c")[0], F.col("c")[1]
    n = c1["support"] + c0["support"]

    def avg(field, weighted):
        if weighted:
            return _ratio(c1[field] * c1["support"] + c0[field] * c0["support"], n)
        return (c1[field] + c0[field]) / F.lit(2.0)

    rows = F.array(c1, c0,
                   F.struct(F.lit("macro avg").alias("class_label"), avg("precision", False).alias("precision"),
                            avg("recall", False).alias("recall"), avg("f1", False).alias("f1"), n.alias("support")),
                   F.struct(F.lit("weighted avg").alias("class_label"), avg("precision", True).alias("precision"),
                            avg("recall", True).alias("recall"), avg("f1", True).alias("f1"), n.alias("support")))
    return per.select("detector", F.inline(rows))


def contamination(df: DataFrame, label: str = "is_attack_ip") -> DataFrame:
    """Attack share of all rows; 0.05 when there are none."""
    share = F.avg(F.col(label).cast("double"))
    return df.agg(F.when(F.coalesce(share, F.lit(0.0)) == 0, F.lit(0.05)).otherwise(share)
                  .alias("contamination"))


def positive_weight(df: DataFrame, label: str = "is_attack_ip") -> DataFrame:
    """``neg / pos``, 1 when there are no positives."""
    pos = F.count_if(_b(label))
    neg = F.count_if(~_b(label))
    return df.agg(F.when(pos == 0, F.lit(1.0)).otherwise(neg / pos).alias("scale_pos_weight"))


def merge_metrics(*tables: DataFrame, key: str = "detector") -> DataFrame:
    """Union of metric tables by name; a later table wins on a name clash.
    Ranking by table position is an aggregate (``max_by``), not a window."""
    tagged = [t.withColumn("gw_rank", F.lit(i)) for i, t in enumerate(tables)]
    allm = tagged[0]
    for t in tagged[1:]:
        allm = allm.unionByName(t, allowMissingColumns=True)
    cols = [c for c in allm.columns if c not in (key, "gw_rank")]
    best = F.max_by(F.struct(*cols), F.col("gw_rank"))
    return allm.groupBy(key).agg(best.alias("m")).select(key, "m.*")


def agreement(frames: dict[str, DataFrame], truth: DataFrame, key: str = "user_id",
              truth_col: str = "is_attack_ip") -> DataFrame:
    """Align detectors by key (as a full outer join would, never by position),
    with ground truth; a user missing from a detector counts as not flagged. The
    frames are stacked and grouped by key once: one shuffle, whatever their
    number. Of repeated keys in a frame the highest flag counts; null is a key."""
    tables = {truth_col: truth, **frames}
    parts = [f.select(F.col(key).alias(key), *[(F.col(n) if n == name else F.lit(None)).cast("int").alias(n) for n in tables])
             for name, f in tables.items()]
    out = reduce(DataFrame.unionByName, parts).groupBy(key).agg(*[F.coalesce(F.max(n), F.lit(0)).alias(n) for n in tables])
    return out.select(key, truth_col, *frames, sum((F.col(n) for n in frames), F.lit(0)).alias("votes"))


def threshold_sweep(scores: DataFrame, score: str, truth: str,
                    thresholds: Sequence[float] = tuple(round(0.1 * i, 1) for i in range(1, 11))) -> DataFrame:
    """Precision / recall at each threshold (``score >= t``). A row is
    counted once, in the bin of the thresholds that it reaches; the counts at a
    threshold are the sums of the bins from it on, over a table of one row a
    threshold. A null score reaches none; a row without a truth is not counted,
    nor is one of a null score among the negatives."""
    cuts = sorted({float(t) for t in thresholds})
    reached = reduce(Column.__add__, [(F.col(score) >= F.lit(t)).cast("int") for t in cuts])
    n = lambda on: F.count_if(on)
    t = _b(truth)
    bins = scores.groupBy(reached.alias("gw_bin")).agg(n(t).alias("pos"), n(~t).alias("neg")).where("gw_bin IS NOT NULL")
    table = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(c).alias("threshold")) for i, c in enumerate(cuts)])
    each = bins.select("pos", "neg", "gw_bin", F.explode(table).alias("c")).select("pos", "neg", (F.col("gw_bin") >= F.col("c.i")).alias("on"), "c.threshold")
    total = lambda col, on: F.coalesce(F.sum(F.when(on, F.col(col))), F.lit(0)).cast("bigint")
    conf = each.groupBy("threshold").agg(total("pos", F.col("on")).alias("tp"), total("neg", F.col("on")).alias("fp"),
                                         total("pos", ~F.col("on")).alias("fn"), total("neg", ~F.col("on")).alias("tn"))
    return metrics(conf)
