"""Per-entity and per-event features.

Skew: what needs a user's events in time order (W1-W3 and the session features)
scans rows dealt to ranges of (user, time, event id), so a user with a third of
all rows, even of a single day, is spread over many tasks; see
:mod:`gatewatch.operators.ordered_scan`. Everything else is a partial+final
aggregate. Only one summary per (user, partition) is ever grouped per user.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewatch.functions.noise import std_normal, uniform, uniform_bits
from gatewatch.functions.scalar import coerce_double, safe_ratio, unusual_hour
from gatewatch.operators import ordered_scan as scan
from gatewatch.session import write_once

USER = "user_id"
DAY = 86400


def epoch_us(col: str = "event_time") -> Column:
    """Microseconds since 1970 of a ``timestamp_ntz``, time-zone free."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})")


def failed_flag() -> Column:
    """A NULL ``success`` is not a failure."""
    return F.coalesce(~F.col("success"), F.lit(False))


# ---------------------------------------------------------- A7-A10, A20
def exact_avg(col: str, scale: int = 6) -> Column:
    """Mean with an exact decimal sum: the result is the same double for any
    partitioning or merge order (a double sum is not), then one division."""
    s = F.sum(F.col(col).cast(f"decimal(18,{scale})")).cast("double")
    return s / F.count(col)



def label_mode() -> Column:
    """Majority of 0/1 labels, tie -> 0 (``mode()[0]``)."""
    lab = F.col("is_attack").cast("int")
    return F.when(F.sum(lab) * 2 > F.count(lab), F.lit(1)).otherwise(F.lit(0))


def label_any_int() -> Column:
    """A10: any positive label; NULL -> 0."""
    return F.coalesce(F.max(F.col("is_attack").cast("int")), F.lit(0))


def universal_features(le: DataFrame, key: str = USER, label: str = "mode") -> DataFrame:
    """``login_freq, failed_count, unique_ips, avg_rtt, is_attack_ip`` per
    key. NULL keys are dropped (pandas groupby). One partial+final aggregate;
    the distinct IP count is Spark's two-level distinct rewrite, so a hot key
    is de-duplicated per (key, ip) map-side before the final count."""
    lab = label_mode() if label == "mode" else label_any_int()
    return (le.where(F.col(key).isNotNull())
            .groupBy(F.col(key).alias(USER))
            .agg(F.count(F.lit(1)).alias("login_freq"),
                 F.count_if(~F.col("success")).cast("bigint").alias("failed_count"),
                 F.count_distinct("ip").alias("unique_ips"),
                 exact_avg("rtt_ms").alias("avg_rtt"),
                 lab.alias("is_attack_ip")))


def impute_mean(feats: DataFrame, col: str = "avg_rtt") -> DataFrame:
    """NULL ``col`` <- mean of the per-entity values (one-row broadcast)."""
    m = feats.agg(F.avg(col).alias("gw_fill"))
    return (feats.crossJoin(F.broadcast(m))
            .withColumn(col, F.coalesce(F.col(col), F.col("gw_fill"))).drop("gw_fill"))


def coerce_and_drop(feats: DataFrame, cols) -> DataFrame:
    """numeric coercion (bad -> NULL, NaN -> NULL) then drop NULL rows."""
    out = feats
    for c in cols:
        out = out.withColumn(c, coerce_double(c))
    return out.dropna(subset=list(cols))


def unique_devices(le: DataFrame) -> DataFrame:
    """Distinct devices per user (an aggregate; DISTINCT is not allowed
    in a window and would not scale there anyway)."""
    return le.groupBy(USER).agg(F.count_distinct("device").alias("unique_devices"))


def class_weights(df: DataFrame, label: str = "is_attack_ip", out: str = "weight") -> DataFrame:
    """M2: balanced weights ``n / (k * n_c)``; the class table has k rows."""

    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("gw_nc"))
    every = Window.partitionBy()  # over the class table: one row per class
    w = counts.select(label, (F.sum("gw_nc").over(every)
                              / (F.count(F.lit(1)).over(every) * F.col("gw_nc"))).alias(out))
    return df.join(F.broadcast(w), label, "left")


# ------------------------------------------------------------- W1
WIDTHS = {"recent_failed_5m": 300, "recent_failed_30m": 1800, "recent_failed_24h": DAY}


def recent_failed_counts(le: DataFrame, widths: Mapping[str, int] | None = None, pieces: int | None = None) -> DataFrame:
    """Per event, failed attempts of the same user in ``[t - w, t]``
    (both ends inclusive, peers included) for each width (seconds). An event
    without a time has no window: its counts are NULL. ``pieces`` is the number
    of time ranges that the rows are dealt to; it changes the work only."""
    widths = dict(widths or WIDTHS)
    rows = le.select(USER, "event_id", epoch_us().alias("us"), failed_flag().alias("f"))
    found = scan.recent_counts(rows.where("us IS NOT NULL"), widths, pieces).select("event_id", USER, *widths)
    timeless = rows.where("us IS NULL").select("event_id", USER, *[F.lit(None).cast("bigint").alias(n) for n in widths])
    return found.unionByName(timeless)


# ------------------------------------------------------------- W2
def _failures_in_order(le: DataFrame) -> DataFrame:
    return le.where(F.col(USER).isNotNull()).select(USER, "event_id", epoch_us().alias("us"), failed_flag().alias("f"))


def longest_run(pieces: Column) -> Column:
    """Fold time-ordered summaries ``(len, prefix, suffix, maxrun, full)``
    into the longest run: an associative run-length monoid evaluated on the
    JVM by ``aggregate`` (no Python, no per-row state across tasks)."""
    init = F.struct(F.lit(0).cast("bigint").alias("cur"), F.lit(0).cast("bigint").alias("best"))

    def step(acc, x):
        joined = acc["cur"] + x["len"]
        return F.struct(F.when(x["full"], joined).otherwise(x["suffix"]).alias("cur"),
                        F.greatest(acc["best"], x["maxrun"],
                                   F.when(x["full"], joined).otherwise(acc["cur"] + x["prefix"])).alias("best"))

    return F.aggregate(pieces, init, step, lambda a: a["best"])


def fold_runs(summaries: DataFrame) -> DataFrame:
    """W2 and W3 per user from ``run_summaries``: the summaries of a user, one
    per partition that holds rows of it, in order. A gap across a border runs
    from the last failure of any piece before to the first of this one."""
    minute = F.lit(scan.MINUTE)
    before = F.expr(f"max(last_fail) OVER (PARTITION BY {USER} ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    border = F.when(F.col("first_fail").isNotNull() & F.col("before").isNotNull(),
                    F.floor((F.col("first_fail") - F.col("before")) / minute))
    per_user = summaries.withColumn("before", before).groupBy(USER).agg(
        F.sort_array(F.collect_list(F.struct("part", "len", "prefix", "suffix", "maxrun", "full"))).alias("runs"),
        (F.sum("gsum") + F.coalesce(F.sum(border), F.lit(0))).alias("tot"), (F.sum("gcnt") + F.count(border)).alias("n"))
    return per_user.select(USER, longest_run(F.col("runs")).alias("consecutive_failed_attempts"),
                           F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("tot") / F.col("n")).alias("avg_failed_gap"))


def consecutive_failed(le: DataFrame, pieces: int | None = None) -> DataFrame:
    """Longest run of consecutive failures per user in time order
    (ties by ``event_id``); users without failures get 0."""
    return fold_runs(scan.run_summaries(_failures_in_order(le), pieces)).select(USER, "consecutive_failed_attempts")


# ------------------------------------------------------------- W3
def avg_failed_gap(le: DataFrame, pieces: int | None = None) -> DataFrame:
    """Mean of whole-minute gaps between consecutive failures per user
    (fewer than two failures -> 0; a failure without a time has no gap). Only
    failures are dealt and sorted."""
    rows = _failures_in_order(le)
    users = rows.select(USER).distinct()
    gaps = fold_runs(scan.run_summaries(rows.where("f"), pieces))
    return users.join(gaps, USER, "left").select(USER, F.coalesce("avg_failed_gap", F.lit(0.0)).alias("avg_failed_gap"))


# ------------------------------------------------------------- W4, F8, F11
def first_sightings(le: DataFrame) -> DataFrame:
    """Per event, is this the user's first (user, ip) / (user, device)?

    First = minimum (event_time, event_id) per pair. One stacked
    (user, kind, value) partial+final aggregate finds the first-sighting
    events; they are regrouped by ``event_id`` (a table no larger than the
    number of distinct pairs) and the events join it once on ``event_id`` --
    a unique, evenly spread key, so the one shuffle of the event rows is
    never skewed by a hot user or ip. A NULL ip / device is its own pair."""
    kinds = le.select(USER, F.struct("event_time", "event_id").alias("t"),
                      F.expr("stack(2, 'ip', ip, 'device', device) AS (kind, val)"))
    firsts = (kinds.groupBy(USER, "kind", "val").agg(F.min("t").alias("first"))
              .select(F.col("first.event_id").alias("event_id"), "kind"))
    flags = firsts.groupBy("event_id").agg(
        F.max((F.col("kind") == "ip").cast("int")).alias("gw_ip"),
        F.max((F.col("kind") == "device").cast("int")).alias("gw_dev"))
    return (le.select("event_id", USER).join(flags, "event_id", "left")
            .select("event_id", USER, F.coalesce("gw_ip", F.lit(0)).alias("is_new_ip"),
                    F.coalesce("gw_dev", F.lit(0)).alias("is_new_device")))


def success_ratio(df: DataFrame) -> DataFrame:
    """``success_count`` as given, else ``login_freq - failed_count``,
    and ``failed_success_ratio`` over it."""
    ok = F.col("success_count") if "success_count" in df.columns else F.col("login_freq") - F.col("failed_count")
    return df.withColumn("success_count", ok).withColumn("failed_success_ratio", safe_ratio(F.col("failed_count"), F.col("success_count")))


def is_new(current, previous) -> Column:
    """1 when ``current`` is not in the ``previous`` array."""
    cur = F.col(current) if isinstance(current, str) else current
    prev = F.col(previous) if isinstance(previous, str) else previous
    return F.when(F.array_contains(prev, cur), F.lit(0)).otherwise(F.lit(1))


# ------------------------------------------------------------- W5, W6
DRAW_BITS = 52
#: bits looked at in a step: the driver gets 1 << STEP_BITS counts a label and bucket, at any number of rows
STEP_BITS = 10
#: rows of one bucket that are put in order by one task
BUCKET_ROWS = 200_000


def _drawn(df: DataFrame, key: str, seed, stream: str, label: str | None) -> DataFrame:
    """``df``, written, with ``gw_l`` (the label as text) and ``gw_v`` (a keyed hash of 52 bits)."""
    lab = F.col(label) if label and label in df.columns else F.lit(0)
    return write_once(df.withColumn("gw_l", lab.cast("string")).withColumn("gw_v", uniform_bits(key, seed, stream)), "drawn")


def select_ranks(rows: DataFrame, key: str, wanted, step_bits: int = STEP_BITS, bucket_rows: int = BUCKET_ROWS) -> dict:
    """Distributed selection: label -> the (gw_v, key) at each of ``wanted(n)``
    ranks (1..n by (gw_v, key), n rows of the label), None for rank 0.

    Rows are counted per label and leading bits of the hash; only the bucket that
    holds a rank is looked into, by its next bits while it is large, and at last
    the rows of that bucket alone are put in order. No row is ranked otherwise."""
    shift = DRAW_BITS - step_bits
    sizes = rows.groupBy("gw_l", F.shiftright("gw_v", shift).alias("b")).count().collect()
    by: dict = {}
    for r in sizes:
        by.setdefault(r["gw_l"], {})[r["b"]] = r["count"]
    found, open_ = {}, {}  # open: (label, shift, bucket) -> [(place in the label's list, rank inside)]
    for lab, count in by.items():
        ranks = wanted(sum(count.values()))
        found[lab] = [None] * len(ranks)
        _place(open_, lab, shift, sorted(count.items()), [(i, r) for i, r in enumerate(ranks) if r > 0])
    held = {(lab, shift, b): n for lab, count in by.items() for b, n in count.items()}
    here = lambda lab, sh, b: F.col("gw_l").eqNullSafe(F.lit(lab)) & (F.shiftright("gw_v", sh) == F.lit(b))
    while large := [k for k in open_ if held[k] > bucket_rows and k[1] > 0]:
        for lab, sh, b in large:
            lower = max(0, sh - step_bits)
            count = sorted((r["c"], r["count"]) for r in rows.where(here(lab, sh, b)).groupBy(F.shiftright("gw_v", lower).alias("c")).count().collect())
            held |= {(lab, lower, c): n for c, n in count}
            _place(open_, lab, lower, count, open_.pop((lab, sh, b)))
    if open_:
        spark = rows.sparkSession
        asked = spark.createDataFrame([(lab, sh, b, r, i) for (lab, sh, b), ranks in open_.items() for i, r in ranks],
                                      "gw_al string, gw_sh int, gw_b bigint, gw_r bigint, gw_i int")
        shifts = sorted({sh for _, sh, _ in open_})
        of = {sh: asked.where(F.col("gw_sh") == sh).select("gw_al", "gw_b").distinct() for sh in shifts}
        for sh in shifts:
            inside = rows.join(F.broadcast(of[sh]), F.col("gw_l").eqNullSafe(F.col("gw_al")) & (F.shiftright("gw_v", sh) == F.col("gw_b")))
            nth = F.row_number().over(Window.partitionBy("gw_al", "gw_b").orderBy("gw_v", key))
            ask = asked.where(F.col("gw_sh") == sh).select(F.col("gw_al").alias("l2"), F.col("gw_b").alias("b2"), "gw_r", "gw_i")
            at = inside.withColumn("gw_n", nth).join(F.broadcast(ask), F.col("gw_al").eqNullSafe(F.col("l2")) & (F.col("gw_b") == F.col("b2"))
                                                     & (F.col("gw_n") == F.col("gw_r")))
            for r in at.select("gw_l", "gw_i", "gw_v", F.col(key).alias("k")).collect():
                found[r["gw_l"]][r["gw_i"]] = (r["gw_v"], r["k"])
    return found


def _place(open_: dict, lab, shift: int, count: list, ranks: list) -> None:
    """Puts each rank into its bucket, with the rank inside."""
    ahead, todo = 0, sorted(ranks, key=lambda x: x[1])
    for b, n in count:
        while todo and todo[0][1] <= ahead + n:
            i, r = todo.pop(0)
            open_.setdefault((lab, shift, b), []).append((i, r - ahead))
        ahead += n


def _below(cuts: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``gw_below``: how many of its label's cuts lie before the row."""
    at = F.struct(F.col("gw_v").alias("v"), F.col(key).alias("k"))
    joined = rows.join(F.broadcast(cuts), F.col("gw_l").eqNullSafe(F.col("gw_cl")), "left")
    return joined.withColumn("gw_below", F.size(F.filter(F.coalesce("gw_cuts", F.array()), lambda c: c < at)))


def _cut_table(rows: DataFrame, key: str, found: dict) -> DataFrame:
    """One row a label: its cuts in order (a missing cut lies before all rows)."""
    kind = rows.schema[key].dataType.simpleString()
    values = [(lab, [{"v": -1, "k": None} if c is None else {"v": c[0], "k": c[1]} for c in cuts]) for lab, cuts in found.items()]
    return rows.sparkSession.createDataFrame(values, f"gw_cl string, gw_cuts array<struct<v:bigint,k:{kind}>>")


def split_flag(df: DataFrame, key: str = USER, train: float = 0.7, seed=42, label: str | None = "is_attack_ip") -> DataFrame:
    """Stratified split. Inside each label (null is one) the ``round(train * n)``
    rows with the smallest keyed hash are train, so every label keeps its share
    within one row; partition-independent and retry-stable. Only one threshold a
    label is looked for (``select_ranks``); ``key`` must be unique. Without a
    label column all rows are one stratum."""
    rows = _drawn(df, key, seed, "split", label)
    cuts = select_ranks(rows, key, lambda n: [math.floor(n * train + 0.5)])
    return _below(_cut_table(rows, key, cuts), rows, key) \
        .select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.col("gw_below") == 0, "train").otherwise("test").alias("split"))


def fold_ids(df: DataFrame, key: str = USER, k: int = 5, seed=42, label: str | None = "is_attack_ip") -> DataFrame:
    """Stratified fold id in ``[0, k)``: inside each label the rows in the order
    of a keyed hash are cut into ``k`` runs (of ``floor(i n / k)`` rows up to the
    i-th cut), so a label's folds differ by one row at most."""
    rows = _drawn(df, key, seed, "fold", label)
    cuts = select_ranks(rows, key, lambda n: [i * n // k for i in range(1, k)])
    return _below(_cut_table(rows, key, cuts), rows, key) \
        .select(*[F.col(f"`{c}`") for c in df.columns], F.col("gw_below").cast("int").alias("fold"))


# ------------------------------------------------------------- P13
def poisson_cdf(lam: float, eps: float = 1e-17) -> list[float]:
    """Cumulative probabilities until the rest is below a double's precision:
    the table grows with ``lam``; a ``lam`` whose exp(-lam) is no longer a
    normal double raises."""
    if not 0 <= lam <= 700:
        raise ValueError("0 <= lam <= 700")
    out, p, c, k = [], math.exp(-lam), 0.0, 0
    while True:
        c += p
        out.append(c)
        k += 1
        p *= lam / k
        if 1.0 - c < eps or (p < eps and k > lam):
            return out


def poisson(key, lam: float, seed, stream: str) -> Column:
    """Inverse-CDF Poisson draw: number of CDF knots below U."""
    u = uniform(key, seed, stream)
    knots = F.array(*[F.lit(c) for c in poisson_cdf(lam)])
    return F.size(F.filter(knots, lambda c: c < u)).cast("bigint")


def augment_overlap(feats: DataFrame, seed=42, key: str = USER) -> DataFrame:
    """Overlap noise -- counts + N(10, 15) floored at 0 and truncated,
    rtt + N(50, 100) floored at 0.1, unique_ips + Poisson(2)."""
    def normal(stream, mu, sd):
        return F.lit(float(mu)) + F.lit(float(sd)) * std_normal(key, seed, stream)
    return (feats
            .withColumn("failed_count", F.floor(F.greatest(F.col("failed_count") + normal("aug.failed", 10, 15), F.lit(0.0))).cast("bigint"))
            .withColumn("login_freq", F.floor(F.greatest(F.col("login_freq") + normal("aug.login", 10, 15), F.lit(0.0))).cast("bigint"))
            .withColumn("avg_rtt", F.greatest(F.col("avg_rtt") + normal("aug.rtt", 50, 100), F.lit(0.1)))
            .withColumn("unique_ips", F.col("unique_ips") + poisson(key, 2.0, seed, "aug.ips")))


# ------------------------------------------------------------- session
def newest_first_sightings(ev: DataFrame) -> DataFrame:
    """Per user: distinct ips and devices, and the newest first sighting of
    each kind -- one stacked (user, kind, value) aggregate, no join back."""
    kinds = ev.select(USER, F.struct("event_time", "event_id").alias("t"),
                      F.expr("stack(2, 'ip', ip, 'device', device) AS (kind, val)"))
    firsts = kinds.groupBy(USER, "kind", "val").agg(F.min("t").alias("first"))
    return firsts.groupBy(USER).agg(
        F.count_if(F.col("kind") == "ip").alias("unique_ips"),
        F.count_if(F.col("kind") == "device").alias("unique_devices"),
        F.max(F.when(F.col("kind") == "ip", F.col("first"))).alias("ip_newest"),
        F.max(F.when(F.col("kind") == "device", F.col("first"))).alias("dev_newest"))


def last_event_flags(le: DataFrame) -> DataFrame:
    """Per named user, flags of the *latest* login: unusual hour (F8) and whether
    its ip / device is new (F11 with previous = history). The latest event's
    ip is new exactly when the newest first-sighting of any of the user's
    ips is that event, so two aggregates answer it without a join back to
    the events."""
    le = le.where(F.col(USER).isNotNull())
    last = le.groupBy(USER).agg(F.max(F.struct("event_time", "event_id", unusual_hour("event_time")
                                               .alias("uh"))).alias("last"))
    seen = newest_first_sightings(le)
    last_t = F.struct(F.col("last.event_time").alias("event_time"), F.col("last.event_id").alias("event_id"))
    return last.join(seen, USER).select(
        USER, F.col("last.uh").alias("unusual_login_hour"),
        (F.col("ip_newest") == last_t).cast("int").alias("is_new_ip"),
        (F.col("dev_newest") == last_t).cast("int").alias("is_new_device"))


def session_features(le: DataFrame, widths: Mapping[str, int] | None = None, include_universal: bool = False,
                     pieces: int | None = None) -> DataFrame:
    """The 11 session features per user from raw events.

    W1-W3 come from scans of (user, time) ranges (:mod:`ordered_scan`), one of
    them for the runs and gaps and one for the peaks of the recent counts; the
    latest event and the universal-feature sums from one aggregate per user; the
    distinct counts and the newest first sighting, which equals the latest event
    exactly when the latest event's ip (device) is new, from one stacked
    aggregate over (user, ip | device). All are joined per user.

    ``recent_failed_*`` per user is the peak over the user's events; the
    other features as named. ``include_universal`` adds login_freq,
    failed_count, unique_ips, avg_rtt and the majority label."""
    widths = dict(widths or WIDTHS)
    ev = le.where(F.col(USER).isNotNull())
    rows = _failures_in_order(le)
    runs = fold_runs(scan.run_summaries(rows, pieces))
    peaks = scan.recent_counts(rows.where("us IS NOT NULL"), widths, pieces, (), peaks=True)
    per_user = ev.groupBy(USER).agg(
        F.count(F.lit(1)).alias("login_freq"), F.count_if(F.coalesce(~F.col("success"), F.lit(False))).alias("failed_count"),
        exact_avg("rtt_ms").alias("avg_rtt"), label_mode().alias("is_attack_ip"),
        F.max(F.struct("event_time", "event_id", unusual_hour("event_time").alias("uh"))).alias("last"))
    last_t = F.struct(F.col("last.event_time").alias("event_time"), F.col("last.event_id").alias("event_id"))
    return per_user.join(runs, USER).join(peaks, USER, "left").join(newest_first_sightings(ev), USER, "left").select(
        USER,
        (F.col("login_freq") - F.col("failed_count")).alias("success_count"),
        safe_ratio(F.col("failed_count"), F.col("login_freq") - F.col("failed_count")).alias("failed_success_ratio"),
        F.col("last.uh").alias("unusual_login_hour"),
        (F.col("ip_newest") == last_t).cast("int").alias("is_new_ip"),
        (F.col("dev_newest") == last_t).cast("int").alias("is_new_device"),
        "consecutive_failed_attempts", *widths, "avg_failed_gap", "unique_devices",
        *([F.col("login_freq"), F.col("failed_count"), F.col("unique_ips"), F.col("avg_rtt"), F.col("is_attack_ip")]
          if include_universal else []))
