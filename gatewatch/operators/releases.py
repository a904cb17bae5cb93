"""A ledger of noisy releases (P4-P10): what was released, of which state of the
log, for how much privacy budget.

The noise of a release is drawn from its name: mechanism, statistic, window,
epsilon and the *state* of the log. The state is derived from the log itself
(latest time, rows, and a digest sum over all rows), so the same question about
the same rows repeats its answer, and any change of the rows is another draw:
the noise of two days never cancels.

A ledger is a folder with one file per release, written once: a file is created
only if there is none of its number, so two drivers cannot take one entry, and
what was charged survives the loss of any executor or driver. A release that is
in the ledger is free (its answer is the same); a new one is charged, and raises
``BudgetSpent`` if the sum of all epsilons would pass the budget (plain
composition, the bound for releases about the same people).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewatch.operators import audit as A

USER = A.USER
LEDGER_SCHEMA = "entry int, mechanism string, statistic string, window string, state string, epsilon double, delta double"


class BudgetSpent(ValueError):
    """A release would pass the ledger's budget."""


def epoch_us(col: str = "event_time") -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})")


def row_digest() -> Column:
    """52 bits of a hash of what counts read of an event."""
    parts = [F.col("event_id").cast("string"), F.col(USER), epoch_us().cast("string"), F.col("success").cast("string"), F.col("activity")]
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("-")) for p in parts]), 256), 1, 13), 16, 10).cast("decimal(20,0)")


def state_of(latest: Column, rows: Column, digest: Column) -> Column:
    """The state's name from the latest time (microseconds), the rows and the digest sum."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("0")) for c in (latest, rows, digest)])


def log_state(le: DataFrame) -> DataFrame:
    """One row, ``gw_state``: the state of the log."""
    return le.agg(state_of(F.max(epoch_us()), F.count(F.lit(1)), F.sum(row_digest())).alias("gw_state"))


class Ledger:
    """Releases charged so far, in files under ``path``; ``budget`` bounds the sum of their epsilons."""

    def __init__(self, spark: SparkSession, path: str, budget: float):
        if not budget > 0:
            raise ValueError("the budget must be > 0")
        self.spark, self.path, self.budget = spark, path.rstrip("/"), float(budget)

    def table(self) -> DataFrame:
        """The entries, in ``LEDGER_SCHEMA``; none if nothing was released."""
        if not self._fs()[0].exists(self._at("")):
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        return self.spark.read.schema(LEDGER_SCHEMA).json(self.path)

    def spent(self) -> float:
        return self.table().agg(F.coalesce(F.sum("epsilon"), F.lit(0.0))).first()[0]

    def _fs(self):
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(sc._jsc.hadoopConfiguration()), jvm

    def _at(self, name: str):
        jvm = self.spark.sparkContext._jvm
        return jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def charge(self, mechanism: str, statistic: str, window: str, state: str, epsilon: float, delta: float = 0.0) -> str:
        """The name of a release, for the ``release`` argument of the noisy
        operators. Charged unless the ledger has it already."""
        if not epsilon > 0:
            raise ValueError("epsilon must be > 0")
        mine = {"mechanism": mechanism, "statistic": statistic, "window": window, "state": state, "epsilon": float(epsilon), "delta": float(delta)}
        fs, _ = self._fs()
        while True:
            rows = self.table().collect()
            if any(all(r[k] == v for k, v in mine.items()) for r in rows):
                break
            if sum(r["epsilon"] for r in rows) + epsilon > self.budget * (1 + 1e-12):
                raise BudgetSpent(f"{statistic} ({window}) for epsilon {epsilon}: {sum(r['epsilon'] for r in rows)} of {self.budget} are spent")
            entry = max((r["entry"] for r in rows), default=0) + 1
            if self._write(fs, entry, mine):
                break
        return f"{statistic}|{window}|{state}"

    def _write(self, fs, entry: int, mine: dict) -> bool:
        """False if another driver took this number first."""
        target = self._at(f"release-{entry:08d}.json")
        try:
            out = fs.create(target, False)
        except Exception:  # noqa: BLE001 -- the file is there: read the ledger again
            if fs.exists(target):
                return False
            raise
        out.write(bytearray(json.dumps({"entry": entry, **mine}).encode() + b"\n"))
        out.close()
        return True


def state_name(le: DataFrame) -> str:
    return log_state(le).first()["gw_state"]


def release_counts(le: DataFrame, ledger: Ledger, epsilon: float, seed, statistic: str = "failed", width: str = "all",
                   mechanism: str = "laplace", delta: float = 0.0) -> DataFrame:
    """P4-P6 through a ledger: ``user_id, noisy_count`` of failed attempts or
    logons, of the whole log or of its latest ``width``."""
    from gatewatch.operators import anomaly as N

    if statistic not in ("failed", "logons"):
        raise ValueError("statistic is 'failed' or 'logons'")
    release = ledger.charge(mechanism, statistic, width, state_name(le), epsilon, delta)
    if width == "all":
        counts = A.failed_per_user(le) if statistic == "failed" else A.logons_per_user(le)
    else:
        counts = A.recent_failed_per_user(le, width) if statistic == "failed" else A.recent_logons_per_user(le, width)
    if mechanism == "gaussian":
        return N.dp_gaussian_counts(counts, epsilon, delta, seed, release)
    if mechanism != "laplace":
        raise ValueError("mechanism is 'laplace' or 'gaussian'")
    return N.dp_counts(counts, epsilon, seed, release)
