"""Account actions as a batch fold.

The reference mutates a users table one request at a time. Here a batch of
actions ``(seq, action, username, role)`` is applied to a users table at once.
The actions are dealt to ranges of (username, seq); a task sums up its actions
of a user: whether there is a delete, the first registration after the last
delete, the last role change, the last suspend or activate. Two summaries merge
in order, a delete clearing what the older one registered, so a user with a huge
history is spread over many tasks and sends one summary a task; no action is
joined with anything.

Rules kept: names are trimmed *before* the existence check; registering an
existing name is rejected; the first registration into an empty users
table gets ``ADMIN``, later ones ``USER``; role / suspend / activate on an
unknown user are ignored; deleting ``admin`` is refused (service rule).
Emptying the table again in the middle of a batch does not hand out a second
``ADMIN`` (only the batch's first registration can be the first user).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch.operators import ordered_scan as scan
from gatewatch.session import write_once
from gatewatch.sources.tables import props_k

USERS_SCHEMA = ("user_id bigint, username string, email string, password_hash string, "
                "role string, suspended boolean")
ACTIONS_SCHEMA = "seq bigint, action string, username string, role string"


REGISTER, DELETE, CHANGE_ROLE, SUSPEND, ACTIVATE = range(1, 6)
SUMMARY = ("part int, has_delete boolean, reg_seq bigint, first_reg bigint, cr_seq bigint, cr_role string, "
           "su_seq bigint, su_v boolean")


def summarise_actions(acts: DataFrame, pieces: int | None = None) -> DataFrame:
    """``acts`` (username, seq, code, role) -> username and ``SUMMARY`` per
    (user, partition); the partitions follow each other in order of seq."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for t, start, _, _ in scan.whole_users(batches):
            seq, code = t.column("seq").combine_chunks(), t.column("code").combine_chunks().to_numpy()
            n, at = len(code), np.arange(len(code))
            size = np.diff(np.r_[start, n])
            last = lambda on: np.maximum.reduceat(np.where(on, at, -1), start)
            first = lambda on: np.minimum.reduceat(np.where(on, at, n), start)
            take = lambda col, i: col.take(pa.array(np.where((i >= 0) & (i < n), i, 0), mask=(i < 0) | (i >= n)))
            gone = last(code == DELETE)
            reg = first((code == REGISTER) & (at > np.repeat(gone, size)))
            change, sus = last(code == CHANGE_ROLE), last((code == SUSPEND) | (code == ACTIVATE))
            yield pa.RecordBatch.from_arrays([
                t.column(0).chunk(0).take(pa.array(start)), pa.array(np.full(len(start), part, np.int32)), pa.array(gone >= 0),
                take(seq, reg), take(seq, first(code == REGISTER)), take(seq, change), take(t.column("role").combine_chunks(), change),
                take(seq, sus), take(pa.array(code == SUSPEND), sus)],
                ["username", *(c.split()[0] for c in SUMMARY.split(", "))])

    order = [F.col("username"), F.col("seq")]
    ranged = scan.in_ranges(acts.select("username", "seq", "code", "role"), order, pieces)
    return ranged.mapInArrow(run, f"username string, {SUMMARY}")


def merge_summaries(summaries: DataFrame) -> DataFrame:
    """One summary per user: username, deleted, reg_seq, cr, sus."""
    step = lambda reg, x: F.when(x["has_delete"], x["reg_seq"]).otherwise(F.coalesce(reg, x["reg_seq"]))
    return summaries.groupBy("username").agg(
        F.bool_or("has_delete").alias("deleted"),
        F.aggregate(F.sort_array(F.collect_list(F.struct("part", "has_delete", "reg_seq"))), F.lit(None).cast("bigint"), step).alias("reg_seq"),
        F.max(F.when(F.col("cr_seq").isNotNull(), F.struct(F.col("cr_seq").alias("seq"), F.col("cr_role").alias("role")))).alias("cr"),
        F.max(F.when(F.col("su_seq").isNotNull(), F.struct(F.col("su_seq").alias("seq"), F.col("su_v").alias("v")))).alias("sus"))


def apply_user_actions(users: DataFrame, actions: DataFrame, protect_admin: bool = True, pieces: int | None = None) -> DataFrame:
    """U1 -> ``username, role, suspended`` after the whole batch. ``pieces`` is
    the number of ranges that the actions are dealt to; it changes the work only."""
    action = F.lower(F.trim("action"))
    code = F.coalesce(*[F.when(action == a, F.lit(i)) for i, a in enumerate(("register", "delete", "change_role", "suspend", "activate"), 1)])
    acts = actions.select(F.trim("username").alias("username"), F.col("seq").cast("bigint").alias("seq"), code.alias("code"), "role").where("code IS NOT NULL AND seq IS NOT NULL")
    if protect_admin:
        acts = acts.where(~((F.col("code") == DELETE) & F.col("username").eqNullSafe("admin")))
    parts = write_once(summarise_actions(acts, pieces), "action_summaries")
    init = users.select(F.trim("username").alias("username"), F.col("role").alias("init_role"),
                        F.coalesce("suspended", F.lit(False)).alias("init_susp"),
                        F.lit(True).alias("init"))
    # one-row facts: is the users table empty, and which registration is the first ever
    n_users = users.agg(F.count(F.lit(1)).alias("n_users"))
    # the first registration of the batch lands in the (possibly) empty table
    first_reg = parts.agg(F.min("first_reg").alias("first_reg"))
    j = (merge_summaries(parts).join(init, "username", "full_outer")
         .crossJoin(F.broadcast(n_users)).crossJoin(F.broadcast(first_reg)))
    kept_init = F.coalesce(F.col("init"), F.lit(False)) & ~F.coalesce(F.col("deleted"), F.lit(False))
    created = F.when(kept_init, F.lit(-1).cast("bigint")).otherwise(F.col("reg_seq"))
    base_role = F.when(kept_init, F.col("init_role")).when(
        (F.col("n_users") == 0) & (F.col("reg_seq") == F.col("first_reg")), F.lit("ADMIN")).otherwise(F.lit("USER"))
    base_susp = F.when(kept_init, F.col("init_susp")).otherwise(F.lit(False))
    role = F.when(F.col("cr.seq") > F.col("gw_created"), F.col("cr.role")).otherwise(F.col("gw_base_role"))
    susp = F.when(F.col("sus.seq") > F.col("gw_created"), F.col("sus.v")).otherwise(F.col("gw_base_susp"))
    return (j.withColumn("gw_created", created).where(F.col("gw_created").isNotNull())
            .withColumn("gw_base_role", base_role).withColumn("gw_base_susp", base_susp)
            .select("username", role.alias("role"), susp.alias("suspended")))


def suspension_candidates(flags: DataFrame, users: DataFrame, flag_col: str = "anomalous",
                          key: str = "username") -> DataFrame:
    """Flagged users that are not suspended yet."""
    f = flags.where(F.col(flag_col)).select(F.col(key).alias("username")).distinct()
    return f.join(users.where(~F.coalesce(F.col("suspended"), F.lit(False))), "username")


def list_users(users: DataFrame) -> DataFrame:
    """Full listing without the password hash."""
    return users.drop("password_hash")


def actions_from_events(le: DataFrame) -> DataFrame:
    """Account actions derived from the event log (fixed mapping): signup ->
    register, error -> suspend, click -> activate, purchase -> change_role
    (or delete when k < 10); views carry no action. Some names are padded
    with spaces (k % 17 = 0) to exercise trimming."""
    k = props_k()
    name = F.when(k % 17 == 0, F.concat(F.lit("  "), F.col("user_id").cast("string"), F.lit(" "))) \
        .otherwise(F.col("user_id").cast("string"))
    action = (F.when(F.col("event_type") == "signup", F.lit("register"))
              .when(F.col("event_type") == "error", F.lit("suspend"))
              .when(F.col("event_type") == "click", F.lit("activate"))
              .when((F.col("event_type") == "purchase") & (k < 10), F.lit("delete"))
              .when(F.col("event_type") == "purchase", F.lit("change_role")))
    role = F.when(k % 2 == 0, F.lit("ANALYST")).otherwise(F.lit("USER"))
    return le.select(F.col("event_id").alias("seq"), action.alias("action"), name.alias("username"),
                     role.alias("role")).where(F.col("action").isNotNull())
