"""Local outlier factor, novelty mode (M8; Breunig et al. 2000).

Fit on ``train``: k-NN among train (a point is not its own neighbour),
k-distance, reachability distance and local reachability density (lrd).
Score ``data`` (train rows included -- there a row finds itself at distance
0, as in novelty prediction): LOF = mean lrd of the neighbours / own lrd.
The cut is the ``contamination`` percentile of the training LOFs (computed
with ``percentile_approx``: bounded memory, no single-task collect).
Everything after the k-NN kernel is joins and aggregates on neighbour ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch.models.knn import knn
from gatewatch.session import tidy

EPS = 1e-10
SALTS = 8


def _on_neighbour(lists: DataFrame, facts: DataFrame, id_col: str) -> DataFrame:
    """Join facts on the neighbour ``o``. Copies of a point share their first
    neighbours, so an id may be in many lists: its rows are dealt to ``SALTS``
    tasks, and the facts, one row an id, are repeated for each."""
    salted = lists.withColumn("gw_s", F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
    return salted.join(facts.withColumn("gw_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), ["o", "gw_s"])


def _lrd_from(nbrs: DataFrame, kdist: DataFrame, id_col: str) -> DataFrame:
    """lrd per query id from its neighbour lists and the train k-distances."""
    ex = nbrs.select(id_col, F.posexplode(F.arrays_zip("nbr_ids", "nbr_dists")).alias("pos", "z")) \
        .select(id_col, F.col("z.nbr_ids").alias("o"), F.col("z.nbr_dists").alias("d"))
    j = _on_neighbour(ex, kdist.withColumnRenamed(id_col, "o"), id_col)
    return (j.groupBy(id_col)
            .agg((F.lit(1.0) / (F.avg(F.greatest("d", "kdist")) + F.lit(EPS))).alias("lrd"),
                 F.collect_list("o").alias("nbrs")))


def lof_scores(train: DataFrame, data: DataFrame, id_col: str, feat_cols: Sequence[str],
               k: int = 20, contamination: float = 0.05, novelty: bool = True) -> DataFrame:
    """``id_col, lof, lof_pred`` for every row of ``data``. Without ``novelty``
    the rows of ``train`` are judged themselves, ``data`` being the same rows."""
    from gatewatch.models.supervised import materialise

    n_train = train.count()
    k_eff = max(1, min(k, n_train - 1))
    fit_nbrs = materialise(knn(train, train, id_col, feat_cols, k_eff, exclude_self=True))
    kdist = fit_nbrs.select(F.col(id_col), F.element_at("nbr_dists", -1).alias("kdist"))
    lrd_train = materialise(_lrd_from(fit_nbrs, kdist, id_col).select(id_col, "lrd"))

    def lof_of(nbrs):
        own = _lrd_from(nbrs, kdist, id_col)
        ex = own.select(id_col, "lrd", F.explode("nbrs").alias("o"))
        nb = _on_neighbour(ex, lrd_train.select(F.col(id_col).alias("o"), F.col("lrd").alias("lrd_o")), id_col)
        return nb.groupBy(id_col).agg((F.avg("lrd_o") / F.first("lrd")).alias("lof"))

    train_lof = lof_of(fit_nbrs)
    cut = train_lof.agg(F.percentile_approx(-F.col("lof"), float(contamination), 100000).alias("offset"))
    if not novelty:
        return (train_lof.crossJoin(F.broadcast(cut))
                .select(F.col(id_col), "lof", (-F.col("lof") < F.col("offset")).cast("int").alias("lof_pred")))
    tidy(train.sparkSession)  # two searches' plans at once are much for the driver
    q_nbrs = materialise(knn(data, train, id_col, feat_cols, k_eff, exclude_self=False))
    scored = lof_of(q_nbrs)
    return (scored.crossJoin(F.broadcast(cut))
            .select(F.col(id_col), "lof", (-F.col("lof") < F.col("offset")).cast("int").alias("lof_pred")))
