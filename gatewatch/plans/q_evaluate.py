"""Catalog: confusion / metrics / reports; the flagship comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewatch.operators import anomaly as N
from gatewatch.operators import audit as A
from gatewatch.operators import evaluate as EV
from gatewatch.operators import features as FT
from gatewatch.operators import scoring as SC
from gatewatch.plans import sqlgen as S
from gatewatch.plans.catalog import register
from gatewatch.plans.q_detect import flags_ctes
from gatewatch.plans.q_features import UF
from gatewatch.plans.sqlgen import with_le
from gatewatch.sources import login_events

FAM = "evaluate"
DET = N.DETECTORS


def _flags_body() -> str:
    return with_le(flags_ctes(100))


def _conf_sql(src: str, truth: str, preds) -> str:
    parts = [f"""SELECT '{p}' AS detector,
       COUNT_IF({p} AND {truth}) AS tp, COUNT_IF({p} AND NOT {truth}) AS fp,
       COUNT_IF(NOT {p} AND {truth}) AS fn, COUNT_IF(NOT {p} AND NOT {truth}) AS tn FROM {src}"""
             for p in preds]
    return "\nUNION ALL\n".join(parts)


CONF_CTE = f"cf AS ({_conf_sql('fl', 'is_attack_ip', DET)})"
METRICS_SELECT = """
SELECT detector, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
       CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
       CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
       CASE WHEN (CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END)
                 + (CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END) = 0 THEN 0.0
            ELSE 2.0 * (CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END)
                     * (CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END)
                 / ((CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END)
                    + (CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END)) END AS f1,
       CASE WHEN tp + tn + fp + fn = 0 THEN 0.0 ELSE (tp + tn) / (tp + tn + fp + fn) END AS accuracy
FROM {src}"""


def _flags(spark, d):
    return N.detector_flags(login_events(spark, d), 100, 42)


register("detector_confusion", _flags_body() + f", {CONF_CTE}\nSELECT detector, CAST(tp AS BIGINT) AS tp, "
         "CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn FROM cf", FAM)(
    lambda spark, d: EV.confusion(_flags(spark, d), "is_attack_ip", DET))

register("detector_metrics", _flags_body() + f", {CONF_CTE}" + METRICS_SELECT.format(src="cf"), FAM)(
    lambda spark, d: EV.metrics(EV.confusion(_flags(spark, d), "is_attack_ip", DET)))

register("accuracy_percent", _flags_body() + f", {CONF_CTE}" + """
SELECT detector, CAST(CASE WHEN tp + fp + fn + tn = 0 THEN 0 ELSE floor(100.0 * (tp + tn) / (tp + fp + fn + tn) + 0.5) END AS BIGINT) AS accuracy_pct,
       CAST(tp + fn AS BIGINT) AS attack, CAST(fp + tn AS BIGINT) AS benign FROM cf""", FAM)(
    lambda spark, d: EV.accuracy_percent(EV.confusion(_flags(spark, d), "is_attack_ip", DET)))


def _report_sql() -> str:
    def ratio(a, b):
        return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END)"

    def f1(p, r):
        return f"(CASE WHEN {p} + {r} = 0 THEN 0.0 ELSE 2.0 * {p} * {r} / ({p} + {r}) END)"

    p1, r1 = ratio("tp", "tp + fp"), ratio("tp", "tp + fn")
    p0, r0 = ratio("tn", "tn + fn"), ratio("tn", "tn + fp")
    f11, f10 = f1(p1, r1), f1(p0, r0)
    s1, s0, n = "(tp + fn)", "(tn + fp)", "(tp + fn + tn + fp)"
    w = lambda a, b: ratio(f"{a} * {s1} + {b} * {s0}", n)
    return _flags_body() + f", {CONF_CTE}" + f"""
SELECT detector, '1' AS class_label, {p1} AS precision, {r1} AS recall, {f11} AS f1, CAST({s1} AS BIGINT) AS support FROM cf
UNION ALL SELECT detector, '0', {p0}, {r0}, {f10}, CAST({s0} AS BIGINT) FROM cf
UNION ALL SELECT detector, 'macro avg', ({p1} + {p0}) / 2.0, ({r1} + {r0}) / 2.0, ({f11} + {f10}) / 2.0, CAST({n} AS BIGINT) FROM cf
UNION ALL SELECT detector, 'weighted avg', {w(p1, p0)}, {w(r1, r0)}, {w(f11, f10)}, CAST({n} AS BIGINT) FROM cf"""


register("classification_report", _report_sql(), FAM)(
    lambda spark, d: EV.classification_report(EV.confusion(_flags(spark, d), "is_attack_ip", DET)))

register("class_distribution", with_le(UF) + """
SELECT is_attack_ip, COUNT(*) AS n FROM uf GROUP BY is_attack_ip""", FAM)(
    lambda spark, d: EV.class_distribution(FT.universal_features(login_events(spark, d))))

register("contamination", with_le(UF) + """
SELECT CASE WHEN COALESCE(AVG(CAST(is_attack_ip AS DOUBLE)), 0.0) = 0 THEN 0.05
            ELSE AVG(CAST(is_attack_ip AS DOUBLE)) END AS contamination FROM uf""", FAM)(
    lambda spark, d: EV.contamination(FT.universal_features(login_events(spark, d))))

register("positive_weight", with_le(UF) + """
SELECT CASE WHEN COUNT_IF(is_attack_ip = 1) = 0 THEN 1.0
            ELSE COUNT_IF(is_attack_ip <> 1) / COUNT_IF(is_attack_ip = 1) END AS scale_pos_weight FROM uf""", FAM)(
    lambda spark, d: EV.positive_weight(FT.universal_features(login_events(spark, d))))


def _merge(spark, d):
    le = login_events(spark, d)
    wide = EV.metrics(EV.confusion(N.detector_flags(le, 100, 42), "is_attack_ip", DET))
    narrow = EV.metrics(EV.confusion(N.detector_flags(le, 40, 42), "is_attack_ip", DET[:4]))
    return EV.merge_metrics(wide, narrow)


def _metrics_union_sql() -> str:
    cols = "tp, fp, fn, tn, precision, recall, f1, accuracy"
    return (with_le(flags_ctes(100), flags_ctes(40, "2"))
            + f", cf AS ({_conf_sql('fl', 'is_attack_ip', DET)})"
            + f", cf2 AS ({_conf_sql('fl2', 'is_attack_ip', DET[:4])})"
            + ", m1 AS (" + METRICS_SELECT.format(src="cf") + ")"
            + ", m2 AS (" + METRICS_SELECT.format(src="cf2") + ")"
            + f"""
SELECT detector, {cols} FROM m2
UNION ALL
SELECT detector, {cols} FROM m1 WHERE detector NOT IN (SELECT detector FROM m2)""")


register("metrics_union", _metrics_union_sql(), FAM)(_merge)

register("detector_agreement", with_le(UF, "fc AS (SELECT user_id, COUNT(*) AS count FROM le WHERE NOT success GROUP BY user_id)") + f"""
, s AS (SELECT avg(count) AS m, stddev_pop(count) AS sd FROM fc)
, z AS (SELECT user_id, CAST(abs(CASE WHEN sd IS NULL OR sd = 0 THEN 0.0 ELSE (count - m) / sd END) >= 1.0 AS INTEGER) AS zscore FROM fc, s)
, dp AS (SELECT user_id, CAST({S.half_up('count + ' + S.laplace('user_id', 1.0, 42, 'laplace|failed|all|1.0'))} >= 12 AS INTEGER) AS dp_threshold FROM fc)
, st AS (SELECT user_id, {S.stump('count')} AS stumps FROM fc)
SELECT uf.user_id, uf.is_attack_ip, COALESCE(z.zscore, 0) AS zscore, COALESCE(dp.dp_threshold, 0) AS dp_threshold,
       COALESCE(st.stumps, 0) AS stumps,
       COALESCE(z.zscore, 0) + COALESCE(dp.dp_threshold, 0) + COALESCE(st.stumps, 0) AS votes
FROM uf LEFT JOIN z USING (user_id) LEFT JOIN dp USING (user_id) LEFT JOIN st USING (user_id)""", FAM)(
    lambda spark, d: (lambda le: EV.agreement(
        {"zscore": N.zscore_flags(A.failed_per_user(le), 1.0).select("user_id", F.col("anomalous").alias("zscore")),
         "dp_threshold": N.dp_threshold(A.failed_per_user(le), 1.0, 12, 42, "failed|all").withColumnRenamed("anomalous", "dp_threshold"),
         "stumps": A.failed_per_user(le).select("user_id", SC.stump_vote("count").alias("stumps"))},
        FT.universal_features(le).select("user_id", "is_attack_ip")))(login_events(spark, d)))

_TH = tuple(round(0.1 * i, 1) for i in range(1, 11))
_TH_VALUES = ", ".join(f"({t!r})" for t in _TH)

register("threshold_sweep", with_le(UF) + f"""
, sc AS (SELECT {S.logistic('failed_count')} AS s, is_attack_ip = 1 AS t FROM uf)
, th AS (SELECT CAST(x AS DOUBLE) AS threshold FROM (VALUES {_TH_VALUES}) v(x))
, cf AS (SELECT threshold, COUNT_IF(s >= threshold AND t) AS tp, COUNT_IF(s >= threshold AND NOT t) AS fp,
                COUNT_IF(NOT (s >= threshold) AND t) AS fn, COUNT_IF(NOT (s >= threshold) AND NOT t) AS tn
         FROM sc, th GROUP BY threshold)""" + METRICS_SELECT.replace("SELECT detector,", "SELECT threshold,").format(src="cf"), FAM)(
    lambda spark, d: EV.threshold_sweep(
        FT.universal_features(login_events(spark, d)).select(
            SC.logistic_score(["failed_count"]).alias("score"), "is_attack_ip"), "score", "is_attack_ip"))


def _percent(spark, d):
    from gatewatch.functions.scalar import percent

    m = EV.metrics(EV.confusion(_flags(spark, d), "is_attack_ip", DET))
    return m.select("detector", *[percent(c, 1).alias(f"{c}_pct") for c in ("precision", "recall", "f1", "accuracy")])


register("metrics_percent", _flags_body() + f", {CONF_CTE}, mm AS (" + METRICS_SELECT.format(src="cf") + """)
SELECT detector, CAST(floor(precision * 1000.0 + 0.5) AS BIGINT) / 10.0 AS precision_pct,
       CAST(floor(recall * 1000.0 + 0.5) AS BIGINT) / 10.0 AS recall_pct,
       CAST(floor(f1 * 1000.0 + 0.5) AS BIGINT) / 10.0 AS f1_pct,
       CAST(floor(accuracy * 1000.0 + 0.5) AS BIGINT) / 10.0 AS accuracy_pct FROM mm""", FAM)(_percent)
