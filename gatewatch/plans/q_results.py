"""Catalog: readers / writers / publishers, checked by round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewatch.operators import evaluate as EV
from gatewatch.operators import anomaly as N
from gatewatch.operators import features as FT
from gatewatch.operators import scoring as SC
from gatewatch.plans import sqlgen as S
from gatewatch.plans.catalog import register
from gatewatch.plans.q_evaluate import _flags_body, CONF_CTE, METRICS_SELECT, DET
from gatewatch.plans.q_features import SPLIT_SQL, UF, _uf_sql
from gatewatch.plans.sqlgen import with_le
from gatewatch.session import scratch_path
from gatewatch.sources import login_events
from gatewatch.sources import readers as R
from gatewatch.sources import sinks as SK
from gatewatch.sources.json_documents import read_documents
from gatewatch.sources.tables import load_table

FAM = "results"
K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def _linux(spark, d):
    return R.normalise_linux(R.linux_raw_from_events(load_table(spark, d, "events")))


register("normalise_linux", f"""
SELECT CAST(user_id AS VARCHAR) AS user_id, '10.0.0.' || CAST({K} AS VARCHAR) AS ip_address,
       COALESCE(event_type <> 'error', false) AS login_successful,
       COALESCE(CASE WHEN {K} % 7 = 0 THEN NULL ELSE value / 100.0 END,
                10.0 + 190.0 * {S.uniform('event_id', 42, 'linux.rtt')}) * 100.0 AS "round-trip_time_[ms]",
       CASE WHEN user_id % 10 = 0 AND {K} < 60 THEN 1 ELSE 0 END AS is_attack_ip
FROM events""", FAM)(_linux)


def _linux_features(spark, d):
    lin = _linux(spark, d)
    le = R.normalise_rba(lin)
    return FT.impute_mean(FT.universal_features(le, key="ip", label="any"))


register("linux_ip_features", f"""WITH lin AS (
  SELECT '10.0.0.' || CAST({K} AS VARCHAR) AS ip, event_type <> 'error' AS success,
         COALESCE(CASE WHEN {K} % 7 = 0 THEN NULL ELSE value / 100.0 END,
                  10.0 + 190.0 * {S.uniform('event_id', 42, 'linux.rtt')}) * 100.0 AS rtt_ms,
         user_id % 10 = 0 AND {K} < 60 AS is_attack FROM events),
le AS (SELECT * FROM lin),
f AS ({_uf_sql('ip', 'any')}),
m AS (SELECT AVG(avg_rtt) AS fill FROM f)
SELECT user_id, login_freq, failed_count, unique_ips, COALESCE(avg_rtt, fill) AS avg_rtt, is_attack_ip FROM f, m""", FAM)(
    _linux_features)


def _json_roundtrip(spark, d):
    feats = FT.universal_features(login_events(spark, d))
    path = scratch_path(spark, "results-json")
    SK.write_json_lines(feats, path)
    schema = "user_id string, login_freq bigint, failed_count bigint, unique_ips bigint, avg_rtt double, is_attack_ip int"
    from pyspark.sql.types import _parse_datatype_string
    return R.read_results_json(spark, path, _parse_datatype_string(schema))


UF_SCHEMA = "user_id string, login_freq bigint, failed_count bigint, unique_ips bigint, avg_rtt double, is_attack_ip int"


def _mixed_json(spark, d):
    """The features as JSON files of every layout: rows, arrays, results documents,
    documents over several lines, two on a line, and a broken line now and then."""
    from pyspark.sql.types import _parse_datatype_string

    path = scratch_path(spark, "mixed-json")
    feats = FT.universal_features(login_events(spark, d))
    one, k = F.to_json(F.struct(*feats.columns)), F.col("user_id").cast("bigint") % 5
    pretty = F.concat(F.lit("{\n  \"results\":\n[\n"), F.replace(one, F.lit(","), F.lit(",\n  ")), F.lit("\n]\n}"))
    text = F.when(k == 0, one).when(k == 1, F.concat(F.lit("["), one, F.lit("]"))) \
        .when(k == 2, F.concat(F.lit('{"results": ['), one, F.lit("]}"))).when(k == 3, pretty).otherwise(F.concat(one, F.lit(" []")))
    broken = F.when(F.col("user_id").cast("bigint") % 7 == 0, F.concat(F.lit('\n{"user_id": "broken-'), F.col("user_id"))).otherwise(F.lit(""))
    feats.select(F.concat(text, broken).alias("value")).repartition(3).write.text(path)
    return read_documents(spark, path, _parse_datatype_string(UF_SCHEMA))


register("results_json_documents", with_le() + _uf_sql(), FAM)(lambda spark, d: _mixed_json(spark, d)[0])

register("results_json_rejects", with_le(UF) + """
SELECT '{"user_id": "broken-' || user_id AS text, true AS has_line FROM uf WHERE CAST(user_id AS BIGINT) % 7 = 0""", FAM)(
    lambda spark, d: _mixed_json(spark, d)[1].select("text", F.col("line").isNotNull().alias("has_line")))

register("results_json_roundtrip", with_le() + _uf_sql(), FAM)(_json_roundtrip)


def _metrics_roundtrip(spark, d):
    m = EV.metrics(EV.confusion(N.detector_flags(login_events(spark, d), 100, 42), "is_attack_ip", DET))
    path = scratch_path(spark, "metrics-json")
    SK.write_json_lines(m.coalesce(1), path)  # one small file: #detectors rows
    back = R.load_metrics_json(spark, path)
    return back.select("detector", *[F.col(c).cast("bigint") for c in ("tp", "fp", "fn", "tn")],
                       "precision", "recall", "f1", "accuracy")


register("metrics_json_roundtrip", _flags_body() + f", {CONF_CTE}" + METRICS_SELECT.format(src="cf"), FAM)(
    _metrics_roundtrip)


def _published(spark, d):
    feats = FT.universal_features(login_events(spark, d))
    scored = feats.withColumn("meta_prob", SC.logistic_score(["failed_count", "login_freq", "unique_ips", "avg_rtt"],
                                                             (-12.0, 0.5, 0.05, 0.02, 0.01)))
    return SK.publish_meta(scored, 0.1)


register("publish_meta", with_le(UF) + """
SELECT user_id, CAST(failed_count AS INTEGER) AS failed_count, CAST(login_freq AS INTEGER) AS login_freq,
       CAST(unique_ips AS INTEGER) AS unique_ips, avg_rtt,
       1.0 / (1.0 + exp(-(-12.0 + 0.5 * failed_count + 0.05 * login_freq + 0.02 * unique_ips + 0.01 * avg_rtt))) AS meta_prob,
       CAST(1.0 / (1.0 + exp(-(-12.0 + 0.5 * failed_count + 0.05 * login_freq + 0.02 * unique_ips + 0.01 * avg_rtt))) >= 0.1 AS INTEGER) AS meta_pred,
       CAST(is_attack_ip AS INTEGER) AS is_attack_ip
FROM uf""", FAM)(_published)


def _append_overwrite(spark, d):
    feats = FT.split_flag(FT.universal_features(login_events(spark, d)))
    path = scratch_path(spark, "append")
    SK.append_results(feats.where("split = 'train'"), path)
    SK.append_results(feats.where("split = 'test'"), path)
    over = scratch_path(spark, "overwrite")
    SK.replace_results(feats, over)
    SK.replace_results(feats.where("split = 'test'"), over)
    appended = spark.read.parquet(path).withColumn("sink", F.lit("append"))
    replaced = spark.read.parquet(over).withColumn("sink", F.lit("overwrite"))
    return appended.unionByName(replaced)


register("append_and_replace_sinks", with_le(UF) + f"""
, sp AS ({SPLIT_SQL})
SELECT *, 'append' AS sink FROM sp
UNION ALL SELECT *, 'overwrite' AS sink FROM sp WHERE split = 'test'""", FAM)(_append_overwrite)


def _split_roundtrip(spark, d):
    feats = FT.split_flag(FT.universal_features(login_events(spark, d)))
    path = scratch_path(spark, "split-csv")
    SK.write_split(feats, path, fmt="csv")
    schema = ("user_id string, login_freq bigint, failed_count bigint, unique_ips bigint, avg_rtt double, "
              "is_attack_ip int, split string")
    return spark.read.option("header", True).schema(schema).csv(path)


register("write_split_csv", with_le(UF) + f"""
{SPLIT_SQL}""", FAM)(
    _split_roundtrip)


def _app_csv(spark, d):
    le = login_events(spark, d)
    path = scratch_path(spark, "app-log-csv")
    (le.select(F.col("event_id").alias("id"), F.col("user_id").alias("username"), F.col("ip").alias("ip_address"),
               "success", F.col("event_time").alias("created_at"))
     .write.option("header", True).csv(path))
    from gatewatch.operators import audit as A
    return A.failed_per_user(R.read_app_logs(spark, path, fmt="csv"))


def _cert_csv(spark, d):
    le = login_events(spark, d)
    path = scratch_path(spark, "cert-log-csv")
    (le.select(F.col("event_id").alias("id"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("cert_event_id"),
               "event_time", F.col("user_id").alias("username"), F.col("device").alias("pc"), "activity")
     .write.option("header", True).csv(path))
    from gatewatch.operators import audit as A
    return A.logons_per_user(R.read_cert_logs(spark, path))


def _rba_csv(spark, d):
    le = login_events(spark, d)
    path = scratch_path(spark, "rba-csv")
    (le.select(F.col("user_id").alias("User ID"), F.col("ip").alias("IP Address"),
               F.col("success").alias("Login Successful"), F.col("rtt_ms").alias("Round-Trip Time [ms]"),
               F.col("is_attack").cast("int").alias("Is Attack IP"))
     .write.option("header", True).csv(path))
    return FT.universal_features(R.read_rba(spark, path))


def _reg_reader_queries():
    from gatewatch.plans.catalog import REGISTRY

    register("app_log_csv_source", REGISTRY["failed_per_user"].sql, FAM)(_app_csv)
    register("cert_log_csv_source", REGISTRY["logons_per_user"].sql, FAM)(_cert_csv)
    register("rba_csv_source", REGISTRY["universal_features"].sql, FAM)(_rba_csv)


_reg_reader_queries()
