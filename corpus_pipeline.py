"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage
before it kept, and returns a DataFrame; between stages the rows are written
as Parquet in the cluster's shared folder and read again. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatewatch.llm import queries as q
from gatewatch.llm.decontaminate import decontaminate
from gatewatch.llm.frames import written
from gatewatch.llm.mixing import resample
from gatewatch.llm.sharding import assign_shards
from gatewatch.llm.simhash import keep_one
from gatewatch.llm.toxicity import drop_toxic, train
from gatewatch.session import tidy
from gatewatch.sources.tables import load_table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return drop_toxic(docs, train(docs, load_table(spark, sf_dir, "labels"), q.may_learn))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: three-word shingles, two bits."""
    return keep_one(docs, size=3, max_bits=2)


def benchmark_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is mostly passage goes."""
    return decontaminate(docs, load_table(spark, sf_dir, "benchmark"), window=10, max_coverage=0.5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its rate says."""
    return resample(docs, q.mix_labels(docs, load_table(spark, sf_dir, "labels")), q.MIX_TARGETS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its slot and shard."""
    return assign_shards(docs, "doc_id", q.SHARDS)


def tidied(stage):
    """``stage`` after the driver has let go of what the stages before left there."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tidy(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


STAGES = [(name, tidied(stage)) for name, stage in (
    ("toxicity", toxicity), ("simhash_near_dedup", near_duplicates), ("decontamination", benchmark_spans),
    ("mixing", mixing), ("sharding", sharding))]

#: learned scores, linked components and fitted rates have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
