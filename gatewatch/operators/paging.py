"""Paging over result tables.

A page is ``ORDER BY key LIMIT size OFFSET from``; the total rides along as
a column from a one-row aggregate (bounded broadcast). ``offset`` makes
Spark keep ``from + size`` rows per task, fine for shallow pages. For deep ones:

* ``build_index`` writes the rows once, dealt to ranges of the order and with
  the number of rows of each range. ``PageIndex.page`` reads only the ranges that
  hold the page, so page 1,000,000 costs what page 1 does.
* ``page_after`` goes on from a page's last row (keyset). A page ends with all
  rows that are equal to its last one in the order, so no tied row is lost or
  shown twice, whatever the order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gatewatch.session import scratch_path


def _order(cols, descending):
    descending = descending or [False] * len(cols)
    return [F.col(c).desc() if d else F.col(c).asc() for c, d in zip(cols, descending)]


def page(df: DataFrame, order: list[str], page: int = 1, size: int = 100,
         descending: list[bool] | None = None) -> DataFrame:
    """1-based page; ``from = max(0, (page-1)*size)``; adds ``total``."""
    start = max(0, (page - 1) * size)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*_order(order, descending))
    if start:
        rows = rows.offset(start)
    return rows.limit(size).crossJoin(F.broadcast(total))


def page0(df: DataFrame, page: int = 0, size: int = 10, order: str = "user_id") -> DataFrame:
    """0-based page with ``total_elements, total_pages, page_number, page_size``."""
    stats = df.agg(F.count(F.lit(1)).alias("total_elements")).select(
        "total_elements",
        F.ceil(F.col("total_elements") / F.lit(float(size))).cast("bigint").alias("total_pages"),
        F.lit(page).alias("page_number"), F.lit(size).alias("page_size"))
    rows = df.orderBy(F.col(order).asc())
    if page * size:
        rows = rows.offset(page * size)
    return rows.limit(size).crossJoin(F.broadcast(stats))


# ------------------------------------------------------------- deep pages
@dataclass(frozen=True)
class PageIndex:
    """Rows in ranges of their order (folder ``path``, a partition ``gw_range``
    each) and the ranges' row counts, one number a range."""
    spark: SparkSession
    path: str
    schema: StructType
    order: tuple[str, ...]
    descending: tuple[bool, ...]
    ranges: np.ndarray
    counts: np.ndarray

    @property
    def total(self) -> int:
        return int(self.counts.sum())

    def page(self, page: int = 1, size: int = 100) -> DataFrame:
        """The 1-based page, in order, with ``total``; only its ranges are read."""
        start = max(0, (page - 1) * size)
        ends = np.cumsum(self.counts)
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + size - 1, "right")
        if first == len(ends):
            return self.spark.createDataFrame([], self.schema).withColumn("total", F.lit(self.total).cast("bigint"))
        rows = self.spark.read.parquet(self.path).where(F.col("gw_range").isin(self.ranges[first:last + 1].tolist())).drop("gw_range") \
            .orderBy(*_order(self.order, self.descending))
        skip = start - (int(ends[first - 1]) if first else 0)
        return (rows.offset(skip) if skip else rows).limit(size).withColumn("total", F.lit(self.total).cast("bigint"))


def build_index(df: DataFrame, order: list[str], descending: list[bool] | None = None, ranges: int | None = None) -> PageIndex:
    """Writes ``df`` in ``ranges`` ranges of ``order`` (as many as Spark finds fit
    by default). Rows that are equal in ``order`` lie in one range, in any order;
    end the order with a unique column to fix theirs."""
    spark = df.sparkSession
    descending = list(descending or [False] * len(order))
    by = _order(order, descending)
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    path = scratch_path(spark, "pages")
    dealt.withColumn("gw_range", F.spark_partition_id()).write.partitionBy("gw_range").parquet(path)
    if not spark.read.schema(df.schema).parquet(path).head(1):
        return PageIndex(spark, path, df.schema, tuple(order), tuple(descending), np.zeros(0, np.int64), np.zeros(0, np.int64))
    counts = spark.read.parquet(path).groupBy("gw_range").count().orderBy("gw_range").collect()  # one row a range
    return PageIndex(spark, path, df.schema, tuple(order), tuple(descending), np.array([r["gw_range"] for r in counts], np.int64),
                     np.array([r["count"] for r in counts], np.int64))


def _after(order: list[str], last: tuple, descending: bool) -> Column:
    """Rows strictly after ``last``; a null sorts before all values, as Spark has it."""
    here, there = F.struct(*order), F.struct(*[F.lit(v).alias(c) for c, v in zip(order, last)])
    beyond = here < there if descending else here > there
    first = F.col(order[0])
    if last[0] is None:
        return beyond
    # also as a plain comparison, which reaches the scan
    return beyond & ((first <= F.lit(last[0])) | first.isNull() if descending else first >= F.lit(last[0]))


def page_after(df: DataFrame, order: list[str] | str, last: tuple | object, size: int = 100, descending: bool = False) -> DataFrame:
    """Keyset page: the ``size`` rows after ``last`` (the values of ``order`` in the
    last row seen; None as ``last`` gives the first page) and all that tie with
    the last of them."""
    order = [order] if isinstance(order, str) else list(order)
    by = _order(order, [descending] * len(order))
    rest = df
    if last is not None:
        rest = df.where(_after(order, last if isinstance(last, tuple) else (last,), descending))
    key = F.struct(*order)
    top = rest.select(*order).orderBy(*by).limit(size)
    edge = top.agg((F.min(key) if descending else F.max(key)).alias("gw_edge"))
    inside = key >= F.col("gw_edge") if descending else key <= F.col("gw_edge")
    return rest.crossJoin(F.broadcast(edge)).where(inside).drop("gw_edge").orderBy(*by)
