"""Connected components of a link table by alternating star contractions.

Large star: every node hands its larger neighbours to its smallest one. Small
star: every node hands itself and its smaller neighbours to the smallest one.
Repeated until nothing changes, which leaves stars around each component's
smallest node. Each round is grouped sums and joins on written tables; minima
are combined before the shuffle and joins may split large nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch.llm.frames import written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """``e`` has u > v."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    pairs = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pairs.union(low.select("u", F.col("m").alias("v"))).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v) of one sortable type -> (node, root): every linked node
    and its component's smallest node. Self-links, repeats and nulls are ignored."""
    e = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "links")
    seen = _state(e)
    while seen[0]:
        e = written(_small_star(_large_star(e)), "links")
        now = _state(e)
        if now == seen:
            break
        seen = now
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
