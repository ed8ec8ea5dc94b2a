"""Connected components by alternating large and small stars, in rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import staged


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of all nodes of the edges; component is the least node that can be reached (longs).

    Each round is written to the shared folder. A node with very many edges is grouped with partial minima and joined by
    a join whose large partitions Spark splits.

    Defined results: null ends and loops are left out and name no node; repeated edges count once; ids are compared as
    numbers, so there are no ties; no edges give no rows; other columns do not matter.
    """
    now = staged(_ordered(edges.select(F.col(u).cast("long").alias("a"), F.col(v).cast("long").alias("b"))), "stars")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = _ordered(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = staged(large, "stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("b", "a", "m")
        small = _ordered(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))))
        now = staged(small, "stars")
        last, state = state, _state(now)
        if state == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
