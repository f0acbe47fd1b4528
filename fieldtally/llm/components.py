"""Connected components of an edge table by star contraction, without collecting any group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.operators.lineage import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) & 1048575 as long))")).first()
    return tuple(row)


def _stars(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points at the smallest node around, then smaller ones do."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    large = cut(large)  # u > v from here on
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(u, root) for every node with an edge that is not its component's smallest.

    `edges` has columns u and v of one ordered type. Rounds grow with the logarithm
    of a component's width; each is written, so a lost executor costs one round.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = _state(now)
    while before[0]:
        now = cut(_stars(now))
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select("u", F.col("v").alias("root"))
