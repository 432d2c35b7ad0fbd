"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithspark.llm.common import cut


def _both_ways(edges: DataFrame, u: str, v: str) -> DataFrame:
    """Each edge as (u, v) and (v, u), in one reading: a union would double the plan at every use."""
    ends = [F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in ((u, v), (v, u))]
    return edges.select(F.explode(F.array(*ends)).alias("e")).select("e.*")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, root the least node of its component. Ids are bigints, not null.

    Every step is an aggregate and an equi-join over the edges, written to the shared folder; a node with many
    neighbours is pre-aggregated and its join split by AQE. The number of steps grows with the logarithm of the longest
    path. Loops (a = b) make a component of their own; repeated edges count once. The edges are read several times, so
    give a written table.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    seen = None
    while True:
        both = _both_ways(now, "u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v >= u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(F.explode(F.array(*[F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in "vu"])).alias("e"))
        now = cut(star.select("e.*").filter("u >= v").distinct(), merge=32)
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            break
        seen = mark
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
