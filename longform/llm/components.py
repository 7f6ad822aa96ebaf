"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longform.llm.common import materialize


def _signature(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has a link; ``root`` is the smallest node reachable.

    Alternates large-star (link every larger neighbour to the smallest neighbour) and small-star (link every smaller
    neighbour to it) until the edge set stops changing, which takes O(log^2 n) rounds. A hub needs no collected
    neighbour list: minima are partial aggregates and the rest are equi-joins, whose hot keys AQE splits. Every round
    is checkpointed in the shared folder; the driver sees a count and a checksum only.
    """
    cur = materialize(edges.where(F.col(a) != F.col(b))
                      .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = _signature(cur)
    while before[0]:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.*").where(F.col("u") != F.col("v")).distinct())
        cur = materialize(small)
        after = _signature(cur)
        if after == before:
            break
        before = after
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .union(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
