"""Connected components of an edge table, by alternating star contraction.

A round hands every node's larger neighbours to the smallest node it knows, and
then does the same for its smaller neighbours; the number of rounds grows with
the logarithm of the longest path.  Minima come from map-side combined
aggregates, so a hub is not one hot group, and every round is written into the
shared folder.  Ids may be of any type that Spark can order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import shared_table


def _contracted(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")),
                             F.struct(F.col("lo").alias("u"), F.col("hi").alias("v"))))
    both = edges.select(ends.alias("e")).select("e.u", "e.v")
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    up = (both.where(F.col("v") > F.col("u")).join(low, "u")
          .select(F.col("v").alias("hi"), F.least("u", "m").alias("lo")).distinct())
    best = up.groupBy("hi").agg(F.min("lo").alias("m"))
    down = (up.join(best, "hi").where(F.col("lo") != F.col("m"))
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
    return down.union(best.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """``(v, root)`` for every node with an edge; ``root`` is the smallest node
    of its component.  Loops and nulls carry nothing; direction and repetition
    of edges don't matter."""
    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()

    pair = edges.where(F.col(a) != F.col(b))
    current = shared_table(pair.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    seen = mark(current)
    while seen[0]:
        current = shared_table(_contracted(current))
        before, seen = seen, mark(current)
        if before == seen:
            break
    return (current.select(F.col("hi").alias("v"), F.col("lo").alias("root"))
            .union(current.select(F.col("lo").alias("v"), F.col("lo").alias("root")).distinct()))
