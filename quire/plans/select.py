"""Selection by rank without sorting: the k first of n, and quotas by rank.

Rows of a group are ordered by a uniform hash key.  A histogram over the key's
first digits says where the wanted ranks lie; whole buckets are taken as they
are, and exact ranks are computed only inside the few buckets that a boundary
cuts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 4  # of a hexadecimal key: 65,536 buckets a group


def by_rank(rows: DataFrame, bounds: DataFrame, group: str, id_col: str, key: str, label: str) -> DataFrame:
    """``(id, group, label)``: the row of rank ``above < rank <= upto`` in its
    group, ordered by ``key``, then id, gets the label.

    ``rows`` has one row per id and group with a hexadecimal hash as ``key``;
    ``bounds(group, label, above, upto)`` has disjoint ranges.  Rows whose rank
    is in no range are left out.
    """
    bucketed = rows.select(id_col, group, key, F.substring(key, 1, DIGITS).alias("_b"))
    counts = bucketed.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    # at most 16^DIGITS rows a group
    so_far = F.sum("_n").over(Window.partitionBy(group).orderBy("_b"))
    counts = counts.withColumn("_before", so_far - F.col("_n"))
    cut = counts.join(bounds, group).where((F.col("above") < F.col("_before") + F.col("_n"))
                                           & (F.col("upto") > F.col("_before")))
    whole = (F.col("above") <= F.col("_before")) & (F.col("upto") >= F.col("_before") + F.col("_n"))
    plan = cut.groupBy(group, "_b", "_before").agg(
        F.collect_list(F.struct("above", "upto", label)).alias("_ranges"), F.bool_and(whole).alias("_whole"))
    placed = bucketed.join(plan, [group, "_b"])
    sure = placed.where("_whole").select(id_col, group, F.col("_ranges")[0][label].alias(label))
    ranked = placed.where(~F.col("_whole")).withColumn("_rank", F.col("_before") + F.row_number().over(
        Window.partitionBy(group, "_b").orderBy(key, id_col)))
    edge = ranked.select(id_col, group, "_rank", F.inline("_ranges")) \
        .where((F.col("_rank") > F.col("above")) & (F.col("_rank") <= F.col("upto")))
    return sure.unionByName(edge.select(id_col, group, label))
