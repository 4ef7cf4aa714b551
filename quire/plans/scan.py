"""Skew-safe ordered scans: running sums, ranks, forward fill, previous row.

A plain ``Window.partitionBy(g).orderBy(o)`` sends a whole group to one
task, so a group holding a third of the data becomes a single straggler (or
an OOM).  These helpers range-partition on ``(g, o)`` instead, so a hot
group is cut into several contiguous segments, run the window per
``(segment, g)``, and then stitch segments together with a carry table.

Because range partitions are contiguous in ``(g, o)`` order, a group can
cross a segment border only as the first or last group of a segment, so the
carry table has at most ``2 * segments`` rows: it is broadcast with a proven
bound.

Range bounds are sampled when the exchange runs, and two separate
exchanges of the same data may sample differently.  So the local pass is
written once into the shared folder, and both the carry table and the final
join read that one copy, also after the loss of an executor.
``session.clear_shared`` deletes the copies.

Null group keys are a group like any other: all joins are null-safe.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import shared_table, shuffle_partitions

SEG = "_seg"


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in names]


def segment(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
            segments: int | None = None) -> DataFrame:
    """Range-partition on (group, order) and tag each row with its segment."""
    n = segments or shuffle_partitions(df.sparkSession)
    return (df.repartitionByRange(n, *_cols(group_cols), *_cols(order_cols))
            .withColumn(SEG, F.spark_partition_id()))


def _edges(seg: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """(segment, group) pairs that sit at a segment border: <= 2 per segment."""
    if not group_cols:
        return seg.select(SEG).distinct()
    key = F.struct(*_cols(group_cols))
    b = seg.groupBy(SEG).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    lo = b.select(SEG, *[F.col("_lo")[c].alias(c) for c in group_cols])
    hi = b.select(SEG, *[F.col("_hi")[c].alias(c) for c in group_cols])
    return lo.union(hi).distinct()


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys`` with nulls equal; the keys come out once."""
    named = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)],
                         *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & left[k].eqNullSafe(named[f"_r{i}"])
    return left.join(named, on, how).drop(*[f"_r{i}" for i in range(len(keys))])


def _scan(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
          value: Column, local: Callable[[Window], Column], summary: Column,
          carry: Callable[[Window], Column], combine: Callable[[Column, Column], Column],
          out: str, segments: int | None) -> DataFrame:
    """Shared skeleton: local window, per-border summary, carry, combine."""
    g, o = list(group_cols), list(order_cols)
    seg = segment(df.withColumn("_v", value), g, o, segments)
    w_local = Window.partitionBy(SEG, *g).orderBy(*_cols(o))
    loc = shared_table(seg.withColumn("_local", local(w_local)))
    edges = F.broadcast(_edges(loc, g))  # at most two rows a segment
    summ = join_null_safe(loc, edges, [SEG, *g], "inner").groupBy(SEG, *g).agg(summary.alias("_sum"))
    w_seg = Window.partitionBy(*g).orderBy(SEG)
    car = summ.select(SEG, *g, carry(w_seg).alias("_carry"))
    res = join_null_safe(loc, F.broadcast(car), [SEG, *g], "left")
    return res.withColumn(out, combine(F.col("_local"), F.col("_carry"))) \
        .drop("_v", "_local", "_carry", SEG)


def _upto(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                value: Column, out: str, segments: int | None = None) -> DataFrame:
    """``out`` = sum of ``value`` over all rows of the group up to this one."""
    return _scan(df, group_cols, order_cols, value,
                 local=lambda w: F.sum("_v").over(_upto(w)),
                 summary=F.sum("_v"),
                 carry=lambda w: F.sum("_sum").over(_before(w)),
                 combine=lambda lo, ca: lo + F.coalesce(ca, F.lit(0)),
                 out=out, segments=segments)


def row_number(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
               out: str = "rn", segments: int | None = None) -> DataFrame:
    """1-based position within the group; ``order_cols`` must be a total order."""
    return running_sum(df, group_cols, order_cols, F.lit(1).cast("long"), out, segments)


def forward_fill(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                 value: Column, out: str, segments: int | None = None) -> DataFrame:
    """``out`` = last non-null ``value`` at or before this row within the group."""
    okey = F.struct(*_cols(order_cols))
    return _scan(df, group_cols, order_cols, value,
                 local=lambda w: F.last("_v", ignorenulls=True).over(_upto(w)),
                 # max_by skips null keys: last non-null of the segment, NULL if none
                 summary=F.max_by("_v", F.when(F.col("_v").isNotNull(), okey)),
                 carry=lambda w: F.last("_sum", ignorenulls=True).over(_before(w)),
                 combine=lambda lo, ca: F.coalesce(lo, ca),
                 out=out, segments=segments)


def previous_value(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                   value: Column, out: str, segments: int | None = None) -> DataFrame:
    """``out`` = ``value`` of the row just before this one in the group (lag 1)."""
    okey = F.struct(*_cols(order_cols))
    # local: (is first row of the segment's run, lag within the run)
    return _scan(df, group_cols, order_cols, value,
                 local=lambda w: F.struct((F.row_number().over(w) == 1).alias("first"),
                                          F.lag("_v", 1).over(w).alias("lag")),
                 summary=F.max_by("_v", okey),
                 carry=lambda w: F.lag("_sum", 1).over(w),
                 combine=lambda lo, ca: F.when(lo["first"], ca).otherwise(lo["lag"]),
                 out=out, segments=segments)
