"""Equi-joins whose keys may be hot.

A key that holds a third of all rows would bring them into one task of a
shuffled join.  Of the keys with more than one row in ``share`` there are fewer
than ``share``: they are joined by broadcast, whatever the size of the table,
and all others by an ordinary join in which no key is large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1000


def join_by_weight(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, share: int = SHARE) -> DataFrame:
    """``rows`` inner-joined with ``table`` on ``keys`` (nulls are equal).

    ``table`` has one row a key, and ``weight`` says how many of ``rows`` have
    it.  Both are read twice: give tables that are stored.  The keys come out
    once; other columns of ``table`` must have names of their own.
    """
    named = table.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                         *[c for c in table.columns if c not in keys])
    size = table.agg(F.sum(weight)).first()[0] or 0
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    heavy = F.col(weight) * share > size
    hot = F.broadcast(named.where(heavy))  # fewer than ``share`` rows
    cold = rows.join(hot, on, "left_anti").join(named.where(~heavy), on)
    return rows.join(hot, on).unionByName(cold).drop(*[f"_k{i}" for i in range(len(keys))])
