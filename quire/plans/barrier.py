"""Compute expensive columns once, even when later filtered on.

Catalyst pushes a filter below the projection that computes the filtered
column and substitutes the column's expression into the filter, so a costly
text expression would be evaluated twice (once in the filter, once in the
projection).  Computing the columns inside a one-element ``inline``
generator stops that: a filter on a generator's output stays above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` plus ``cols``, each evaluated once per row."""
    one = F.array(F.struct(*[c.alias(name) for name, c in cols.items()]))
    return df.select("*", F.inline(one))
