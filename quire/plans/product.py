"""Products with a configuration table, without a cross join.

A template, a list of groups or of quotas belongs to every record.  Records are
spread over salts by a hash of their id, every table row is copied once for each
salt, and both meet in an equi-join on the salt: no row holds the table, and
Spark chooses the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import shuffle_partitions


def product(rows: DataFrame, table: DataFrame, by: str) -> DataFrame:
    """Every row of ``rows`` with every row of ``table`` (none if that is empty).
    ``by`` is the column of ``rows`` whose hash spreads them; column names must
    differ."""
    salts = shuffle_partitions(rows.sparkSession)
    copies = table.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(copies, "_salt").drop("_salt")
