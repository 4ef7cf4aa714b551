"""Sheets with quoted line breaks, read from splits in parallel (SRC15).

Whether a line break ends a row depends on all quotes before it.  A split can't
know them, but what it does to the state is known: it flips "inside quotes" or
not, and it starts so many rows in either case.  So every split counts both, a
running composition over the splits (one row each) gives the state in which each
begins, and its lines then know their row.  Only rows of several lines are
gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import shared_table

_SCHEMA = ("file string, block long, n long, line string, quotes int, odd int, rows0 long, rows1 long")


def _marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines with their number in the split, the parity of the quotes before them,
    and the rows that start in the split up to them, for both states before it."""
    split, n, odd, rows = None, 0, 0, [0, 0]
    for batch in batches:
        for key, part in batch.groupby(["file", "block"], sort=False):
            if key != split:
                split, n, odd, rows = key, 0, 0, [0, 0]
            quotes = part["quotes"].to_numpy()
            flips = np.cumsum(quotes) % 2
            before = (np.concatenate([[0], flips[:-1]]) + odd) % 2
            counts = [rows[0] + np.cumsum(before == 0), rows[1] + np.cumsum(before == 1)]
            yield part.assign(n=np.arange(n, n + len(part)), odd=before.astype(np.int32), rows0=counts[0], rows1=counts[1])[
                ["file", "block", "n", "line", "quotes", "odd", "rows0", "rows1"]]
            n, odd, rows = n + len(part), (odd + int(flips[-1])) % 2, [int(counts[0][-1]), int(counts[1][-1])]


def sheet_records(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, line)``: the rows of a CSV sheet, from 0, blank ones included; a
    row's ``line`` may hold line breaks inside quotes.

    ``path`` is a file or a folder whose files, in the order of their names, are
    one sheet.  Quotes inside a cell are doubled, and cells with quotes are
    quoted, as CSV asks; a quote that is never closed takes all that follows.
    Lines end with a line feed, which a carriage return may precede.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"))
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    lines = shared_table(raw.withColumn("quotes", (quotes % 2).cast("int")).mapInPandas(_marked, _SCHEMA))

    in_order = Window.orderBy("file", "block")  # one row for each split
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "block").agg(
        F.max("rows0").alias("r0"), F.max("rows1").alias("r1"), (F.sum("quotes") % 2).alias("flip"))
    entered = splits.withColumn("inside", F.coalesce(F.sum("flip").over(before), F.lit(0)) % 2)
    own = F.when(F.col("inside") == 0, F.col("r0")).otherwise(F.col("r1"))
    entered = entered.withColumn("offset", F.coalesce(F.sum(own).over(before), F.lit(0))).select("file", "block", "inside", "offset")

    known = lines.join(entered, ["file", "block"])
    inside = F.col("odd").bitwiseXOR(F.col("inside").cast("int"))
    row = F.col("offset") + F.when(F.col("inside") == 0, F.col("rows0")).otherwise(F.col("rows1")) - 1
    known = known.select("file", "block", "n", "line", row.alias("pos"), (inside == 0).alias("starts"),
                         (inside.bitwiseXOR(F.col("quotes")) == 0).alias("ends"))
    whole = known.where("starts AND ends").select("pos", "line")
    pieces = known.where("NOT (starts AND ends)").groupBy("pos").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("file", "block", "n", "line"))), lambda x: x["line"]), "\n").alias("line"))
    return whole.unionByName(pieces).select("pos", F.regexp_replace("line", "\r$", "").alias("line"))
