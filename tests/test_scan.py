"""Skew-safe scans equal plain windows, also with one hot group."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.plans import scan
from quire.session import clear_shared


def data(spark):
    rnd = random.Random(1)
    rowsd = []
    for i in range(3000):
        g = 0 if i % 3 == 0 or i < 800 else rnd.randrange(1, 40)  # group 0 holds ~half the rows
        v = None if rnd.random() < 0.7 else f"v{i}"
        rowsd.append((g, i, v, rnd.randrange(10)))
    return spark.createDataFrame(rowsd, "g int, o int, v string, x int")


def test_scans_match_windows(spark):
    df = data(spark)
    w = Window.partitionBy("g").orderBy("o")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.select("g", "o", F.sum("x").over(upto).alias("s"), F.row_number().over(w).alias("rn"),
                     F.last("v", ignorenulls=True).over(upto).alias("ff"), F.lag("x").over(w).alias("prev"))
    got = scan.running_sum(df, ["g"], ["o"], F.col("x"), "s", segments=7)
    got = scan.row_number(got, ["g"], ["o"], "rn", segments=5)
    got = scan.forward_fill(got, ["g"], ["o"], F.col("v"), "ff", segments=6)
    got = scan.previous_value(got, ["g"], ["o"], F.col("x"), "prev", segments=9)
    cols = ["g", "o", "s", "rn", "ff", "prev"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = scan.row_number(df, [], ["k"], "rn", segments=4)
    assert all(r["rn"] == r["k"] + 1 for r in got.collect())


def test_null_and_hot_groups(spark):
    rows = [(None if i % 3 == 0 else "hot" if i % 3 == 1 else f"g{i % 7}", None if i % 11 == 0 else i % 5, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, h int, o int").withColumn("v", F.when(F.col("o") % 4 == 0, F.col("o")))
    for group in (["g"], ["g", "h"], ["h"]):
        w = Window.partitionBy(*group).orderBy("o")
        want = df.select("o", F.row_number().over(w).alias("rn"), F.last("v", True).over(w).alias("f"), F.lag("o").over(w).alias("p"))
        got = scan.row_number(df, group, ["o"], "rn", segments=4)
        got = scan.forward_fill(got, group, ["o"], F.col("v"), "f", segments=5)
        got = scan.previous_value(got, group, ["o"], F.col("o"), "p", segments=3).select("o", "rn", "f", "p")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, o int")
    assert scan.row_number(df, ["g"], ["o"], "rn", segments=4).count() == 0


def test_copies_are_deleted(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"))
    assert scan.row_number(df, ["g"], ["o"], "rn", segments=3).count() == 100
    assert clear_shared(spark) and not clear_shared(spark)
