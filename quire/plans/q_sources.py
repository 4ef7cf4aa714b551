"""Listing, routing, naming, ordering and date queries on pages, orders,
customers and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.dates import age_at
from quire.plans import scan
from quire.plans.catalog import register
from quire.session import read_table, spread
from quire.sources import files

HOST = r"^[a-z]+://([^/?#]+)"


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a file listing: host = folder, url = file name."""
    p = read_table(spark, sf_dir, "pages")
    return p.select(F.regexp_extract("url", HOST, 1).alias("folder"), F.col("url").alias("name"),
                    F.col("page_id").cast("string").alias("path"))


@register("first_per_folder", oracle=r"""
SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS folder, min(url) AS name
FROM pages WHERE lower(url) LIKE '%.html' GROUP BY 1
""")
def first_per_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, _missing = files.first_per_folder(page_files(spark, sf_dir), ".html")
    return first.select("folder", "name")


@register("missing_folders", oracle=r"""
SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS folder FROM pages
EXCEPT
SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) FROM pages WHERE lower(url) LIKE '%.html'
""")
def missing_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    _first, missing = files.first_per_folder(page_files(spark, sf_dir), ".html")
    return missing


TAGS = ["/fr/", "/en/", "blog."]


@register("route_by_name", oracle="""
SELECT page_id, CASE WHEN contains(lower(url), '/fr/') THEN '/fr/' WHEN contains(lower(url), '/en/') THEN '/en/'
                     WHEN contains(lower(url), 'blog.') THEN 'blog.' END AS route
FROM pages
""")
def route_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", files.source_type("url", TAGS).alias("route"))


ENTITY = r"^https?://blog\.([a-z]+)\."


@register("route_entity", oracle=r"""
SELECT page_id, CASE WHEN regexp_matches(url, '^https?://blog\.([a-z]+)\.')
                     THEN regexp_extract(url, '^https?://blog\.([a-z]+)\.', 1) END AS entity
FROM pages
""")
def route_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("name"))
    return files.route_entity(p, "name", ENTITY).select("page_id", "entity")


@register("file_names", oracle=r"""
SELECT page_id,
       CASE WHEN regexp_matches(b, '[^.]\.[^./]*$') THEN regexp_replace(b, '([^.])\.[^./]*$', '\1') ELSE b END AS stem,
       array_to_string(string_split(url, '-')[1:2], '-') AS short_title
FROM (SELECT page_id, url, regexp_extract(url, '[^/]*$') AS b FROM pages)
""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", T.file_stem("url").alias("stem"), T.short_title("url").alias("short_title"))


@register("top_k_preview", oracle="""
SELECT o_custkey, o_orderkey, rn AS rank FROM (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
  FROM orders) WHERE rn <= 3
""")
def top_k_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT3: first three orders per customer (the limit is the feature)."""
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    # a plain window: Spark keeps three rows per customer and task before it shuffles
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return (o.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= 3)
            .select("o_custkey", "o_orderkey", "rank"))


@register("sorted_listing", oracle="""
SELECT c_name AS name, row_number() OVER (ORDER BY c_name) AS pos FROM customer
""")
def sorted_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT2: names in text order (``P10`` before ``P2``), numbered."""
    c = read_table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    return scan.row_number(c, [], ["name"], "pos")


@register("age_at", oracle="""
WITH d AS (
  SELECT o.o_orderdate AS b, l.l_shipdate AS e FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
a AS (SELECT b, e, year(e) - year(b) AS y0, month(e) - month(b) - CASE WHEN day(e) < day(b) THEN 1 ELSE 0 END AS m0 FROM d)
SELECT CAST(y0 - CASE WHEN m0 < 0 THEN 1 ELSE 0 END AS VARCHAR) || '-years, '
       || CAST(CASE WHEN m0 < 0 THEN m0 + 12 ELSE m0 END AS VARCHAR) || '-months' AS age,
       count(*) AS n
FROM a GROUP BY 1
""")
def age_at_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL19: order date as birth, ship date as evaluation, as text dates."""
    li, o = spread(read_table(spark, sf_dir, "lineitem"), "l_orderkey"), read_table(spark, sf_dir, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    fmt = lambda c: F.date_format(c, "MM/dd/yyyy")
    return j.select(age_at(fmt("o_orderdate"), fmt("l_shipdate")).alias("age")) \
        .groupBy("age").agg(F.count("*").alias("n"))
