"""Generator queries: customers are the population, lineitem rows a large
config sheet, order priorities and segments the recorded flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import synth
from quire.plans.catalog import register
from quire.session import read_table

SEED = "s1"

# Quota config per 100 patients and exclusive groups for the customers.
QUOTA_CONFIG = [
    ("AUTOMOBILE", "count", 30, None), ("BUILDING", "count", 25, None),
    ("LOW", "count", 50, None), ("MID", "count", 40, None), ("HIGH", "count", 30, None),
    ("Flag A", "count", 10, None), ("Flag B", "count", 3, None), ("Flag C", "count", 0, None),
    ("Age", "range", None, "6 - 18"), ("Score", "range", None, "40-60"),
]
GROUPS = [
    (1, "AUTOMOBILE", 0), (1, "BUILDING", 1), (1, "Unknown segment", 2),
    (2, "LOW", 0), (2, "MID", 1), (2, "HIGH", 2),
]


def _config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUOTA_CONFIG, "field string, kind string, count long, range_text string")


def _groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GROUPS, "group_id int, field string, pos int")


def _patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("patient_id"))


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _patients(spark, sf_dir).count()
    return synth.scale_config(_config(spark), n)


RANK_SQL = """
p AS (SELECT c_custkey AS patient_id FROM customer),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM p),
q AS (SELECT
  round_even(30 / 100.0 * n, 0) AS a1, round_even(25 / 100.0 * n, 0) AS a2,
  round_even(50 / 100.0 * n, 0) AS b1, round_even(40 / 100.0 * n, 0) AS b2,
  round_even(30 / 100.0 * n, 0) AS b3, n FROM n),
r AS (SELECT patient_id, g AS group_id,
        row_number() OVER (PARTITION BY g ORDER BY md5(CAST(patient_id AS VARCHAR) || '|' || CAST(g AS VARCHAR) || '|s1'),
                           patient_id) AS rn
      FROM p, (SELECT unnest([1, 2]) AS g))"""


@register("quota_assign", oracle=f"""
WITH {RANK_SQL}
SELECT patient_id, group_id,
  CASE WHEN group_id = 1 THEN
         CASE WHEN rn <= a1 THEN 'AUTOMOBILE' WHEN rn <= a1 + a2 THEN 'BUILDING' ELSE 'Unknown segment' END
       ELSE CASE WHEN rn <= b1 THEN 'LOW' WHEN rn <= b1 + b2 THEN 'MID'
                 WHEN rn <= b1 + b2 + b3 THEN 'HIGH' END END AS field
FROM r, q
WHERE group_id = 1 OR rn <= b1 + b2 + b3
""")
def quota_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.assign_exclusive(_patients(spark, sf_dir), _scaled(spark, sf_dir), _groups(spark),
                                  seed=SEED)


@register("random_k", oracle="""
WITH p AS (SELECT c_custkey AS patient_id FROM customer),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM p),
k AS (SELECT * FROM (VALUES ('Flag A', 10), ('Flag B', 3)) AS t(field, c)),
r AS (SELECT patient_id, field, round_even(c / 100.0 * n, 0) AS k,
             row_number() OVER (PARTITION BY field ORDER BY md5(CAST(patient_id AS VARCHAR) || '|' || field || '|s1'),
                                patient_id) AS rn
      FROM p, k, n)
SELECT patient_id, field FROM r WHERE rn <= k
""")
def random_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = synth.assign_remaining(_patients(spark, sf_dir), _scaled(spark, sf_dir), _groups(spark),
                               seed=SEED)
    return f.where(F.col("is_true")).select("patient_id", "field")


@register("random_range", oracle="""
WITH p AS (SELECT c_custkey AS patient_id FROM customer),
k AS (SELECT * FROM (VALUES ('Age', 6, 18), ('Score', 40, 60)) AS t(field, lo, hi))
SELECT patient_id, field,
       CAST(lo + (CAST('0x' || substr(md5(CAST(patient_id AS VARCHAR) || '|' || field || '|s1'), 1, 8) AS BIGINT)
                  % (hi - lo + 1)) AS VARCHAR) AS value
FROM p, k
""")
def random_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = synth.assign_remaining(_patients(spark, sf_dir), _scaled(spark, sf_dir), _groups(spark),
                               seed=SEED)
    return f.where(F.col("value").isNotNull()).select("patient_id", "field", "value")


CONFIG_ROWS_SQL = r"""rows AS (
  SELECT {'o': l_orderkey, 'l': l_linenumber, 'p': l_partkey, 's': l_suppkey, 'e': l_extendedprice} AS pos,
         CASE WHEN l_linestatus = 'F' THEN 'F' || l_returnflag ELSE 'V' || l_returnflag END AS field,
         CASE l_linenumber
           WHEN 5 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' - ' || CAST(CAST(l_quantity AS BIGINT) + 10 AS VARCHAR)
           WHEN 6 THEN 'few' WHEN 7 THEN ''
           ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS cnt
  FROM lineitem),
d AS (
  SELECT field, 'count' AS kind,
         CAST(sum(CASE WHEN cnt = '' THEN 0 WHEN cnt = 'few' THEN 1 ELSE CAST(cnt AS BIGINT) END) AS BIGINT) AS count,
         CAST(NULL AS VARCHAR) AS range_text, min(pos) AS first_pos
  FROM rows WHERE NOT regexp_matches(cnt, '^\d+\s*-\s*\d+') GROUP BY field
  UNION ALL
  SELECT field, 'range', CAST(NULL AS BIGINT), arg_max(cnt, pos), min(pos)
  FROM rows WHERE regexp_matches(cnt, '^\d+\s*-\s*\d+') GROUP BY field)"""


def lineitem_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem rows as a config sheet: variable V<flag>, value name F<flag>
    for status F, counts numeric, a range on line 5, text on line 6, empty
    on line 7; a quoted variable name is unquoted by the clean-up."""
    li = read_table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("long")
    cnt = (F.when(F.col("l_linenumber") == 5,
                  F.concat(q.cast("string"), F.lit(" - "), (q + 10).cast("string")))
           .when(F.col("l_linenumber") == 6, F.lit("few"))
           .when(F.col("l_linenumber") == 7, F.lit(""))
           .otherwise(q.cast("string")))
    # the sheet position is the lineitem key (a total order, no numbering pass)
    sheet = li.select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"),
        F.concat(F.lit('"V'), F.col("l_returnflag"), F.lit('"')).alias("Variable"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("F"), F.col("l_returnflag")))
        .otherwise(F.lit("")).alias("n"),
        cnt.alias("count"))
    return synth.clean_config(sheet)


@register("config_dedup", oracle=f"""
WITH {CONFIG_ROWS_SQL}
SELECT field, kind, count, range_text,
       row_number() OVER (ORDER BY CASE kind WHEN 'count' THEN 0 ELSE 1 END, first_pos, field) AS out_pos
FROM d
""")
def config_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.dedup_config(lineitem_config(spark, sf_dir)).drop("first_pos")


@register("config_rescale", oracle=f"""
WITH {CONFIG_ROWS_SQL}
SELECT field, kind,
       CASE WHEN kind = 'count' THEN CAST(round_even(CAST(count AS DOUBLE) / 100.0 * 1000.0, 0) AS BIGINT) END AS count,
       range_text,
       CAST(regexp_extract(range_text, '(\\d+)', 1) AS INT) AS lo,
       CAST(regexp_extract(range_text, '\\d+\\D+(\\d+)', 1) AS INT) AS hi
FROM d
""")
def config_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.functions.text import range_bounds
    s = synth.scale_config(synth.dedup_config(lineitem_config(spark, sf_dir)), 1000)
    lo, hi = range_bounds("range_text")
    return s.select("field", "kind", "count", "range_text", lo.alias("lo"), hi.alias("hi"))


def recorded_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' recorded fields: each order priority seen (true), the
    market segment (true), and the balance as text."""
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    pri = o.select(F.col("o_custkey").alias("patient_id"), F.col("o_orderpriority").alias("field")) \
        .distinct().select("patient_id", "field", F.lit(True).alias("is_true"),
                           F.lit(None).cast("string").alias("value"))
    seg = c.select(F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("field"),
                   F.lit(True).alias("is_true"), F.lit(None).cast("string").alias("value"))
    bal = c.select(F.col("c_custkey").alias("patient_id"), F.lit("Balance").alias("field"),
                   F.lit(None).cast("boolean").alias("is_true"),
                   F.col("c_acctbal").cast("long").cast("string").alias("value"))
    return pri.unionByName(seg).unionByName(bal)


VALIDATE_GROUPS = [
    (1, "1-URGENT", 0), (1, "2-HIGH", 1), (1, "3-MEDIUM", 2), (1, "4-NOT SPECIFIED", 3), (1, "5-LOW", 4),
    (2, "AUTOMOBILE", 0), (2, "BUILDING", 1), (2, "FURNITURE", 2), (2, "HOUSEHOLD", 3), (2, "MACHINERY", 4),
]
VALIDATE_CONFIG = [
    ("1-URGENT", "count", 1000, None), ("AUTOMOBILE", "count", 300, None),
    ("Balance", "range", None, "0 - 5000"), ("Missing", "count", 5, None),
]


@register("validate_counts", oracle="""
WITH cfg AS (SELECT * FROM (VALUES ('1-URGENT', 'count', 1000, NULL), ('AUTOMOBILE', 'count', 300, NULL),
                                   ('Balance', 'range', NULL, '0 - 5000'), ('Missing', 'count', 5, NULL))
             AS t(field, kind, expected, range_text)),
a AS (
  SELECT '1-URGENT' AS field, count(DISTINCT o_custkey) AS actual FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT 'AUTOMOBILE', count(*) FROM customer WHERE c_mktsegment = 'AUTOMOBILE'
  UNION ALL SELECT 'Balance', count(*) FROM customer
            WHERE CAST(c_acctbal AS BIGINT) BETWEEN 0 AND 5000)
SELECT cfg.field, cfg.kind, CAST(cfg.expected AS BIGINT) AS expected, cfg.range_text,
       coalesce(a.actual, 0) AS actual,
       CASE WHEN cfg.kind = 'count' THEN coalesce(a.actual, 0) = cfg.expected END AS passed,
       (SELECT count(*) FROM customer) AS total
FROM cfg LEFT JOIN a ON a.field = cfg.field
""")
def validate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = spark.createDataFrame(VALIDATE_CONFIG, "field string, kind string, count long, range_text string")
    return synth.validate_counts(recorded_flags(spark, sf_dir), cfg, patients=_patients(spark, sf_dir))


@register("violations", oracle="""
WITH g AS (SELECT * FROM (VALUES ('1-URGENT', 0), ('2-HIGH', 1), ('3-MEDIUM', 2), ('4-NOT SPECIFIED', 3),
                                 ('5-LOW', 4)) AS t(field, pos)),
f AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)
SELECT o_custkey AS patient_id, 1 AS group_id, count(*) AS n_true,
       string_agg(o_orderpriority, ', ' ORDER BY pos) AS fields
FROM f JOIN g ON g.field = f.o_orderpriority GROUP BY o_custkey HAVING count(*) > 1
""")
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = spark.createDataFrame(VALIDATE_GROUPS, "group_id int, field string, pos int")
    return synth.violations(recorded_flags(spark, sf_dir), g)


@register("coverage_gaps", oracle="""
SELECT c_custkey AS patient_id, 1 AS group_id FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
UNION ALL
SELECT c_custkey, 2 FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING')
""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = spark.createDataFrame([(1, "1-URGENT", 0), (2, "AUTOMOBILE", 0), (2, "BUILDING", 1)],
                              "group_id int, field string, pos int")
    return synth.coverage_gaps(_patients(spark, sf_dir), recorded_flags(spark, sf_dir), g)


@register("remainder_fields", oracle="""
SELECT n_name AS field FROM nation JOIN region ON n_regionkey = r_regionkey
WHERE r_name NOT IN ('ASIA', 'EUROPE')
""")
def remainder_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET2: nations (config fields) outside the chosen regions (groups)."""
    n, r = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    nr = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    cfg = nr.select(F.col("n_name").alias("field"))
    groups = nr.where(F.col("r_name").isin("ASIA", "EUROPE")).select(
        F.col("r_regionkey").alias("group_id"), F.col("n_name").alias("field"))
    return synth.remaining_config(cfg, groups)


@register("union_columns", oracle="""
SELECT c_custkey AS key, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier
""")
def union_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET1: records with different key sets united by name, missing as NULL."""
    c = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    s = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return c.unionByName(s, allowMissingColumns=True)


@register("violation_preview", oracle="""
WITH g AS (SELECT * FROM (VALUES ('1-URGENT', 0), ('2-HIGH', 1), ('3-MEDIUM', 2), ('4-NOT SPECIFIED', 3),
                                 ('5-LOW', 4)) AS t(field, pos)),
f AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)
SELECT o_custkey AS patient_id, 1 AS group_id, count(*) AS n_true,
       string_agg(o_orderpriority, ', ' ORDER BY pos) AS fields
FROM f JOIN g ON g.field = f.o_orderpriority GROUP BY o_custkey HAVING count(*) > 1
ORDER BY patient_id LIMIT 5
""")
def violation_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT3: the first five violations (the limit is the feature)."""
    return synth.violation_preview(violations(spark, sf_dir))
