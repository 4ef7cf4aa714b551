"""Cohort queries on the driver tables: customers as patients, order
priorities as their flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import cohort
from quire.plans.catalog import register
from quire.session import read_table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
# A template field that never occurs in the data.
UNSEEN = "9-UNSEEN"


def priority_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``flags`` long form: one row per (customer, priority) seen in orders."""
    o = read_table(spark, sf_dir, "orders")
    return (o.select(F.col("o_custkey").alias("patient_id"),
                     F.col("o_orderpriority").alias("field"))
            .distinct()
            .withColumn("is_true", F.lit(True))
            .withColumn("value", F.lit(None).cast("string")))


def priority_template(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f,) for f in PRIORITIES + [UNSEEN]], "field string")


def _queries(spark: SparkSession, rows: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "cohort_id int, query string")


@register("cohort_and_or", headline=True, oracle="""
SELECT o_custkey AS patient_id FROM orders GROUP BY o_custkey
HAVING bool_or(o_orderpriority = '1-URGENT')
   AND bool_or(o_orderpriority IN ('2-HIGH', '5-LOW'))
""")
def cohort_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    crit = cohort.parse_cohort_text(_queries(spark, [(1, "1-URGENT, (2-HIGH OR 5-LOW)")]))
    m = cohort.cohort_members(priority_flags(spark, sf_dir), crit, priority_template(spark))
    return m.select("patient_id")


COHORTS = [
    (1, "1-URGENT, (2-HIGH OR 5-LOW)"),
    (2, "3-MEDIUM, 4-NOT SPECIFIED, (1-URGENT OR Z-BOGUS)"),
    (3, "2-HIGH, (Z-BOGUS OR 9-UNSEEN)"),
    (4, "(5-LOW OR 2-HIGH), (3-MEDIUM OR 1-URGENT), 4-NOT SPECIFIED"),
]


@register("cohort_many", oracle="""
SELECT 1 AS cohort_id, o_custkey AS patient_id FROM orders GROUP BY o_custkey
HAVING bool_or(o_orderpriority = '1-URGENT') AND bool_or(o_orderpriority IN ('2-HIGH', '5-LOW'))
UNION ALL
SELECT 2, o_custkey FROM orders GROUP BY o_custkey
HAVING bool_or(o_orderpriority = '3-MEDIUM') AND bool_or(o_orderpriority = '4-NOT SPECIFIED')
   AND bool_or(o_orderpriority = '1-URGENT')
UNION ALL
SELECT 4, o_custkey FROM orders GROUP BY o_custkey
HAVING bool_or(o_orderpriority IN ('5-LOW', '2-HIGH')) AND bool_or(o_orderpriority IN ('3-MEDIUM', '1-URGENT'))
   AND bool_or(o_orderpriority = '4-NOT SPECIFIED')
""")
def cohort_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    crit = cohort.parse_cohort_text(_queries(spark, COHORTS))
    return cohort.cohort_members(priority_flags(spark, sf_dir), crit, priority_template(spark))


@register("cohort_sizes", oracle="""
SELECT cohort_id, count(*) AS n_patients FROM (
  SELECT 1 AS cohort_id FROM orders GROUP BY o_custkey
  HAVING bool_or(o_orderpriority = '1-URGENT') AND bool_or(o_orderpriority IN ('2-HIGH', '5-LOW'))
  UNION ALL
  SELECT 2 FROM orders GROUP BY o_custkey
  HAVING bool_or(o_orderpriority = '3-MEDIUM') AND bool_or(o_orderpriority = '4-NOT SPECIFIED')
     AND bool_or(o_orderpriority = '1-URGENT')
  UNION ALL
  SELECT 4 FROM orders GROUP BY o_custkey
  HAVING bool_or(o_orderpriority IN ('5-LOW', '2-HIGH')) AND bool_or(o_orderpriority IN ('3-MEDIUM', '1-URGENT'))
     AND bool_or(o_orderpriority = '4-NOT SPECIFIED')
) GROUP BY cohort_id
""")
def cohort_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.cohort_sizes(cohort_many(spark, sf_dir))


@register("cohort_warnings", oracle="""
WITH c AS (SELECT * FROM (VALUES
  (1, 1, '1-URGENT'), (1, 0, '2-HIGH'), (1, 0, '5-LOW'),
  (2, 1, '3-MEDIUM'), (2, 2, '4-NOT SPECIFIED'), (2, 0, '1-URGENT'), (2, 0, 'Z-BOGUS'),
  (3, 1, '2-HIGH'), (3, 0, 'Z-BOGUS'), (3, 0, '9-UNSEEN'),
  (4, 0, '5-LOW'), (4, 0, '2-HIGH'), (4, 1, '3-MEDIUM'), (4, 1, '1-URGENT'), (4, 2, '4-NOT SPECIFIED'))
  AS t(cohort_id, clause_id, field)),
v AS (SELECT *, field <> 'Z-BOGUS' AS known,
             field IN (SELECT o_orderpriority FROM orders) AS seen FROM c)
SELECT cohort_id, clause_id, field,
       CASE WHEN NOT known THEN 'field is not in the template' ELSE 'field does not occur in the data' END AS message
FROM v WHERE NOT (known AND seen)
UNION ALL
SELECT cohort_id, clause_id, NULL, 'no valid field in clause: cohort has no result'
FROM v GROUP BY cohort_id, clause_id HAVING NOT bool_or(known AND seen)
""")
def cohort_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    crit = cohort.parse_cohort_text(_queries(spark, COHORTS))
    return cohort.cohort_warnings(crit, priority_flags(spark, sf_dir), priority_template(spark))


@register("flag_counts", oracle="""
SELECT f.field, count(DISTINCT o_custkey) AS n_patients
FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('9-UNSEEN')) AS f(field)
LEFT JOIN orders ON o_orderpriority = f.field GROUP BY f.field
""")
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.flag_counts(priority_flags(spark, sf_dir), priority_template(spark))


@register("flag_intersection", oracle="""
SELECT 1 AS cohort_id, o_custkey AS patient_id FROM orders GROUP BY o_custkey
HAVING bool_or(o_orderpriority = '1-URGENT') AND bool_or(o_orderpriority = '2-HIGH')
""")
def flag_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Z-BOGUS is not in the template and is skipped, as in the reference.
    crit = cohort.parse_cohort_text(_queries(spark, [(1, "1-URGENT, 2-HIGH, Z-BOGUS")]))
    return cohort.cohort_intersection(priority_flags(spark, sf_dir), crit, priority_template(spark))


@register("cohort_everybody", oracle="""
SELECT 1 AS cohort_id, o_custkey AS patient_id FROM orders GROUP BY o_custkey HAVING bool_or(o_orderpriority = '1-URGENT')
UNION ALL
SELECT 2, o_custkey FROM orders GROUP BY o_custkey
""")
def cohort_everybody(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cohort whose query is empty has all patients."""
    asked = _queries(spark, [(1, "1-URGENT"), (2, "  ")])
    return cohort.cohort_members(priority_flags(spark, sf_dir), cohort.parse_cohort_text(asked),
                                 priority_template(spark), asked)
