"""Boolean cohort queries over long-form patient flags (PRJ8 - PRJ11, AGG1).

``flags(patient_id, field, is_true BOOLEAN, value STRING)``: one row per
set field of a record.  ``is_true`` is the JSON boolean ``true``; ``value``
keeps any other scalar as text.  AND terms test ``is_true``; OR groups test
truthiness (``is_true`` or a non-empty value), as the reference does.

Many cohorts are answered in one job: the criteria of all cohorts are a table
that is joined to the flags on the field (Spark chooses the join and splits a
hot field); what a criterion needs to know about the data comes out of the same
aggregate as the matches, so the flags are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import non_blank, ws_trim
from quire.plans.product import product


def truthy() -> Column:
    return F.coalesce(F.col("is_true"), F.lit(False)) | non_blank(F.col("value"))


def parse_cohort_text(queries: DataFrame, query_col: str = "query",
                      id_col: str = "cohort_id") -> DataFrame:
    """Criteria rows ``(cohort_id, clause_id, kind, field)`` from query text.

    ``A, (B OR C), D``: a comma separates AND terms, a parenthesised group
    of ``OR``-separated fields is one OR clause.  As in the reference the
    word ``OR`` splits anywhere inside the group, and OR groups are numbered
    before the AND terms.
    """
    q = ws_trim(F.col(query_col))
    base = queries.select(F.col(id_col).alias("cohort_id"), q.alias("_q"))
    blocks = F.regexp_extract_all(F.col("_q"), F.lit(r"\((.*?)\)"), 1)
    ors = (base.select("cohort_id", F.posexplode(blocks).alias("clause_id", "_block"))
           .select("cohort_id", "clause_id", F.lit("OR").alias("kind"),
                   F.explode(F.transform(F.split("_block", "OR"), ws_trim)).alias("field")))
    rest = F.regexp_replace(F.col("_q"), r"\((.*?)\)", "")
    and_fields = F.filter(F.transform(F.split(rest, ","), ws_trim), lambda x: x != "")
    ands = (base.select("cohort_id", F.size(blocks).alias("_k"),
                        F.posexplode(and_fields).alias("_p", "field"))
            .select("cohort_id", (F.col("_k") + F.col("_p")).alias("clause_id"),
                    F.lit("AND").alias("kind"), "field"))
    return ors.unionByName(ands)


def _in_template(criteria: DataFrame, template: DataFrame) -> DataFrame:
    t = template.select("field").distinct().withColumn("in_template", F.lit(True))
    return criteria.join(t, "field", "left").select(
        *criteria.columns, F.coalesce("in_template", F.lit(False)).alias("in_template"))


def validate_criteria(criteria: DataFrame, flags: DataFrame, template: DataFrame) -> DataFrame:
    """PRJ11: each criterion with ``in_template`` and ``in_data`` marks."""
    seen = (flags.select("field").distinct()
            .join(criteria.select("field").distinct(), "field", "left_semi")
            .withColumn("in_data", F.lit(True)))
    return (_in_template(criteria, template).join(seen, "field", "left")
            .select(*criteria.columns, "in_template", F.coalesce("in_data", F.lit(False)).alias("in_data"))
            .withColumn("valid", F.col("in_template") & F.col("in_data")))


def cohort_warnings(criteria: DataFrame, flags: DataFrame, template: DataFrame) -> DataFrame:
    """Messages for unknown fields and for clauses that void their cohort."""
    v = validate_criteria(criteria, flags, template)
    field_msgs = v.where(~F.col("valid")).select(
        "cohort_id", "clause_id", "field",
        F.when(~F.col("in_template"), F.lit("field is not in the template"))
        .otherwise(F.lit("field does not occur in the data")).alias("message"))
    void = (v.groupBy("cohort_id", "clause_id").agg(F.max("valid").alias("ok"))
            .where(~F.col("ok"))
            .select("cohort_id", "clause_id", F.lit(None).cast("string").alias("field"),
                    F.lit("no valid field in clause: cohort has no result").alias("message")))
    return field_msgs.unionByName(void)


def _matched(flags: DataFrame, criteria: DataFrame, hit: Column) -> DataFrame:
    """``(cohort_id, patient_id, marks)``: per patient, for each criterion whose
    field the record has, ``(clause_id, field, hit)``.  A record has at most as
    many marks as the cohort has criteria."""
    c = criteria.select("cohort_id", "clause_id", "kind", "field")
    mark = F.struct("clause_id", "field", hit.alias("hit"))
    return (flags.join(c, "field").groupBy("cohort_id", "patient_id")
            .agg(F.collect_set(mark).alias("marks")))


def _everybody(flags: DataFrame, cohorts: DataFrame | None, criteria: DataFrame) -> DataFrame | None:
    """All patients for each asked cohort that has no criterion at all."""
    if cohorts is None:
        return None
    empty = cohorts.select("cohort_id").distinct().join(criteria.select("cohort_id").distinct(), "cohort_id", "left_anti")
    people = flags.select("patient_id").distinct()
    return product(people, empty, "patient_id").select("cohort_id", "patient_id")


def cohort_members(flags: DataFrame, criteria: DataFrame, template: DataFrame,
                   cohorts: DataFrame | None = None) -> DataFrame:
    """PRJ10: ``(cohort_id, patient_id)`` for patients meeting every clause.

    A clause with no valid field voids its whole cohort (no rows).  A cohort of
    ``cohorts`` (column ``cohort_id``) without any criterion has all patients.
    """
    known = _in_template(criteria, template)
    hit = F.when(F.col("kind") == "AND", F.coalesce("is_true", F.lit(False))).otherwise(truthy())
    per = _matched(flags, known.where("in_template"), hit)
    # a clause is valid if any record has one of its fields
    seen = per.select("cohort_id", F.explode("marks.clause_id").alias("clause_id")).distinct()
    need = (known.select("cohort_id", "clause_id").distinct()
            .join(seen.withColumn("ok", F.lit(True)), ["cohort_id", "clause_id"], "left")
            .groupBy("cohort_id").agg(F.count(F.lit(1)).alias("n_clauses"), F.count("ok").alias("n_ok"))
            .where(F.col("n_ok") == F.col("n_clauses")))
    clauses = F.array_distinct(F.transform(F.filter("marks", lambda m: m["hit"]), lambda m: m["clause_id"]))
    found = (per.select("cohort_id", "patient_id", F.size(clauses).alias("n_hit")).where(F.col("n_hit") > 0)
             .join(need, "cohort_id").where(F.col("n_hit") == F.col("n_clauses"))
             .select("cohort_id", "patient_id"))
    rest = _everybody(flags, cohorts, criteria)
    return found if rest is None else found.unionByName(rest)


def cohort_intersection(flags: DataFrame, criteria: DataFrame, template: DataFrame) -> DataFrame:
    """PRJ9: all *valid* fields must be true; invalid ones are skipped.

    A cohort with no valid field at all has no result.
    """
    known = _in_template(criteria, template).where("in_template")
    per = _matched(flags, known, F.coalesce("is_true", F.lit(False)))
    need = (per.select("cohort_id", F.explode("marks.field").alias("field")).distinct()
            .groupBy("cohort_id").agg(F.count(F.lit(1)).alias("n_fields")))
    fields = F.array_distinct(F.transform(F.filter("marks", lambda m: m["hit"]), lambda m: m["field"]))
    return (per.select("cohort_id", "patient_id", F.size(fields).alias("n_hit")).where(F.col("n_hit") > 0)
            .join(need, "cohort_id").where(F.col("n_hit") == F.col("n_fields"))
            .select("cohort_id", "patient_id"))


def flag_counts(flags: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """PRJ8 + AGG1: patients per field whose value is exactly true; of the given
    ``fields`` also those that no record has, with 0."""
    # flags hold one row per (patient, field), so a conditional count is a
    # patient count (one exchange, no distinct expansion)
    counts = flags.groupBy("field").agg(
        F.count_if(F.coalesce(F.col("is_true"), F.lit(False))).alias("n_patients"))
    if fields is None:
        return counts
    return (fields.select("field").distinct().join(counts, "field", "left")
            .select("field", F.coalesce("n_patients", F.lit(0).cast("long")).alias("n_patients")))


def cohort_sizes(members: DataFrame) -> DataFrame:
    """AGG1 for cohorts: number of matching patients per cohort."""
    return members.groupBy("cohort_id").agg(F.count("*").alias("n_patients"))
