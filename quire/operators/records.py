"""Form records and section templates (PRJ1 - PRJ7, PRJ12, AGG12, WIN1, WIN2).

Long forms used throughout:

* ``fields(record_id, field, value, ord)``: one row per form field.
* ``template(section, section_pos, field, field_pos)``: ordered config.
* ``mapped(record_id, section, field, value, section_pos, field_pos)``.

Templates are tables like any other: they are joined, never collected, and
Spark chooses the join.  Records are never grouped into one task: every
per-record step is keyed by the record id, and hot keys only meet partial
aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.dates import age_at
from quire.functions.text import clean_cell, non_blank, ws_trim
from quire.plans import scan
from quire.plans.product import product

# PRJ1 -------------------------------------------------------------------------
def clean_form_fields(raw: DataFrame, id_col: str = "record_id") -> DataFrame:
    """Drop pairs with an empty name or value, strip the first and last
    character of both, keep the last value per (record, field) by ``ord``."""
    inner = lambda c: F.expr(f"substring({c}, 2, char_length({c}) - 2)")
    f = (raw.where(non_blank("field") & non_blank("value"))
         .select(id_col, inner("field").alias("field"), inner("value").alias("value"), "ord"))
    return f.groupBy(id_col, "field").agg(F.max_by("value", "ord").alias("value"),
                                          F.max("ord").alias("ord"))


# PRJ2 -------------------------------------------------------------------------
def project_template(fields: DataFrame, template: DataFrame,
                     id_col: str = "record_id") -> DataFrame:
    """Every template row for every record, value NULL when absent; fields
    outside the template are dropped; a field in two sections shows twice.

    ``fields`` holds one row per (record, field) (the output of
    :func:`clean_form_fields`); the values are looked up in a per-record map.
    """
    per = fields.groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_m"))
    t = template.select("section", F.col("section_pos").cast("int"), "field", F.col("field_pos").cast("int"))
    return (product(per, t, id_col)
            .select(id_col, "section", "field", F.try_element_at("_m", F.col("field")).alias("value"),
                    "section_pos", "field_pos"))


# PRJ3 -------------------------------------------------------------------------
def extract_sections(fields: DataFrame, template: DataFrame, sections: Sequence[str],
                     id_col: str = "record_id") -> DataFrame:
    """Template fields of the given sections that the record has, in
    template order (``section_pos``, ``field_pos``)."""
    t = template.where(F.col("section").isin(list(sections)))
    return (fields.join(t, "field")
            .select(id_col, "section", "field", "value", "section_pos", "field_pos"))


def empty_sections(fields: DataFrame, template: DataFrame, sections: Sequence[str],
                   id_col: str = "record_id") -> DataFrame:
    """``(record, section)``: requested sections of which a record has no field,
    unknown ones included (:func:`extract_sections` has no row for them)."""
    asked = F.explode(F.array(*[F.lit(s) for s in dict.fromkeys(sections)]).cast("array<string>")).alias("section")
    every = fields.select(id_col).distinct().select(id_col, asked)
    return every.join(extract_sections(fields, template, sections, id_col).select(id_col, "section").distinct(),
                      [id_col, "section"], "left_anti")


# PRJ4 -------------------------------------------------------------------------
def invert_template(template: DataFrame) -> DataFrame:
    """field -> section; a field listed in several sections keeps the last."""
    return template.groupBy("field").agg(
        F.max_by("section", F.struct("section_pos", "field_pos")).alias("section"))


# PRJ5 -------------------------------------------------------------------------
def flatten_records(mapped: DataFrame, id_col: str = "record_id", sep: str = "__") -> DataFrame:
    """Nested sections to ``section__field`` names (long form; pivot at the edge)."""
    return mapped.select(id_col, F.concat_ws(sep, "section", "field").alias("column"), "value")


# PRJ6 -------------------------------------------------------------------------
def flatten_sections(mapped: DataFrame, id_col: str = "record_id") -> DataFrame:
    """Merge the section dicts of a record (later section wins per field) and
    drop top-level scalars; a record with no section at all stays as is.

    Top-level scalars are rows whose ``section`` is NULL.
    """
    place = F.struct(F.coalesce("section_pos", F.lit(-1)), F.coalesce("field_pos", F.lit(-1)))
    inside = F.col("section").isNotNull()
    # one pass: of every field the value inside sections and outside, with the
    # record's own mark carried by a window over its aggregated fields
    per = mapped.groupBy(id_col, "field").agg(
        F.max_by(F.struct("value"), F.when(inside, place)).alias("_in"),
        F.max_by(F.struct("value"), F.when(~inside, place)).alias("_out"))
    nested = F.max(F.col("_in").isNotNull()).over(Window.partitionBy(id_col))
    return (per.withColumn("_nested", nested)
            .where(F.col("_in").isNotNull() | ~F.col("_nested"))
            .select(id_col, "field", F.when(F.col("_nested"), F.col("_in.value"))
                    .otherwise(F.col("_out.value")).alias("value")))


# PRJ7 -------------------------------------------------------------------------
def lookup_first(mapped: DataFrame, template: DataFrame, targets: Sequence[str],
                 id_col: str = "record_id") -> DataFrame:
    """For each target field: ``(record, field, section, value.strip())`` from
    the first section in template order where the record has a truthy
    value.  Field names compare stripped."""
    want = [t.strip() for t in targets]
    t = template.where(ws_trim("field").isin(want)).select("section", "field")
    m = (mapped.join(t, ["section", "field"], "left_semi")
         .where(non_blank("value")))
    best = m.groupBy(id_col, ws_trim("field").alias("field")).agg(
        F.min_by(F.struct("section", "value"), F.struct("section_pos", "field_pos")).alias("_b"))
    return best.select(id_col, "field", F.col("_b.section").alias("section"),
                       ws_trim(F.col("_b.value")).alias("value"))


# AGG12 ------------------------------------------------------------------------
def merge_sources(rows: DataFrame, order: Column | str, id_col: str = "record_id") -> DataFrame:
    """Per (record, section, field) the value of the latest source by ``order``."""
    o = F.col(order) if isinstance(order, str) else order
    return rows.groupBy(id_col, "section", "field").agg(F.max_by("value", o).alias("value"))


# PRJ12 ------------------------------------------------------------------------
def patient_header(fields: DataFrame, id_col: str = "record_id",
                   name_field: str = "Pt Name", birth_field: str = "Pt DOB",
                   date_field: str = "Form Date", examiners: Sequence[str] = (),
                   record_mask: str = "#########") -> DataFrame:
    """One header row per record: name, masked number, dates, age, examiners."""
    pick = lambda f: F.max_by(F.when(F.col("field") == f, F.col("value")),
                              F.when(F.col("field") == f, F.col("ord")))
    agg = fields.groupBy(id_col).agg(
        F.max(F.col("field") == name_field).alias("_has_name"),
        pick(name_field).alias("_name"), pick(birth_field).alias("_dob"),
        pick(date_field).alias("_eval"))
    return agg.select(
        id_col,
        F.when(F.col("_has_name"), F.col("_name")).otherwise(F.lit("Unknown")).alias("name"),
        F.lit(record_mask).alias("medical_record_no"),
        F.when(non_blank("_dob"), F.col("_dob")).otherwise(F.lit("N/A")).alias("date_of_birth"),
        F.when(non_blank("_eval"), F.col("_eval")).otherwise(F.lit("N/A")).alias("dates_of_service"),
        age_at("_dob", "_eval").alias("age_at_evaluation"),
        F.array(*[F.lit(e) for e in examiners]).cast("array<string>").alias("examiners"))


# WIN1 + WIN2 --------------------------------------------------------------------
def section_sheet(sheet: DataFrame, row_col: str = "row", variable: str = "Variable",
                  sub_variable: str = "Sub Variable", section: str = "Report Section",
                  sheet_col: str | None = None, default: str = "unclassified") -> DataFrame:
    """Field/section sheet -> ``(section, section_pos, item, item_pos)``.

    Rows without an item are dropped *before* the forward fill, so a
    heading-only row does not set the section; a blank section takes the
    last non-blank one above; comma lists explode; each item appears once
    per section in first-appearance order.
    """
    g = [sheet_col] if sheet_col else []
    s = sheet.select(*g, row_col, clean_cell(variable).alias("_var"),
                     clean_cell(sub_variable).alias("_sub"), clean_cell(section).alias("_sec"))
    item = F.when(non_blank("_sub"), F.col("_sub")).otherwise(F.col("_var"))
    s = s.withColumn("item", item).where(non_blank("item"))
    filled = scan.forward_fill(s, g, [row_col], F.when(non_blank("_sec"), F.col("_sec")), "_fill")
    secs = F.coalesce(F.col("_fill"), F.lit(default))
    ex = filled.select(*g, row_col, "item",
                       F.posexplode(F.transform(F.split(secs, ","), ws_trim)).alias("_p", "section"))
    return ordered_dedup(ex, [*g, "section"], "item", [row_col, "_p"], sheet_cols=g)


def ordered_dedup(rows: DataFrame, group_cols: Sequence[str], item_col: str,
                  order_cols: Sequence[str], sheet_cols: Sequence[str] = ()) -> DataFrame:
    """Each item once per group, numbered by first appearance; groups are
    numbered by their own first appearance within ``sheet_cols``."""
    group_cols = list(group_cols)
    first = F.min(F.struct(*order_cols))
    items = rows.groupBy(*group_cols, item_col).agg(first.alias("_first"))
    items = scan.row_number(items, group_cols, ["_first", item_col], "item_pos")
    groups = rows.groupBy(*group_cols).agg(first.alias("_gfirst"))
    groups = scan.row_number(groups, list(sheet_cols), ["_gfirst", *group_cols], "group_pos")
    return (scan.join_null_safe(items, groups.drop("_gfirst"), group_cols, "inner")
            .select(*group_cols, "group_pos", item_col, "item_pos"))
