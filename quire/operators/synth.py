"""Synthetic population: config clean-up, quotas, generation and validation
(PRJ16, AGG8, SCL23, SCL24, JN3, SCL29, SCL30, JN7, AGG9 - AGG11, SET2).

Configuration (quota rows, exclusive groups) and population are DataFrames of
any size; configuration meets the population in joins that Spark chooses.
Randomness is a seeded md5 hash, so results are reproducible and the same in
every engine.  Ranks inside a group that holds every patient come from a
histogram of the hashes, never from a sort of all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import as_int, is_range, range_bounds, rescale, seeded_int, ws_trim
from quire.plans import scan
from quire.plans.product import product
from quire.plans.select import by_rank
from quire.sources.named import entity_files

# Fixed values of the reference --------------------------------------------------
FALLBACK_MARK = "Unknown"  # an exclusive group's shortfall goes to the field containing it
CONFIG_TOTAL = 100  # config counts are per 100 patients
VIOLATION_PREVIEW = 5
# ---------------------------------------------------------------------------------


def _key(*parts: Column | str, seed: str) -> Column:
    return F.md5(F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string")
                                    for p in parts], F.lit(seed)))


# PRJ16 --------------------------------------------------------------------------------
def clean_config(sheet: DataFrame, pos_col: str = "pos", variable: str = "Variable",
                 value: str = "n", count: str = "count") -> DataFrame:
    """Config sheet rows -> ``(pos, field, kind, count, text)``.

    Names are stripped and unquoted; rows with neither name are skipped;
    the field is the value name if present, else the variable.  A missing
    count is 0, a numeric one is truncated to int, anything else is kept as
    stripped text (``kind`` = ``int`` or ``text``).
    """
    unq = lambda c: F.btrim(ws_trim(F.coalesce(F.col(c).cast("string"), F.lit(""))),
                            F.lit('"'))
    s = sheet.select(pos_col, unq(variable).alias("_var"), unq(value).alias("_val"),
                     ws_trim(F.col(count).cast("string")).alias("_cnt"))
    s = s.where((F.col("_var") != "") | (F.col("_val") != ""))
    num = F.col("_cnt").try_cast("double")
    missing = F.col("_cnt").isNull() | (F.col("_cnt") == "")
    return s.select(
        pos_col,
        F.when(F.col("_val") != "", F.col("_val")).otherwise(F.col("_var")).alias("field"),
        F.when(missing | num.isNotNull(), F.lit("int")).otherwise(F.lit("text")).alias("kind"),
        F.when(missing, F.lit(0)).when(num.isNotNull(), num.cast("long")).alias("count"),
        F.when(~missing & num.isNull(), F.col("_cnt")).alias("text"))


# AGG8 ---------------------------------------------------------------------------------
def dedup_config(rows: DataFrame, pos_col: str = "pos") -> DataFrame:
    """``(field, kind, count, range_text, first_pos, out_pos)``.

    Int counts of a field are summed; a ``lo-hi`` text keeps the last one;
    any other text adds 1.  Counted fields come first, then ranges, each in
    first-appearance order; a field with both forms gives two rows.
    """
    rng = (F.col("kind") == "text") & is_range("text")
    # one aggregation for both forms (a field with both gives two groups),
    # so the config rows are read once
    agg = rows.withColumn("_rng", rng).groupBy("field", "_rng").agg(
        F.sum(F.when(F.col("kind") == "int", F.col("count")).otherwise(F.lit(1))).alias("_sum"),
        F.max_by("text", pos_col).alias("_last"),
        F.min(pos_col).alias("first_pos"))
    both = agg.select(
        "field", F.when(F.col("_rng"), F.lit("range")).otherwise(F.lit("count")).alias("kind"),
        F.when(~F.col("_rng"), F.col("_sum")).cast("long").alias("count"),
        F.when(F.col("_rng"), F.col("_last")).alias("range_text"),
        "first_pos", F.col("_rng").cast("int").alias("_kord"))
    return scan.row_number(both, [], ["_kord", "first_pos", "field"], "out_pos").drop("_kord")


# SCL23 --------------------------------------------------------------------------------
def scale_config(config: DataFrame, total: int | Column, config_total: int = CONFIG_TOTAL) -> DataFrame:
    """Counts per ``config_total`` rescaled to ``total`` patients, rounded half
    to even; ranges unchanged."""
    t = total if isinstance(total, Column) else F.lit(total)
    return config.withColumn(
        "count", F.when(F.col("kind") == "count", rescale("count", F.lit(config_total), t))
        .otherwise(F.col("count")))


# JN3 ----------------------------------------------------------------------------------
def quota_bounds(config: DataFrame, groups: DataFrame, n_patients: int) -> DataFrame:
    """``(group_id, field, above, upto)``: the ranks ``above < rank <= upto`` of a
    group get the field.

    A field's quota is its configured count, 0 without one.  What a group's
    quotas leave of the patients goes to its first field that holds
    ``FALLBACK_MARK``, else to its last.
    """
    quota = config.where(F.col("kind") == "count").select("field", F.col("count").alias("quota"))
    rows = groups.select("group_id", "field", "pos").join(quota, "field", "left").fillna(0, ["quota"])
    marked = F.min(F.when(F.col("field").contains(FALLBACK_MARK), F.col("pos")))
    per_group = rows.groupBy("group_id").agg(
        F.greatest(F.lit(n_patients) - F.sum("quota"), F.lit(0)).alias("short"),
        F.coalesce(marked, F.max("pos")).alias("fallback"))
    filled = rows.join(per_group, "group_id").withColumn(
        "quota", F.col("quota") + F.when(F.col("pos") == F.col("fallback"), F.col("short")).otherwise(0))
    upto = F.sum("quota").over(Window.partitionBy("group_id").orderBy("pos"))
    return filled.withColumn("upto", upto).select(
        "group_id", "field", (F.col("upto") - F.col("quota")).alias("above"), "upto")


def assign_exclusive(patients: DataFrame, config: DataFrame, groups: DataFrame,
                     id_col: str = "patient_id", seed: str = "0") -> DataFrame:
    """For each exclusive group: order patients by a seeded hash, give the
    first n1 the first field, the next n2 the second, and so on (see
    :func:`quota_bounds`); an overshoot is cut, so that late fields lose.
    ``(patient_id, group_id, field)``.
    """
    bounds = quota_bounds(config, groups, patients.count())
    p = product(patients.select(id_col), groups.select("group_id").distinct(), id_col)
    return by_rank(p.withColumn("_k", _key(id_col, "group_id", seed=seed)), bounds, "group_id", id_col, "_k", "field") \
        .select(id_col, "group_id", "field")


# SET2 ---------------------------------------------------------------------------------
def remaining_config(config: DataFrame, groups: DataFrame) -> DataFrame:
    """Config fields outside every exclusive group."""
    return config.join(groups.select("field").distinct(), "field", "left_anti")


# SCL29, SCL30 -------------------------------------------------------------------------
def assign_remaining(patients: DataFrame, config: DataFrame, groups: DataFrame,
                     id_col: str = "patient_id", seed: str = "0") -> DataFrame:
    """Non-exclusive fields: a range gives every patient a seeded integer in
    ``[lo, hi]`` (as text); a positive count flags that many distinct
    patients chosen by seeded hash.  Long form ``(patient_id, field,
    is_true, value)``."""
    rest = remaining_config(config, groups)

    ids = patients.select(id_col)
    lo, hi = range_bounds("range_text")
    ranged = product(ids, rest.where(F.col("kind") == "range").select("field", "range_text"), id_col).select(
        id_col, "field", F.lit(None).cast("boolean").alias("is_true"),
        seeded_int(lo, hi, id_col, "field", seed=seed).cast("string").alias("value"))
    counted = rest.where((F.col("kind") == "count") & (F.col("count") > 0))
    keyed = product(ids, counted.select("field"), id_col).withColumn("_k", _key(id_col, "field", seed=seed))
    bounds = counted.select("field", F.lit(0).cast("long").alias("above"), F.col("count").alias("upto"), F.lit(True).alias("is_true"))
    return ranged.unionByName(by_rank(keyed, bounds, "field", id_col, "_k", "is_true").select(
        id_col, "field", "is_true", F.lit(None).cast("string").alias("value")))


def generate(patients: DataFrame, config: DataFrame, groups: DataFrame,
             id_col: str = "patient_id", seed: str = "0") -> DataFrame:
    """Whole population as ``flags`` (only set fields are present)."""
    ex = assign_exclusive(patients, config, groups, id_col, seed).select(
        id_col, "field", F.lit(True).alias("is_true"), F.lit(None).cast("string").alias("value"))
    return ex.unionByName(assign_remaining(patients, config, groups, id_col, seed))


# JN7 + AGG9 ------------------------------------------------------------------------------
def validate_counts(flags: DataFrame, config: DataFrame, id_col: str = "patient_id",
                    patients: DataFrame | None = None) -> DataFrame:
    """Per config field: int -> records whose value is exactly true, pass when
    equal to the expected count; range -> records with an integer value
    inside the bounds, out of the total (of ``patients`` where given, so that
    records without any field count too)."""
    people = flags if patients is None else patients
    total = people.agg(F.count_distinct(id_col)).first()[0]  # one number
    cfg = config.select("field", "kind", F.col("count").cast("long").alias("expected"), "range_text")
    lo, hi = range_bounds("range_text")
    v = as_int("value")
    hit = F.when(F.col("kind") == "count", F.coalesce(F.col("is_true"), F.lit(False))) \
        .otherwise(v.isNotNull() & (v >= lo) & (v <= hi))
    actual = flags.join(cfg, "field").where(hit).groupBy("field", "kind").agg(
        F.count_distinct(id_col).alias("actual"))
    return cfg.join(actual, ["field", "kind"], "left").select(
        "field", "kind", "expected", "range_text", F.coalesce("actual", F.lit(0).cast("long")).alias("actual"),
        F.when(F.col("kind") == "count", F.coalesce("actual", F.lit(0)) == F.col("expected")).alias("passed"),
        F.lit(total).cast("long").alias("total"))


# AGG10 ------------------------------------------------------------------------------------
def violations(flags: DataFrame, groups: DataFrame, id_col: str = "patient_id") -> DataFrame:
    """Record and group with more than one true field; fields in group order."""
    g = groups.select("group_id", "field", "pos")
    t = flags.where(F.coalesce(F.col("is_true"), F.lit(False))).join(g, "field")
    per = t.groupBy(id_col, "group_id").agg(
        F.count("*").alias("n_true"),
        F.array_sort(F.collect_list(F.struct("pos", "field"))).alias("_f"))
    return (per.where(F.col("n_true") > 1)
            .select(id_col, "group_id", "n_true",
                    F.array_join(F.transform("_f", lambda x: x["field"]), ", ").alias("fields")))


def violation_preview(v: DataFrame, id_col: str = "patient_id", k: int = VIOLATION_PREVIEW) -> DataFrame:
    """SRT3: the first ``k`` violations (a top-k report)."""
    return v.orderBy(id_col, "group_id").limit(k)


# AGG11 ------------------------------------------------------------------------------------
def coverage_gaps(patients: DataFrame, flags: DataFrame, groups: DataFrame,
                  id_col: str = "patient_id") -> DataFrame:
    """Patient and group with no true field of the group."""
    pg = product(patients.select(id_col), groups.select("group_id").distinct(), id_col)
    covered = (flags.where(F.coalesce(F.col("is_true"), F.lit(False)))
               .join(groups.select("group_id", "field"), "field").select(id_col, "group_id").distinct())
    return pg.join(covered, [id_col, "group_id"], "left_anti")


def _json_string(c: str) -> Column:
    """A string as a quoted, escaped JSON literal."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def patients_json(flags: DataFrame, id_col: str = "patient_id") -> DataFrame:
    """SRC4 payload: one JSON object per record with only its set fields;
    booleans stay JSON ``true``, other values stay strings."""
    val = F.when(F.col("is_true"), F.lit("true")).otherwise(_json_string("value"))
    pair = F.concat(_json_string("field"), F.lit(": "), val)
    per = flags.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("field", pair.alias("p"))))
                                    .alias("_p"))
    return per.select(id_col, F.concat(F.lit("{"), F.array_join(F.transform("_p", lambda x: x["p"]), ", "),
                                       F.lit("}")).alias("json"))


def write_patient_folders(flags: DataFrame, path: str, id_col: str = "patient_id", file: str = "form.json") -> None:
    """SRC4 sink: ``<path>/<id>/form.json`` for every record."""
    entity_files(patients_json(flags, id_col), path, id_col, "json", file)
