"""Rating-scale score reports (PRJ19, SCL1 - SCL5, SCL18 - SCL22, JN4, JN6,
AGG14, AGG15, SRT1, WIN5).

``reports(patient_id, report, text)``: one row per decoded score report.
Scale sets are fixed, small configuration and are used as literal arrays
(no join); everything per report is a column expression or an explode, and
per-patient steps are keyed aggregations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.dates import date_before_comma
from quire.functions.text import (
    between_markers, html_escape, is_adaptive_scale, number_run,
    numeric_score, rater_label, rater_relationship, rater_type,
    score_display, severity_band, test_date,
)
from quire.plans import scan
from quire.plans.barrier import with_computed

# Fixed values that must equal the reference for equal results ---------------
# Label order of the score block and scale grouping, per form variant.  The
# parent form uses the "Relationship" label; every other form the second set.
PARENT_LABELS = [
    "Hyperactivity", "Aggression", "Conduct Problems", "Externalizing Problems",
    "Anxiety", "Depression", "Somatization", "Internalizing Problems",
    "Attention Problems", "Atypicality", "Withdrawal", "Behavioral Symptoms Index",
    "Adaptability", "Social Skills", "Leadership", "Functional Communication",
    "Activities of Daily Living", "Adaptive Skills",
]
PARENT_TREE = [
    ("Externalizing Problems", ["Hyperactivity", "Aggression", "Conduct Problems"]),
    ("Internalizing Problems", ["Anxiety", "Depression", "Somatization"]),
    ("Behavioral Symptoms Index", ["Attention Problems", "Atypicality", "Withdrawal"]),
    ("Adaptive Skills", ["Adaptability", "Social Skills", "Leadership",
                         "Functional Communication", "Activities of Daily Living"]),
]
OTHER_LABELS = [
    "Hyperactivity", "Aggression", "Conduct Problems", "Externalizing Problems",
    "Anxiety", "Depression", "Somatization", "Internalizing Problems",
    "Attention Problems", "Learning Problems", "School Problems",
    "Atypicality", "Withdrawal", "Behavioral Symptoms Index",
    "Adaptability", "Social Skills", "Leadership", "Study Skills",
    "Functional Communication", "Adaptive Skills",
]
OTHER_TREE = [
    ("Externalizing Problems", ["Hyperactivity", "Aggression", "Conduct Problems"]),
    ("Internalizing Problems", ["Anxiety", "Depression", "Somatization"]),
    ("School Problems", ["Learning Problems"]),
    ("Behavioral Symptoms Index", ["Atypicality", "Withdrawal"]),
    ("Adaptive Skills", ["Adaptability", "Social Skills", "Leadership", "Study Skills",
                         "Functional Communication"]),
]
# Text spans holding the rater header and the score block.
HEADER_SPAN = ("Behavior Assessment System for Children", "Norm Group 1:")
SCORE_SPAN = ("VALIDITY INDEX SUMMARY", "Percentile")
# Plot split: positions after this composite are the adaptive part.
PROFILE_SPLIT_AFTER = "Behavioral Symptoms Index"
MISSING = "n/a"
# Cell colours of the score table by (severity, adaptive scale), and its notes.
CELL_STYLES = {
    ("significant", True): "background-color: darkblue; color: white;",
    ("at risk", True): "background-color: lightblue; color: black;",
    ("significant", False): "background-color: red; color: white;",
    ("at risk", False): "background-color: orange; color: white;",
}
HIGHER_NOTE = ("Higher scores represent greater endorsed concerns (scores above 60 are considered “at risk” "
               "and above 70 are considered clinically significant)")
REVERSED_NOTE = ("*Reverse scored, such that lower scores reflect greater endorsed concerns (scores below 40 are considered "
                 "“at risk,” and below 30 are considered of significant concern)")
# -----------------------------------------------------------------------------

VARIANTS = {"Relationship": (PARENT_LABELS, PARENT_TREE)}
DEFAULT_VARIANT = (OTHER_LABELS, OTHER_TREE)


def labels_for(kind: Column) -> Column:
    """PRJ19: the label array of the form variant named by ``kind``."""
    parent = F.array(*[F.lit(x) for x in PARENT_LABELS])
    other = F.array(*[F.lit(x) for x in OTHER_LABELS])
    return F.when(kind == "Relationship", parent).otherwise(other)


def tree_rows(labels: Sequence[str] | None = None, tree=None) -> list[tuple]:
    """Flattened tree: (row_pos, label, scale, scale_pos, is_scale, sub_pos)."""
    rows, pos = [], 0
    for si, (scale, subs) in enumerate(tree or PARENT_TREE):
        rows.append((pos, scale, scale, si, True, -1))
        pos += 1
        for j, sub in enumerate(subs):
            rows.append((pos, sub, scale, si, False, j))
            pos += 1
    return rows


def tree_array(tree=None) -> Column:
    return F.array(*[
        F.struct(F.lit(p).alias("row_pos"), F.lit(lab).alias("label"), F.lit(sc).alias("scale"),
                 F.lit(sp).alias("scale_pos"), F.lit(isc).alias("is_scale"),
                 F.lit(sub).alias("sub_pos"))
        for p, lab, sc, sp, isc, sub in tree_rows(tree=tree)])


# SCL1 - SCL5 --------------------------------------------------------------------
def parse_headers(reports: DataFrame, text_col: str = "text") -> DataFrame:
    """Rater header per report: test date, relationship, form type, label."""
    head = between_markers(text_col, *HEADER_SPAN)
    r = with_computed(reports, _head=head)  # computed once, referenced many times
    return (r.withColumn("test_date", test_date("_head"))
            .withColumn("relationship", rater_relationship("_head"))
            .withColumn("form_type", rater_type("_head"))
            .withColumn("rater_label", rater_label("test_date", "relationship"))
            .drop("_head"))


# SCL4 + JN6 -----------------------------------------------------------------------
def zip_scores(reports: DataFrame, key_cols: Sequence[str], text_col: str = "text",
               kind_col: str = "form_type", packed: Sequence[str] | None = None) -> DataFrame:
    """i-th number of the score block gets the i-th label of the form's label
    set; extra numbers are cut, missing ones leave labels out.  Long form
    ``(keys..., pos, label, t_score)``; reports without a score block give
    no rows (see :func:`score_rejects`).  With ``packed``, a list of labels, a row
    per report instead: ``(keys..., scores)``, the score of each label or null."""
    block = between_markers(text_col, *SCORE_SPAN)
    b = with_computed(reports.select(*key_cols, kind_col, text_col), _block=block)
    if packed is not None:
        n = with_computed(b.select(*key_cols, kind_col, "_block"), _nums=number_run("_block")).where(F.col("_nums").isNotNull())

        def of(labels: Sequence[str]) -> Column:
            return F.array(*[F.get("_nums", F.lit(labels.index(x))) if x in labels else F.lit(None).cast("string") for x in packed])

        return n.select(*key_cols, F.when(F.col(kind_col) == "Relationship", of(PARENT_LABELS))
                        .otherwise(of(OTHER_LABELS)).alias("scores"))
    r = b.select(*key_cols, labels_for(F.col(kind_col)).alias("_labels"),
                 number_run("_block").alias("_nums"))
    ex = r.select(*key_cols, "_labels", F.posexplode("_nums").alias("pos", "t_score"))
    return (ex.where(F.col("pos") < F.size("_labels"))
            .select(*key_cols, "pos", F.element_at("_labels", F.col("pos") + 1).alias("label"),
                    "t_score"))


def score_rejects(reports: DataFrame, key_cols: Sequence[str], text_col: str = "text") -> DataFrame:
    """Reports whose text has no usable score block."""
    block = between_markers(text_col, *SCORE_SPAN)
    r = with_computed(reports.select(*key_cols, text_col), _nums=number_run(block))
    return r.where(F.col("_nums").isNull()).select(
        *key_cols, F.lit("score block not found").alias("reason"))


# SCL18, SCL20, SCL21 + JN4 -------------------------------------------------------
def table_rows(reports: DataFrame, scores: DataFrame, key_cols: Sequence[str],
               tree=None) -> DataFrame:
    """JN4: every scale and subscale row for every report; absent = ``n/a``.

    The tree is a literal array inlined per report (no cross join); the
    scores are looked up through a per-report map, so the product is never
    shuffled.
    """
    key_cols = list(key_cols)
    per = scores.groupBy(*key_cols).agg(
        F.map_from_entries(F.collect_list(F.struct("label", F.col("t_score").cast("string"))))
        .alias("_m"))
    rows = reports.select(*key_cols).join(per, key_cols, "left")
    rows = rows.select(*key_cols, "_m", F.inline(tree_array(tree)))
    adaptive = is_adaptive_scale(F.col("scale"))
    value = F.coalesce(F.try_element_at("_m", F.col("label")), F.lit(MISSING))
    return (rows.select(*key_cols, "row_pos", "label", "scale", "is_scale",
                        value.alias("value"), adaptive.alias("adaptive"))
            .withColumn("display", score_display("value", "adaptive", MISSING))
            .withColumn("band", F.when(F.col("value") == MISSING, F.lit(None).cast("string"))
                        .otherwise(severity_band("value", "adaptive"))))


# SRT1 --------------------------------------------------------------------------------
def rater_order(reports: DataFrame, group_cols: Sequence[str], label_col: str = "rater_label",
                pos_col: str = "report_pos", out: str = "rater_pos") -> DataFrame:
    """Newest first by the date before the first comma (unparsable =
    1900-01-01), stable on the report position.  Skew-safe ranking."""
    d = date_before_comma(label_col)
    r = reports.withColumn("_neg_days", -F.datediff(d, F.lit("1900-01-01").cast("date")))
    return scan.row_number(r, group_cols, ["_neg_days", pos_col], out).drop("_neg_days")


def highest(score: Column | str) -> Column:
    """The highest of several scores by number, numbers or texts (as
    :func:`zip_scores` gives them); a text that is no number is below all."""
    c = F.col(score) if isinstance(score, str) else score
    as_number = c.cast("string").try_cast("double")
    return F.max(F.struct(as_number.alias("n"), c.alias("s")))["s"]


# AGG15 -------------------------------------------------------------------------------
def combined_table(reports: DataFrame, scores: DataFrame, patient_col: str, rater_col: str,
                   raters: Sequence[str], tree=None) -> DataFrame:
    """AGG15: one row per patient and scale row, one display column per
    rater (``n/a`` when that rater's report lacks the scale, NULL when the
    patient has no report from that rater).

    The scores of each report become one map, the maps are pivoted to one
    row per patient (a shuffle of one row per report), and only then is the
    scale tree inlined, so the patient x tree product is never shuffled.
    ``raters`` fixes the column order (e.g. newest first, SRT1).  ``scores`` are
    in long form, or a row per report as :func:`zip_scores` packs them for the
    labels of the tree, in its order: they are then never taken apart.
    """
    # of several scores of one rater for a label the highest is shown; use
    # combined_long for a column per report
    if "scores" in scores.columns:
        found = [highest(F.get("scores", F.lit(i))) for i in range(len(tree_rows(tree=tree)))]
        maps = scores.groupBy(patient_col, rater_col).agg(F.array(*found).alias("_m"))
        empty = F.array().cast("array<string>")

        def score(r: str) -> Column:
            return F.get(F.col(r), F.col("row_pos"))
    else:
        scores = scores.groupBy(patient_col, rater_col, "label").agg(highest("t_score").alias("t_score"))
        maps = scores.groupBy(patient_col, rater_col).agg(
            F.map_from_entries(F.collect_list(F.struct("label", F.col("t_score").cast("string"))))
            .alias("_m"))
        empty = F.create_map().cast("map<string,string>")

        def score(r: str) -> Column:
            return F.try_element_at(F.col(r), F.col("label"))
    per = (reports.select(patient_col, rater_col).distinct()
           .join(maps, [patient_col, rater_col], "left")
           .withColumn("_m", F.coalesce("_m", empty)))
    wide = per.groupBy(patient_col).pivot(rater_col, list(raters)).agg(F.first("_m"))
    rows = wide.select(patient_col, *raters, F.inline(tree_array(tree)))
    adaptive = is_adaptive_scale(F.col("scale"))
    cells = [F.when(F.col(r).isNotNull(),
                    score_display(F.coalesce(score(r), F.lit(MISSING)),
                                  adaptive, MISSING)).alias(r) for r in raters]
    return rows.select(patient_col, "row_pos", "label", *cells)


def combined_long(reports: DataFrame, scores: DataFrame, patient_col: str, report_col: str,
                  label_col: str = "rater_label", pos_col: str = "report_pos", trees: DataFrame | None = None,
                  tree=None, packed: bool = False) -> DataFrame:
    """AGG15 in long form: ``(patient, rater_pos, rater label, row_pos, label,
    is_scale, display, style)``, a row for every report of a patient, newest first, and every row
    of the patient's scale tree.  No report is left out, whoever the rater is,
    and two reports of one rater stay two.

    With ``trees`` (see :func:`scale_union`, grouped by patient) the tree is the
    union over the patient's reports; otherwise it is the fixed ``tree``.

    The scores of a report become one row before they meet it, and its tree is
    inlined last, so that the product isn't shuffled.  ``packed`` leaves them so:
    ``(patient, rater_pos, rater label, scores)``, and ``tree`` where ``trees`` are given.
    """
    ranked = rater_order(reports, [patient_col], label_col, pos_col) \
        .select(patient_col, report_col, label_col, F.col("rater_pos"))
    best = scores.where(F.col("label").isNotNull()).groupBy(patient_col, report_col, "label") \
        .agg(highest("t_score").cast("string").alias("_t")) \
        .groupBy(patient_col, report_col).agg(F.collect_list(F.struct("label", F.col("_t").alias("score"))).alias("scores"))
    if not packed:  # a map once for each report, not for each cell
        best = best.withColumn("scores", F.map_from_entries("scores"))
    per = ranked.join(best, [patient_col, report_col], "left").select(patient_col, "rater_pos", label_col, "scores")
    if trees is not None:
        u = scale_union(trees, [patient_col])
        row = [F.col("scale_rank"), F.coalesce("sub_rank", F.lit(0).cast("long"))]
        rows = u.select(patient_col, "scale", F.col("scale").alias("label"), row[0].alias("_a"),
                        F.lit(0).cast("long").alias("_b")).unionByName(
            u.where(F.col("subscale").isNotNull()).select(patient_col, "scale", F.col("subscale").alias("label"),
                                                          row[0].alias("_a"), row[1].alias("_b"))).distinct()
        rows = scan.row_number(rows, [patient_col], ["_a", "_b", "label"], "_n") \
            .select(patient_col, "scale", "label", (F.col("_n") - 1).alias("row_pos"))
        # a scale tree has tens of labels
        rows = rows.groupBy(patient_col).agg(F.array_sort(F.collect_list(F.struct("row_pos", "label", "scale"))).alias("tree"))
        per = per.join(rows, patient_col)
    if packed:
        return per
    of_tree = tree_array(tree) if trees is None else F.col("tree")
    cells = per.select(patient_col, "rater_pos", label_col, F.col("scores").alias("_m"), F.inline(of_tree))
    shown, style = _cell(F.try_element_at("_m", F.col("label")), is_adaptive_scale(F.col("scale")))
    return cells.select(patient_col, "rater_pos", label_col, "row_pos", "label", (F.col("label") == F.col("scale")).alias("is_scale"),
                        shown.alias("display"), style.alias("style"))


def _cell(score: Column, adaptive: Column) -> tuple[Column, Column]:
    """What a score's cell shows, and its style."""
    band = severity_band(score, adaptive)
    style = F.coalesce(*[F.when((band == b) & (adaptive == a), F.lit(c)) for (b, a), c in CELL_STYLES.items()], F.lit(""))
    return score_display(F.coalesce(score, F.lit(MISSING)), adaptive, MISSING), style


def score_table_html(cells: DataFrame, patient_col: str, title: Column, label_col: str = "rater_label", tree=None) -> DataFrame:
    """SCL26: ``(patient, html)``, the score table of every patient from the rows
    of :func:`combined_long`: a column per report, newest first, scales in bold,
    subscales indented, cells coloured by severity.  One report gives the single
    table.  ``title`` is an expression over the patient column; texts are escaped.
    Packed rows become cells only within their patient's table; ``tree`` is theirs.
    """
    def cell(display: Column, style: Column) -> Column:
        return F.concat(F.lit('<td style="text-align: center; '), style, F.lit('">'), html_escape(display), F.lit("</td>"))

    def row(label: Column, is_scale: Column, shown: Column) -> Column:
        name = F.when(is_scale, F.concat(F.lit("<td><strong>"), html_escape(label), F.lit("</strong></td>"))) \
            .otherwise(F.concat(F.lit('<td style="padding-left: 20px;">'), html_escape(label), F.lit("</td>")))
        return F.concat(F.lit("<tr>"), name, F.array_join(shown, ""), F.lit("</tr>"))

    if "scores" in cells.columns:
        of_tree = [F.first("tree").alias("_tree")] if "tree" in cells.columns else []
        per = cells.groupBy(patient_col).agg(
            F.array_sort(F.collect_list(F.struct("rater_pos", F.col(label_col).alias("head"), "scores"))).alias("c"), *of_tree)
        per = with_computed(per, _m=F.transform("c", lambda x: F.map_from_entries(x["scores"])))
        body = F.transform(F.col("_tree") if of_tree else tree_array(tree), lambda t: row(
            t["label"], t["label"] == t["scale"],
            F.transform("_m", lambda m: cell(*_cell(F.try_element_at(m, t["label"]), is_adaptive_scale(t["scale"]))))))
        first = F.col("c")
    else:
        rows = cells.groupBy(patient_col, "row_pos", "label", "is_scale").agg(
            F.array_sort(F.collect_list(F.struct("rater_pos", "display", "style", F.col(label_col).alias("head")))).alias("c"))
        per = rows.groupBy(patient_col).agg(F.array_sort(F.collect_list(F.struct("row_pos", "label", "is_scale", "c"))).alias("r"))
        body = F.transform("r", lambda x: row(
            x["label"], x["is_scale"], F.transform(x["c"], lambda y: cell(y["display"], y["style"]))))
        first = F.col("r")[0]["c"]
    heads = F.array_join(F.transform(first, lambda x: F.concat(F.lit("<th>"), html_escape(x["head"]), F.lit("</th>"))), "")
    return per.select(patient_col, F.concat(
        F.lit("<h1>"), html_escape(title), F.lit("</h1><p>" + HIGHER_NOTE + "</p><table><thead><tr><th>Scales</th>"), heads,
        F.lit("</tr></thead><tbody>"), F.array_join(body, ""),
        F.lit("</tbody></table><p>" + REVERSED_NOTE + "</p>")).alias("html"))


# AGG14 -------------------------------------------------------------------------------
def scale_union(trees: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Union of scale trees over reports, first-seen order, no duplicates.

    ``trees(group..., report_pos, scale, scale_pos, subscale, sub_pos)``.
    """
    g = list(group_cols)
    scales = trees.groupBy(*g, "scale").agg(F.min(F.struct("report_pos", "scale_pos")).alias("_f"))
    scales = scan.row_number(scales, g, ["_f", "scale"], "scale_rank")
    subs = trees.where(F.col("subscale").isNotNull()).groupBy(*g, "scale", "subscale").agg(
        F.min(F.struct("report_pos", "sub_pos")).alias("_f"))
    subs = scan.row_number(subs, [*g, "scale"], ["_f", "subscale"], "sub_rank")
    return (scan.join_null_safe(scales.drop("_f"), subs.drop("_f"), [*g, "scale"], "left")
            .select(*g, "scale", "scale_rank", "subscale", "sub_rank"))


# WIN5 --------------------------------------------------------------------------------
def profile_positions(tree: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Plot order: each group's subscales, then the group's composite.

    ``tree(group..., scale, scale_pos, subscale, sub_pos)`` (one row per
    subscale).  Returns the 0-based position of every label, the group's
    bounds (first - 0.5, composite + 0.5) and its label position (start +
    number of subscales / 2).
    """
    g = list(group_cols)
    subs = tree.select(*g, "scale", "scale_pos", F.col("subscale").alias("label"),
                       F.lit(0).alias("is_composite"), "sub_pos")
    comps = tree.groupBy(*g, "scale", "scale_pos").agg(F.count("*").alias("_n")) \
        .select(*g, "scale", "scale_pos", F.col("scale").alias("label"),
                F.lit(1).alias("is_composite"), F.lit(0).alias("sub_pos"))
    allrows = subs.unionByName(comps)
    pos = scan.row_number(allrows, g, ["scale_pos", "is_composite", "sub_pos"], "_rn") \
        .withColumn("pos", F.col("_rn") - 1).drop("_rn")
    bounds = pos.groupBy(*g, "scale").agg(
        F.min("pos").alias("_start"), F.max("pos").alias("_end"),
        F.sum(1 - F.col("is_composite")).alias("_nsub"))
    out = (pos.join(bounds, [*g, "scale"])
           .select(*g, "label", "scale", "is_composite", "pos",
                   (F.col("_start") - 0.5).alias("group_lo"),
                   (F.col("_end") + 0.5).alias("group_hi"),
                   (F.col("_start") + F.col("_nsub") / 2).alias("group_mid")))
    # first adaptive position: after the behavioural composite, else half way
    # (a scale tree has tens of labels, so one window per tree is bounded)
    w = Window.partitionBy(*g)
    bsi = F.max(F.when(F.col("label") == PROFILE_SPLIT_AFTER, F.col("pos") + 1)).over(w)
    return out.withColumn("split_at", F.coalesce(bsi, F.floor(F.count("*").over(w) / 2)).cast("long"))


# SCL22 -------------------------------------------------------------------------------
def profile_values(scores: DataFrame, key_cols: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Profile y-values: labels matched trimmed and lower-case, digits only,
    anything else a gap (NULL)."""
    want = F.array(*[F.lit(x.strip().lower()) for x in labels])
    s = scores.withColumn("_k", F.lower(F.trim("label")))
    return (s.where(F.array_contains(want, F.col("_k")))
            .select(*key_cols, "label", numeric_score(F.col("t_score").cast("string")).alias("y")))
