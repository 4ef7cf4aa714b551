"""Score-report queries: report texts are assembled from lineitem rows and
parsed back; scale trees come from the region/nation hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import scores
from quire.plans.catalog import register
from quire.session import read_table, spread

RATERS = ["A", "N", "R"]


def score_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score report per lineitem: returnflag R is a teacher form, line 5
    has no test date, line 6 no score block, line 7 the fallback marker."""
    li = spread(read_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
    teacher = F.col("l_returnflag") == "R"
    nums = F.concat_ws(" ", F.col("l_quantity").cast("int").cast("string"),
                       F.col("l_linenumber").cast("string"),
                       F.round(F.col("l_tax") * 100).cast("int").cast("string"))
    date = F.when(F.col("l_linenumber") != 5,
                  F.concat(F.lit(" Test Date: "), F.date_format("l_shipdate", "M/d/yyyy"))) \
        .otherwise(F.lit(""))
    block = (F.when(F.col("l_linenumber") == 6, F.lit("no scores"))
             .when(F.col("l_linenumber") == 7, F.concat(F.lit("Clinical Combined "), nums))
             .otherwise(F.concat(F.lit("General Combined "), nums)))
    text = F.concat(
        F.lit("Behavior Assessment System for Children "),
        F.when(teacher, F.lit("Teacher Rating Scales")).otherwise(F.lit("Parent Rating Scales")),
        date,
        F.when(teacher, F.lit(" Rater Position: ")).otherwise(F.lit(" Relationship: ")),
        F.col("l_linestatus"), F.lit(" Age: 9 Norm Group 1: General VALIDITY INDEX SUMMARY "),
        block, F.lit(" Percentile 50"))
    return li.select("l_orderkey", "l_linenumber", "l_returnflag", text.alias("text"))


@register("score_zip", oracle="""
SELECT label, pos, count(*) AS n_scores, CAST(sum(v) AS BIGINT) AS sum_scores FROM (
  SELECT 0 AS pos, 'Hyperactivity' AS label, CAST(l_quantity AS BIGINT) AS v FROM lineitem WHERE l_linenumber <> 6
  UNION ALL SELECT 1, 'Aggression', l_linenumber FROM lineitem WHERE l_linenumber <> 6
  UNION ALL SELECT 2, 'Conduct Problems', CAST(round(l_tax * 100) AS BIGINT) FROM lineitem WHERE l_linenumber <> 6)
GROUP BY label, pos
""")
def score_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scores.parse_headers(score_reports(spark, sf_dir))
    z = scores.zip_scores(r, ["l_orderkey", "l_linenumber"])
    return z.groupBy("label", "pos").agg(F.count("*").alias("n_scores"),
                                         F.sum(F.col("t_score").cast("long")).alias("sum_scores"))


@register("score_rejects", oracle="""
SELECT l_orderkey, l_linenumber, 'score block not found' AS reason FROM lineitem WHERE l_linenumber = 6
""")
def score_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.score_rejects(score_reports(spark, sf_dir), ["l_orderkey", "l_linenumber"])


@register("rater_header", oracle="""
SELECT CASE WHEN l_returnflag = 'R' THEN 'Rater Position' ELSE 'Relationship' END AS form_type,
       l_linestatus AS relationship, count(*) AS n_reports,
       count(DISTINCT CASE WHEN l_linenumber <> 5 THEN strftime(l_shipdate, '%-m/%-d/%Y') ELSE 'Unknown' END
             || ', (' || l_linestatus || ')') AS n_labels
FROM lineitem GROUP BY 1, 2
""")
def rater_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scores.parse_headers(score_reports(spark, sf_dir))
    return r.groupBy("form_type", "relationship").agg(
        F.count("*").alias("n_reports"), F.count_distinct("rater_label").alias("n_labels"))


def _rater_scores(spark: SparkSession, sf_dir: str):
    """Reports = (order, returnflag); line n scores label (3n mod 18) of the
    parent set with quantity + 20; a repeated label keeps the highest."""
    li = read_table(spark, sf_dir, "lineitem")
    labels = F.array(*[F.lit(x) for x in scores.PARENT_LABELS])
    s = li.select("l_orderkey", F.col("l_returnflag").alias("rater"),
                  F.element_at(labels, (F.col("l_linenumber") * 3) % 18 + 1).alias("label"),
                  (F.col("l_quantity").cast("int") + 20).alias("v"))
    s = s.groupBy("l_orderkey", "rater", "label").agg(F.max("v").alias("t_score"))
    reports = li.select("l_orderkey", F.col("l_returnflag").alias("rater")).distinct()
    return reports, s


def _labels_sql(labels) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in labels) + "]"


TREE_SQL = "tree(row_pos, label, adaptive) AS (VALUES " + ", ".join(
    f"({p}, '{lab}', {str(sc == 'Adaptive Skills').upper()})"
    for p, lab, sc, _sp, _isc, _sub in scores.tree_rows()) + ")"

SEVERITY_SQL = f"""
WITH {TREE_SQL},
s AS (
  SELECT l_orderkey, l_returnflag AS rater,
         ({_labels_sql(scores.PARENT_LABELS)})[(l_linenumber * 3) % 18 + 1] AS label,
         max(CAST(l_quantity AS INT) + 20) AS v
  FROM lineitem GROUP BY 1, 2, 3),
r AS (SELECT DISTINCT l_orderkey, l_returnflag AS rater FROM lineitem),
t AS (
  SELECT r.l_orderkey, r.rater, tree.label, tree.adaptive, s.v
  FROM r CROSS JOIN tree LEFT JOIN s ON s.l_orderkey = r.l_orderkey AND s.rater = r.rater AND s.label = tree.label)
"""


@register("severity_bands", oracle=SEVERITY_SQL + """
SELECT label, rater,
       CASE WHEN v IS NULL THEN 'n/a'
            WHEN adaptive AND v <= 30 THEN 'significant' WHEN adaptive AND v <= 40 THEN 'at risk'
            WHEN NOT adaptive AND v >= 70 THEN 'significant' WHEN NOT adaptive AND v >= 60 THEN 'at risk'
            ELSE 'none' END AS band,
       count(*) AS n,
       count(*) FILTER (WHERE v IS NOT NULL AND adaptive) AS n_starred
FROM t GROUP BY 1, 2, 3
""")
def severity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports, s = _rater_scores(spark, sf_dir)
    rows = scores.table_rows(reports, s, ["l_orderkey", "rater"])
    band = (F.when(F.col("value") == scores.MISSING, F.lit("n/a"))
            .otherwise(F.coalesce("band", F.lit("none"))))
    return rows.groupBy("label", "rater", band.alias("band")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("display").endswith("*")).alias("n_starred"))


@register("combined_raters", oracle=SEVERITY_SQL + """
SELECT label, count(*) AS n_rows,
       count(*) FILTER (WHERE a IS NOT NULL AND a <> 'n/a') AS n_a,
       count(*) FILTER (WHERE nn IS NOT NULL AND nn <> 'n/a') AS n_n,
       count(*) FILTER (WHERE rr IS NOT NULL AND rr <> 'n/a') AS n_r
FROM (
  SELECT l_orderkey, label,
         max(CASE WHEN rater = 'A' THEN coalesce(CAST(v AS VARCHAR), 'n/a') END) AS a,
         max(CASE WHEN rater = 'N' THEN coalesce(CAST(v AS VARCHAR), 'n/a') END) AS nn,
         max(CASE WHEN rater = 'R' THEN coalesce(CAST(v AS VARCHAR), 'n/a') END) AS rr
  FROM t GROUP BY l_orderkey, label)
GROUP BY label
""")
def combined_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports, s = _rater_scores(spark, sf_dir)
    wide = scores.combined_table(reports, s, "l_orderkey", "rater", RATERS)
    has = lambda c: F.count_if(F.col(c).isNotNull() & (F.col(c) != scores.MISSING))
    return wide.groupBy("label").agg(F.count("*").alias("n_rows"), has("A").alias("n_a"),
                                     has("N").alias("n_n"), has("R").alias("n_r"))


def numbered_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report text per order line: 18 numbers from the quantity, the first
    number from 1 to 99 (so that texts and numbers order differently)."""
    li = spread(read_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
    first = F.pmod(F.col("l_quantity").cast("int") * F.col("l_linenumber"), F.lit(99)) + 1
    numbers = F.concat(F.array(first.cast("string")),
                       F.transform(F.sequence(F.lit(1), F.lit(17)), lambda i: (F.col("l_quantity").cast("int") + i).cast("string")))
    text = F.concat(F.lit("Behavior Assessment System for Children Parent Rating Scales Test Date: 1/2/2020 Relationship: "),
                    F.col("l_returnflag"), F.lit(" Age: 9 Norm Group 1: General VALIDITY INDEX SUMMARY General Combined "),
                    F.array_join(numbers, " "), F.lit(" Percentile 50"))
    return li.select("l_orderkey", "l_linenumber", text.alias("text"))


@register("combined_texts", oracle=f"""
WITH x AS (
  SELECT l_orderkey, l_returnflag, CAST(l_quantity AS INT) AS q, CAST(l_quantity AS INT) * l_linenumber % 99 + 1 AS first FROM lineitem),
y AS (SELECT l_orderkey, l_returnflag, max(first) AS first, max(q) AS q FROM x GROUP BY 1, 2),
z AS (SELECT l_returnflag, ({_labels_sql(scores.PARENT_LABELS)})[i + 1] AS label, CASE WHEN i = 0 THEN first ELSE q + i END AS v
      FROM y, range(18) AS r(i))
SELECT label, l_returnflag AS rater, CAST(sum(v) AS BIGINT) AS sum_scores, count(*) AS n FROM z
WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1, 2
""")
def combined_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15 after JN6: scores that were read as texts; a rater's highest score of
    an order is the highest number."""
    reports = scores.parse_headers(numbered_reports(spark, sf_dir))
    z = scores.zip_scores(reports, ["l_orderkey", "l_linenumber", "relationship"], packed=[x[1] for x in scores.tree_rows()])
    keys = reports.select("l_orderkey", "relationship")
    wide = scores.combined_table(keys, z, "l_orderkey", "relationship", RATERS)
    shown = F.explode(F.array(*[F.struct(F.lit(r).alias("rater"), F.regexp_replace(r, r"\*$", "").alias("v")) for r in RATERS]))
    return (wide.select("label", shown.alias("x")).where(F.col("x.v").try_cast("long").isNotNull())
            .groupBy("label", F.col("x.rater").alias("rater"))
            .agg(F.sum(F.col("x.v").cast("long")).alias("sum_scores"), F.count("*").alias("n")))


@register("combined_cells", oracle=SEVERITY_SQL.replace("r AS (SELECT DISTINCT", """o AS (
  SELECT l_orderkey, l_returnflag AS rater,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(min(l_shipdate) AS DATE) DESC, l_returnflag) AS rater_pos
  FROM lineitem GROUP BY 1, 2),
r AS (SELECT DISTINCT""", 1) + """
SELECT rater_pos, label, coalesce(CAST(v AS VARCHAR) || CASE WHEN adaptive THEN '*' ELSE '' END, 'n/a') AS display,
       count(*) AS n
FROM t JOIN o ON o.l_orderkey = t.l_orderkey AND o.rater = t.rater GROUP BY 1, 2, 3
""")
def combined_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15, long form: every cell of every report, newest report first."""
    return _cells(spark, sf_dir).groupBy("rater_pos", "label", "display").agg(F.count("*").alias("n"))


def _cells(spark: SparkSession, sf_dir: str, packed: bool = False) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    _, s = _rater_scores(spark, sf_dir)
    label = F.concat(F.date_format(F.min("l_shipdate"), "M/d/yyyy"), F.lit(", (Mother)"))
    reports = li.groupBy("l_orderkey", F.col("l_returnflag").alias("rater")).agg(label.alias("rater_label")) \
        .withColumn("report_pos", F.ascii("rater"))
    return scores.combined_long(reports, s, "l_orderkey", "rater", packed=packed)


@register("score_table_html", oracle=SEVERITY_SQL.replace("r AS (SELECT DISTINCT", """o AS (
  SELECT l_orderkey, l_returnflag AS rater, strftime(min(l_shipdate), '%-m/%-d/%Y') || ', (Mother)' AS head,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(min(l_shipdate) AS DATE) DESC, l_returnflag) AS rater_pos
  FROM lineitem GROUP BY 1, 2),
r AS (SELECT DISTINCT""", 1) + """,
c AS (SELECT o.l_orderkey, o.rater_pos, o.head, p.row_pos, t.label,
             p.label IN ('Externalizing Problems', 'Internalizing Problems', 'Behavioral Symptoms Index', 'Adaptive Skills') AS is_scale,
             '<td style="text-align: center; ' ||
             CASE WHEN t.adaptive AND v <= 30 THEN 'background-color: darkblue; color: white;'
                  WHEN t.adaptive AND v <= 40 THEN 'background-color: lightblue; color: black;'
                  WHEN NOT t.adaptive AND v >= 70 THEN 'background-color: red; color: white;'
                  WHEN NOT t.adaptive AND v >= 60 THEN 'background-color: orange; color: white;' ELSE '' END || '">' ||
             coalesce(CAST(v AS VARCHAR) || CASE WHEN t.adaptive THEN '*' ELSE '' END, 'n/a') || '</td>' AS td
      FROM t JOIN o ON o.l_orderkey = t.l_orderkey AND o.rater = t.rater JOIN tree p ON p.label = t.label),
w AS (SELECT l_orderkey, row_pos, '<tr>' || CASE WHEN is_scale THEN '<td><strong>' || label || '</strong></td>'
               ELSE '<td style="padding-left: 20px;">' || label || '</td>' END || string_agg(td, '' ORDER BY rater_pos) || '</tr>' AS tr,
             string_agg('<th>' || head || '</th>', '' ORDER BY rater_pos) AS heads
      FROM c GROUP BY l_orderkey, row_pos, label, is_scale)
SELECT l_orderkey, md5('<h1>Report ' || CAST(l_orderkey AS VARCHAR) || '</h1><p>' || '""" + scores.HIGHER_NOTE + """'
  || '</p><table><thead><tr><th>Scales</th>' || min(heads) || '</tr></thead><tbody>' || string_agg(tr, '' ORDER BY row_pos)
  || '</tbody></table><p>' || '""" + scores.REVERSED_NOTE + """' || '</p>') AS html_md5
FROM w GROUP BY l_orderkey
""")
def score_table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL26: the combined score table of every order as HTML."""
    title = F.concat(F.lit("Report "), F.col("l_orderkey").cast("string"))
    html = scores.score_table_html(_cells(spark, sf_dir, packed=True), "l_orderkey", title)
    return html.select("l_orderkey", F.md5("html").alias("html_md5"))


@register("score_zip_forms", oracle=f"""
WITH r AS (
  SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q, [18, 20, 25][l_linenumber % 3 + 1] AS k,
         CASE WHEN l_returnflag = 'R' THEN {_labels_sql(scores.OTHER_LABELS)}
              ELSE {_labels_sql(scores.PARENT_LABELS)} END AS labels FROM lineitem),
x AS (SELECT labels, q, unnest(range(CAST(least(k, len(labels)) AS BIGINT))) AS pos FROM r)
SELECT labels[pos + 1] AS label, CAST(pos AS INT) AS pos, count(*) AS n_scores, CAST(sum(q + pos) AS BIGINT) AS sum_scores
FROM x GROUP BY 1, 2
""")
def score_zip_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN6 with 18, 20 and 25 numbers for both forms: labels differ by form and
    numbers beyond the labels are cut."""
    li = spread(read_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
    teacher = F.col("l_returnflag") == "R"
    k = F.get(F.array(F.lit(18), F.lit(20), F.lit(25)), F.col("l_linenumber") % 3)
    numbers = F.transform(F.sequence(F.lit(0), k - 1), lambda i: (F.col("l_quantity").cast("int") + i).cast("string"))
    text = F.concat(
        F.lit("Behavior Assessment System for Children "),
        F.when(teacher, F.lit("Teacher Rating Scales")).otherwise(F.lit("Parent Rating Scales")),
        F.lit(" Test Date: 1/2/2020"), F.when(teacher, F.lit(" Rater Position: ")).otherwise(F.lit(" Relationship: ")),
        F.lit("M Age: 9 Norm Group 1: General VALIDITY INDEX SUMMARY General Combined "),
        F.array_join(numbers, " "), F.lit(" Percentile 50"))
    r = scores.parse_headers(li.select("l_orderkey", "l_linenumber", text.alias("text")))
    z = scores.zip_scores(r, ["l_orderkey", "l_linenumber"])
    return z.groupBy("label", "pos").agg(F.count("*").alias("n_scores"),
                                         F.sum(F.col("t_score").cast("long")).alias("sum_scores"))


@register("rater_order", oracle="""
SELECT o_custkey, o_orderkey,
       row_number() OVER (PARTITION BY o_custkey
                          ORDER BY CASE WHEN o_orderstatus = 'P' THEN DATE '1900-01-01'
                                        ELSE CAST(o_orderdate AS DATE) END DESC, o_orderkey) AS rater_pos
FROM orders
""")
def rater_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    label = F.concat(F.when(F.col("o_orderstatus") == "P", F.lit("date pending"))
                     .otherwise(F.date_format("o_orderdate", "M/d/yyyy")),
                     F.lit(", ("), F.col("o_orderpriority"), F.lit(")"))
    r = o.select("o_custkey", "o_orderkey", label.alias("rater_label"),
                 F.col("o_orderkey").alias("report_pos"))
    return scores.rater_order(r, ["o_custkey"]).select("o_custkey", "o_orderkey", "rater_pos")


def region_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = read_table(spark, sf_dir, "region"), read_table(spark, sf_dir, "nation")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("scale"), F.col("r_regionkey").alias("scale_pos"),
        F.col("n_name").alias("subscale"), F.col("n_nationkey").alias("sub_pos"))


@register("profile_positions", oracle="""
WITH rows AS (
  SELECT r_name AS scale, r_regionkey AS scale_pos, n_name AS label, 0 AS is_composite, n_nationkey AS sub_pos
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_name, r_regionkey, r_name, 1, 0 FROM region
  WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey)),
p AS (SELECT *, row_number() OVER (ORDER BY scale_pos, is_composite, sub_pos) - 1 AS pos FROM rows),
b AS (SELECT scale, min(pos) AS st, max(pos) AS en, sum(1 - is_composite) AS nsub FROM p GROUP BY scale)
SELECT label, p.scale, is_composite, CAST(pos AS BIGINT) AS pos, CAST(st - 0.5 AS DOUBLE) AS group_lo, CAST(en + 0.5 AS DOUBLE) AS group_hi,
       CAST(st + nsub / 2 AS DOUBLE) AS group_mid,
       CAST(coalesce(max(CASE WHEN label = 'Behavioral Symptoms Index' THEN pos + 1 END) OVER (),
                     floor(count(*) OVER () / 2)) AS BIGINT) AS split_at
FROM p JOIN b ON p.scale = b.scale
""")
def profile_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.profile_positions(region_tree(spark, sf_dir))


@register("scale_union", oracle="""
WITH t AS (
  SELECT 0 AS report_pos, r_name AS scale, r_regionkey AS scale_pos, n_name AS subscale, n_nationkey AS sub_pos
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 1, r_name, r_regionkey, n_name, n_nationkey
  FROM nation JOIN region ON (n_nationkey * 2) % 5 = r_regionkey),
s AS (SELECT scale, row_number() OVER (ORDER BY min(report_pos * 1000 + scale_pos), scale) AS scale_rank
      FROM t GROUP BY scale),
u AS (SELECT scale, subscale,
             row_number() OVER (PARTITION BY scale ORDER BY min(report_pos * 1000 + sub_pos), subscale) AS sub_rank
      FROM t GROUP BY scale, subscale)
SELECT s.scale, s.scale_rank, u.subscale, u.sub_rank FROM s LEFT JOIN u ON s.scale = u.scale
""")
def scale_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = read_table(spark, sf_dir, "region"), read_table(spark, sf_dir, "nation")
    t0 = region_tree(spark, sf_dir).withColumn("report_pos", F.lit(0))
    t1 = n.join(r, (F.col("n_nationkey") * 2) % 5 == F.col("r_regionkey")).select(
        F.lit(1).alias("report_pos"), F.col("r_name").alias("scale"),
        F.col("r_regionkey").alias("scale_pos"), F.col("n_name").alias("subscale"),
        F.col("n_nationkey").alias("sub_pos"))
    return scores.scale_union(t0.unionByName(t1))


@register("profile_values", oracle=f"""
SELECT (CASE WHEN l_returnflag = 'R' THEN {_labels_sql(scores.OTHER_LABELS)}
             ELSE {_labels_sql(scores.PARENT_LABELS)} END)[l_linenumber] AS label,
       count(*) AS n_values,
       count(*) FILTER (WHERE l_linestatus = 'O') AS n_gaps,
       CAST(sum(CASE WHEN l_linestatus <> 'O' THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS sum_y
FROM lineitem GROUP BY 1
""")
def profile_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", F.lit("Rater Position")).otherwise(F.lit("Relationship"))
    q = F.col("l_quantity").cast("int").cast("string")
    txt = F.when(F.col("l_linestatus") == "O", F.concat(q, F.lit("?"))).otherwise(F.concat(F.lit(" "), q))
    s = li.select("l_orderkey", "l_linenumber",
                  F.element_at(scores.labels_for(kind), F.col("l_linenumber")).alias("label"),
                  txt.alias("t_score"))
    v = scores.profile_values(s, ["l_orderkey", "l_linenumber"], scores.PARENT_LABELS)
    return v.groupBy("label").agg(F.count("*").alias("n_values"),
                                  F.count_if(F.col("y").isNull()).alias("n_gaps"),
                                  F.sum(F.col("y").cast("long")).alias("sum_y"))
