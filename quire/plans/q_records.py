"""Record and template queries on the driver tables.

Template: regions are sections, their nations the fields.  Records:
market segments, whose field values are customer names (last customer key
wins), wrapped in brackets first so that the clean-up step has work to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import cluster, records
from quire.plans import scan
from quire.plans.catalog import register
from quire.session import read_table
from quire.sources import files

# An extra template row that never occurs in the data.
EXTRA_SECTION = ("OTHER", 99, "ATLANTIS", 99)

T_SQL = """t AS (
  SELECT r_name AS section, r_regionkey AS section_pos, n_name AS field, n_nationkey AS field_pos
  FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT 'OTHER', 99, 'ATLANTIS', 99)"""
F_SQL = """f AS (
  SELECT c_mktsegment AS record_id, n_name AS field, arg_max(c_name, c_custkey) AS value
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment, n_name)"""
T2_SQL = """t2 AS (
  SELECT r_name AS section, r_regionkey AS section_pos, n_name AS field, n_nationkey AS field_pos
  FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 'LETTER ' || substr(n_name, 1, 1), 10 + ascii(substr(n_name, 1, 1)), n_name, n_nationkey
  FROM nation)"""


def region_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = read_table(spark, sf_dir, "region"), read_table(spark, sf_dir, "nation")
    t = (n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
         .select(F.col("r_name").alias("section"), F.col("r_regionkey").alias("section_pos"),
                 F.col("n_name").alias("field"), F.col("n_nationkey").alias("field_pos")))
    extra = spark.createDataFrame([EXTRA_SECTION], t.schema)
    return t.unionByName(extra)


def letter_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions plus first-letter sections: every nation sits in two sections."""
    r, n = read_table(spark, sf_dir, "region"), read_table(spark, sf_dir, "nation")
    t = (n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
         .select(F.col("r_name").alias("section"), F.col("r_regionkey").alias("section_pos"),
                 F.col("n_name").alias("field"), F.col("n_nationkey").alias("field_pos")))
    first = F.substring("n_name", 1, 1)
    letters = n.select(F.concat(F.lit("LETTER "), first).alias("section"),
                       (F.lit(10) + F.ascii(first)).alias("section_pos"),
                       F.col("n_name").alias("field"), F.col("n_nationkey").alias("field_pos"))
    return t.unionByName(letters)


def segment_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw bracketed form fields per segment, cleaned (PRJ1)."""
    c, n = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "nation")
    raw = (c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
           .select(F.col("c_mktsegment").alias("record_id"),
                   F.concat(F.lit("("), F.col("n_name"), F.lit(")")).alias("field"),
                   F.concat(F.lit("("), F.col("c_name"), F.lit(")")).alias("value"),
                   F.col("c_custkey").alias("ord")))
    return records.clean_form_fields(raw)


@register("template_projection", oracle=f"""
WITH {T_SQL}, {F_SQL}, r AS (SELECT DISTINCT record_id FROM f)
SELECT r.record_id, t.section, t.field, f.value, t.section_pos, t.field_pos
FROM r CROSS JOIN t LEFT JOIN f ON f.record_id = r.record_id AND f.field = t.field
""")
def template_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.project_template(segment_fields(spark, sf_dir), region_template(spark, sf_dir))


@register("section_extraction", oracle=f"""
WITH {T_SQL}, {F_SQL}
SELECT f.record_id, t.section, t.field, f.value, t.section_pos, t.field_pos
FROM f JOIN t ON f.field = t.field WHERE t.section IN ('EUROPE', 'ASIA', 'NOWHERE')
""")
def section_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.extract_sections(segment_fields(spark, sf_dir), region_template(spark, sf_dir),
                                    ["EUROPE", "ASIA", "NOWHERE"])


@register("template_inversion", oracle=f"""
WITH {T2_SQL}
SELECT field, arg_max(section, section_pos * 1000 + field_pos) AS section FROM t2 GROUP BY field
""")
def template_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.invert_template(letter_template(spark, sf_dir))


@register("record_flatten", oracle=f"""
WITH {T_SQL}, {F_SQL}, r AS (SELECT DISTINCT record_id FROM f)
SELECT r.record_id, concat_ws('__', t.section, t.field) AS "column", f.value
FROM r CROSS JOIN t LEFT JOIN f ON f.record_id = r.record_id AND f.field = t.field
""")
def record_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.flatten_records(template_projection(spark, sf_dir))


@register("field_lookup_first", oracle=f"""
WITH {T2_SQL}, {F_SQL}
SELECT record_id, field, section, trim(value) AS value FROM (
  SELECT f.record_id, t2.field, t2.section, f.value,
         row_number() OVER (PARTITION BY f.record_id, t2.field
                            ORDER BY t2.section_pos, t2.field_pos) AS rn
  FROM f JOIN t2 ON f.field = t2.field
  WHERE t2.field IN ('NATION_3', 'NATION_7', 'ATLANTIS') AND f.value <> '')
WHERE rn = 1
""")
def field_lookup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    t2 = letter_template(spark, sf_dir)
    mapped = records.project_template(segment_fields(spark, sf_dir), t2)
    return records.lookup_first(mapped, t2, ["NATION_3", " NATION_7 ", "ATLANTIS"])


M_SQL = """m AS (
  SELECT l_orderkey AS record_id, l_linestatus AS section, l_returnflag AS field,
         CAST(l_partkey AS VARCHAR) AS value,
         row_number() OVER (PARTITION BY l_orderkey, l_linestatus, l_returnflag
                            ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC,
                                     l_suppkey DESC, l_extendedprice DESC) AS rn
  FROM lineitem)"""


def line_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("record_id"), F.col("l_linestatus").alias("section"),
                     F.col("l_returnflag").alias("field"),
                     F.col("l_partkey").cast("string").alias("value"),
                     F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey",
                              "l_extendedprice").alias("source"))


@register("merge_sources", oracle=f"""
WITH {M_SQL} SELECT record_id, section, field, value FROM m WHERE rn = 1
""")
def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.merge_sources(line_sources(spark, sf_dir), "source")


@register("flatten_sections", oracle=f"""
WITH {M_SQL}
SELECT record_id, field, arg_max(value, CASE section WHEN 'F' THEN 0 ELSE 1 END) AS value
FROM m WHERE rn = 1 GROUP BY record_id, field
""")
def flatten_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge_sources(spark, sf_dir)
    mapped = merged.select("record_id", "section", "field", "value",
                           F.when(F.col("section") == "F", 0).otherwise(1).alias("section_pos"),
                           F.lit(0).alias("field_pos"))
    return records.flatten_sections(mapped)


@register("patient_header", oracle="""
WITH d AS (
  SELECT o_custkey, strftime(min(o_orderdate), '%m/%d/%Y') AS dob,
         strftime(max(o_orderdate), '%m/%d/%Y') AS ev,
         min(o_orderdate) AS b, max(o_orderdate) AS e
  FROM orders GROUP BY o_custkey),
a AS (
  SELECT *, year(e) - year(b) AS y0,
         month(e) - month(b) - CASE WHEN day(e) < day(b) THEN 1 ELSE 0 END AS m0 FROM d)
SELECT c_custkey AS record_id, c_name AS name, '#########' AS medical_record_no,
       coalesce(dob, 'N/A') AS date_of_birth, coalesce(ev, 'N/A') AS dates_of_service,
       CASE WHEN b IS NULL THEN 'Unknown'
            ELSE CAST(y0 - CASE WHEN m0 < 0 THEN 1 ELSE 0 END AS VARCHAR) || '-years, '
                 || CAST(CASE WHEN m0 < 0 THEN m0 + 12 ELSE m0 END AS VARCHAR) || '-months'
       END AS age_at_evaluation
FROM customer LEFT JOIN a ON a.o_custkey = c_custkey
""")
def patient_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    d = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("b"), F.max("o_orderdate").alias("e"))
    fmt = lambda x: F.date_format(x, "MM/dd/yyyy")
    dates = d.select(F.col("o_custkey").alias("record_id"),
                     F.explode(F.array(
                         F.struct(F.lit("Pt DOB").alias("field"), fmt("b").alias("value")),
                         F.struct(F.lit("Form Date").alias("field"), fmt("e").alias("value")))
                     ).alias("_f")).select("record_id", "_f.*")
    names = c.select(F.col("c_custkey").alias("record_id"), F.lit("Pt Name").alias("field"),
                     F.col("c_name").alias("value"))
    fields = dates.unionByName(names).withColumn("ord", F.lit(0))
    h = records.patient_header(fields)
    return h.drop("examiners")


@register("forward_fill", oracle="""
SELECT event_id, user_id,
       coalesce(last_value(CASE WHEN event_type = 'signup' THEN props END IGNORE NULLS)
                OVER (PARTITION BY user_id ORDER BY ts, event_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unclassified') AS section
FROM events
""")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    filled = scan.forward_fill(e.select("event_id", "user_id", "ts", "event_type", "props"),
                               ["user_id"], ["ts", "event_id"],
                               F.when(F.col("event_type") == "signup", F.col("props")), "_s")
    return filled.select("event_id", "user_id",
                         F.coalesce("_s", F.lit("unclassified")).alias("section"))


@register("ordered_dedup", oracle="""
WITH f AS (SELECT user_id, event_type, min(ts) AS t0, arg_min(event_id, ts) AS e0
           FROM events GROUP BY user_id, event_type),
u AS (SELECT user_id, row_number() OVER (ORDER BY min(ts), arg_min(event_id, ts), user_id) AS group_pos
      FROM events GROUP BY user_id)
SELECT f.user_id, u.group_pos, f.event_type,
       row_number() OVER (PARTITION BY f.user_id ORDER BY t0, e0, event_type) AS item_pos
FROM f JOIN u ON f.user_id = u.user_id
""")
def ordered_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return records.ordered_dedup(e, ["user_id"], "event_type", ["ts", "event_id"])


@register("section_sheet", oracle="""
WITH x AS (
  SELECT CASE user_id % 3 WHEN 0 THEN 'one' WHEN 1 THEN 'two' END AS sheet, event_id AS pos,
         CASE WHEN event_id % 5 = 0 THEN 'S' || CAST(event_id % 3 AS VARCHAR) ELSE 'V' || CAST(event_id % 7 AS VARCHAR) END AS item,
         CASE WHEN event_id % 41 = 0 THEN 'A, B' WHEN event_id % 43 = 0 THEN 'C' END AS sec
  FROM events WHERE event_id % 17 <> 0 OR event_id % 5 = 0),
f AS (SELECT sheet, pos, item, coalesce(last_value(sec IGNORE NULLS) OVER (
        PARTITION BY sheet ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unclassified') AS secs FROM x),
e AS (SELECT sheet, pos, item, trim(unnest(string_split(secs, ','))) AS section,
             unnest(range(len(string_split(secs, ',')))) AS p FROM f),
g AS (SELECT sheet, section, row_number() OVER (PARTITION BY sheet ORDER BY min(pos * 10 + p)) AS group_pos FROM e GROUP BY 1, 2),
i AS (SELECT sheet, section, item, row_number() OVER (PARTITION BY sheet, section ORDER BY min(pos * 10 + p)) AS item_pos
      FROM e GROUP BY 1, 2, 3)
SELECT coalesce(i.sheet, 'none') AS sheet, i.section, g.group_pos, i.item, i.item_pos
FROM i JOIN g ON g.sheet IS NOT DISTINCT FROM i.sheet AND g.section = i.section
""")
def section_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN1: several sheets, one of them without a name; rows without an item set no section."""
    e, n = read_table(spark, sf_dir, "events"), F.col("event_id")
    empty = (n % 17 == 0) & (n % 5 != 0)
    sheet = e.select(
        F.when(F.col("user_id") % 3 == 0, "one").when(F.col("user_id") % 3 == 1, "two").alias("sheet"),
        n.alias("row"), F.when(empty, " ").otherwise(F.concat(F.lit("V"), (n % 7).cast("string"))).alias("Variable"),
        F.when(n % 5 == 0, F.concat(F.lit("S"), (n % 3).cast("string"))).alias("Sub Variable"),
        F.when(n % 41 == 0, "A, B").when(n % 43 == 0, "C").alias("Report Section"))
    s = records.section_sheet(sheet, sheet_col="sheet")
    return s.select(F.coalesce("sheet", F.lit("none")).alias("sheet"), "section", "group_pos", "item", "item_pos")


@register("null_group_scans", oracle="""
WITH e AS (SELECT event_id, value, event_type, CASE WHEN user_id % 3 <> 0 THEN user_id END AS u FROM events)
SELECT event_id, row_number() OVER w AS rn, count(*) FILTER (WHERE event_type = 'click') OVER w AS clicks,
       last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS signup,
       lag(event_id) OVER (PARTITION BY u ORDER BY event_id) AS prev
FROM e WINDOW w AS (PARTITION BY u ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def null_group_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ordered scans where the key of a third of the users is null."""
    e = read_table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("u"))
    kind = F.col("event_type")
    e = scan.row_number(e, ["u"], ["event_id"], "rn")
    e = scan.running_sum(e, ["u"], ["event_id"], F.when(kind == "click", 1).otherwise(0).cast("long"), "clicks")
    e = scan.forward_fill(e, ["u"], ["event_id"], F.when(kind == "signup", F.col("event_id")), "signup")
    e = scan.previous_value(e, ["u"], ["event_id"], F.col("event_id"), "prev")
    return e.select("event_id", "rn", "clicks", "signup", "prev")


@register("flag_matrix", oracle="""
SELECT DISTINCT o_custkey AS patient_id, o_orderpriority AS feature FROM orders WHERE o_orderstatus = 'F'
""")
def flag_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ17: true flags alone become indicators; null and false ones don't."""
    o = read_table(spark, sf_dir, "orders")
    flags = o.select(F.col("o_custkey").alias("patient_id"), F.col("o_orderpriority").alias("field"),
                     F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("is_true"))
    return cluster.flag_matrix(flags)


def _json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text per event, of several shapes, some of them no record."""
    e, n = read_table(spark, sf_dir, "events"), F.col("event_id")
    text = (F.when(n % 7 == 0, F.concat(F.lit("{broken "), F.col("props")))
            .when(n % 7 == 1, F.concat(F.lit("["), F.col("props"), F.lit("]")))
            .when(n % 7 == 2, F.lit("{}"))
            .when(n % 7 == 3, F.lit('{"A": true, "B": "true", "C": false, "D": 0, "E": 1, "patient_id": "x"}'))
            .otherwise(F.col("props")))
    return e.select(n.alias("patient_id"), text.alias("json"))


@register("json_records", oracle="""
WITH e AS (SELECT event_id AS patient_id, event_id % 7 AS m, CAST(props ->> '$.k' AS INT) AS k FROM events)
SELECT patient_id, 'k' AS field, k = 1 AS is_true, CASE WHEN k <> 0 THEN CAST(k AS VARCHAR) END AS value FROM e WHERE m > 3
UNION ALL
SELECT patient_id, f.field, f.is_true, f.value FROM e, (VALUES ('A', true, NULL), ('B', false, 'true'), ('C', false, NULL),
  ('D', false, NULL), ('E', true, '1')) AS f(field, is_true, value) WHERE m = 3
""")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1: JSON true and the string "true" stay apart."""
    return files.flags_from_json(_json_records(spark, sf_dir))


@register("json_rejects", oracle="""
SELECT event_id AS patient_id, ['not valid JSON', 'not an object', 'no field'][event_id % 7 + 1] AS reason
FROM events WHERE event_id % 7 < 3
""")
def json_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.json_rejects(_json_records(spark, sf_dir))


@register("nested_mapped", oracle=f"""
WITH {T_SQL}
SELECT CAST(c_custkey AS VARCHAR) AS record_id, section, field, CASE WHEN c_nationkey = field_pos THEN c_mktsegment END AS value,
       CAST(dense_rank() OVER (PARTITION BY c_custkey ORDER BY section_pos) - 1 AS INT) AS section_pos,
       CAST(row_number() OVER (PARTITION BY c_custkey, section ORDER BY field_pos) - 1 AS INT) AS field_pos
FROM customer, t
""")
def nested_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3 nested: mapped records written as JSON and read back, in order."""
    c = read_table(spark, sf_dir, "customer")
    fields = c.join(read_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("record_id"), F.col("n_name").alias("field"), F.col("c_mktsegment").alias("value"))
    mapped = records.project_template(fields, region_template(spark, sf_dir))
    text = files.nested_records(mapped).select(F.concat(F.lit("["), "json", F.lit("]")).alias("t"))
    return files.flatten_mapped(text.select(files.mapped_from_json("t").alias("nested")))


@register("empty_sections", oracle="""
SELECT c_custkey AS record_id, s.section FROM customer JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey, (VALUES ('ASIA'), ('EUROPE'), ('NOWHERE')) AS s(section)
WHERE s.section <> r_name
""")
def empty_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ3: requested sections that a record has nothing for, unknown ones too."""
    c = read_table(spark, sf_dir, "customer")
    fields = c.join(read_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("record_id"), F.col("n_name").alias("field"), F.col("c_mktsegment").alias("value"))
    return records.empty_sections(fields, region_template(spark, sf_dir), ["ASIA", "EUROPE", "NOWHERE"])
