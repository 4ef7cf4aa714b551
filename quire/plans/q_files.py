"""File round trips: given rows are written as the files that the readers
expect, under exact names, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import synth
from quire.plans.catalog import register
from quire.session import read_table, shared_path
from quire.sources import files, named


@register("sheet_scan", oracle="""
SELECT row_number() OVER (ORDER BY o_orderkey) + 2 AS pos,
       'order ' || CAST(o_orderkey AS VARCHAR) || chr(10) || 'says "' || o_orderpriority || '",' || chr(10) AS "Variable",
       o_orderstatus AS n, CAST(o_custkey AS VARCHAR) AS "count"
FROM orders
""")
def sheet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC15: orders as a sheet whose cells hold line breaks, quotes and commas."""
    o = read_table(spark, sf_dir, "orders")
    row = F.concat(F.lit('"order '), F.col("o_orderkey").cast("string"), F.lit('\nsays ""'), F.col("o_orderpriority"),
                   F.lit('"",\n",'), F.col("o_orderstatus"), F.lit(","), F.col("o_custkey").cast("string"))
    heads = ['"Orders,\nall of ""them""",,', ",,", "Variable,n,count"]
    head = spark.range(len(heads)).select((F.col("id") - len(heads)).alias("k"),
                                          F.get(F.array(*[F.lit(h) for h in heads]), F.col("id").cast("int")).alias("line"))
    path = shared_path(spark, "sheet")
    (head.unionByName(o.select(F.col("o_orderkey").alias("k"), row.alias("line")))
     .repartitionByRange("k").sortWithinPartitions("k").select("line").write.text(path))
    return files.read_config_sheet(spark, path)


@register("entity_files", oracle="""
SELECT 'P' || CAST(s_suppkey AS VARCHAR) AS patient_id, 'Name' AS field, false AS is_true, s_name || ' "é"' AS value FROM supplier
UNION ALL SELECT 'P' || CAST(s_suppkey AS VARCHAR), 'Nation ' || CAST(s_nationkey AS VARCHAR), true, NULL FROM supplier
""")
def entity_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4 and SRC1: a folder with ``form.json`` for every supplier."""
    s = read_table(spark, sf_dir, "supplier")
    both = F.array(F.struct(F.lit("Name").alias("field"), F.lit(None).cast("boolean").alias("is_true"),
                            F.concat("s_name", F.lit(' "é"')).alias("value")),
                   F.struct(F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("field"),
                            F.lit(True).alias("is_true"), F.lit(None).cast("string").alias("value")))
    flags = s.select(F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("patient_id"), F.inline(both))
    path = shared_path(spark, "entities")
    synth.write_patient_folders(flags, path)
    return files.read_record_folder(spark, path)


@register("stem_files", oracle="""
SELECT 'conv ' || CAST(conv_id AS VARCHAR) || '.json' AS file,
       md5('é ' || string_agg(text, chr(10) ORDER BY turn)) AS text_md5
FROM conversations GROUP BY conv_id
""")
def stem_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7 and SRC6: a file for every conversation, about half of them in Windows-1252."""
    c = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    text = F.concat(F.lit("é "), F.array_join("t.text", "\n"))
    one_byte = (F.pmod("conv_id", F.lit(2)) == 1) & text.rlike(r"^[\x00-\x7F\xA0-\xFF]*$")
    body = F.when(one_byte, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    path = shared_path(spark, "stems")
    named.stem_files(c.select(F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("stem"), body.alias("text")), path, "stem", "text")
    return files.read_text_fallback(spark, path, "*.json").select("file", F.md5("text").alias("text_md5"))


@register("document_files", oracle="""
SELECT CAST(s_suppkey AS VARCHAR) || '.txt' AS filename, s_name || chr(10) || CAST(s_nationkey AS VARCHAR) AS text FROM supplier
""")
def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5: documents with blank paragraphs, a file each."""
    s = read_table(spark, sf_dir, "supplier")
    text = F.concat(F.col("s_name"), F.lit("\n\n  \n"), F.col("s_nationkey").cast("string"), F.lit("\n"))
    path = shared_path(spark, "documents")
    named.stem_files(s.select("s_suppkey", text.alias("text")), path, "s_suppkey", "text", ".txt")
    return files.read_documents(spark, path)


@register("report_files", oracle="""
SELECT r_name AS folder, n_name || '.html' AS name, n_name AS stem FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC16 and SRC12: HTML files in folders, listed again."""
    n = read_table(spark, sf_dir, "nation").join(read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = shared_path(spark, "reports")
    named.write_named(n, path, F.concat("r_name", F.lit("/"), "n_name", F.lit(".html")), F.concat(F.lit("<h1>"), "n_name", F.lit("</h1>")))
    return files.list_files(spark, path, "*.html").select("folder", "name", "stem")


@register("template_file", oracle="""
SELECT r_name AS section, CAST(dense_rank() OVER (ORDER BY r_regionkey) - 1 AS INT) AS section_pos, n_name AS field,
       CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS INT) AS field_pos
FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def template_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2: regions as the sections, nations as the fields of a template file."""
    n = read_table(spark, sf_dir, "nation").join(read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    per = n.groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("f"))
    # a template is one small file
    whole = per.agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name", F.col("f.n_name").alias("f")))).alias("s"))
    text = F.to_json(F.map_from_entries(F.transform("s", lambda x: F.struct(x["r_name"], x["f"]))))
    path = shared_path(spark, "template")
    named.stem_files(whole.select(F.lit("template").alias("stem"), text.alias("text")), path, "stem", "text")
    return files.read_template(spark, f"{path}/template.json")
