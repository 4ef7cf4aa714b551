"""File sources and sinks (SRC1 - SRC8, SRC11 - SRC16).

Every reader lists and reads files with Spark's own file sources
(``text`` with ``wholetext``, ``binaryFile``, ``csv``, ``parquet``) so the
listing and the reading are distributed; the file path comes from the
``_metadata`` column.  Writers use partitioned writes instead of a loop of
single-file writes on the driver.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import file_name, file_stem
from quire.operators.textops import drop_blank_lines
from quire.sources.sheets import sheet_records

# Fixed values of the reference ------------------------------------------------
ENTITY_PATTERN = r"^BASC-(P\d+)-"  # score-report file name -> patient folder
SOURCE_TAGS = ["np_hx_form", "epic_report"]  # tried in this order, first hit wins
# Windows-1252 characters for bytes 0x80-0x9F, from Python's codec; the five
# bytes undefined there keep the Latin-1 control character of the same code.
CP1252_HIGH = "".join(bytes([b]).decode("cp1252", errors="ignore") or chr(b)
                      for b in range(0x80, 0xA0))
# -------------------------------------------------------------------------------

def _path() -> Column:
    return F.col("_metadata.file_path")


def _parent(path: Column) -> Column:
    """Name of the folder holding the file."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


# SRC1 ---------------------------------------------------------------------------
def read_record_folder(spark: SparkSession, data_dir: str, file: str = "form.json",
                       id_col: str = "patient_id") -> DataFrame:
    """``<dir>/<record>/form.json`` -> long ``flags(patient_id, field, is_true, value)``.

    The folder name is the record id (it overrides a key of that name).
    Values go through VARIANT so JSON ``true`` and the string ``"true"``
    stay apart: ``is_true`` is a boolean true or the number 1 (pandas
    ``== True``); ``value`` keeps strings and other numbers as text (NULL
    for booleans and zero, which are falsy).  Unparsable files give no rows
    (see :func:`read_record_rejects`).
    """
    return flags_from_json(_record_files(spark, data_dir, file, id_col), id_col)


def read_record_rejects(spark: SparkSession, data_dir: str, file: str = "form.json",
                        id_col: str = "patient_id") -> DataFrame:
    """``(patient_id, reason)`` of the record files that give no record (files
    without a byte are not listed by Spark's readers and so not reported)."""
    return json_rejects(_record_files(spark, data_dir, file, id_col), id_col)


def _record_files(spark: SparkSession, data_dir: str, file: str, id_col: str) -> DataFrame:
    return (spark.read.text(f"{data_dir.rstrip('/')}/*/{file}", wholetext=True)
            .select(_parent(_path()).alias(id_col), F.col("value").alias("json")))


def flags_from_json(records: DataFrame, id_col: str = "patient_id", json_col: str = "json") -> DataFrame:
    """SRC1's rule on ``(id, json)`` rows; see :func:`read_record_folder`."""
    m = records.select(id_col, F.try_variant_get(F.try_parse_json(json_col), "$", "map<string,variant>").alias("_m"))
    e = m.select(id_col, F.explode("_m").alias("field", "_x")).where(F.col("field") != id_col)
    t = F.schema_of_variant("_x")
    num = t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL")
    dval = F.try_variant_get("_x", "$", "double")
    is_true = F.when(t == "BOOLEAN", F.try_variant_get("_x", "$", "boolean")) \
        .when(num, dval == 1.0).otherwise(F.lit(False))
    value = F.when(t == "BOOLEAN", F.lit(None).cast("string")) \
        .when(num & (dval == 0.0), F.lit(None).cast("string")) \
        .when(F.is_variant_null("_x"), F.lit(None).cast("string")) \
        .otherwise(F.try_variant_get("_x", "$", "string"))
    return e.select(id_col, "field", is_true.alias("is_true"), value.alias("value"))


def json_rejects(records: DataFrame, id_col: str = "patient_id", json_col: str = "json") -> DataFrame:
    """Records that :func:`flags_from_json` has no row for, with the reason."""
    v = F.try_parse_json(json_col)
    m = F.try_variant_get(v, "$", "map<string,variant>")
    fields = F.filter(F.map_keys(m), lambda k: k != id_col)
    reason = (F.when(F.col(json_col).isNull() | v.isNull(), "not valid JSON")
              .when(m.isNull(), "not an object").when(F.size(fields) == 0, "no field"))
    return records.select(id_col, reason.alias("reason")).where(F.col("reason").isNotNull())


# SRC2 ---------------------------------------------------------------------------
def read_template(spark: SparkSession, path: str) -> DataFrame:
    """JSON ``{section: [field, ...]}`` -> ``(section, section_pos, field, field_pos)``,
    file order kept."""
    raw = spark.read.text(path, wholetext=True)
    m = raw.select(F.from_json("value", "map<string,array<string>>").alias("_m"))
    s = m.select(F.posexplode("_m").alias("section_pos", "section", "_fields"))
    return s.select("section", "section_pos",
                    F.posexplode("_fields").alias("field_pos", "field"))


# SRC3, SRC8 ------------------------------------------------------------------------
def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)


MAPPED_SCHEMA = ("record_id string, section string, field string, value string, "
                 "section_pos int, field_pos int")


def read_mapped(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    r = spark.read.format(fmt)
    if fmt == "json":
        r = r.schema(MAPPED_SCHEMA)
    return r.load(path)


# SRC5 ----------------------------------------------------------------------------
def read_documents(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """One row per document ``(filename, text)``, blank paragraphs dropped."""
    raw = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True)
    return raw.select(file_name(_path()).alias("filename"), drop_blank_lines("value").alias("text"))


# SRC6 ----------------------------------------------------------------------------
def decode_fallback(content: Column | str) -> Column:
    """Bytes as UTF-8 when valid, else as Windows-1252."""
    c = F.col(content) if isinstance(content, str) else content
    latin = F.decode(c, "ISO-8859-1")
    cp1252 = F.translate(latin, "".join(chr(b) for b in range(0x80, 0xA0)), CP1252_HIGH)
    return F.when(F.is_valid_utf8(c), F.decode(c, "UTF-8")).otherwise(cp1252)


def read_text_fallback(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``(file, text)`` for every file, decoded with the charset fallback."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return b.select(file_name("path").alias("file"), decode_fallback("content").alias("text"))


# SRC11, SRC12 ---------------------------------------------------------------------
def list_files(spark: SparkSession, root: str, glob: str | None = None,
               recursive: bool = True) -> DataFrame:
    """``(path, folder, name, stem)`` for matching files; content is pruned."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        r = r.option("pathGlobFilter", glob)
    b = r.load(root).select("path")
    return b.select("path", _parent(F.col("path")).alias("folder"),
                    file_name("path").alias("name"), file_stem("path").alias("stem"))


def first_per_folder(files: DataFrame, suffix: str = ".pdf") -> tuple[DataFrame, DataFrame]:
    """First file with ``suffix`` (any case) per folder in name order, and
    the folders that have none.  A ``min`` per folder, not a window."""
    match = F.lower("name").endswith(suffix.lower())
    first = files.where(match).groupBy("folder").agg(
        F.min(F.struct("name", "path")).alias("_f")).select("folder", "_f.name", "_f.path")
    missing = files.select("folder").distinct().join(first.select("folder"), "folder", "left_anti")
    return first, missing


# SRC13, SRC14 -----------------------------------------------------------------------
def route_entity(names: DataFrame, name_col: str = "name", pattern: str = ENTITY_PATTERN) -> DataFrame:
    """``entity`` from the name (NULL when the pattern does not match)."""
    n = F.col(name_col)
    return names.withColumn("entity", F.when(n.rlike(pattern), F.regexp_extract(n, pattern, 1)))


def source_type(name: Column | str, tags: Sequence[str] = SOURCE_TAGS) -> Column:
    """First tag contained in the lower-cased name, in declared order; NULL if none."""
    n = F.lower(F.col(name) if isinstance(name, str) else name)
    out = F.lit(None).cast("string")
    for t in reversed(list(tags)):
        out = F.when(n.contains(t), F.lit(t)).otherwise(out)
    return out


# SRC3, nested form ------------------------------------------------------------------
NESTED_SCHEMA = "array<struct<patient_id: string, mapped_data: map<string, map<string, string>>>>"


def mapped_from_json(text: Column | str) -> Column:
    """The array of nested records ``{patient_id, mapped_data: {section: {field:
    value}}}`` in a JSON text; null if it isn't one."""
    return F.from_json(F.col(text) if isinstance(text, str) else text, NESTED_SCHEMA)


def flatten_mapped(nested: DataFrame, nested_col: str = "nested", id_col: str = "record_id") -> DataFrame:
    """Nested records to ``(record, section, field, value, section_pos, field_pos)``."""
    r = nested.select(F.explode(nested_col).alias("_r"))
    s = r.select(F.col("_r.patient_id").alias(id_col), F.posexplode("_r.mapped_data").alias("section_pos", "section", "_f"))
    return s.select(id_col, "section", F.posexplode("_f").alias("field_pos", "field", "value"), "section_pos") \
        .select(id_col, "section", "field", "value", "section_pos", "field_pos")


def read_nested_mapped(spark: SparkSession, path: str, id_col: str = "record_id") -> DataFrame:
    """Files that each hold one array of nested records."""
    raw = spark.read.text(path, wholetext=True).select(mapped_from_json("value").alias("nested"))
    return flatten_mapped(raw, "nested", id_col)


def nested_records(mapped: DataFrame, id_col: str = "record_id") -> DataFrame:
    """``(record, json)``: each record in the nested form, sections and fields in
    their order, null values kept as null."""
    fields = mapped.groupBy(id_col, "section").agg(
        F.min("section_pos").alias("_p"),
        F.array_sort(F.collect_list(F.struct("field_pos", "field", "value"))).alias("_f"))
    entry = F.map_from_entries(F.transform("_f", lambda x: F.struct(x["field"], x["value"])))
    data = fields.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_p", "section"))).alias("_o"),
                                      F.map_from_entries(F.collect_list(F.struct("section", entry))).alias("_d"))
    ordered = F.map_from_entries(F.transform("_o", lambda x: F.struct(x["section"], F.element_at("_d", x["section"]))))
    return data.select(id_col, F.to_json(F.struct(F.col(id_col).cast("string").alias("patient_id"),
                                                  ordered.alias("mapped_data")), {"ignoreNullFields": "false"}).alias("json"))


# SRC15 -----------------------------------------------------------------------------
def read_config_sheet(spark: SparkSession, path: str, skip_rows: int = 2,
                      columns: Sequence[str] = ("Variable", "n", "count")) -> DataFrame:
    """CSV config sheet after ``skip_rows`` heading rows; the next row is the
    header; wanted columns missing from the sheet become NULL.  ``pos`` is the
    row position; quoted cells may hold line breaks (see
    :func:`quire.sources.sheets.sheet_records`)."""
    return sheet_rows(sheet_records(spark, path), skip_rows, columns)


def sheet_rows(lines: DataFrame, skip_rows: int = 2, columns: Sequence[str] = ("Variable", "n", "count")) -> DataFrame:
    """SRC15's rule on ``(pos, line)`` rows of a sheet, blank lines included, so
    that they count as rows: the header is row ``skip_rows``, counted from 0 (one
    row comes to the driver); blank lines after it are no data."""
    head = lines.where(F.col("pos") == skip_rows).limit(1).collect()
    empty = [F.lit(None).cast("string").alias(c) for c in columns]
    if not head:
        return lines.where(F.lit(False)).select("pos", *empty)
    names = [(x or "").strip() for x in next(csv.reader([head[0]["line"] or ""]), [])]
    schema = ", ".join(f"_c{i} string" for i in range(max(1, len(names))))
    body = lines.where((F.col("pos") > skip_rows) & (F.trim("line") != "")).select(
        "pos", F.from_csv("line", schema, {"multiLine": "true", "escape": '"'}).alias("_r"))
    return body.select("pos", *[
        (F.col(f"_r._c{names.index(c)}") if c in names else F.lit(None).cast("string")).alias(c) for c in columns])
