"""Record and template operators on fixtures F1, F2, F5, F10, F12."""

import pytest
from pyspark.sql import functions as F

from quire.functions.dates import age_at
from quire.operators import records
from quire.sources import files
from tests.conftest import rows

TEMPLATE = [("School", 0, "School Type Public", 0), ("School", 0, "Grade", 1),
            ("Medical", 1, "Asthma", 0), ("Medical", 1, "Grade", 1)]
RAW = [("P1", "(Grade)", "(4)", 0), ("P1", "(Asthma)", "/On", 1), ("P1", "(Grade)", "(5)", 2),
       ("P2", "(Grade)", None, 0), ("P2", "(Other)", "(x)", 1), ("P10", "(Grade)", "( 6 )", 0)]


@pytest.fixture
def tmpl(spark):
    return spark.createDataFrame(TEMPLATE, "section string, section_pos int, field string, field_pos int")


@pytest.fixture
def fields(spark):
    raw = spark.createDataFrame(RAW, "record_id string, field string, value string, ord int")
    return records.clean_form_fields(raw)


def test_clean_form_fields(fields):
    got = rows(fields, "record_id", "field", "value")
    assert got == [("P1", "Asthma", "O"), ("P1", "Grade", "5"), ("P10", "Grade", " 6 "),
                   ("P2", "Other", "x")]


def test_project_template(fields, tmpl):
    p = records.project_template(fields, tmpl)
    assert p.count() == 12
    assert p.where(F.col("value").isNotNull()).count() == 5


def test_extract_sections(fields, tmpl):
    got = rows(records.extract_sections(fields, tmpl, ["Medical", "Nope"]), "record_id", "section", "field")
    assert got == [("P1", "Medical", "Asthma"), ("P1", "Medical", "Grade"), ("P10", "Medical", "Grade")]


def test_invert_last_section_wins(tmpl):
    got = dict(rows(records.invert_template(tmpl), "field", "section"))
    assert got["Grade"] == "Medical" and got["Asthma"] == "Medical"


def test_lookup_first(fields, tmpl):
    mapped = records.project_template(fields, tmpl)
    got = rows(records.lookup_first(mapped, tmpl, [" Grade "]), "record_id", "section", "value")
    assert got == [("P1", "School", "5"), ("P10", "School", "6")]


def test_flatten_sections(spark):
    m = spark.createDataFrame(
        [("r1", "S1", "a", "1", 0, 0), ("r1", "S2", "a", "2", 1, 0), ("r1", None, "x", "9", None, None),
         ("r2", None, "x", "7", None, None)],
        "record_id string, section string, field string, value string, section_pos int, field_pos int")
    got = rows(records.flatten_sections(m), "record_id", "field", "value")
    assert got == [("r1", "a", "2"), ("r2", "x", "7")]


def test_section_sheet(spark):
    sheet = spark.createDataFrame(
        [(1, "a", None, None), (2, "'b',", None, "S1, S2"), (3, None, None, "S9"),
         (4, "c", "c1", None), (5, "b", None, "S2")],
        "row int, Variable string, `Sub Variable` string, `Report Section` string")
    out = records.section_sheet(sheet)
    got = {}
    for r in out.orderBy("group_pos", "item_pos").collect():
        got.setdefault(r["section"], []).append(r["item"])
    assert got == {"unclassified": ["a"], "S1": ["b", "c1"], "S2": ["b", "c1"]}


@pytest.mark.parametrize("b,e,expected", [
    ("01/31/2010", "02/28/2021", "11-years, 0-months"),
    ("11/20/2010", "03/05/2021", "10-years, 3-months"),
    ("3/7/2010", "3/7/2021", "11-years, 0-months"),
    (None, "03/05/2021", "Unknown"),
    ("13/45/2010", "03/05/2021", "Unknown"),
    ("3/7/10", "3/7/2021", "Unknown"),
])
def test_age_at(spark, b, e, expected):
    df = spark.createDataFrame([(b, e)], "b string, e string")
    assert df.select(age_at("b", "e")).first()[0] == expected


def test_patient_header(spark):
    f = spark.createDataFrame([("p", "Pt Name", "Kim", 0), ("p", "Pt DOB", "01/31/2010", 1),
                               ("p", "Form Date", "02/28/2021", 2), ("q", "Other", "x", 0)],
                              "record_id string, field string, value string, ord int")
    h = {r["record_id"]: r for r in records.patient_header(f, examiners=["E1"]).collect()}
    assert h["p"]["age_at_evaluation"] == "11-years, 0-months" and h["p"]["name"] == "Kim"
    assert h["q"]["name"] == "Unknown" and h["q"]["date_of_birth"] == "N/A"
    assert h["q"]["medical_record_no"] == "#########" and h["p"]["examiners"] == ["E1"]


def test_merge_sources_and_routing(spark):
    f = spark.createDataFrame(
        [("p", "X_NP_HX_FORM.pdf", "S", "f", "old"), ("p", "epic_report_1.pdf", "S", "f", "new"),
         ("p", "notes.pdf", "S", "g", "skip")],
        "record_id string, source_file string, section string, field string, value string")
    typed = f.withColumn("kind", files.source_type("source_file")).where(F.col("kind").isNotNull())
    got = rows(records.merge_sources(typed, "source_file"), "record_id", "section", "field", "value")
    # the later file name (byte order: 'epic...' after 'X_...') wins
    assert got == [("p", "S", "f", "new")]


def test_large_templates_have_a_result(spark):
    n = 60_000
    t = spark.range(n).select(F.lit("S").alias("section"), F.lit(0).alias("section_pos"),
                              F.concat(F.lit("f"), "id").alias("field"), F.col("id").cast("int").alias("field_pos"))
    f = spark.createDataFrame([("r1", "f7", "x", 0), ("r2", "none", "y", 0)], "record_id string, field string, value string, ord int")
    out = records.project_template(f, t)
    assert out.count() == 2 * n and [tuple(r) for r in out.where("value IS NOT NULL").select("record_id", "field", "value").collect()] == [("r1", "f7", "x")]
