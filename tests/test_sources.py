"""File sources and sinks: write, then read back."""

import csv
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from quire.operators import cluster, recommend, reports
from quire.sources import files, named, sheets
from tests.conftest import rows


def write(path, name, content, binary=False):
    os.makedirs(os.path.dirname(os.path.join(path, name)), exist_ok=True)
    with open(os.path.join(path, name), "wb" if binary else "w") as f:
        f.write(content)


def test_record_folder(spark, tmp_dir):
    write(tmp_dir, "P1/form.json", json.dumps({"A": True, "B": True}))
    write(tmp_dir, "P3/form.json", json.dumps({"A": True, "N": "7", "Z": 0, "patient_id": "x"}))
    write(tmp_dir, "P4/form.json", json.dumps({"A": "true", "D": True}))
    write(tmp_dir, "P5/notes.txt", "skip")
    f = files.read_record_folder(spark, tmp_dir)
    got = rows(f, "patient_id", "field", "is_true", "value")
    assert ("P3", "N", False, "7") in got and ("P4", "A", False, "true") in got
    assert ("P1", "A", True, None) in got and ("P3", "Z", False, None) in got
    assert not any(r[1] == "patient_id" for r in got)


def test_template_keeps_file_order(spark, tmp_dir):
    write(tmp_dir, "t.json", '{"School": ["School Type Public", "Grade"], "Medical": ["Asthma", "Grade"]}')
    t = files.read_template(spark, os.path.join(tmp_dir, "t.json"))
    assert rows(t, "section_pos", "field_pos", "section", "field") == [
        (0, 0, "School", "School Type Public"), (0, 1, "School", "Grade"),
        (1, 0, "Medical", "Asthma"), (1, 1, "Medical", "Grade")]


def test_listing_routing_and_first(spark, tmp_dir):
    for name in ["f1/b.PDF", "f1/a.pdf", "f2/x.txt", "BASC-P1-2025-Mother.pdf", "report.pdf"]:
        write(tmp_dir, name, b"%PDF", binary=True)
    listing = files.list_files(spark, tmp_dir)
    first, missing = files.first_per_folder(listing)
    assert ("f1", "a.pdf") in rows(first, "folder", "name")
    assert rows(missing, "folder") == [("f2",)]
    ent = dict(rows(files.route_entity(listing).select("name", "entity")))
    assert ent["BASC-P1-2025-Mother.pdf"] == "P1" and ent["report.pdf"] is None
    names = spark.createDataFrame([("X_NP_HX_FORM.pdf",), ("epic_report_1.pdf",), ("notes.pdf",)], "n string")
    assert [r[0] for r in names.select(files.source_type("n")).collect()] == ["np_hx_form", "epic_report", None]


def test_fallback_files_and_documents(spark, tmp_dir):
    write(tmp_dir, "a.json", bytes([0x93, 0x61, 0x62, 0x94]), binary=True)
    write(tmp_dir, "b.json", "ok é".encode(), binary=True)
    got = dict(rows(files.read_text_fallback(spark, tmp_dir, "*.json")))
    assert got == {"a.json": "“ab”", "b.json": "ok é"}
    write(tmp_dir, "docs/d.txt", "one\n\n  \ntwo\n")
    assert rows(files.read_documents(spark, os.path.join(tmp_dir, "docs"))) == [("d.txt", "one\ntwo")]


def test_config_sheet(spark, tmp_dir):
    write(tmp_dir, "c.csv", "title,,\nnote,,\nVariable,count,extra\nAsthma,13,x\nAge,6 - 18,y\n")
    c = files.read_config_sheet(spark, os.path.join(tmp_dir, "c.csv"))
    assert [tuple(r)[1:] for r in c.orderBy("pos").collect()] == [("Asthma", None, "13"), ("Age", None, "6 - 18")]


def test_table_roundtrip_and_per_key(spark, tmp_dir):
    df = spark.createDataFrame([("r", "S", "f", "v", 0, 0)], files.MAPPED_SCHEMA)
    files.write_table(df, os.path.join(tmp_dir, "m"), "json")
    assert rows(files.read_mapped(spark, os.path.join(tmp_dir, "m"), "json")) == rows(df)
    named.stem_files(spark.createDataFrame([("k1", "<p>x</p>")], "k string, html string"),
                     os.path.join(tmp_dir, "html"), "k", "html", ".html")
    assert open(os.path.join(tmp_dir, "html", "k1.html")).read() == "<p>x</p>"


def test_cluster_report_roundtrip(spark, tmp_dir):
    m = spark.createDataFrame([(0, "Ada_1.json", "rest", 0), (1, "Ben x.json", "rest more", 0),
                               (2, "Cy.json", "walk", 0), (3, "Dee.json", "alone", -1)],
                              "idx long, file string, recommendation string, cluster_id long")
    summ = cluster.cluster_summary(m)
    reps = spark.createDataFrame([(0, "rest")], "cluster_id long, representative string")
    lines = recommend.report_lines(m, summ, reps)
    path = os.path.join(tmp_dir, "report")
    recommend.write_report(lines, path)
    clusters, counts = recommend.parse_report(spark, path)
    c = clusters.first()
    assert (c["cluster_id"], c["representative"], c["providers"]) == (0, "rest", ["Ada", "Ben", "Cy"])
    # member lines keep the extension when the name has neither '_' nor ' '
    assert rows(counts, "provider", "n") == [("Ada", 1), ("Ben", 1), ("Cy.json", 1)]


def test_generate_and_collect(spark):
    p = spark.createDataFrame([("k", "S1", "p1"), ("k", "S2", "bad")], "k string, section string, prompt string")

    def gen(prompts):
        if "bad" in prompts:
            raise ValueError("refused")
        return [x.upper() + "<think>z</think>" for x in prompts]
    ans = reports.generate(p, gen)
    req = spark.createDataFrame([("k", "S1", 0), ("k", "S2", 1), ("k", "S3", 2)], "k string, section string, pos int")
    got = rows(reports.collect_sections(req, ans, ["k"]), "section", "text")
    assert got == [("S1", "P1"), ("S2", "Error: refused"), ("S3", "Missing")]
    ordered = reports.order_sections(reports.collect_sections(req, ans, ["k"]), ["S1", "S2"], lead="S3")
    assert rows(ordered, "section", "section_id") == [("S1", 1), ("S2", 2), ("S3", 0)]
    hdr = spark.createDataFrame([("k", "<Kim>", "N/A", "N/A", "Unknown")],
                                "k string, name string, date_of_birth string, dates_of_service string, "
                                "age_at_evaluation string")
    html = reports.render_report(ordered, hdr, "k").first()["html"]
    assert "&lt;Kim&gt;" in html and html.index("section-0") < html.index("section-1")


def test_udf_surface(spark):
    import numpy as np

    from quire.functions import text as T
    from quire.operators import textops, udfs
    d = spark.createDataFrame([(1, "ab cd"), (2, "")], "id int, text string")
    assert [r[0] for r in d.orderBy("id").select(textops.token_counter()("text")).collect()] == [5, 0]
    assert [r[0] for r in d.orderBy("id").select(textops.token_counter(len)("text")).collect()] == [5, 0]
    e = udfs.embed(d, "text", encoder=lambda ts: np.array([[len(t), 1.0] for t in ts]))
    vecs = {r["id"]: r["embedding"] for r in e.collect()}
    assert abs(sum(x * x for x in vecs[1]) - 1) < 1e-6
    page = d.select(T.html_page(F.lit("T"), T.paragraphs_html("text", escape=True))).first()[0]
    assert page.startswith("<!DOCTYPE html>") and "<h1>T</h1>" in page
    prompt = d.select(reports.build_file_prompt("text", F.lit("f.json"), "{}")).first()[0]
    assert "f.json" in prompt and "```json" in prompt


def test_record_folder_numeric_one_is_true(spark, tmp_dir):
    write(tmp_dir, "P9/form.json", json.dumps({"A": 1, "B": 2, "C": False}))
    got = rows(files.read_record_folder(spark, tmp_dir), "field", "is_true", "value")
    assert got == [("A", True, "1"), ("B", False, "2"), ("C", False, None)]


def test_record_rejects(spark, tmp_dir):
    for name, text in (("P1", '{"A": true}'), ("P2", "{broken"), ("P3", "[1]"), ("P4", '{"patient_id": "x"}'), ("P5", " ")):
        write(tmp_dir, f"{name}/form.json", text)
    assert rows(files.read_record_rejects(spark, tmp_dir)) == [
        ("P2", "not valid JSON"), ("P3", "not an object"), ("P4", "no field"), ("P5", "not valid JSON")]
    assert rows(files.read_record_folder(spark, tmp_dir), "patient_id", "field") == [("P1", "A")]


def test_nested_records_round_trip(spark, tmp_dir):
    write(tmp_dir, "all.json", json.dumps([
        {"patient_id": "P1", "mapped_data": {"Zoo": {"b": "1", "a": None}, "Art": {}}},
        {"patient_id": "P2", "mapped_data": {"Art": {"x": "é \"q\""}}}], indent=4))
    m = files.read_nested_mapped(spark, os.path.join(tmp_dir, "all.json"))
    got = rows(m, "record_id", "section_pos", "section", "field_pos", "field", "value")
    assert got == [("P1", 0, "Zoo", 0, "b", "1"), ("P1", 0, "Zoo", 1, "a", None), ("P2", 0, "Art", 0, "x", 'é "q"')]
    back = dict(rows(files.nested_records(m), "record_id", "json"))
    assert json.loads(back["P1"]) == {"patient_id": "P1", "mapped_data": {"Zoo": {"b": "1", "a": None}}}


def test_blank_rows_keep_the_header_in_place(spark, tmp_dir):
    write(tmp_dir, "b.csv", "title,,\n\nVariable,count,n\n\n\"A, b\",13,x\nAge,6 - 18,\n")
    c = files.read_config_sheet(spark, os.path.join(tmp_dir, "b.csv"))
    assert [tuple(r) for r in c.orderBy("pos").collect()] == [(4, "A, b", "x", "13"), (5, "Age", None, "6 - 18")]
    write(tmp_dir, "e.csv", "only\n")
    assert files.read_config_sheet(spark, os.path.join(tmp_dir, "e.csv")).count() == 0


def test_report_names_with_quotes(spark, tmp_dir):
    m = spark.createDataFrame([(0, "O'Brien_1.json", "rest", 0), (0, 'Lee "x"_2.json', "rest more", 1), (0, "D'A \"q\"_3.json", "r", 2)],
                              "cluster_id int, file string, recommendation string, idx int")
    reps = spark.createDataFrame([(0, "rest")], "cluster_id int, representative string")
    path = os.path.join(tmp_dir, "quoted")
    recommend.write_report(recommend.report_lines(m, cluster.cluster_summary(m), reps), path)
    lines = [r[0] for r in spark.read.text(path).collect()]
    assert recommend.TITLE in lines and """Providers in cluster: ["O'Brien", 'Lee "x"', 'D\\'A "q"']""" in lines
    clusters, counts = recommend.parse_report(spark, path)
    assert clusters.first()["providers"] == ["O'Brien", 'Lee "x"', "D'A \"q\""]
    assert sorted(r["n"] for r in counts.collect()) == [1, 1, 1]


SHEET = ["title,,", '"note', 'with ""quotes"" and', '', ' breaks",x,', "Variable,n,count", "plain,1,2", "", '"a', '', 'b",3,4', "c,,5",
         '"d ""x"" e",6,7', '"', '",8,9', '"""q""', '",10,"11,', '12"']


@pytest.mark.parametrize("size", ["701", "64m"])
def test_sheet_rows_from_any_splits(spark, tmp_dir, size):
    lines = SHEET + SHEET[6:] * 25
    for ending, name in (("\n", "s.csv"), ("\r\n", "w.csv")):
        write(tmp_dir, name, ending.join(lines) + ending)
    want = list(csv.reader(io.StringIO("\n".join(lines) + "\n", newline="")))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for name in ("s.csv", "w.csv"):
            got = [r["line"] for r in sheets.sheet_records(spark, os.path.join(tmp_dir, name)).orderBy("pos").collect()]
            assert [next(csv.reader(io.StringIO(x.replace("\r\n", "\n"), newline="")), []) for x in got] == want
        c = files.read_config_sheet(spark, os.path.join(tmp_dir, "s.csv")).orderBy("pos").collect()
        assert [tuple(r) for r in c][:6] == [
            (3, "plain", "1", "2"), (5, "a\n\nb", "3", "4"), (6, "c", None, "5"), (7, 'd "x" e', "6", "7"), (8, "\n", "8", "9"),
            (9, '"q"\n', "10", "11,\n12")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def _all_files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)


def test_named_files_are_published_whole_or_not_at_all(spark, tmp_dir):
    root = os.path.join(tmp_dir, "named")
    df = spark.createDataFrame([("P1", "{}"), ("P2 é", '{"a": "é"}'), ("P3", None)], "id string, json string").repartition(3)
    named.entity_files(df, root, "id", "json")
    assert _all_files(root) == ["P1/form.json", "P2 é/form.json", "P3/form.json"]
    assert open(os.path.join(root, "P2 é", "form.json")).read() == '{"a": "é"}' and os.path.getsize(os.path.join(root, "P3/form.json")) == 0
    # names that can't be, names that repeat, tasks that fail: nothing appears
    for bad in (None, "../x", "/x", "", "_x", "a//b"):
        with pytest.raises(Exception, match="not a file name"):
            named.write_named(spark.createDataFrame([("ok", "1"), (bad, "2")], "n string, t string"), root, F.col("n"), F.col("t"))
    with pytest.raises(Exception, match="one file name"):
        named.write_named(spark.createDataFrame([("y", "1"), ("y", "2")], "n string, t string").repartition(2), root, F.col("n"), F.col("t"))
    late = spark.range(400).select(F.concat(F.lit("z"), F.col("id").cast("string")).alias("n"),
                                   F.when(F.col("id") == 399, F.raise_error(F.lit("lost"))).otherwise(F.lit("t")).alias("t"))
    with pytest.raises(Exception, match="lost"):
        named.write_named(late, root, F.col("n"), F.col("t"))
    assert _all_files(root) == ["P1/form.json", "P2 é/form.json", "P3/form.json"] and len(os.listdir(root)) == 3
    # files of the same name are replaced
    named.entity_files(df.where("id = 'P1'").withColumn("json", F.lit("new")), root, "id", "json")
    assert open(os.path.join(root, "P1/form.json")).read() == "new" and len(_all_files(root)) == 3
    named.entity_files(df.where("false"), root, "id", "json")
    assert len(_all_files(root)) == 3
