"""Score reports on fixture F9."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import scores
from tests.conftest import rows

HEAD = "Behavior Assessment System for Children {form} Test Date: {date} {label}: Mother Age: 9 Norm Group 1: x "


def report(form="Parent Rating Scales", date="3/7/2021", label="Relationship", block="General Combined 50 61 72"):
    head = HEAD.format(form=form, date=date, label=label)
    if not date:
        head = head.replace("Test Date:  ", "")
    return head + "VALIDITY INDEX SUMMARY " + block + " Percentile"


@pytest.fixture
def reports(spark):
    data = [
        ("p", "r1", report()),
        ("p", "r2", report(block="General Combined " + " ".join(str(40 + i) for i in range(20)))),
        ("p", "r3", report(block="Clinical Combined 55")),
        ("p", "r4", report(block="nothing")),
        ("p", "r5", report(date="")),
        ("p", "r6", report(form="Teacher Rating Scales", label="Rater Position")),
    ]
    return scores.parse_headers(spark.createDataFrame(data, "patient_id string, report string, text string"))


def test_headers(reports):
    h = {r["report"]: r for r in reports.collect()}
    assert h["r1"]["rater_label"] == "3/7/2021, (Mother)"
    assert h["r5"]["rater_label"] == "Unknown, (Mother)"
    assert h["r6"]["form_type"] == "Rater Position" and h["r6"]["relationship"] == "Mother"


def test_zip(reports):
    z = scores.zip_scores(reports, ["report"])
    got = {(r["report"], r["label"]): r["t_score"] for r in z.collect()}
    assert got[("r1", "Hyperactivity")] == "50" and got[("r1", "Conduct Problems")] == "72"
    assert ("r1", "Anxiety") not in got
    assert sum(1 for k in got if k[0] == "r2") == 18  # 20 numbers, 18 labels
    assert got[("r3", "Hyperactivity")] == "55"
    assert not any(k[0] == "r4" for k in got)
    assert rows(scores.score_rejects(reports, ["report"]), "report") == [("r4",)]
    assert sum(1 for k in got if k[0] == "r6") == 3


@pytest.mark.parametrize("v,adaptive,band", [
    ("59", False, None), ("60", False, "at risk"), ("70", False, "significant"),
    ("41", True, None), ("40", True, "at risk"), ("31", True, "at risk"), ("30", True, "significant"),
    ("n/a", False, None), (" 65 ", False, "at risk")])
def test_bands(spark, v, adaptive, band):
    df = spark.createDataFrame([(v, adaptive)], "v string, a boolean")
    assert df.select(T.severity_band("v", "a")).first()[0] == band


def test_table_rows_and_order(spark, reports):
    z = scores.zip_scores(reports, ["patient_id", "report"])
    t = scores.table_rows(reports.select("patient_id", "report"), z, ["patient_id", "report"])
    r1 = {r["label"]: r for r in t.where("report = 'r1'").collect()}
    assert len(r1) == 18 and r1["Anxiety"]["value"] == "n/a" and r1["Hyperactivity"]["band"] is None
    r2 = {r["label"]: r for r in t.where("report = 'r2'").collect()}
    assert r2["Adaptive Skills"]["display"].endswith("*")
    o = scores.rater_order(reports.withColumn("report_pos", F.col("report")), ["patient_id"])
    order = [r["report"] for r in o.orderBy("rater_pos").collect()]
    assert order[-1] == "r5"  # unknown date sorts last


def test_profile_positions(spark):
    tree = spark.createDataFrame(
        [(s, si, sub, j) for si, (s, subs) in enumerate(scores.PARENT_TREE) for j, sub in enumerate(subs)],
        "scale string, scale_pos int, subscale string, sub_pos int")
    p = {r["label"]: r for r in scores.profile_positions(tree).collect()}
    assert p["Hyperactivity"]["pos"] == 0 and p["Externalizing Problems"]["pos"] == 3
    assert p["Anxiety"]["pos"] == 4 and p["Externalizing Problems"]["group_mid"] == 1.5
    assert p["Adaptive Skills"]["group_hi"] == 17.5


def test_scale_union(spark):
    t = spark.createDataFrame(
        [(0, "S1", 0, "a", 0), (0, "S1", 0, "b", 1), (1, "S2", 0, "c", 0), (1, "S1", 1, "z", 0),
         (1, "S1", 1, "a", 1)], "report_pos int, scale string, scale_pos int, subscale string, sub_pos int")
    got = rows(scores.scale_union(t), "scale_rank", "sub_rank", "subscale")
    assert got == [(1, 1, "a"), (1, 2, "b"), (1, 3, "z"), (2, 1, "c")]


def test_combined_table(spark, reports):
    z = scores.zip_scores(reports, ["patient_id", "report"])
    wide = scores.combined_table(reports.select("patient_id", "report"), z, "patient_id", "report",
                                 ["r1", "r4", "r9"])
    row = {r["label"]: r for r in wide.collect()}
    assert len(row) == 18
    assert (row["Hyperactivity"]["r1"], row["Hyperactivity"]["r4"], row["Hyperactivity"]["r9"]) == ("50", "n/a", None)
    assert row["Adaptive Skills"]["r1"] == "n/a"


def test_profile_split(spark):
    tree = spark.createDataFrame(
        [(s, si, sub, j) for si, (s, subs) in enumerate(scores.PARENT_TREE) for j, sub in enumerate(subs)],
        "scale string, scale_pos int, subscale string, sub_pos int")
    p = scores.profile_positions(tree).collect()
    assert {r["split_at"] for r in p} == {12}  # composite at position 11


def test_combined_long_over_the_union_tree(spark):
    reports = spark.createDataFrame(
        [("P", "r1", "1/2/2020, (Mother)", 0), ("P", "r2", "3/4/2021, (Mother)", 1), ("P", "r3", "no date", 2), ("Q", "q1", "1/1/2020, (x)", 0)],
        "patient string, report string, rater_label string, report_pos int")
    values = spark.createDataFrame([("P", "r1", "a", "71"), ("P", "r2", "a", "50"), ("P", "r2", "a", "61"), ("P", "r3", "b", "7"), ("Q", "q1", "z", "1")],
                                   "patient string, report string, label string, t_score string")
    trees = spark.createDataFrame(
        [("P", 0, "S", 0, "a", 0), ("P", 1, "S", 0, "b", 0), ("P", 1, "T", 1, "c", 0), ("Q", 0, "U", 0, "z", 0)],
        "patient string, report_pos int, scale string, scale_pos int, subscale string, sub_pos int")
    got = scores.combined_long(reports, values, "patient", "report", trees=trees)
    p = got.where("patient = 'P'").orderBy("rater_pos", "row_pos").collect()
    assert [r["label"] for r in p if r["rater_pos"] == 1] == ["S", "a", "b", "T", "c"]
    cells = {(r["rater_pos"], r["label"]): r["display"] for r in p}
    assert len(p) == 15 and (cells[1, "a"], cells[2, "a"], cells[3, "b"], cells[3, "c"]) == ("61", "71", "7", "n/a")
    assert {r["rater_label"] for r in p if r["rater_pos"] == 1} == {"3/4/2021, (Mother)"}
    assert rows(got.where("patient = 'Q'"), "row_pos", "label", "display") == [(0, "U", "n/a"), (1, "z", "1")]
    html = {r["patient"]: r["html"] for r in scores.score_table_html(got, "patient", F.lit("<T>")).collect()}
    assert "&lt;T&gt;" in html["P"] and html["P"].count("<tr>") == 6 and "background-color: red" in html["P"]


def test_two_reports_of_one_rater_do_not_stop_the_table(spark):
    values = spark.createDataFrame([("P", "M", "Anxiety", 50), ("P", "M", "Anxiety", 60)], "patient string, rater string, label string, t_score int")
    wide = scores.combined_table(values.select("patient", "rater"), values, "patient", "rater", ["M"])
    assert {r["M"] for r in wide.where("label = 'Anxiety'").collect()} == {"60"}


def test_packed_reports_give_the_same_table(spark):
    reports = spark.createDataFrame(
        [("P", "r1", "1/2/2020, (Mother)", 0), ("P", "r2", "3/4/2021, <x>", 1), ("Q", "q1", "no date", 0), (None, "n", "1/1/2020, (x)", 0)],
        "patient string, report string, rater_label string, report_pos int")
    values = spark.createDataFrame(
        [("P", "r1", "Anxiety", "71"), ("P", "r1", "Anxiety", "9"), ("P", "r2", "Leadership", "30"), ("P", "r2", "Adaptive Skills", "38"),
         ("P", "r2", None, "50"), ("Q", "q1", "Depression", "x"), (None, "n", "Anxiety", "60")],
        "patient string, report string, label string, t_score string")
    trees = spark.createDataFrame([("P", 0, "S", 0, "Anxiety", 0), ("P", 1, "Adaptive Skills", 1, "Leadership", 0), ("Q", 0, "U", 0, "z", 0)],
                                  "patient string, report_pos int, scale string, scale_pos int, subscale string, sub_pos int")
    for of in (None, trees):
        long = scores.combined_long(reports, values, "patient", "report", trees=of)
        packed = scores.combined_long(reports, values, "patient", "report", trees=of, packed=True)
        assert packed.count() == (4 if of is None else 3)
        want = rows(scores.score_table_html(long, "patient", F.lit("T")), "patient", "html")
        assert rows(scores.score_table_html(packed, "patient", F.lit("T")), "patient", "html") == want
        assert any("71" in h and "darkblue" in h and "lightblue" in h and "&lt;x&gt;" in h for _, h in want)


def test_packed_scores_give_the_same_table(spark):
    labels = [x[1] for x in scores.tree_rows()]
    block = "Behavior Assessment System for Children {} Age: 9 Norm Group 1: General VALIDITY INDEX SUMMARY General Combined {} Percentile 50"
    texts = [("P", 0, block.format("Relationship: M", "9 70 58")), ("P", 1, block.format("Relationship: M", "10 7 058 1")),
             ("P", 2, block.format("Rater Position: T", " ".join(str(i) for i in range(30, 55)))), ("Q", 0, "no scores"),
             (None, 0, block.format("Relationship: M", "5"))]
    reports = scores.parse_headers(spark.createDataFrame(texts, "patient string, n int, text string"))
    long = scores.zip_scores(reports, ["patient", "n", "relationship"])
    packed = scores.zip_scores(reports, ["patient", "n", "relationship"], packed=labels)
    assert packed.count() == 4  # a row for every report with a score block
    keys, raters = reports.select("patient", "relationship"), ["M", "T"]
    want = rows(scores.combined_table(keys, long, "patient", "relationship", raters))
    got = scores.combined_table(keys, packed, "patient", "relationship", raters)
    assert rows(got) == want and len(want) == 3 * 18
    assert {r["M"] for r in got.where("patient = 'P' AND label = 'Conduct Problems'").collect()} == {"58"}
