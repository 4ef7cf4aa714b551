"""Cohort queries on fixture F3 (values read from the reference's rules)."""

import pytest
from pyspark.sql import functions as F

from quire.operators import cohort
from tests.conftest import rows

FLAGS = [
    ("P1", "A", True, None), ("P1", "B", True, None),
    ("P2", "A", True, None), ("P2", "C", True, None), ("P2", "D", True, None),
    ("P3", "A", True, None), ("P3", "N", None, "7"),
    ("P4", "A", None, "true"), ("P4", "D", True, None),
]
TEMPLATE = ["A", "B", "C", "D", "N", "Z"]


@pytest.fixture
def data(spark):
    flags = spark.createDataFrame(FLAGS, "patient_id string, field string, is_true boolean, value string")
    tmpl = spark.createDataFrame([(f,) for f in TEMPLATE], "field string")
    return flags, tmpl


def run(spark, data, q, fn=cohort.cohort_members):
    flags, tmpl = data
    crit = cohort.parse_cohort_text(spark.createDataFrame([(1, q)], "cohort_id int, query string"))
    return [r[0] for r in rows(fn(flags, crit, tmpl), "patient_id")]


@pytest.mark.parametrize("q,expected", [
    ("A", ["P1", "P2", "P3"]),
    ("A, (B OR C)", ["P1", "P2"]),
    ("A, (B OR C), D", ["P2"]),
    ("(N OR B)", ["P1", "P3"]),
    ("N", []),
    ("A, Z", []),
    ("(B OR Z)", ["P1"]),
    ("  A ,  ", ["P1", "P2", "P3"]),
])
def test_and_or(spark, data, q, expected):
    assert run(spark, data, q) == expected


def test_intersection_skips_invalid(spark, data):
    assert run(spark, data, "A, Z", cohort.cohort_intersection) == ["P1", "P2", "P3"]
    assert run(spark, data, "Q", cohort.cohort_intersection) == []


def test_parse_clause_order(spark):
    q = spark.createDataFrame([(7, "A, (B OR C), D")], "cohort_id int, query string")
    got = rows(cohort.parse_cohort_text(q), "clause_id", "kind", "field")
    assert got == [(0, "OR", "B"), (0, "OR", "C"), (1, "AND", "A"), (2, "AND", "D")]


def test_warnings(spark, data):
    flags, tmpl = data
    crit = cohort.parse_cohort_text(spark.createDataFrame([(1, "A, X, Z")], "cohort_id int, query string"))
    msgs = rows(cohort.cohort_warnings(crit, flags, tmpl), "field", "message")
    assert (("X", "field is not in the template") in msgs)
    assert (("Z", "field does not occur in the data") in msgs)
    assert (None, "no valid field in clause: cohort has no result") in msgs


def test_flag_counts_only_true(spark, data):
    flags, _ = data
    got = dict(rows(cohort.flag_counts(flags), "field", "n_patients"))
    assert got["A"] == 3 and got["N"] == 0 and got["D"] == 2


def test_many_cohorts_one_job(spark, data):
    flags, tmpl = data
    qs = spark.createDataFrame([(1, "A"), (2, "A, (B OR C), D"), (3, "N")], "cohort_id int, query string")
    got = rows(cohort.cohort_members(flags, cohort.parse_cohort_text(qs), tmpl))
    assert got == [(1, "P1"), (1, "P2"), (1, "P3"), (2, "P2")]


def test_and_result_inside_single_flags(spark, data):
    both = set(run(spark, data, "A, D"))
    assert both <= set(run(spark, data, "A")) and both <= set(run(spark, data, "D"))


def _cohort_rule(records, template, query):
    """The AND/OR cohort rule written out in plain Python, for comparison."""
    import re
    q, clauses = query.strip(), []
    for block in re.findall(r"\((.*?)\)", q):
        clauses.append(("OR", [f.strip() for f in block.split("OR")]))
        q = q.replace(f"({block})", "")
    clauses += [("AND", [f.strip()]) for f in q.split(",") if f.strip()]
    seen = {k for r in records.values() for k in r}
    ids = set(records)
    for kind, fields in clauses:
        valid = [f for f in fields if f in template and f in seen]
        if not valid:
            return []
        if kind == "AND":
            ids = {p for p in ids if all(records[p].get(f) is True for f in valid)}
        else:
            ids = {p for p in ids if any(bool(records[p].get(f)) for f in valid)}
    return sorted(ids)


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

FIELDS = ["A", "B", "C", "D", "N", "Z", "Q"]
term = st.one_of(st.sampled_from(FIELDS),
                 st.lists(st.sampled_from(FIELDS), min_size=1, max_size=3).map(lambda fs: "(" + " OR ".join(fs) + ")"))


@settings(max_examples=20, deadline=None)
@given(st.dictionaries(st.sampled_from(["p1", "p2", "p3", "p4", "p5"]),
                       st.dictionaries(st.sampled_from(FIELDS[:5]), st.sampled_from([True, "7", ""]), max_size=4),
                       min_size=1, max_size=5),
       st.lists(term, min_size=1, max_size=3))
def test_cohort_matches_rule(spark, records, terms):
    query = ", ".join(terms)
    flags = spark.createDataFrame(
        [(p, f, v is True, None if v is True else v) for p, r in records.items() for f, v in r.items()],
        "patient_id string, field string, is_true boolean, value string")
    # patients without any field still exist in the reference frame but can never match
    tmpl = spark.createDataFrame([(f,) for f in TEMPLATE], "field string")
    crit = cohort.parse_cohort_text(spark.createDataFrame([(1, query)], "cohort_id int, query string"))
    got = [r[0] for r in rows(cohort.cohort_members(flags, crit, tmpl), "patient_id")]
    assert got == _cohort_rule(records, TEMPLATE, query)


def test_many_criteria_and_empty_queries(spark):
    n = 120_000
    flags = spark.createDataFrame([("p1", "f5", True, None), ("p2", "f6", None, "x")], "patient_id string, field string, is_true boolean, value string")
    crit = spark.range(n).select(F.col("id").cast("int").alias("cohort_id"), F.lit(0).alias("clause_id"), F.lit("OR").alias("kind"),
                                 F.concat(F.lit("f"), "id").alias("field"))
    asked = spark.createDataFrame([(5,), (6,), (7,), (-1,)], "cohort_id int")
    got = cohort.cohort_members(flags, crit, crit.select("field"), asked)
    assert rows(got, "cohort_id", "patient_id") == [(-1, "p1"), (-1, "p2"), (5, "p1"), (6, "p2")]
    fields = spark.createDataFrame([("f5",), ("f9",)], "field string")
    assert rows(cohort.flag_counts(flags, fields), "field", "n_patients") == [("f5", 1), ("f9", 0)]
