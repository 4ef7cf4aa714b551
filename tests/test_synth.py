"""Generator config, quotas and validation (F4)."""

import pytest
from pyspark.sql import functions as F

from quire.operators import synth
from tests.conftest import rows


@pytest.fixture
def sheet(spark):
    data = [(0, '"Asthma"', None, "13"), (1, "Asthma", None, "2"), (2, "Sex", "Male", "40"),
            (3, "Age", None, "6 - 18"), (4, "Note", None, "few"), (5, None, None, "9"),
            (6, "Empty", None, None), (7, "Age", None, "7-9")]
    return spark.createDataFrame(data, "pos int, Variable string, n string, count string")


def test_clean_and_dedup(sheet):
    d = synth.dedup_config(synth.clean_config(sheet))
    got = rows(d, "out_pos", "field", "kind", "count", "range_text")
    assert got == [(1, "Asthma", "count", 15, None), (2, "Male", "count", 40, None),
                   (3, "Note", "count", 1, None), (4, "Empty", "count", 0, None),
                   (5, "Age", "range", None, "7-9")]


def test_rescale_half_even(spark):
    c = spark.createDataFrame([("A", "count", 13, None), ("R", "range", None, "1-2")],
                              "field string, kind string, count long, range_text string")
    got = dict(rows(synth.scale_config(c, 50), "field", "count"))
    assert got["A"] == round(13 / 100 * 50) and got["R"] is None


def quota(spark, counts, fields, n=100):
    cfg = spark.createDataFrame([(f, "count", c, None) for f, c in counts.items()],
                                "field string, kind string, count long, range_text string")
    groups = spark.createDataFrame([(1, f, i) for i, f in enumerate(fields)], "group_id int, field string, pos int")
    pats = spark.range(n).select(F.col("id").cast("string").alias("patient_id"))
    out = synth.assign_exclusive(pats, cfg, groups, seed="t")
    return {f: c for f, c in rows(out.groupBy("field").count())}, out, pats, groups


def test_quotas_fill_unknown(spark):
    got, out, pats, groups = quota(spark, {"Male": 40, "Female": 50, "Unknown": 0}, ["Male", "Female", "Unknown"])
    assert got == {"Male": 40, "Female": 50, "Unknown": 10}
    flags = out.select("patient_id", "field", F.lit(True).alias("is_true"), F.lit(None).cast("string").alias("value"))
    assert synth.violations(flags, groups).count() == 0
    assert synth.coverage_gaps(pats, flags, groups).count() == 0


def test_quotas_last_field_and_overshoot(spark):
    assert quota(spark, {"A": 40, "B": 50}, ["A", "B"])[0] == {"A": 40, "B": 60}
    assert quota(spark, {"A": 70, "B": 50}, ["A", "B"])[0] == {"A": 70, "B": 30}


def test_remaining_and_validation(spark):
    cfg = spark.createDataFrame([("F", "count", 5, None), ("Age", "range", None, "6 - 18")],
                                "field string, kind string, count long, range_text string")
    groups = spark.createDataFrame([(1, "X", 0)], "group_id int, field string, pos int")
    pats = spark.range(20).select(F.col("id").cast("string").alias("patient_id"))
    flags = synth.assign_remaining(pats, cfg, groups, seed="t")
    v = {r["field"]: r for r in synth.validate_counts(flags, cfg).collect()}
    assert v["F"]["actual"] == 5 and v["F"]["passed"]
    assert v["Age"]["actual"] == 20 and v["Age"]["total"] == 20
    ages = [int(r[0]) for r in flags.where("field = 'Age'").select("value").collect()]
    assert all(6 <= a <= 18 for a in ages)


def test_violation_and_gap(spark):
    groups = spark.createDataFrame([(1, "A", 0), (1, "B", 1)], "group_id int, field string, pos int")
    flags = spark.createDataFrame([("p1", "B", True, None), ("p1", "A", True, None)],
                                  "patient_id string, field string, is_true boolean, value string")
    pats = spark.createDataFrame([("p1",), ("p2",)], "patient_id string")
    assert rows(synth.violations(flags, groups), "patient_id", "fields") == [("p1", "A, B")]
    assert rows(synth.coverage_gaps(pats, flags, groups), "patient_id") == [("p2",)]


def test_patient_json(spark):
    flags = spark.createDataFrame([("P1", "A", True, None), ("P1", "Age", None, "7")],
                                  "patient_id string, field string, is_true boolean, value string")
    assert rows(synth.patients_json(flags), "json") == [('{"A": true, "Age": "7"}',)]


def _quota_rule(patients, counts, fields, seed, group_id=1):
    """Quota assignment written out in plain Python with the same seeded order."""
    import hashlib
    quota = [counts.get(f, 0) for f in fields]
    n = len(patients)
    if sum(quota) < n:
        fb = next((i for i, f in enumerate(fields) if "Unknown" in f), len(fields) - 1)
        quota[fb] += n - sum(quota)
    order = sorted(patients, key=lambda p: (hashlib.md5(f"{p}|{group_id}|{seed}".encode()).hexdigest(), p))
    out, i = {}, 0
    for f, q in zip(fields, quota):
        for _ in range(q):
            if i >= n:
                break
            out[order[i]] = f
            i += 1
    return out


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=10, deadline=None)
@given(st.integers(min_value=1, max_value=40),
       st.lists(st.integers(min_value=0, max_value=30), min_size=1, max_size=4),
       st.booleans())
def test_quota_matches_rule(spark, n, counts, with_unknown):
    fields = [f"F{i}" for i in range(len(counts))] + (["Unknown x"] if with_unknown else [])
    cmap = dict(zip(fields, counts))
    cfg = spark.createDataFrame([(f, "count", c, None) for f, c in cmap.items()],
                                "field string, kind string, count long, range_text string")
    groups = spark.createDataFrame([(1, f, i) for i, f in enumerate(fields)], "group_id int, field string, pos int")
    pats = spark.createDataFrame([(f"p{i}",) for i in range(n)], "patient_id string")
    got = dict(rows(synth.assign_exclusive(pats, cfg, groups, seed="q"), "patient_id", "field"))
    assert got == _quota_rule([f"p{i}" for i in range(n)], cmap, fields, "q")
