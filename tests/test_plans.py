"""Plan checks: no cartesian products or nested-loop joins, pushed scans."""

import pytest

from quire.plans import catalog

SF = "/root/testdata/sf0.001"
catalog.load_all()
QUERIES = catalog.QUERIES
# Python stages are allowed only where a model call, a tile join or a
# numpy step is the operator itself.
PYTHON_OK = {"chunk_reassemble", "token_words", "cosine_edges", "dbscan", "dbscan_border",
             "noise_count", "jaccard_pairs", "dbscan_names", "cluster_representative", "section_report", "report_html",
             "embed_injected"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shape(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON_OK:
        assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
        assert "MapInPandas" not in plan and "FlatMapGroupsInPandas" not in plan


def test_scan_prunes_columns(spark):
    plan = QUERIES["cohort_and_or"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_custkey:bigint,o_orderpriority:string>" in plan


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cohorts_read_the_flags_once(spark):
    df = QUERIES["cohort_many"](spark, SF)
    df.collect()  # the plan that ran: what two branches share is reused
    plan = _plan(df).split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1


def test_text_queries_have_no_exchange(spark):
    for name in ("text_clean", "paragraphs_html", "fenced_json", "text_between"):
        assert "Exchange" not in _plan(QUERIES[name](spark, SF))
