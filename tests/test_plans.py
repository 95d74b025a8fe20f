"""Plan-shape guards: the scale properties the README claims, checked on the
planned queries (sf0.001)."""

import pytest

import __spark_entry__ as entry
from prlens.plans import catalog

from conftest import SF_SMALL

QUERIES = {k: v for k, v in entry.queries().items() if k in catalog.QUERIES}
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
                "FlatMapCoGroupsInPandas")
PYTHON_ALLOWED = {"batch_infer", "similar_code", "similar_code_approx", "retrieval_context", "build_prompts", "build_prompts_style"}
EAGER = {"stream_review_requests", "stream_issue_counts", "stream_pr_pipeline", "webhook_source"}


PLANS = {}


def plan(spark, name):
    if name not in PLANS:
        PLANS[name] = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    return PLANS[name]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_python_only_where_declared(spark, name):
    p = plan(spark, name)
    found = [n for n in PYTHON_NODES if n in p]
    assert not found or name in PYTHON_ALLOWED, f"{name} runs Python: {found}"


@pytest.mark.parametrize("name", ["inline_comments", "suggest_reviewers_latest", "past_issues", "repo_snapshot",
                                  "similar_code", "hotspot_prompt"])
def test_top_n_is_a_partial_group_limit(spark, name):
    p = plan(spark, name)
    if name == "hotspot_prompt":
        assert "WindowGroupLimit" not in p  # no top-N there: every hotspot is kept
    else:
        assert "WindowGroupLimit" in p and "Partial" in p


def test_breaking_changes_reads_patches_once(spark):
    assert scans_reading(spark, "breaking_changes", "patch") == 1 and "Union" not in plan(spark, "breaking_changes")


def test_no_cross_join_anywhere(spark):
    for name in sorted(set(QUERIES) - EAGER):
        p = plan(spark, name)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def scans_reading(spark, name, column):
    """Scans whose ReadSchema has the column."""
    return sum("FileScan parquet" in line and f"{column}:string" in line.partition("ReadSchema")[2]
               for line in plan(spark, name).splitlines())


@pytest.mark.parametrize("name", ["unified_findings", "inline_comments", "severity_filter", "tool_prompt_text",
                                  "finding_totals", "pr_risk_report", "build_prompts"])
def test_tool_reports_are_read_once(spark, name):
    assert scans_reading(spark, name, "report") == 1


@pytest.mark.parametrize("name", ["removed_classes", "removed_endpoints", "parse_issue_blocks", "parse_review_sections"])
def test_pure_maps_shuffle_nothing_big(spark, name):
    p = plan(spark, name)
    assert "Window" not in p and "SortMergeJoin" not in p


@pytest.mark.parametrize(("name", "most"), [("pr_risk_report", 22), ("build_prompts", 30), ("comment_outbox", 24),
                                            ("merge_decision", 8), ("unified_findings", 12)])
def test_scans_per_query_are_bounded(spark, name, most):
    assert plan(spark, name).count("FileScan parquet") <= most
