"""The tokens of test lines meet the added functions in a merge join."""

from prlens.operators import breaking as bk, dependencies as dp

FILES = "repo_name string, pr_number long, file_pos int, filename string, patch string"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_of_test_lines_are_never_broadcast(spark):
    files = spark.createDataFrame([("r", 1, 1, "a.py", "+def f():"), ("r", 1, 2, "tests/test_a.py", "+g()")], FILES)
    lines = bk.patch_lines(files)
    gaps = dp.test_gaps(bk.extract_definitions(lines), lines)
    assert [r.name for r in gaps.collect()] == ["f"]
    plan = executed(gaps)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
