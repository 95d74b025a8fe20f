"""Reports are written in one pass and each of their fields is read once."""

from conftest import SF_SMALL
from prlens.operators import findings as fd
from prlens.sources import fixtures as fx


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reports_come_from_one_pass_over_the_files(spark):
    assert executed(fx.fx_tool_report.build(spark, SF_SMALL)).count("FileScan parquet") == 1


def test_a_field_of_a_report_is_read_once(spark):
    reports = spark.createDataFrame([("r", 1, "eslint", '[{"filePath":"f","messages":[{"ruleId":"x","message":"m"}]}]')],
                                    "repo_name string, pr_number long, tool string, report string")
    found = fd.norm_eslint(reports)
    assert [(r.file, r.rule_id, r.message) for r in found.collect()] == [("f", "x", "[x] m")]
    assert plan_of(found).count("$.ruleId") == 1
