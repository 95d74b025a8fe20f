"""Lines, definitions and rules are read from rows, with the same results as the plain regexes."""

import re

import pytest
from pyspark.sql import functions as F

from prlens.functions import py_strip
from prlens.operators import breaking as bk, scans

FILES = "repo_name string, pr_number long, file_pos int, filename string, patch string"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_and_definitions_are_rows_not_lambdas(spark):
    files = spark.createDataFrame([("r", 1, 1, "a.py", "+x")], FILES)
    assert "lambda" not in plan_of(bk.patch_definitions(files))


def test_lines_keep_signs_sides_and_code(spark):
    patch = "@@ -1 +1 @@\n--- a\n+++ b\n-\n+\n--x \n++ y\t\n+-z\n-  def f(a): \r\n+ a  \n context"
    files = spark.createDataFrame([("r", 1, 1, "a.py", patch)], FILES)
    got = [(r.line_no, r.side, r.code, r.raw) for r in bk.patch_lines(files).orderBy("line_no").collect()]
    assert got == [(3, "removed", "", ""), (4, "added", "", ""), (5, "removed", "x", "-x "), (6, "added", "y", "+ y\t"),
                   (7, "added", "-z", "-z"), (8, "removed", "def f(a):", "  def f(a): \r"),
                   (9, "added", "a ", " a  ")]
    assert bk.patch_lines(files, keep_context=True).filter("side IS NULL AND code IS NULL").count() == 4


def test_strip_equals_its_regex(spark):
    texts = ["", " ", "\t a b \x0b\f\r\n", "a \u0085", "  ", "x  ", "  a", "é \n", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = d.select(py_strip("t").alias("new"), F.regexp_replace("t", r"^\s+|\s+$", "").alias("old")).collect()
    assert [r.new for r in rows] == [r.old for r in rows]


RULES = scans.SECRET_RULES + scans.SECURITY_RULES + scans.FAILURE_RULES + scans.MAINTAINABILITY_RULES
LINES = ["PASSWORD : 'abcdef1'", 'Api_key="abcdefg"', "x = -----BEGIN EC PRIVATE KEY-----", "sk-" + "a1" * 12, "AKIA" + "Z9" * 8,
         "gho_" + "a" * 36, 'q = f"SELECT a {b}"', "' delete from t ' % x", "eval (x)", "SHA1 (x)", 'f"<b>{x}"', "except :",
         "PRINT('Error')", "requests.head(u)", "requests.get(u, timeout = 1)", "HACK", "TODO AB-1", "tmp =1", "x == 1",
         "def a_and_b (", "plain", ""]


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.rule_id)
def test_needed_texts_lose_no_match(spark, rule):
    d = spark.createDataFrame([(t,) for t in LINES], "code string")
    plain = d.filter(F.col("code").rlike(rule.pattern)).select("code").collect()
    if rule.unless:
        plain = [r for r in plain if not re.search(rule.unless, r.code)]
    assert plain and {r.code for r in scans.scan_lines(d, [rule]).collect()} == {r.code for r in plain}
    assert rule.needs
