"""What queries leave on disk while they run: shuffles of written tables go, tokens that name nothing broken are
not moved, and patches without a rule's fixed text are not split."""

import time

from pyspark.sql import functions as F

from prlens.operators import breaking as bk, findings as fd, scans
from prlens.session import written

PATCH = "repo_name string, pr_number long, file_pos int, filename string, patch string"


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shuffles_of_a_written_table_go(spark):
    before = shuffle_files(spark)
    t = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    assert t.count() == 7
    for _ in range(50):
        # That of the count itself may stay.
        if len({f.split("_")[1] for f in shuffle_files(spark) - before}) <= 1:
            return
        time.sleep(0.2)
    raise AssertionError("shuffle files stay")


def test_only_tokens_of_broken_names_are_moved(spark):
    b = spark.createDataFrame([("r", 1, 1, "function", "load", "a.py"), ("r", 1, 2, "endpoint", None, "a.py"),
                               ("s", 2, 1, "class", "Gone", "b.py")],
                              "repo_name string, pr_number long, finding_pos int, kind string, name string, filename string")
    code = spark.createDataFrame([("r", "a.py", "load(load)"), ("r", "c.py", "x = load()"), ("r", "c.py", "load"),
                                  ("r", "d.py", "other"), ("s", "b.py", "load"), (None, "e.py", "load")],
                                 "repo_name string, path string, content string")
    out = bk.backward_compat_report(b, bk.code_tokens(code))
    assert {(r["repo_name"], r["name"], r["n_caller_files"]) for r in out.collect()} == {("r", "load", 1), ("s", "Gone", 0)}
    assert "Generate" not in plan(out)  # the tokens are made once, and left before a shuffle


def test_findings_of_prefiltered_patches(spark):
    reports = spark.createDataFrame([
        ("r", 1, "ruff", '[{"code":"E1","message":"m","filename":"a.py","location":{"row":3}}]'),
        ("r", 1, "radon", "oops"), ("r", 1, "radon", '{"a.py":[{"complexity":12}]}'),
        ("r", 2, "ruff", '[{"code":"E1","message":"m","filename":"b.py","location":{"row":4}}]'),
        ("r", 3, "detect-secrets", "oops")], "repo_name string, pr_number long, tool string, report string")
    files = spark.createDataFrame([("r", 1, 1, "a.py", '+k = 1\n+password = "hunter22"'), ("r", 3, 1, "c.py", '+x\n+token = "abcdefgh"')],
                                  PATCH)
    routes = spark.createDataFrame([("r", 1, "ruff"), ("r", 1, "radon"), ("r", 1, "detect-secrets"), ("r", 1, "ruff"),
                                    ("r", 3, "detect-secrets")], "repo_name string, pr_number long, tool string")
    secrets = scans.secret_findings(bk.patch_lines(files, where=scans.may_hold_secret))
    found = fd.inline_comments(fd.unified_findings(routes, fd.all_tool_findings(reports, secrets)))
    rows = found.collect()
    assert sorted((r["pr_number"], r["path"], r["line"]) for r in rows) == [(1, "a.py", 1), (1, "a.py", 3), (3, "c.py", 1)]
    root = fd.all_tool_findings(reports, secrets, root="a")
    assert sorted(r["file"] for r in root.filter("pr_number = 1").collect()) == [".py", "a.py"]  # of a secret it stays


def test_patches_without_a_fixed_text_are_not_split(spark):
    files = spark.createDataFrame([("r", 1, 1, "a.py", "+x = 1\n+y: int"), ("r", 1, 2, "b.py", '-def f(a):\n+k = "v"\n def\n+class C')],
                                  PATCH)
    lines = bk.patch_lines(files, where=scans.may_hold_secret)
    assert [(r["file_pos"], r["line_no"], r["code"]) for r in lines.collect()] == [(2, 1, 'k = "v"')]
    found = {(r["kind"], r["name"], r["message"][:8]) for r in bk.breaking_changes(files).collect()}
    assert found == {("function", "f", "Public f")}
    defs = bk.patch_definitions(files).collect()
    assert {(r["kind"], r["name"], r["side"]) for r in defs} == {("function", "f", "removed"), ("class", "C", "added")}


def test_every_secret_rule_names_its_fixed_texts():
    assert all(r.needs for r in scans.SECRET_RULES)
