"""The three-file PR fixture through the breaking-change, size, routing,
scan and dependency operators (expected values worked out by hand)."""

from pyspark.sql import functions as F

from prlens.operators import breaking as bk, dependencies as dp, filters, scans, size

from diff_fixture import files_df, prs_df


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_changed_signature_only(spark):
    ann = bk.annotate_definitions(bk.patch_definitions(files_df(spark)))
    ch = rows(bk.changed_signatures(ann), "filename", "name", "old", "new")
    assert ch == [("beds/humidity.py", "mean_humidity", "def mean_humidity(bed)",
                   "def mean_humidity(self, bed, since=None, unit='percent')")]
    assert bk.removed_functions(ann).count() == 0
    assert bk.removed_classes(ann).count() == 0
    assert bk.removed_endpoints(ann).count() == 0


def test_breaking_changes_message(spark):
    b = bk.breaking_changes(files_df(spark)).collect()
    assert len(b) == 1
    assert b[0]["kind"] == "signature"
    assert b[0]["message"] == (
        "Function signature changed in `beds/humidity.py`: `def mean_humidity(bed)` → "
        "`def mean_humidity(self, bed, since=None, unit='percent')` — existing callers may break")


def test_size_not_oversized(spark):
    s = size.pr_size_check(prs_df(spark), files_df(spark)).collect()[0]
    assert (s["total_lines"], s["total_files"], s["is_oversized"]) == (98, 3, False)


def test_size_with_tight_config(spark):
    cfg = spark.createDataFrame([("farm/greenhouse", 80, 2)], "repo_name string, max_lines bigint, max_files bigint")
    s = size.pr_size_check(prs_df(spark), files_df(spark), cfg).collect()[0]
    assert s["is_oversized"] and len(s["warnings"]) == 2
    assert s["warnings"][1].startswith("This PR touches **3 files** (recommended max: 2).")
    c = size.pr_size_comment(size.pr_size_check(prs_df(spark), files_df(spark), cfg)).collect()[0]["body"]
    assert c.startswith("## ⚠️ PR Size Warning\n\n- This PR changes **98 lines**")
    assert "**Stats:** +93 additions, -5 deletions, 3 files changed" in c


def test_route_tools(spark):
    r = rows(filters.route_tools(prs_df(spark), files_df(spark)), "tool")
    assert [t for (t,) in r] == sorted(["bandit", "ruff", "radon", "detect-secrets", "pip-audit"])


def test_scans(spark):
    lines = bk.patch_lines(files_df(spark))
    sec = rows(scans.secret_scan(lines), "filename", "rule_id")
    assert ("beds/humidity.py", "hardcoded-credential") in sec
    assert ("beds/valves.py", "hardcoded-credential") in sec
    s2 = {r for _, r in rows(scans.security_pattern_scan(lines), "filename", "rule_id")}
    assert {"sql-string-build", "eval-call", "weak-hash", "fstring-html"} <= s2
    f = rows(scans.failure_pattern_scan(lines), "filename", "rule_id")
    assert ("beds/humidity.py", "bare-except") in f
    http = [x for x in f if x[1] == "http-without-timeout"]
    assert http == [("beds/valves.py", "http-without-timeout")]  # the call with timeout= is not flagged
    p = {r for _, r in rows(scans.performance_pattern_scan(files_df(spark)), "filename", "rule_id")}
    assert {"query-in-loop", "select-star", "unbounded-cache"} <= p
    m = {r for _, r in rows(scans.maintainability_scan(lines), "filename", "rule_id")}
    assert {"todo-without-ticket", "vague-name", "and-in-function-name"} <= m


def test_dependency_checks(spark):
    lines = bk.patch_lines(files_df(spark)).filter((F.col("filename") == "requirements.txt") & (F.col("side") == "added"))
    reqs = dp.parse_requirements(lines, ["repo_name", "line_no"], text_col="code")
    assert {r["package"] for r in dp.unpinned_dependencies(reqs).collect()} == {"django", "boto3", "setuptools", "pyyaml"}
    t = rows(dp.typosquats(reqs), "package", "popular")
    assert ("djnago", "django") in t
    v = rows(dp.vulnerable_dependencies(reqs, dp.advisories_frame(spark)), "package", "advisory_id")
    assert v == [("jinja2", "ADV-2005"), ("urllib3", "ADV-2006")]
    assert [r["package"] for r in dp.deprecated_dependencies(reqs).collect()] == ["nose"]


def test_test_gaps(spark):
    lines = bk.patch_lines(files_df(spark))
    g = {r["name"] for r in dp.test_gaps(bk.extract_definitions(lines), lines).collect()}
    assert {"open_valve", "close_valve", "mean_humidity"} <= g
