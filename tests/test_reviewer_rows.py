"""H3: a PR's file, not each of its touches, is a row of the shuffle by PR."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from prlens.operators import asof, history as hs

T0 = dt.datetime(2020, 1, 1)
COMMITS = "repo_name string, path string, sha string, author string, message string, ts timestamp_ntz"
PRS = "repo_name string, pr_number bigint, author string, created_at timestamp_ntz"
FILES = "repo_name string, pr_number bigint, file_pos int, filename string"


def world(spark):
    commits = [("r", f"f{i % 3}", f"{i:03d}", f"dev{i % 7}", "m", T0 + dt.timedelta(days=i)) for i in range(200)]
    prs = [("r", n, "dev1", T0 + dt.timedelta(days=10 * n)) for n in range(20)]
    files = [("r", n, k + 1, f"f{k}") for n in range(20) for k in range(3)]
    return (spark.createDataFrame(prs, PRS), spark.createDataFrame(files, FILES), spark.createDataFrame(commits, COMMITS))


@pytest.mark.parametrize("at_creation", [True, False])
def test_touches_are_not_rows(spark, at_creation):
    prs, files, commits = world(spark)
    plan = hs.suggest_reviewers(prs, files, commits, at_creation=at_creation)._jdf.queryExecution().optimizedPlan().toString()
    # One window at most (the newest commits of a path), none over the touches of a PR.
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert len(windows) <= 1 and not any("pr_number" in x for x in windows)


def test_newest_meets_one_block_a_state(spark):
    _, _, commits = world(spark)
    moments = spark.createDataFrame([("r", "f0", T0 + dt.timedelta(days=d), True, d) for d in (0, 1, 59, 60, 61, 150)],
                                    "repo_name string, path string, ts timestamp_ntz, after boolean, n int")
    history, states = asof.placed(commits, moments, ["repo_name", "path"], ["sha"], "author")
    assert history.filter("path = 'f0'").count() == 67
    got = {x.n: (x.seen, x.newest) for x in asof.newest(history, states, ["repo_name", "path"], 20, "author").collect()}
    for d in (0, 1, 59, 60, 61, 150):
        seen = [f"dev{i % 7}" for i in range(0, 200, 3) if i <= d]
        assert got[d] == (len(seen), seen[::-1][:20])


def test_names_of_any_characters_and_missing_authors(spark):
    odd = ['a"b', "x\\n", "é\n漢", "a,b", "[1]"]
    commits = spark.createDataFrame([("r", "f", f"{i}", a, "m", T0) for i, a in enumerate([*odd, None, ""])], COMMITS)
    prs = spark.createDataFrame([("r", 1, "z", T0)], PRS)
    files = spark.createDataFrame([("r", 1, 1, "f")], FILES)
    for at_creation in (True, False):
        got = hs.suggest_reviewers(prs, files, commits, people=None, at_creation=at_creation).orderBy("rank").collect()
        assert [x.login for x in got] == odd[::-1] and [x["rank"] for x in got] == [1, 2, 3, 4, 5]


def test_pr_files_need_one_exchange(spark):
    from prlens.sources import fixtures as fx

    plan = fx._pr_file(spark, "/root/testdata/sf0.001").select(F.lit(1), "*")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    lines = [x for x in physical.splitlines() if "Exchange hashpartitioning" in x]
    assert not any("filename" in x for x in lines) and len(lines) <= 2
