"""A4 parses only the patches and lines that hold the fixed text of a rule (F12); files at rest hold a bounded number of rows."""

from __future__ import annotations

import glob

from prlens.operators import scans
from prlens.sources import fixtures as fx

PATCHES = {
    "loop.py": "+for a in xs:\n+    db.execute(a)\n+    for b in a:\n+        pass",
    "star.py": "+q = 'SeLeCt *'\n-for x in y:",
    "cache.py": "+ROW_CACHE = {}\n+    inner_cache = {}\n+cache = dict( )",
    "plain.py": "+x = f(1)\n+y = requests.get(u)",
    "far.py": "+for a in xs:\n" + "+    pass\n" * 5 + "+    db.execute(a)",
    "none.py": None,
}
FOUND = {("loop.py", 1, "query-in-loop"), ("loop.py", 2, "nested-loop"), ("star.py", 0, "select-star"),
         ("cache.py", 0, "unbounded-cache"), ("cache.py", 2, "unbounded-cache")}


def scan(spark):
    files = spark.createDataFrame([("r", 1, f, p) for f, p in PATCHES.items()],
                                  "repo_name string, pr_number bigint, filename string, patch string")
    return scans.performance_pattern_scan(files)


def test_the_rows_are_those_of_every_line(spark):
    assert {(r["filename"], r["line_no"], r["rule_id"]) for r in scan(spark).collect()} == FOUND


def test_a_patch_without_a_rules_text_is_left_out_before_it_is_split(spark):
    plan = scan(spark)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    first_split = max(i for i, x in enumerate(plan) if "split(patch" in x)
    assert any("Filter" in x and "Contains(patch" in x for x in plan[first_split:])


def test_a_file_at_rest_holds_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fx, "FILE_ROWS", 300)
    monkeypatch.setattr(fx, "checkpoint_dir", lambda _: str(tmp_path))
    review = fx.stored("fx_review_in_parts")(fx.fx_review.build)(spark, "/root/testdata/sf0.001")
    files = glob.glob(f"{tmp_path}/fixtures/*/*/fx_review_in_parts/*.parquet")
    assert files and max(spark.read.parquet(f"file://{f}").count() for f in files) <= 300 < review.count()
