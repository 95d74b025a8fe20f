"""the files of a repo are not shuffled to its config."""

import pytest
from pyspark.sql import functions as F

from prlens.operators import filters

FILES = 4000


@pytest.mark.parametrize("limit", ["10485760", "-1"])
def test_files_are_moved_only_to_a_large_config(spark, limit):
    files = spark.range(FILES).select(F.concat(F.lit("r"), (F.col("id") % 4).cast("string")).alias("repo_name"),
                                      F.concat(F.lit("d"), (F.col("id") % 10).cast("string"), F.lit("/x.py")).alias("filename"))
    overrides = spark.createDataFrame([("r0", ["d1/*", "d2/x.py"]), ("r1", ["*.py"]), ("r2", None), (None, ["*"])],
                                      "repo_name string, ignore array<string>")
    # A config as it comes: an aggregate and a join, whose size nobody knows before it runs.
    repos = files.select("repo_name").distinct()
    cfg = repos.join(overrides.groupBy("repo_name").agg(F.min("ignore").alias("ignore")), "repo_name", "left")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        kept = filters.ignore_filter(files, cfg)
        moved = kept._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(repo_name")
        got = {tuple(r) for r in kept.groupBy("repo_name").count().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # d1 and d2 go from r0, all of r1.
    assert got == {("r0", 800),
                   ("r2", 1000), ("r3", 1000)}
    assert moved == (0 if limit != "-1" else 1)
