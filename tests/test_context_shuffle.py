"""The retrieval step inside the prompts moves an embedding once and a context not at all."""

from __future__ import annotations

import re

from prlens.operators import retrieval as rt
from prlens.plans import reviews
from prlens.sources import fixtures as fx

KEY = r"hashpartitioning\((.*?), \d+\)"


def exchanges(df):
    """Columns each shuffle of the plan goes by."""
    tree = df._jdf.queryExecution().executedPlan().toString()
    return [re.findall(r"(\w+)#\d+", keys) for keys in re.findall(KEY, tree)]


def test_an_embedding_is_not_shuffled_by_its_repo_alone(spark):
    q = spark.createDataFrame([("r", 7, [1.0, 0.0]), ("r", 2**60 + 1, [0.0, 1.0])],
                              "repo_name string, query_id bigint, embedding array<float>")
    ix = spark.createDataFrame([("r", "a", "p/a", "x" * 600, [1.0, 0.1]), ("r", "b", "p/b", None, [0.1, 1.0])],
                               "repo_name string, id string, path string, content string, embedding array<float>")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = rt.similar_code(q, ix, k=1)
        # The two counts, a row per repo each, are all that goes by the repo.
        tree = hits._jdf.queryExecution().executedPlan().toString()
        by_repo = re.findall(r"Exchange hashpartitioning\(repo_name#\d+, \d+\).*\n(.*)", tree)
        assert by_repo and all("partial_count" in below for below in by_repo)
        got = {(r["query_id"], r["id"]) for r in hits.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == {(7, "a"), (2**60 + 1, "b")}


def test_a_context_is_put_together_by_the_keys_of_its_prompt(spark):
    d = "/root/testdata/sf0.001"
    ctx = reviews.pr_context(spark, d)
    prs = fx.fx_pr(spark, d).select("repo_name", "pr_number").repartition("repo_name", "pr_number")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        alone, joined = exchanges(ctx), exchanges(prs.join(ctx, ["repo_name", "pr_number"], "left"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(joined) == len(alone) + 1  # that of the pull requests
