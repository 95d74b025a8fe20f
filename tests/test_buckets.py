"""Tables bucketed by key (W3): a batch reads only its own buckets."""

import re

from prlens.sources import buckets
from prlens.sources.buckets import PrStore, read_buckets, write_buckets

KEYS = ["repo_name", "pr_number"]


def rows(spark, n=300):
    return spark.createDataFrame([(f"r{i % 5}", i % 50, f"t{i}") for i in range(n)] + [(None, None, "no key")] * 2,
                                 "repo_name string, pr_number long, text string")


def asked(spark, keys):
    return spark.createDataFrame(keys, "repo_name string, pr_number long")


def test_only_the_buckets_of_the_keys_are_read(spark, tmp_path):
    df, path = rows(spark), f"{tmp_path}/t"
    write_buckets(df, path, KEYS)
    assert sorted(map(str, read_buckets(spark, path, df.schema, KEYS).collect())) == sorted(map(str, df.collect()))
    only = asked(spark, [("r1", 1), ("r1", 1), ("r2", 7), ("gone", 3)])
    got = read_buckets(spark, path, df.schema, KEYS, only)
    want = df.filter("(repo_name = 'r1' AND pr_number = 1) OR (repo_name = 'r2' AND pr_number = 7)")
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    named = re.search(r"PartitionFilters: \[[^\]]*" + buckets.BUCKET + r"[^\]]*", plan).group(0)
    assert len(re.findall(r"\b\d+\b", named.split(" IN ")[1])) <= 3  # of 64 folders


def test_no_keys_null_keys_and_empty_tables(spark, tmp_path):
    df = rows(spark)
    write_buckets(df, f"{tmp_path}/t", KEYS)
    write_buckets(df.limit(0), f"{tmp_path}/none", KEYS)
    assert read_buckets(spark, f"{tmp_path}/t", df.schema, KEYS, asked(spark, [])).count() == 0
    assert read_buckets(spark, f"{tmp_path}/t", df.schema, KEYS, asked(spark, [(None, None)])).count() == 0
    assert read_buckets(spark, f"{tmp_path}/none", df.schema, KEYS, asked(spark, [("r1", 1)])).count() == 0


def test_a_batch_reads_its_prs_and_the_history_of_their_paths(spark, tmp_path):
    store = PrStore(spark, str(tmp_path), 8)
    store.put("pr", asked(spark, [("r", i) for i in range(40)]))
    store.put("file", spark.createDataFrame([("r", i, f"f{i % 4}.py") for i in range(40)],
                                            "repo_name string, pr_number long, filename string"))
    store.put("commit", spark.createDataFrame([("r", f"f{i % 6}.py", i) for i in range(60)],
                                              "repo_name string, path string, n long"))
    read = store.reader(asked(spark, [("r", 1), ("r", 5), ("r", 2), ("r", 99)]))
    assert sorted(r.pr_number for r in read("pr").collect()) == [1, 2, 5]
    assert sorted(r.filename for r in read("file").collect()) == ["f1.py", "f1.py", "f2.py"]
    assert {r.path for r in read("commit").collect()} == {"f1.py", "f2.py"} and read("commit").count() == 20
