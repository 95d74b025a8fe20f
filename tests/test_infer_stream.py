"""Provider chain semantics (U1) and batch/stream twin equality."""

from prlens.operators import infer
from prlens.plans import streams

from conftest import SF_SMALL


def stand_ins():
    """Providers without a network (local functions, so workers get them by value)."""
    def quota_exhausted(prompt):
        raise RuntimeError("429 resource exhausted")

    def flaky(prompt):
        raise RuntimeError("connection reset")

    def length_scorer(prompt):
        return str(1 + len(prompt) % 10)

    return quota_exhausted, flaky, length_scorer


quota_exhausted, flaky, length_scorer = stand_ins()
PROVIDERS = [("unavailable", None), ("quota", quota_exhausted), ("flaky", flaky), ("scorer", length_scorer)]


class Counter:
    def __init__(self, fn):
        self.fn, self.calls = fn, 0

    def __call__(self, p):
        self.calls += 1
        return self.fn(p)


def test_chain_skips_unavailable_and_quota():
    quota = Counter(quota_exhausted)
    ok = Counter(lambda p: " 7 ")
    text, name, attempts = infer.call_chain("x", [("none", None), ("q", quota), ("ok", ok)], backoff=0)
    assert (text, name, attempts) == ("7", "ok", 2)
    assert quota.calls == 1  # a quota error moves on at once, no retry


def test_chain_retries_then_fails_over():
    slept = []
    down = Counter(flaky)
    text, name, attempts = infer.call_chain("x", [("f", down), ("g", lambda p: "ok")], backoff=2.0, sleep=slept.append)
    assert (text, name, attempts, down.calls) == ("ok", "g", 3, 2)
    assert slept == [2.0]


def test_chain_all_failed():
    assert infer.call_chain("x", [("f", flaky)], backoff=0) == (infer.ALL_FAILED, "", 2)


def test_batch_infer_in_spark(spark):
    df = spark.createDataFrame([(i, "p" * i) for i in range(1, 6)], "k int, prompt string")
    out = infer.batch_infer(df, PROVIDERS, backoff=0.0, partitions=2).orderBy("k").collect()
    assert [r["response"] for r in out] == [str(1 + i % 10) for i in range(1, 6)]
    assert {r["provider"] for r in out} == {"scorer"} and {r["attempts"] for r in out} == {4}


def test_stream_equals_batch(spark):
    s = streams.q_stream_review_requests(spark, SF_SMALL)
    b = streams.q_review_requests(spark, SF_SMALL)
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))
    c = {r["type"]: r["count"] for r in streams.q_stream_issue_counts(spark, SF_SMALL).collect()}
    from prlens.plans import history
    assert c == {r["type"]: r["count"] for r in history.q_issue_counts(spark, SF_SMALL).collect()}


def test_a_delivery_sent_again_gives_one_report(spark, tmp_path):
    """The same delivery in one batch, in a second one, and after a restart from the checkpoint."""
    from prlens.streaming import webhooks as wh

    schema = "delivery_id long, action string, pr_number long, repo_name string"
    src, sink = f"{tmp_path}/in", f"{tmp_path}/out"

    def drop(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        wh.run_pr_report_stream(spark, stream, lambda b: b.select("repo_name", "pr_number"), sink)

    drop([(1, "opened", 7, "r"), (1, "opened", 7, "r"), (2, "opened", 8, "r")])
    drop([(1, "opened", 7, "r"), (3, "synchronize", 8, "r")])
    run()
    drop([(2, "opened", 8, "r")])
    drop([(4, "opened", 9, "r")])
    run()
    got = wh.read_reports(spark, sink, spark.createDataFrame([], "repo_name string, pr_number long").schema)
    assert sorted(r.pr_number for r in got.collect()) == [7, 8, 8, 9]
