"""S8/S9 at rest, approximate retrieval (R1), glob sets (F1), entropy (A1)."""

import base64
import fnmatch
import hashlib
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from prlens.operators import filters, retrieval as rt, scans
from prlens.operators.code_index import CodeIndex

FILES = "repo_name string, path string, content string"


def listing(base):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(base) for f in names
            if f.endswith(".parquet")}


def rows(df):
    return sorted((r.repo_name, r.path, r.content) for r in df.collect())


def test_an_upsert_writes_only_what_it_touches(spark, tmp_path):
    base = str(tmp_path / "index")
    store = CodeIndex(spark, base, buckets=64)
    files = [("r", f"p{i}", f"text {i} " + "x" * 400) for i in range(3000)]
    df = lambda x: spark.createDataFrame(x, FILES)
    assert store.upsert(df(files)) == 1 and rows(store.read()) == sorted(files)
    before = listing(base)
    some = [("r", "p7", "new"), ("s", "q", "added"), ("r", "p8", ""), ("r", "p9", None), ("r", "p10", files[10][2])]
    reader = store.read()  # a reader keeps the version it opened
    assert store.upsert(df(some)) == 2
    want = sorted([f for f in files if f[1] != "p7"] + some[:2])
    assert rows(store.read()) == want and rows(reader) == sorted(files) == rows(store.read(1))
    after = listing(base)
    assert all(after[f] == n for f, n in before.items())  # nothing is written over
    assert sum(n for f, n in after.items() if f not in before) < sum(before.values()) * 4 / 64
    replay = listing(base)
    assert store.upsert(df(some)) == 2 and listing(base) == replay  # a replay changes nothing
    assert store.clear("s") == 3 and rows(store.read()) == [r for r in want if r[0] == "r"]
    assert store.clear("nobody") == 3


def test_ties_between_new_rows(spark, tmp_path):
    store = CodeIndex(spark, str(tmp_path / "index"), buckets=4)
    df = spark.createDataFrame([("r", "a", "1"), ("r", "a", "3"), ("r", "a", "2")], FILES)
    store.upsert(df)
    assert rows(store.read()) == [("r", "a", "3")]
    assert rows(rt.index_upsert(rt.index_rows(df).limit(0), df)) == [("r", "a", "3")]
    assert store.upsert(spark.createDataFrame([("r", "a", "0")], FILES)) == 2  # new wins over old, whatever its text
    assert rows(store.read()) == [("r", "a", "0")]
    assert store.clear("r") == 3 and rows(store.read(schema=FILES)) == []


def test_a_second_writer_fails(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "index")
    store = CodeIndex(spark, base, buckets=2)
    store.upsert(spark.createDataFrame([("r", "a", "1")], FILES))
    late = CodeIndex(spark, base, buckets=2)
    monkeypatch.setattr(late, "version", lambda: 0)
    with pytest.raises(RuntimeError, match="another writer"):
        late._publish(0, {}, {0}, store.read(1).withColumn("bucket", F.lit(0)))


@pytest.mark.parametrize("lists", [None, 7])
def test_approximate_retrieval_finds_most_of_the_exact_answers(spark, lists):
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(25)]
    data = [(f"r{i % 2}", f"p{i}", "t", [c + rng.gauss(0, 0.4) for c in rng.choice(centres)]) for i in range(1500)]
    files = spark.createDataFrame(data, FILES + ", embedding array<float>")
    index = rt.index_rows(files)
    queries = files.filter("path LIKE '%7'").select("repo_name", F.col("path").alias("query_id"), "embedding")
    hits = lambda df: {(r.repo_name, r.query_id, r.id): r.score for r in df.collect()}
    exact, near = hits(rt.similar_code(queries, index)), hits(rt.similar_code_approx(queries, index, lists=lists))
    assert len(near) == len(exact)
    assert len(exact.keys() & near.keys()) >= 0.9 * len(exact)
    assert all(math.isclose(exact[k], near[k]) for k in exact.keys() & near.keys())
    assert hits(rt.similar_code_approx(queries, index, lists=5, probes=5)) == exact
    none = rt.similar_code_approx(queries, index.limit(0))
    assert none.count() == 0


def test_approximate_retrieval_on_the_given_embeddings(spark):
    import __spark_entry__ as entry

    q = entry.queries()
    key = lambda n: {(r.repo_name, r.query_id, r.id) for r in q[n](spark, "/root/testdata/sf0.01").collect()}
    exact, near = key("similar_code"), key("similar_code_approx")
    assert len(exact & near) >= 0.9 * len(exact)


def test_ignore_filter_equals_fnmatch(spark):
    rng = random.Random(10)
    name = lambda: "".join(rng.choice("ab./-]") for _ in range(rng.randrange(0, 6)))
    names = [name() for _ in range(80)] + ["src/[x", "a*b", "a?"]
    cfg = [(f"r{i}", [rng.choice(["*", "a*", "*b", "a", "*.b", "[ab]*", "?", "a?b", "[!a]", "**", "a*b", "", "src/[x", name(),
                                  name() + "*", "*" + name()]) for _ in range(rng.randrange(0, 4))]) for i in range(60)]
    cfg += [("none", None)]
    files = [(r, n) for r, _ in cfg for n in names] + [("unknown", "a"), (None, "a"), ("r1", None)]
    got = filters.ignore_filter(spark.createDataFrame(files, "repo_name string, filename string"),
                                spark.createDataFrame(cfg, "repo_name string, ignore array<string>")).collect()
    globs = dict(cfg)
    want = [(r, n) for r, n in files if not (n is not None and any(fnmatch.fnmatchcase(n, g) for g in globs.get(r) or ()))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_entropy(spark):
    rng = random.Random(11)
    secrets = [base64.b64encode(rng.randbytes(36)).decode() for _ in range(30)]
    plain = ["a_rather_long_variable_name_in_prose", "the-quick-brown-fox-jumps-over", hashlib.md5(b"x").hexdigest(),
             hashlib.sha256(b"x").hexdigest(), "123e4567-e89b-12d3-a456-426614174000", "a" * 40, "short"]
    lines = spark.createDataFrame([("r", 1, 1, "f", i, "added", f'k = "{t}"') for i, t in enumerate(secrets + plain)]
                                  + [("r", 1, 1, "f", 99, "removed", f'k = "{secrets[0]}"')],
                                  "repo_name string, pr_number bigint, file_pos int, filename string, line_no int, side string, code string")
    assert sorted(r.line_no for r in scans.entropy_scan(lines).collect()) == list(range(30))
    texts = ["", "a", "aab", "abcd", "é" * 3 + "x", *secrets]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scans.shannon_entropy(F.col("t")).alias("h")).collect()
    for r in got:
        want = -sum(p * math.log2(p) for p in (r.t.count(c) / len(r.t) for c in set(r.t)))
        assert math.isclose(r.h, want, abs_tol=1e-9), r.t
