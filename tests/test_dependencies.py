"""A10 and A11 against plain comparisons, A14 and R3 by their failing cases."""

import itertools
import random
import string

import pytest
from packaging.version import InvalidVersion, Version
from pyspark.sql import functions as F

from prlens.operators import breaking as bk, dependencies as dp, reviews as rv

VERSIONS = ["1", "1.0", "1.0.0", "1.0.dev1", "1.0a1", "1.0a1.dev2", "1.0a2", "1.0b1", "1.0rc1", "1.0c1", "1.0.post1", "1.0.post1.dev3",
            "1.0-1", "1.0rev2", "1.1", "1.0.1", "1!0.5", "1!0.5.0", "v1.0", "1.0+abc", "1.0+abc.5", "1.0+5", "1.0+10", "1.0.0+abc.x",
            "2.0", "10.0", "9.9", "2.10.0", "2.9.0", "0", "0.0", "1.0ALPHA1", "1.0-preview-3", "1.0.dev", "1.0a", "1.0.post"]
INVALID = ["", "x", "1.x", "1..2", "latest", "1.0-", "1.0+", "1.0 beta gamma", "99999999999999999999"]


def test_version_order_is_the_packaging_order(spark):
    pairs = list(itertools.product(VERSIONS, VERSIONS))
    a, b = dp.version_key(F.col("a")), dp.version_key(F.col("b"))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", (a < b).alias("lt"), (a == b).alias("eq")).collect()
    wrong = [tuple(r) for r in got if (r["lt"], r["eq"]) != (Version(r.a) < Version(r.b), Version(r.a) == Version(r.b))]
    assert wrong == []


def test_other_texts_are_no_versions(spark):
    got = spark.createDataFrame([(v,) for v in INVALID], "v string").select(dp.version_key(F.col("v")).isNull().alias("none")).collect()
    assert all(r["none"] for r in got)
    for v in INVALID[:-1]:
        with pytest.raises(InvalidVersion):
            Version(v)


def test_vulnerable_ranges(spark):
    ranges = [("jinja2", "2.0.0", "3.1.3", "A"), ("urllib3", "1.0.0", "1.26.18", "B"), ("many", None, "1.5", "C"),
              ("many", "2.0", "2.3.dev1", "D"), ("many", "3", None, "E"), ("Odd_Name", "1", "2", "F")]
    adv = spark.createDataFrame(ranges, "package string, introduced string, fixed string, advisory_id string")
    lines = ["jinja2==2.0", "jinja2==3.1.3rc1", "jinja2==3.1.3", "urllib3==1", "many==1.5rc1", "many==2.3", "many==2.2.post1",
             "many==2.3.dev0", "many==4!0", "many==x", "many>=2.1", "odd.name==1.5", "many==2.3.dev0"]
    reqs = dp.parse_requirements(spark.createDataFrame(list(enumerate(lines)), "n int, line string"), ["n"])
    got = sorted((r.n, r.advisory_id) for r in dp.vulnerable_dependencies(reqs, adv).collect())
    want = []
    for n, line in enumerate(lines):
        name, _, version = line.partition("==")
        for package, low, high, i in ranges:
            try:
                if package.lower().replace("_", "-") == name.replace(".", "-") and version and (
                        low is None or Version(low) <= Version(version)) and (high is None or Version(version) < Version(high)):
                    want.append((n, i))
            except InvalidVersion:
                pass
    assert got == want == [(0, "A"), (1, "A"), (3, "B"), (4, "C"), (6, "D"), (7, "D"), (8, "E"), (11, "F"), (12, "D")]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_typosquats_equal_brute_force(spark):
    rng = random.Random(5)
    popular = sorted({"".join(rng.choice("abc-") for _ in range(rng.randrange(1, 8))) for _ in range(300)})
    used = sorted({"".join(rng.choice("abc-") for _ in range(rng.randrange(0, 8))) for _ in range(60)})
    reqs = spark.createDataFrame([(i, p) for i, p in enumerate(used + used[:3])], "n int, package string")
    got = {(r.n, r.package, r.popular, r.distance) for r in dp.typosquats(reqs, popular).collect()}
    want = {(i, a, b, edits(a, b)) for i, a in enumerate(used + used[:3]) for b in popular if 1 <= edits(a, b) <= 2}
    assert got == want and len(want) > 500


def test_typosquats_of_a_large_table(spark):
    """10,000 popular names, by edits of known distance."""
    rng = random.Random(6)
    popular = sorted({"".join(rng.choice(string.ascii_lowercase) for _ in range(12)) for _ in range(10_000)})
    reqs = []
    for name in popular[::50]:
        i, j = sorted(rng.sample(range(12), 2))
        reqs += [name[:i] + name[i + 1:], name[:i] + "0" + name[i:j] + "1" + name[j:], name[:i] + "0" + name[i + 1:], name, name + "000"]
    table = spark.createDataFrame([(p,) for p in popular], "popular string")
    df = dp.typosquats(spark.createDataFrame([(r,) for r in reqs], "package string"), table)
    got = {}
    for r in df.collect():
        got.setdefault(r.package, set()).add((r.popular, r.distance))
    for k, name in enumerate(popular[::50]):
        a, b, c, same, far = reqs[5 * k:5 * k + 5]
        assert (name, 1) in got[a] and (name, 2) in got[b] and (name, 1) in got[c]
        assert (name, 0) not in got.get(same, set()) and name not in {p for p, _ in got.get(far, set())}
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_unicode_functions_are_tested(spark):
    patch = "+def größe(a):\n+def weite(a):\n+    pass"
    test = "+def test_x():\n+    assert größe(1)"
    files = spark.createDataFrame([("r", 1, 1, "src/a.py", patch), ("r", 1, 2, "tests/test_a.py", test)],
                                  "repo_name string, pr_number bigint, file_pos int, filename string, patch string")
    lines = bk.patch_lines(files)
    assert [r.name for r in dp.test_gaps(bk.extract_definitions(lines), lines).collect()] == ["weite"]


def test_query_text_with_null_fields(spark):
    rows = [("r", p, i, f"f{i}" if p else None, None, None, None, None) for p in range(3) for i in range(1, 301)]
    files = spark.createDataFrame(rows, "repo_name string, pr_number bigint, file_pos int, filename string, status string, "
                                        "patch string, additions bigint, deletions bigint")
    full = {r.pr_number: r.diff[:500] for r in rv.diff_text(files).collect()}
    assert {r.pr_number: r.query for r in rv.query_text(files).collect()} == full
    assert {len(t) for t in full.values()} == {500}
