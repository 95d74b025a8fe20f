"""Registered queries: dependency manifests and test gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from prlens.operators import breaking as bk, dependencies as dp
from prlens.plans.changes import DEFS_SQL
from prlens.plans.findings import q
from prlens.plans.registry import register
from prlens.sources import fixtures as fx

NAME_SQL = "lower(regexp_replace({x}, '[-_.]+', '-', 'g'))"
REQS_SQL = f"""reqs AS (
  SELECT repo_name, line_no, {NAME_SQL.format(x=f"regexp_extract(t, {q(dp.REQ_RX)}, 1)")} AS package,
         regexp_extract(t, {q(dp.REQ_RX)}, 3) AS op, regexp_extract(t, {q(dp.REQ_RX)}, 4) AS version
  FROM (SELECT repo_name, line_no, regexp_replace(regexp_replace(line, '#.*$', ''), '^\\s+|\\s+$', '', 'g') AS t
        FROM fx_requirement) a
  WHERE t <> '' AND {NAME_SQL.format(x=f"regexp_extract(t, {q(dp.REQ_RX)}, 1)")} <> '')"""


def _vkey(v: str) -> str:
    """The version order written anew: a list of numbers, each phase ten apart, then the local label's text."""
    ex = lambda i: f"regexp_extract({v}, {q(dp.VERSION_RX)}, {i})"
    num = lambda t: f"coalesce(TRY_CAST(nullif(regexp_extract({t}, '([0-9]+)$', 1), '') AS BIGINT), 0)"
    return (f"CASE WHEN regexp_matches({v}, {q(dp.VERSION_RX)}) THEN {{'e': {num(ex(1))}, "
            f"'r': list_transform(string_split(regexp_replace({ex(2)}, '(\\.0+)+$', ''), '.'), lambda x: CAST(x AS BIGINT)), "
            f"'p': CASE WHEN lower({ex(3)}) IN ('a', 'alpha') THEN 10 WHEN lower({ex(3)}) IN ('b', 'beta') THEN 20 "
            f"WHEN {ex(3)} <> '' THEN 30 WHEN {ex(6)} <> '' AND {ex(5)} = '' THEN 0 ELSE 40 END, 'n': {num(ex(4))}, "
            f"'o': CASE WHEN {ex(5)} = '' THEN -1 ELSE {num(ex(5))} END, "
            f"'d': CASE WHEN {ex(6)} = '' THEN 9223372036854775807 ELSE {num(ex(6))} END, 'l': {ex(7)}}} END")


def reqs(spark, d):
    return dp.parse_requirements(fx.fx_requirement(spark, d), ["repo_name", "line_no"])


@register("parse_requirements", f"WITH {REQS_SQL}\nSELECT repo_name, line_no, package, op, version FROM reqs")
def q_parse_requirements(spark, d):
    return reqs(spark, d)


@register("unpinned_dependencies", f"WITH {REQS_SQL}\nSELECT repo_name, line_no, package, op, version FROM reqs WHERE op <> '=='")
def q_unpinned_dependencies(spark, d):
    return dp.unpinned_dependencies(reqs(spark, d))


POPULAR_SQL = "(VALUES " + ", ".join(f"({q(p)})" for p in dp.POPULAR) + ") AS pop(popular)"


@register("typosquats", f"""WITH {REQS_SQL}
SELECT repo_name, line_no, package, popular, CAST(levenshtein(package, popular) AS BIGINT) AS distance
FROM reqs CROSS JOIN {POPULAR_SQL}
WHERE abs(length(package) - length(popular)) <= 2 AND package <> popular AND levenshtein(package, popular) BETWEEN 1 AND 2""")
def q_typosquats(spark, d):
    return dp.typosquats(reqs(spark, d)).select("repo_name", "line_no", "package", "popular", "distance")


ADV_SQL = "(VALUES " + ", ".join("(" + ", ".join("NULL::VARCHAR" if x is None else q(x) for x in r) + ")" for r in dp.ADVISORIES) \
    + ") AS adv(package, introduced, fixed, advisory_id)"


@register("vulnerable_dependencies", f"""WITH {REQS_SQL}
SELECT r.repo_name, r.line_no, r.package, r.version, adv.advisory_id, adv.fixed
FROM reqs r JOIN {ADV_SQL} ON {NAME_SQL.format(x="adv.package")} = r.package
WHERE r.op = '==' AND {_vkey('r.version')} IS NOT NULL
  AND (adv.introduced IS NULL OR {_vkey('r.version')} >= {_vkey("adv.introduced")})
  AND (adv.fixed IS NULL OR {_vkey('r.version')} < {_vkey("adv.fixed")})""")
def q_vulnerable_dependencies(spark, d):
    v = dp.vulnerable_dependencies(reqs(spark, d), dp.advisories_frame(spark))
    return v.select("repo_name", "line_no", "package", "version", "advisory_id", "fixed")


@register("deprecated_dependencies", f"""WITH {REQS_SQL}
SELECT repo_name, line_no, package, op, version FROM reqs WHERE package IN ({', '.join(q(x) for x in dp.DEPRECATED)})""")
def q_deprecated_dependencies(spark, d):
    return dp.deprecated_dependencies(reqs(spark, d))


@register("test_gaps", "WITH " + DEFS_SQL + f""",
tok AS (SELECT DISTINCT repo_name, pr_number, name FROM (
          SELECT repo_name, pr_number, unnest(regexp_split_to_array(code, '[^\\p{{L}}\\p{{N}}_]+')) AS name FROM pl
          WHERE side = 'added' AND regexp_matches(filename, {q(dp.TEST_PATH_RX)})) t WHERE name <> '')
SELECT d.repo_name, d.pr_number, d.filename, CAST(d.line_no AS BIGINT) AS line_no, d.name FROM defs d
WHERE d.side = 'added' AND d.kind = 'function' AND NOT regexp_matches(d.filename, {q(dp.TEST_PATH_RX)})
  AND NOT EXISTS (SELECT 1 FROM tok t WHERE t.repo_name = d.repo_name AND t.pr_number = d.pr_number AND t.name = d.name)""")
def q_test_gaps(spark, d):
    lines = bk.patch_lines(fx.fx_patch(spark, d))
    g = dp.test_gaps(bk.extract_definitions(lines), lines)
    return g.select("repo_name", "pr_number", "filename", F.col("line_no").cast("bigint").alias("line_no"), "name")
