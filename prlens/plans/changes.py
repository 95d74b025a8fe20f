"""Registered queries: patch lines, definitions and breaking changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from prlens.operators import breaking as bk
from prlens.plans.intake import CONFIG_SQL, KEPT_PATCH_SQL, KEPT_SQL, kept_patches
from prlens.plans.registry import register
from prlens.session import written
from prlens.sources import fixtures as fx

LINES_SQL = r"""lines AS (
  SELECT repo_name, pr_number, file_pos, filename,
         generate_subscripts(string_split(patch, chr(10)), 1) - 1 AS line_no,
         unnest(string_split(patch, chr(10))) AS line
  FROM fx_patch WHERE patch IS NOT NULL),
pl AS (
  SELECT repo_name, pr_number, file_pos, filename, line_no, side,
         CASE WHEN side = 'removed'
              THEN regexp_replace(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^-+', ''), '^\s+|\s+$', '', 'g')
              ELSE regexp_replace(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^\++', ''), '^\s+|\s+$', '', 'g')
         END AS code, substring(line, 2) AS raw
  FROM (SELECT *, CASE WHEN starts_with(line, '-') AND NOT starts_with(line, '---') THEN 'removed'
                       WHEN starts_with(line, '+') AND NOT starts_with(line, '+++') THEN 'added' END AS side FROM lines) x
  WHERE side IS NOT NULL)"""

#: The lines that reviews look at (B3 onwards): files the repo ignores are left out.
KEPT_LINES_SQL = (f"{CONFIG_SQL}, {KEPT_SQL}, {KEPT_PATCH_SQL}, "
                  + LINES_SQL.replace("FROM fx_patch WHERE", "FROM kept_patch WHERE"))

DEFS_TAIL = r""",
dm AS (
  SELECT *, regexp_extract(code, '^def\s+([\p{L}\p{N}_]+)\s*\(([^)]*)\)', 1) AS dname,
         regexp_matches(code, '^def\s+([\p{L}\p{N}_]+)\s*\(([^)]*)\)') AS mdef,
         regexp_matches(code, '^class\s+([\p{L}\p{N}_]+)') AS mclass,
         regexp_matches(code, '^export\s+(?:default\s+)?(?:function|const|class|let|var)\s+([\p{L}\p{N}_]+)') AS mexport,
         regexp_matches(code, '@[\p{L}\p{N}_]+\.(get|post|put|delete|patch)\s*\(\s*["'']([^"'']+)') AS mdeco,
         regexp_matches(code, '\.(get|post|put|delete|patch)\s*\(\s*["'']([^"'']+)') AS mroute
  FROM pl),
defs AS (
  SELECT repo_name, pr_number, file_pos, filename, line_no, side, code,
    CASE WHEN mdef AND NOT starts_with(dname, '_') THEN 'function' WHEN mclass THEN 'class' WHEN mexport THEN 'export'
         WHEN mdeco OR mroute THEN 'endpoint' END AS kind,
    CASE WHEN mdef AND NOT starts_with(dname, '_') THEN dname WHEN mclass THEN regexp_extract(code, '^class\s+([\p{L}\p{N}_]+)', 1)
         WHEN mexport THEN regexp_extract(code, '^export\s+(?:default\s+)?(?:function|const|class|let|var)\s+([\p{L}\p{N}_]+)', 1) END AS name,
    CASE WHEN mdef AND NOT starts_with(dname, '_') THEN 'def ' || dname || '(' || regexp_extract(code, '^def\s+([\p{L}\p{N}_]+)\s*\(([^)]*)\)', 2) || ')' END AS sig,
    CASE WHEN mdef AND NOT starts_with(dname, '_') OR mclass OR mexport THEN NULL
         WHEN mdeco THEN upper(regexp_extract(code, '@[\p{L}\p{N}_]+\.(get|post|put|delete|patch)\s*\(\s*["'']([^"'']+)', 1))
         WHEN mroute THEN upper(regexp_extract(code, '\.(get|post|put|delete|patch)\s*\(\s*["'']([^"'']+)', 1)) END AS method,
    CASE WHEN mdef AND NOT starts_with(dname, '_') OR mclass OR mexport THEN NULL
         WHEN mdeco THEN regexp_extract(code, '@[\p{L}\p{N}_]+\.(get|post|put|delete|patch)\s*\(\s*["'']([^"'']+)', 2)
         WHEN mroute THEN regexp_extract(code, '\.(get|post|put|delete|patch)\s*\(\s*["'']([^"'']+)', 2) END AS path
  FROM dm WHERE (mdef AND NOT starts_with(dname, '_')) OR mclass OR mexport OR mdeco OR mroute)"""

DEFS_SQL = LINES_SQL + DEFS_TAIL

CHANGED_TAIL = DEFS_TAIL + r""",
oldd AS (SELECT repo_name, pr_number, file_pos, filename, name, arg_max(sig, line_no) AS old, min(line_no) AS line_no
         FROM defs WHERE side = 'removed' AND kind = 'function' GROUP BY ALL),
newd AS (SELECT repo_name, pr_number, filename, name, arg_max(sig, line_no) AS new
         FROM defs WHERE side = 'added' AND kind = 'function' GROUP BY ALL),
changed AS (SELECT o.repo_name, o.pr_number, o.file_pos, o.filename, o.name, o.old, n.new, o.line_no
            FROM oldd o JOIN newd n USING (repo_name, pr_number, filename, name) WHERE o.old <> n.new)"""

CHANGED_SQL = KEPT_LINES_SQL + CHANGED_TAIL

BREAKING_TAIL = CHANGED_TAIL + r""",
parts AS (
  SELECT repo_name, pr_number, 0 AS kind_pos, 'function' AS kind, file_pos, filename, line_no, name,
         'Public function `' || name || '` removed from `' || filename || '` — existing callers will break' AS message
  FROM defs d WHERE side = 'removed' AND kind IN ('function', 'export')
    AND NOT EXISTS (SELECT 1 FROM changed c WHERE c.repo_name = d.repo_name AND c.pr_number = d.pr_number AND c.name = d.name)
  UNION ALL
  SELECT repo_name, pr_number, 1, 'class', file_pos, filename, line_no, name,
         'Class `' || name || '` removed from `' || filename || '` — any code importing it will break'
  FROM defs WHERE side = 'removed' AND kind = 'class'
  UNION ALL
  SELECT repo_name, pr_number, 2, 'endpoint', file_pos, filename, line_no, NULL,
         'API endpoint `' || method || ' ' || path || '` removed from `' || filename || '` — clients will get 404s'
  FROM defs WHERE side = 'removed' AND kind = 'endpoint'
  UNION ALL
  SELECT repo_name, pr_number, 3, 'signature', file_pos, filename, line_no, name,
         'Function signature changed in `' || filename || '`: `' || old || '` → `' || new || '` — existing callers may break'
  FROM changed),
breaking AS (SELECT *, row_number() OVER (PARTITION BY repo_name, pr_number ORDER BY kind_pos, file_pos, line_no) AS finding_pos
             FROM parts)"""

BREAKING_SQL = KEPT_LINES_SQL + BREAKING_TAIL


def _defs(spark, d):
    return bk.patch_definitions(fx.fx_patch(spark, d))


def _kept_defs(spark, d):
    return bk.patch_definitions(kept_patches(spark, d))


def _ann(spark, d):
    return bk.annotate_definitions(_kept_defs(spark, d))


def breaking(spark, d):
    return bk.breaking_changes(kept_patches(spark, d))


def _i(c):
    return F.col(c).cast("bigint").alias(c)


@register("patch_lines", "WITH " + LINES_SQL + """
SELECT repo_name, pr_number, CAST(file_pos AS BIGINT) AS file_pos, CAST(line_no AS BIGINT) AS line_no, side, code, raw FROM pl
""")
def q_patch_lines(spark, d):
    pl = bk.patch_lines(fx.fx_patch(spark, d))
    return pl.select("repo_name", "pr_number", _i("file_pos"), _i("line_no"), "side", "code", "raw")


@register("extract_definitions", "WITH " + DEFS_SQL + """
SELECT repo_name, pr_number, CAST(file_pos AS BIGINT) AS file_pos, CAST(line_no AS BIGINT) AS line_no, side, kind, name,
       sig, method, path FROM defs
""")
def q_extract_definitions(spark, d):
    return _defs(spark, d).select("repo_name", "pr_number", _i("file_pos"), _i("line_no"), "side", "kind", "name",
                                  "sig", "method", "path")


@register("changed_signatures", "WITH " + CHANGED_SQL + """
SELECT repo_name, pr_number, filename, name, old, new, CAST(line_no AS BIGINT) AS line_no FROM changed
""")
def q_changed_signatures(spark, d):
    c = bk.changed_signatures(_ann(spark, d))
    return c.select("repo_name", "pr_number", "filename", "name", "old", "new", _i("line_no"))


@register("removed_functions", "WITH " + CHANGED_SQL + """
SELECT repo_name, pr_number, filename, CAST(line_no AS BIGINT) AS line_no, name FROM defs d
WHERE side = 'removed' AND kind IN ('function', 'export')
  AND NOT EXISTS (SELECT 1 FROM changed c WHERE c.repo_name = d.repo_name AND c.pr_number = d.pr_number AND c.name = d.name)
""")
def q_removed_functions(spark, d):
    r = bk.removed_functions(_ann(spark, d))
    return r.select("repo_name", "pr_number", "filename", _i("line_no"), "name")


@register("removed_classes", "WITH " + KEPT_LINES_SQL + DEFS_TAIL + """
SELECT repo_name, pr_number, filename, CAST(line_no AS BIGINT) AS line_no, name FROM defs
WHERE side = 'removed' AND kind = 'class'
""")
def q_removed_classes(spark, d):
    return bk.removed_classes(_kept_defs(spark, d)).select("repo_name", "pr_number", "filename", _i("line_no"), "name")


@register("removed_endpoints", "WITH " + KEPT_LINES_SQL + DEFS_TAIL + """
SELECT repo_name, pr_number, filename, CAST(line_no AS BIGINT) AS line_no, method, path FROM defs
WHERE side = 'removed' AND kind = 'endpoint'
""")
def q_removed_endpoints(spark, d):
    return bk.removed_endpoints(_kept_defs(spark, d)).select("repo_name", "pr_number", "filename", _i("line_no"),
                                                        "method", "path")


@register("breaking_changes", "WITH " + BREAKING_SQL + """
SELECT repo_name, pr_number, CAST(finding_pos AS BIGINT) AS finding_pos, kind, filename, message FROM breaking
""")
def q_breaking_changes(spark, d):
    return breaking(spark, d).select("repo_name", "pr_number", _i("finding_pos"), "kind", "filename", "message")


@register("breaking_changes_strict", "WITH " + KEPT_LINES_SQL + BREAKING_TAIL.replace(
    r"""'\.(get|post|put|delete|patch)\s*\(\s*["'']([^"'']+)'""", r"""'\.(get|post|put|delete|patch)\s*\(\s*["''](/[^"'']*)'""")
    .replace("AND NOT EXISTS (SELECT 1 FROM changed c", "AND NOT EXISTS (SELECT 1 FROM defs a WHERE a.repo_name = d.repo_name "
             "AND a.pr_number = d.pr_number AND a.filename = d.filename AND a.name = d.name AND a.side = 'added' "
             "AND a.kind IN ('function', 'export')) AND NOT EXISTS (SELECT 1 FROM changed c") + """
SELECT repo_name, pr_number, CAST(finding_pos AS BIGINT) AS finding_pos, kind, filename, message FROM breaking
""")
def q_breaking_changes_strict(spark, d):
    """B7, strict: routes must start with ``/``; a function added again in the same file is not removed."""
    b = bk.breaking_changes(kept_patches(spark, d), strict=True)
    return b.select("repo_name", "pr_number", _i("finding_pos"), "kind", "filename", "message")


@register("breaking_flags", "WITH " + BREAKING_SQL + """
SELECT p.repo_name, p.pr_number, CAST(count(b.finding_pos) AS BIGINT) AS n_breaking, count(b.finding_pos) > 0 AS has_breaking
FROM fx_pr p LEFT JOIN breaking b ON b.repo_name = p.repo_name AND b.pr_number = p.pr_number GROUP BY p.repo_name, p.pr_number
""")
def q_breaking_flags(spark, d):
    f = bk.breaking_flags(fx.fx_pr(spark, d), breaking(spark, d))
    return f.select("repo_name", "pr_number", _i("n_breaking"), "has_breaking")


def repo_code_tokens(spark, d):
    """Identifier tokens of the code each repo's PRs add (path = changed file)."""
    added = bk.patch_lines(kept_patches(spark, d)).filter(F.col("side") == "added")
    return bk.code_tokens(added.select("repo_name", F.col("filename").alias("path"), F.col("code").alias("content")))


@register("backward_compat_report", "WITH " + BREAKING_SQL + r""",
tokens AS (SELECT DISTINCT repo_name, path, token FROM (
  SELECT repo_name, filename AS path, unnest(regexp_split_to_array(code, '[^\p{L}\p{N}_]+')) AS token
  FROM pl WHERE side = 'added') t WHERE token <> '')
SELECT b.repo_name, b.pr_number, CAST(b.finding_pos AS BIGINT) AS finding_pos, b.kind, b.name, b.filename,
       CAST(count(t.path) AS BIGINT) AS n_caller_files
FROM breaking b LEFT JOIN tokens t ON t.repo_name = b.repo_name AND t.token = b.name AND t.path <> b.filename
WHERE b.name IS NOT NULL
GROUP BY b.repo_name, b.pr_number, b.finding_pos, b.kind, b.name, b.filename
""")
def q_backward_compat_report(spark, d):
    # The findings feed two consumers (the names, the report): written once, without
    # their texts, so the patch parse runs once and its shuffles can go.
    b = written(breaking(spark, d).filter("name IS NOT NULL").select(
        "repo_name", "pr_number", "finding_pos", "kind", "name", "filename"), "breaking")
    r = bk.backward_compat_report(b, repo_code_tokens(spark, d))
    return r.select("repo_name", "pr_number", _i("finding_pos"), "kind", "name", "filename", _i("n_caller_files"))
