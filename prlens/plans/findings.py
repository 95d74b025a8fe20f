"""Registered queries: tool reports, findings, status, scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from prlens.operators import breaking as bk, filters, findings as fd, scans
from prlens.plans.changes import KEPT_LINES_SQL, LINES_SQL
from prlens.plans.intake import ROUTE_SQL, kept_files, kept_patches, resolved_config
from prlens.plans.registry import register
from prlens.sources import fixtures as fx, prs

FIND_COLS = ["repo_name", "pr_number", "tool", "file", "line", "severity", "message", "rule_id", "suggestion"]


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _rules_sql(rules, src: str, cols: str, text: str = "code", first_only: bool = False) -> str:
    parts = []
    for pos, r in enumerate(rules):
        cond = f"regexp_matches({text}, {q(r.pattern)})"
        if r.unless:
            cond += f" AND NOT regexp_matches({text}, {q(r.unless)})"
        if first_only:
            for prev in rules[:pos]:
                pc = f"regexp_matches({text}, {q(prev.pattern)})"
                if prev.unless:
                    pc = f"({pc} AND NOT regexp_matches({text}, {q(prev.unless)}))"
                cond += f" AND NOT {pc}"
        parts.append(f"SELECT {cols}, {pos} AS rule_pos, {q(r.rule_id)} AS rule_id, {q(r.severity)} AS severity, "
                     f"{q(r.message)} AS message FROM {src} WHERE {cond}")
    return "\nUNION ALL\n".join(parts)


#: Reports as S3 leaves them, with the error each would have failed its tool with.
#: ``first(list)`` is the first problem in document order.
def _first(elements: str, cases: str) -> str:
    return f"list_filter(list_transform({elements}, lambda e: CASE {cases} END), lambda x: x IS NOT NULL)[1]"


def _missing(key: str, of: str = "e") -> str:
    return f"WHEN json_type({of}, '$.{key}') IS NULL THEN '''{key}'''"


_GET = "'''str'' object has no attribute ''get'''"
_NOGET = "'''NoneType'' object has no attribute ''get'''"
_ITER = "'''NoneType'' object is not iterable'"
_OBJ = "json_type(e) <> 'OBJECT'"

REP_SQL = f"""rep0 AS (
  SELECT repo_name, pr_number, tool, coalesce(nullif(regexp_replace(report, '^\\s+|\\s+$', '', 'g'), ''),
         CASE tool WHEN 'bandit' THEN '{{}}' WHEN 'ruff' THEN '[]' WHEN 'radon' THEN '{{}}' WHEN 'eslint' THEN '[]'
                   WHEN 'pip-audit' THEN '[]' END, '{{}}') AS report FROM fx_tool_report),
rep1 AS (
  SELECT *, json_valid(report) AND (starts_with(report, '[') OR starts_with(report, '{{')) AS ok FROM rep0),
rep2 AS (SELECT *, CASE WHEN ok THEN CAST(report AS JSON) ELSE CAST('[]' AS JSON) END AS j FROM rep1),
rep AS (
  SELECT *, CASE WHEN NOT ok THEN 'report is not valid JSON'
    WHEN tool = 'bandit' THEN CASE
      WHEN json_type(j) = 'ARRAY' THEN '''list'' object has no attribute ''get'''
      WHEN json_type(j, '$.results') IS NULL THEN NULL
      WHEN json_type(j, '$.results') = 'NULL' THEN {_ITER}
      ELSE {_first("json_extract(j, '$.results[*]')", f"WHEN {_OBJ} THEN {_GET} {_missing('filename')} {_missing('line_number')} {_missing('issue_text')}")} END
    WHEN tool = 'ruff' THEN CASE
      WHEN json_type(j) = 'OBJECT' THEN CASE WHEN report = '{{}}' THEN NULL ELSE {_GET} END
      ELSE {_first("json_extract(j, '$[*]')", f"WHEN {_OBJ} THEN {_GET} WHEN json_type(e, '$.code') = 'NULL' THEN '''NoneType'' object has no attribute ''startswith''' {_missing('filename')} WHEN json_type(e, '$.location') = 'NULL' THEN {_NOGET}")} END
    WHEN tool = 'radon' THEN CASE
      WHEN json_type(j) = 'ARRAY' THEN '''list'' object has no attribute ''items'''
      ELSE {_first("json_extract(j, '$.*')", f"WHEN json_type(e) = 'NULL' THEN {_ITER} WHEN json_type(e) = 'OBJECT' AND len(json_keys(e)) > 0 THEN {_GET}")} END
    WHEN tool = 'eslint' THEN CASE
      WHEN json_type(j) = 'OBJECT' THEN CASE WHEN report = '{{}}' THEN NULL ELSE {_GET} END
      ELSE {_first("json_extract(j, '$[*]')", f"WHEN {_OBJ} THEN {_GET} WHEN json_type(e, '$.messages') = 'NULL' THEN {_ITER}")} END
    WHEN tool = 'pip-audit' THEN CASE
      WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.dependencies') = 'NULL' THEN {_ITER}
      ELSE {_first("CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE json_extract(j, '$.dependencies[*]') END",
                   f"WHEN {_OBJ} THEN {_GET} WHEN json_type(e, '$.vulns') = 'NULL' THEN {_ITER} "
                   "WHEN json_type(e, '$.name') IS NULL AND coalesce(json_array_length(e, '$.vulns'), 0) > 0 THEN '''name'''")} END
    END AS err FROM rep2)"""


def _els(expr: str, where: str, pos: str = "ord") -> str:
    """Rows (repo_name, pr_number, v, pos) of a JSON array expression over ``rep``."""
    return (f"(SELECT * EXCLUDE (vs), unnest(vs) AS v, generate_subscripts(vs, 1) - 1 AS {pos} "
            f"FROM (SELECT *, {expr} AS vs FROM {where}) a)")


def _txt(path: str, of: str = "v") -> str:
    return f"json_extract_string({of}, '$.{path}')"


NORM_SQL = REP_SQL + f""",
good AS (SELECT repo_name, pr_number, tool, j FROM rep WHERE err IS NULL),
bandit AS (
  SELECT repo_name, pr_number, 'bandit' AS tool, [0, ord] AS ord, {_txt('filename')} AS file,
         coalesce(TRY_CAST({_txt('line_number')} AS BIGINT), 0) AS line, coalesce({_txt('issue_severity')}, 'MEDIUM') AS severity,
         coalesce({_txt('issue_text')}, 'None') || ' (CWE-' || CASE WHEN json_type(v, '$.issue_cwe') = 'OBJECT' THEN
           CASE WHEN json_type(v, '$.issue_cwe.id') IS NULL THEN 'N/A' ELSE coalesce({_txt('issue_cwe.id')}, 'None') END ELSE 'N/A' END
           || ')' AS message, coalesce({_txt('test_id')}, '') AS rule_id, '' AS suggestion
  FROM {_els("json_extract(j, '$.results[*]')", "good WHERE tool = 'bandit'")}),
ruff AS (
  SELECT repo_name, pr_number, 'ruff' AS tool, [0, ord] AS ord, {_txt('filename')} AS file,
         coalesce(TRY_CAST({_txt('location.row')} AS BIGINT), 0) AS line,
         CASE WHEN starts_with(code, 'E9') OR starts_with(code, 'F8') OR starts_with(code, 'F6') THEN 'HIGH'
              WHEN starts_with(code, 'E') OR starts_with(code, 'W') THEN 'MEDIUM' ELSE 'LOW' END AS severity,
         '[' || code || '] ' || coalesce({_txt('message')}, '') AS message, code AS rule_id,
         coalesce({_txt('fix.message')}, '') AS suggestion
  FROM (SELECT *, coalesce({_txt('code')}, '') AS code FROM {_els("json_extract(j, '$[*]')", "good WHERE tool = 'ruff'")} a) b),
radon AS (
  SELECT repo_name, pr_number, 'radon' AS tool, [fpos, bpos] AS ord, path AS file, coalesce(TRY_CAST({_txt('lineno')} AS BIGINT), 0) AS line,
         CASE WHEN cx >= 20 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
         '''' || coalesce({_txt('name')}, '?') || ''' has cyclomatic complexity ' || CAST(cx AS VARCHAR) || ' (rank '
           || coalesce({_txt('rank')}, '?') || ')' AS message, 'CC' || CAST(cx AS VARCHAR) AS rule_id,
         'Break into smaller functions — complexity ' || CAST(cx AS VARCHAR) || ' exceeds threshold 10' AS suggestion
  FROM (SELECT *, coalesce(TRY_CAST({_txt('complexity')} AS BIGINT), 0) AS cx FROM (
        SELECT * EXCLUDE (bl), unnest(bl) AS v, generate_subscripts(bl, 1) - 1 AS bpos
        FROM (SELECT *, json_extract(blocks, '$[*]') AS bl FROM (
              SELECT repo_name, pr_number, unnest(json_keys(j)) AS path, unnest(json_extract(j, '$.*')) AS blocks,
                     generate_subscripts(json_keys(j), 1) - 1 AS fpos FROM good WHERE tool = 'radon') x) a) b) c
  WHERE cx >= 10),
eslint AS (
  SELECT repo_name, pr_number, 'eslint' AS tool, [fpos, mpos] AS ord, path AS file, coalesce(TRY_CAST({_txt('line')} AS BIGINT), 0) AS line,
         CASE WHEN coalesce(TRY_CAST({_txt('severity')} AS BIGINT), 1) >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
         '[' || rule || '] ' || coalesce({_txt('message')}, '') AS message, rule AS rule_id, coalesce({_txt('fix.text')}, '') AS suggestion
  FROM (SELECT *, CASE WHEN json_type(v, '$.ruleId') IS NULL THEN 'unknown' ELSE coalesce({_txt('ruleId')}, 'None') END AS rule FROM (
        SELECT * EXCLUDE (ms), unnest(ms) AS v, generate_subscripts(ms, 1) - 1 AS mpos
        FROM (SELECT repo_name, pr_number, fpos, coalesce({_txt('filePath')}, '') AS path, json_extract(v, '$.messages[*]') AS ms
              FROM {_els("json_extract(j, '$[*]')", "good WHERE tool = 'eslint'", "fpos")} x) a) b) c),
audit AS (
  SELECT repo_name, pr_number, 'pip-audit' AS tool, [dpos, vpos] AS ord, 'requirements.txt' AS file, CAST(0 AS BIGINT) AS line,
         'HIGH' AS severity,
         {_txt('name', 'dep')} || '==' || coalesce({_txt('version', 'dep')}, '?') || ': ' || coalesce({_txt('id')}, 'Unknown CVE') || ' — '
           || substring(coalesce({_txt('description')}, ''), 1, 200) AS message,
         coalesce({_txt('id')}, '') AS rule_id,
         CASE WHEN len(coalesce(fixes, [])) > 0 THEN 'Upgrade to ' || array_to_string(fixes, ', ')
              ELSE 'No fix available yet' END AS suggestion
  FROM (SELECT *, json_extract_string(v, '$.fix_versions[*]') AS fixes FROM (
        SELECT * EXCLUDE (vs), unnest(vs) AS v, generate_subscripts(vs, 1) - 1 AS vpos
        FROM (SELECT repo_name, pr_number, dpos, v AS dep, json_extract(v, '$.vulns[*]') AS vs
              FROM {_els("CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE json_extract(j, '$.dependencies[*]') END",
                         "good WHERE tool = 'pip-audit'", "dpos")} x) a) b) c)"""

SECRETS_SQL = ",\nsecret_hits AS (\n" + _rules_sql(
    scans.SECRET_RULES, "(SELECT * FROM pl WHERE side = 'added') s",
    "repo_name, pr_number, file_pos, filename, line_no") + "),\n" + """secrets AS (
  SELECT repo_name, pr_number, 'detect-secrets' AS tool, [line_no, rule_pos] AS ord, filename AS file,
         line_no AS line, severity, message, rule_id,
         'Move the value to an environment variable or a secret store' AS suggestion FROM secret_hits)"""

ALL_SQL = f"""WITH {KEPT_LINES_SQL}{SECRETS_SQL}, {ROUTE_SQL}, {NORM_SQL},
found AS (
  SELECT * FROM bandit UNION ALL SELECT * FROM ruff UNION ALL SELECT * FROM radon UNION ALL SELECT * FROM eslint
  UNION ALL SELECT * FROM audit UNION ALL
  SELECT repo_name, pr_number, tool, ord, file, line, severity, message, rule_id, suggestion FROM secrets),
fails AS (SELECT repo_name, pr_number, tool, min(err) AS error FROM rep WHERE err IS NOT NULL GROUP BY ALL),
counts AS (SELECT repo_name, pr_number, tool, count(*) AS n_raw FROM found GROUP BY ALL),
targets AS (SELECT repo_name, pr_number, count(*) AS n_targets FROM kept k WHERE filename LIKE '%.py'
            AND EXISTS (SELECT 1 FROM fx_commit c WHERE c.repo_name = k.repo_name AND c.path = k.filename) GROUP BY ALL),
status AS (
  SELECT r.repo_name, r.pr_number, r.tool, r.tool_pos, f.error IS NULL AS success,
         CAST(CASE WHEN f.error IS NULL THEN coalesce(c.n_raw, 0) ELSE 0 END AS BIGINT) AS n_findings,
         CASE WHEN f.error IS NOT NULL THEN ''
              WHEN r.tool = 'bandit' AND coalesce(t.n_targets, 0) = 0 THEN 'Changed files not found in workspace.'
              WHEN r.tool = 'bandit' THEN 'Scanned ' || CAST(coalesce(t.n_targets, 0) AS VARCHAR) || ' files, found '
                   || CAST(coalesce(c.n_raw, 0) AS VARCHAR) || ' security issues.'
              WHEN r.tool = 'ruff' THEN 'Found ' || CAST(coalesce(c.n_raw, 0) AS VARCHAR) || ' linting issues.'
              WHEN r.tool = 'radon' THEN 'Found ' || CAST(coalesce(c.n_raw, 0) AS VARCHAR) || ' high-complexity blocks.'
              WHEN r.tool = 'eslint' THEN 'Found ' || CAST(coalesce(c.n_raw, 0) AS VARCHAR) || ' JS/TS issues.'
              WHEN r.tool = 'pip-audit' THEN 'Scanned dependencies, found ' || CAST(coalesce(c.n_raw, 0) AS VARCHAR)
                   || ' vulnerabilities.'
              WHEN r.tool = 'detect-secrets' THEN 'Found ' || CAST(coalesce(c.n_raw, 0) AS VARCHAR) || ' potential secrets.'
              ELSE '' END AS summary,
         coalesce(f.error, '') AS error
  FROM routed r LEFT JOIN fails f ON f.repo_name = r.repo_name AND f.pr_number = r.pr_number AND f.tool = r.tool
  LEFT JOIN counts c ON c.repo_name = r.repo_name AND c.pr_number = r.pr_number AND c.tool = r.tool
  LEFT JOIN targets t ON t.repo_name = r.repo_name AND t.pr_number = r.pr_number AND r.tool = 'bandit'),
unified AS (
  SELECT f.*, s.tool_pos, '[' || f.tool || '] ' || f.message AS tagged_message FROM found f
  JOIN status s ON s.repo_name = f.repo_name AND s.pr_number = f.pr_number AND s.tool = f.tool AND s.success)"""


def _reports(spark, d):
    return prs.load_tool_reports(fx.fx_tool_report(spark, d)).drop("root", "parse_ok")


def _lines(spark, d):
    return bk.patch_lines(fx.fx_patch(spark, d))


def _secrets(spark, d):
    return scans.secret_findings(bk.patch_lines(kept_patches(spark, d), where=scans.may_hold_secret))


def _routes(spark, d):
    return filters.route_tools(fx.fx_pr(spark, d), kept_files(spark, d))


def _results(spark, d):
    return fd.tool_results(_routes(spark, d), _reports(spark, d), _secrets(spark, d))


def _status(spark, d):
    python = filters.language_files(kept_files(spark, d)).filter(F.col("tool") == "bandit")
    return fd.tool_status(_results(spark, d), filters.existing_targets(python, fx.fx_commit(spark, d)))


def _unified(spark, d):
    return fd.unified_findings(_routes(spark, d), fd.all_tool_findings(_reports(spark, d), _secrets(spark, d)))


def _fcols(df):
    return df.select(*FIND_COLS)


@register("load_tool_reports", """
SELECT repo_name, pr_number, tool, report,
       CASE WHEN starts_with(report, '[') THEN 'array' WHEN starts_with(report, '{') THEN 'object' ELSE 'invalid' END AS root,
       json_valid(report) AND (starts_with(report, '[') OR starts_with(report, '{')) AS parse_ok
FROM (SELECT repo_name, pr_number, tool, coalesce(nullif(regexp_replace(report, '^\\s+|\\s+$', '', 'g'), ''),
        CASE tool WHEN 'bandit' THEN '{}' WHEN 'ruff' THEN '[]' WHEN 'radon' THEN '{}' WHEN 'eslint' THEN '[]'
                  WHEN 'pip-audit' THEN '[]' END, '{}') AS report FROM fx_tool_report) r
""")
def q_load_tool_reports(spark, d):
    r = prs.load_tool_reports(fx.fx_tool_report(spark, d))
    return r.select("repo_name", "pr_number", "tool", "report", "root", "parse_ok")


@register("norm_bandit", f"WITH {NORM_SQL}\nSELECT {', '.join(FIND_COLS)} FROM bandit")
def q_norm_bandit(spark, d):
    return _fcols(fd.norm_bandit(_reports(spark, d)))


@register("norm_ruff", f"WITH {NORM_SQL}\nSELECT {', '.join(FIND_COLS)} FROM ruff")
def q_norm_ruff(spark, d):
    return _fcols(fd.norm_ruff(_reports(spark, d)))


@register("norm_radon", f"WITH {NORM_SQL}\nSELECT {', '.join(FIND_COLS)} FROM radon")
def q_norm_radon(spark, d):
    return _fcols(fd.norm_radon(_reports(spark, d)))


@register("norm_eslint", f"WITH {NORM_SQL}\nSELECT {', '.join(FIND_COLS)} FROM eslint")
def q_norm_eslint(spark, d):
    return _fcols(fd.norm_eslint(_reports(spark, d)))


@register("norm_dependency_audit", f"WITH {NORM_SQL}\nSELECT {', '.join(FIND_COLS)} FROM audit")
def q_norm_dependency_audit(spark, d):
    return _fcols(fd.norm_dependency_audit(_reports(spark, d)))


WORKSPACE_SQL = "'/work/' || repo_name || '/'"


@register("relativize_paths", f"""
WITH {NORM_SQL}
SELECT repo_name, pr_number, CASE WHEN starts_with(abs_file, {WORKSPACE_SQL}) THEN substring(abs_file, length({WORKSPACE_SQL}) + 1)
       ELSE abs_file END AS file, line FROM (SELECT *, '/work/' || repo_name || '/' || file AS abs_file FROM bandit) b
""")
def q_relativize_paths(spark, d):
    """Bandit reports absolute paths under a per-repo workspace; strip the root."""
    b = fd.norm_bandit(_reports(spark, d))
    root = F.concat(F.lit("/work/"), F.col("repo_name"), F.lit("/"))
    b = b.withColumn("file", F.concat(root, F.col("file")))
    return fd.relativize_paths(b, root).select("repo_name", "pr_number", "file", "line")


@register("tool_status", ALL_SQL + """
SELECT repo_name, pr_number, tool, CAST(tool_pos AS BIGINT) AS tool_pos, success, n_findings, summary, error FROM status
""")
def q_tool_status(spark, d):
    s = _status(spark, d)
    return s.select("repo_name", "pr_number", "tool", F.col("tool_pos").cast("bigint").alias("tool_pos"), "success",
                    "n_findings", "summary", "error")


@register("unified_findings", ALL_SQL + f"""
SELECT {', '.join(FIND_COLS)}, CAST(tool_pos AS BIGINT) AS tool_pos, tagged_message FROM unified
""")
def q_unified_findings(spark, d):
    u = _unified(spark, d)
    return u.select(*FIND_COLS, F.col("tool_pos").cast("bigint").alias("tool_pos"), "tagged_message")


@register("tool_prompt_text", ALL_SQL + """
SELECT s.repo_name, s.pr_number, s.tool, CAST(s.tool_pos AS BIGINT) AS tool_pos,
  CASE WHEN NOT s.success THEN '[' || s.tool || '] Not available: ' || s.error
       WHEN s.n_findings = 0 THEN '[' || s.tool || '] No issues found.'
       ELSE '[' || s.tool || '] ' || CAST(s.n_findings AS VARCHAR) || ' issue(s):' || chr(10) || l.txt END AS text
FROM status s LEFT JOIN (
  SELECT repo_name, pr_number, tool, string_agg('  - [' || severity || '] ' || file || ':' || CAST(line AS VARCHAR) || ' — '
         || message || CASE WHEN suggestion <> '' THEN chr(10) || '    Suggested fix: ' || suggestion ELSE '' END,
         chr(10) ORDER BY file, ord) AS txt
  FROM found GROUP BY ALL) l ON l.repo_name = s.repo_name AND l.pr_number = s.pr_number AND l.tool = s.tool
""")
def q_tool_prompt_text(spark, d):
    t = fd.tool_prompt_text(_results(spark, d))
    return t.select("repo_name", "pr_number", "tool", F.col("tool_pos").cast("bigint").alias("tool_pos"), "text")


@register("finding_totals", ALL_SQL + """
SELECT repo_name, pr_number, CAST(sum(n_findings) AS BIGINT) AS total_findings,
       CAST(count(*) FILTER (WHERE success) AS BIGINT) AS tools_ok, CAST(count(*) FILTER (WHERE NOT success) AS BIGINT) AS tools_failed
FROM status GROUP BY ALL
""")
def q_finding_totals(spark, d):
    return fd.finding_totals(_status(spark, d))


@register("severity_filter", ALL_SQL + f"""
SELECT u.repo_name, u.pr_number, u.tool, u.file, u.line, u.severity, u.message FROM unified u JOIN cfg c ON c.repo_name = u.repo_name
WHERE (CASE upper(c.severity_threshold) WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 0 END) <= 1
   OR (CASE upper(u.severity) WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 0 END)
      >= (CASE upper(c.severity_threshold) WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 0 END)
""")
def q_severity_filter(spark, d):
    s = fd.severity_filter(_unified(spark, d), resolved_config(spark, d))
    return s.select("repo_name", "pr_number", "tool", "file", "line", "severity", "message")


INLINE_SQL = """inline AS (
  SELECT repo_name, pr_number, comment_pos, file AS path, line,
         '**' || coalesce(severity, 'INFO') || '**: ' || tagged_message ||
         CASE WHEN coalesce(suggestion, '') <> '' THEN chr(10) || chr(10) || '**Suggested fix**: ' || suggestion ELSE '' END AS body
  FROM (SELECT *, row_number() OVER (PARTITION BY repo_name, pr_number ORDER BY tool_pos, file, ord) AS comment_pos FROM unified) x
  WHERE comment_pos <= 25 AND line >= 1)"""


@register("inline_comments", ALL_SQL + ", " + INLINE_SQL + """
SELECT repo_name, pr_number, CAST(comment_pos AS BIGINT) AS comment_pos, path, line, body FROM inline
""")
def q_inline_comments(spark, d):
    c = fd.inline_comments(_unified(spark, d))
    return c.select("repo_name", "pr_number", F.col("comment_pos").cast("bigint").alias("comment_pos"), "path", "line",
                    "body")


# ---- rule scans (A1-A7, A12) ----

@register("entropy_scan", f"""WITH {LINES_SQL},
tok AS (SELECT * EXCLUDE (ts), unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS token_pos FROM (
          SELECT repo_name, pr_number, file_pos, filename, line_no, regexp_extract_all(code, {q(scans.TOKEN_RX)}, 1) AS ts
          FROM pl WHERE side = 'added') a)
SELECT repo_name, pr_number, CAST(file_pos AS BIGINT) AS file_pos, filename, CAST(line_no AS BIGINT) AS line_no,
       CAST(token_pos AS BIGINT) AS token_pos, CAST(length(token) AS BIGINT) AS token_chars, round(bits, 6) AS entropy
FROM (SELECT *, list_entropy(string_split(token, '')) AS bits FROM tok WHERE NOT regexp_matches(token, {q(scans.DIGEST_RX)})) t
WHERE bits >= CASE WHEN regexp_matches(token, {q(scans.HEX_RX)}) THEN {scans.MIN_HEX_BITS} ELSE {scans.MIN_BITS} END
""")
def q_entropy_scan(spark, d):
    """A1 by entropy."""
    e = scans.entropy_scan(_lines(spark, d))
    return e.select("repo_name", "pr_number", *[F.col(c).cast("bigint").alias(c) for c in ("file_pos",)], "filename",
                    *[F.col(c).cast("bigint").alias(c) for c in ("line_no", "token_pos", "token_chars")], "entropy")


SCAN_COLS = "repo_name, pr_number, filename, line_no"


def _scan_sql(rules) -> str:
    return ("WITH " + LINES_SQL + ",\nhits AS (\n"
            + _rules_sql(rules, "(SELECT * FROM pl WHERE side = 'added') s", SCAN_COLS) + ")\n"
            "SELECT repo_name, pr_number, filename, CAST(line_no AS BIGINT) AS line_no, rule_id, severity, message FROM hits")


def _scan_cols(df):
    return df.select("repo_name", "pr_number", "filename", F.col("line_no").cast("bigint").alias("line_no"), "rule_id",
                     "severity", "message")


@register("secret_scan", _scan_sql(scans.SECRET_RULES))
def q_secret_scan(spark, d):
    return _scan_cols(scans.secret_scan(_lines(spark, d)))


@register("security_pattern_scan", _scan_sql(scans.SECURITY_RULES))
def q_security_pattern_scan(spark, d):
    return _scan_cols(scans.security_pattern_scan(_lines(spark, d)))


@register("failure_pattern_scan", _scan_sql(scans.FAILURE_RULES))
def q_failure_pattern_scan(spark, d):
    return _scan_cols(scans.failure_pattern_scan(_lines(spark, d)))


@register("maintainability_scan", _scan_sql(scans.MAINTAINABILITY_RULES))
def q_maintainability_scan(spark, d):
    return _scan_cols(scans.maintainability_scan(_lines(spark, d)))


@register("performance_pattern_scan", "WITH " + LINES_SQL + f""",
a AS (SELECT *, length(regexp_extract(raw, '^[ \\t]*', 0)) AS indent, regexp_matches(code, {q(scans.LOOP_RX)}) AS is_for
      FROM pl WHERE side = 'added'),
b AS (SELECT *, min(CASE WHEN is_for THEN indent END) OVER (PARTITION BY repo_name, pr_number, filename ORDER BY line_no
                ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS loop_indent FROM a),
c AS (SELECT *, coalesce(loop_indent < indent, false) AS in_loop FROM b)
SELECT repo_name, pr_number, filename, CAST(line_no AS BIGINT) AS line_no, 'query-in-loop' AS rule_id, 'HIGH' AS severity,
       'Query or HTTP call inside a loop (N+1)' AS message FROM c WHERE in_loop AND regexp_matches(code, {q(scans.CALL_RX)})
UNION ALL SELECT repo_name, pr_number, filename, line_no, 'nested-loop', 'MEDIUM', 'Nested loop (quadratic)' FROM c
  WHERE in_loop AND is_for
UNION ALL SELECT repo_name, pr_number, filename, line_no, 'select-star', 'LOW', 'SELECT * loads every column' FROM c
  WHERE regexp_matches(code, {q(scans.SELECT_STAR_RX)})
UNION ALL SELECT repo_name, pr_number, filename, line_no, 'unbounded-cache', 'MEDIUM', 'Module-level cache without a bound'
  FROM c WHERE indent = 0 AND regexp_matches(code, {q(scans.CACHE_RX)})
""")
def q_performance_pattern_scan(spark, d):
    return _scan_cols(scans.performance_pattern_scan(fx.fx_patch(spark, d)))


@register("function_length", "WITH " + LINES_SQL + """,
a AS (SELECT *, row_number() OVER (PARTITION BY repo_name, pr_number, filename ORDER BY line_no) AS rn,
             count(*) OVER (PARTITION BY repo_name, pr_number, filename) AS n_added FROM pl WHERE side = 'added'),
d AS (SELECT *, coalesce(lead(rn) OVER (PARTITION BY repo_name, pr_number, filename ORDER BY rn), n_added + 1) - rn AS length
      FROM a WHERE regexp_matches(code, '^def\\s+\\w+'))
SELECT repo_name, pr_number, filename, CAST(line_no AS BIGINT) AS line_no, regexp_extract(code, '^def\\s+(\\w+)', 1) AS name,
       CAST(length AS BIGINT) AS length, CASE WHEN length > 50 THEN 'HIGH' WHEN length > 30 THEN 'MEDIUM' END AS severity FROM d
""")
def q_function_length(spark, d):
    f = scans.function_length(fx.fx_patch(spark, d))
    return f.select("repo_name", "pr_number", "filename", F.col("line_no").cast("bigint").alias("line_no"), "name",
                    "length", "severity")


@register("duplicate_blocks", """
WITH l AS (SELECT repo_name, path, generate_subscripts(string_split(content, chr(10)), 1) AS pos,
                  regexp_replace(unnest(string_split(content, chr(10))), '^\\s+|\\s+$', '', 'g') AS t FROM fx_code_file),
nb AS (SELECT * FROM l WHERE t <> ''),
sh AS (SELECT repo_name, path, concat_ws(chr(10), t, lead(t, 1) OVER w, lead(t, 2) OVER w, lead(t, 3) OVER w, lead(t, 4) OVER w) AS shingle,
              lead(t, 4) OVER w IS NOT NULL AS is_full
       FROM nb WINDOW w AS (PARTITION BY repo_name, path ORDER BY pos))
SELECT repo_name, md5(shingle) AS shingle_id, CAST(count(*) AS BIGINT) AS n_places, CAST(count(DISTINCT path) AS BIGINT) AS n_files
FROM sh WHERE is_full GROUP BY repo_name, md5(shingle) HAVING count(*) >= 2
""")
def q_duplicate_blocks(spark, d):
    return scans.duplicate_blocks(fx.fx_code_file(spark, d))


DOC_LINES_SQL = """dl AS (SELECT repo_name, path, generate_subscripts(string_split(content, chr(10)), 1) AS line_no,
                  unnest(string_split(content, chr(10))) AS line FROM fx_code_file)"""


@register("secret_scan_documents", "WITH " + DOC_LINES_SQL + ",\nhits AS (\n"
          + _rules_sql(scans.SECRET_RULES, "dl", "repo_name, path, line_no", text="line") + """)
SELECT repo_name, path, CAST(line_no AS BIGINT) AS line_no, rule_id, severity, message FROM hits""")
def q_secret_scan_documents(spark, d):
    s = scans.secret_scan_texts(fx.fx_code_file(spark, d), "content", ["repo_name", "path"])
    return s.select("repo_name", "path", F.col("line_no").cast("bigint").alias("line_no"), "rule_id", "severity",
                    "message")


@register("license_flags", "WITH " + DOC_LINES_SQL + ",\nhits AS (\n"
          + _rules_sql(scans.LICENSE_RULES, "dl", "repo_name, path, line_no", text="line", first_only=True) + """)
SELECT repo_name, path, CAST(line_no AS BIGINT) AS line_no, rule_id AS license, message AS license_class FROM hits""")
def q_license_flags(spark, d):
    s = scans.license_flags(fx.fx_code_file(spark, d), "content", ["repo_name", "path"])
    return s.select("repo_name", "path", F.col("line_no").cast("bigint").alias("line_no"), "license", "license_class")


def _near_sql() -> str:
    """Every pair of files of a repo by its whole shingle sets (as text), closed by recursion."""
    n, (num, den) = scans.NEAR_SHINGLE_WORDS, scans.NEAR_THRESHOLD
    return f"""WITH RECURSIVE w AS (
  SELECT repo_name, path, regexp_split_to_array(regexp_replace(coalesce(content, ''), '^\\s+|\\s+$', '', 'g'), '\\s+') AS w
  FROM fx_code_file),
sh AS MATERIALIZED (
  SELECT DISTINCT repo_name, path, array_to_string(w[p:p + least(len(w), {n}) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), {n}) + 2)) AS p FROM w WHERE w[1] <> '') t),
sz AS (SELECT repo_name, path, count(*) AS n FROM sh GROUP BY ALL),
link AS MATERIALIZED (
  SELECT a.repo_name, a.path AS a, b.path AS b
  FROM sh a JOIN sh b ON b.repo_name = a.repo_name AND b.g = a.g AND a.path <> b.path
  JOIN sz sa ON sa.repo_name = a.repo_name AND sa.path = a.path
  JOIN sz sb ON sb.repo_name = b.repo_name AND sb.path = b.path
  GROUP BY a.repo_name, a.path, b.path, sa.n, sb.n HAVING {den} * count(*) >= {num} * (sa.n + sb.n - count(*))),
reach(repo_name, path, other) AS (
  SELECT repo_name, path, path FROM fx_code_file
  UNION SELECT r.repo_name, r.path, l.b FROM reach r JOIN link l ON l.repo_name = r.repo_name AND l.a = r.other),
near AS (SELECT repo_name, path, min(other) AS first_path, count(*) AS n_docs FROM reach GROUP BY ALL)"""


@register("near_duplicate_groups", _near_sql() + """
SELECT DISTINCT repo_name, first_path, n_docs FROM near WHERE n_docs > 1""")
def q_near_duplicate_groups(spark, d):
    """A7 near-duplicates: groups of files linked by their true Jaccard similarity."""
    return scans.near_duplicate_groups(fx.fx_code_file(spark, d))


@register("near_duplicate_files", _near_sql() + """
SELECT repo_name, path, first_path, n_docs FROM near""")
def q_near_duplicate_files(spark, d):
    """A7 near-duplicates: each file's group."""
    return scans.near_duplicate_files(fx.fx_code_file(spark, d))
