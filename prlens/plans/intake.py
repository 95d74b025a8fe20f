"""Registered queries: intake, config, size guard, file selection."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from prlens.operators import filters, size
from prlens.plans.registry import register
from prlens.sources import config, fixtures as fx, prs

# The "now" of the hotspot queries and the 90-day window.
AS_OF = dt.datetime(2001, 8, 1)
WINDOW_DAYS = 90
SINCE = AS_OF - dt.timedelta(days=WINDOW_DAYS)
AS_OF_SQL = "TIMESTAMP '2001-08-01 00:00:00'"
SINCE_SQL = "TIMESTAMP '2001-05-03 00:00:00'"

# DuckDB twin of functions.glob_to_regex.
GLOB_RX_SQL = (
    "'(?s)^' || replace(replace(replace(regexp_replace({p}, '([.^$+(){{}}|\\\\])', '\\\\\\1', 'g'), "
    "'*', '.*'), '?', '.'), '[!', '[^') || '$'"
)


def resolved_config(spark, d):
    repos = fx.fx_pr(spark, d).select("repo_name").distinct()
    return config.resolve_config(repos, fx.fx_config_override(spark, d))


CONFIG_SQL = """cfg AS (
  SELECT r.repo_name, c.file_name AS config_file, coalesce(c.parse_ok, false) AS use_cfg, c.agents AS agents_o,
         CASE WHEN coalesce(c.parse_ok, false) THEN coalesce(c.severity_threshold, 'LOW') ELSE 'LOW' END AS severity_threshold,
         CASE WHEN coalesce(c.parse_ok, false) THEN coalesce(c.ignore, []::VARCHAR[]) ELSE []::VARCHAR[] END AS ignore,
         CAST(CASE WHEN coalesce(c.parse_ok, false) THEN coalesce(c.pr_size['max_lines'], 500) ELSE 500 END AS BIGINT) AS max_lines,
         CAST(CASE WHEN coalesce(c.parse_ok, false) THEN coalesce(c.pr_size['max_files'], 20) ELSE 20 END AS BIGINT) AS max_files
  FROM (SELECT DISTINCT repo_name FROM fx_pr) r
  LEFT JOIN (SELECT * FROM fx_config_override WHERE file_name IN ('.ai-reviewer.yml', '.ai-reviewer.yaml')
             QUALIFY row_number() OVER (PARTITION BY repo_name ORDER BY CASE file_name WHEN '.ai-reviewer.yml' THEN 0 ELSE 1 END) = 1) c
    ON c.repo_name = r.repo_name
)"""


def agent_sql(a: str) -> str:
    return f"CASE WHEN use_cfg THEN coalesce(agents_o['{a}'], true) ELSE true END"


@register("load_pr_files", """
SELECT p.repo_name, p.pr_number, p.author, CAST(f.file_pos AS BIGINT) AS file_pos, f.filename,
       CAST(f.additions AS BIGINT) AS additions, CAST(f.deletions AS BIGINT) AS deletions,
       coalesce(x.patch, 'Binary file or no changes') AS patch, x.status, p.head_sha
FROM fx_pr_file f JOIN fx_patch x ON x.pr_number = f.pr_number AND x.file_pos = f.file_pos
JOIN fx_pr p ON p.pr_number = f.pr_number
""")
def q_load_pr_files(spark, d):
    out = prs.load_pr_files(fx.fx_pr(spark, d).select("repo_name", "pr_number", "author", "head_sha"),
                            fx.fx_files(spark, d).drop("pk"))
    return out.select("repo_name", "pr_number", "author", F.col("file_pos").cast("bigint").alias("file_pos"),
                      "filename", "additions", "deletions", "patch", "status", "head_sha")


@register("load_pr_dump", """
SELECT p.repo_name, p.pr_number, CASE WHEN p.pr_number % 3 = 0 THEN '' ELSE 'body ' || CAST(p.pr_number AS VARCHAR) END AS body,
       CAST(f.file_pos AS BIGINT) AS file_pos, f.filename, x.status, coalesce(x.patch, 'Binary file or no changes') AS patch
FROM fx_pr_file f JOIN fx_patch x ON x.pr_number = f.pr_number AND x.file_pos = f.file_pos
JOIN fx_pr p ON p.pr_number = f.pr_number
""")
def q_load_pr_dump(spark, d):
    """S1 on a dump: one record per PR with its files nested, some without a body."""
    f = fx.fx_files(spark, d)
    nested = f.groupBy("repo_name", "pr_number").agg(F.array_sort(F.collect_list(F.struct(
        "file_pos", F.struct("filename", "patch", "additions", "deletions", "status").alias("f")))).alias("fs"))
    body = F.when(F.col("pr_number") % 3 != 0, F.concat(F.lit("body "), F.col("pr_number").cast("string")))
    dump = nested.select("repo_name", "pr_number", body.alias("body"),
                         F.transform("fs", lambda x: x["f"]).alias("files"))
    return prs.load_pr_files(dump).select("repo_name", "pr_number", "body", F.col("file_pos").cast("bigint")
                                          .alias("file_pos"), "filename", "status", "patch")


@register("load_commits", f"""
SELECT repo_name, path, sha, author, message, CAST(ts AS VARCHAR) AS ts FROM fx_commit
WHERE ts >= {SINCE_SQL} AND ts <= {AS_OF_SQL}
""")
def q_load_commits(spark, d):
    c = prs.load_commits(fx.fx_commit(spark, d), SINCE, AS_OF)
    return c.select("repo_name", "path", "sha", "author", "message", F.col("ts").cast("string").alias("ts"))


@register("resolve_config", f"""
WITH {CONFIG_SQL}
SELECT repo_name, config_file, {', '.join(agent_sql(a) + ' AS agent_' + a for a in config.DEFAULT_AGENTS)},
       severity_threshold, array_to_string(ignore, '|') AS ignore_globs, max_lines, max_files FROM cfg
""")
def q_resolve_config(spark, d):
    c = resolved_config(spark, d)
    agents = [F.try_element_at("agents", F.lit(a)).alias("agent_" + a) for a in config.DEFAULT_AGENTS]
    return c.select("repo_name", "config_file", *agents, "severity_threshold",
                    F.array_join("ignore", "|").alias("ignore_globs"), "max_lines", "max_files")


def _size_sql(with_cfg: bool) -> str:
    lim = ("c.max_lines", "c.max_files") if with_cfg else ("CAST(500 AS BIGINT)", "CAST(20 AS BIGINT)")
    join = "JOIN cfg c ON c.repo_name = p.repo_name" if with_cfg else ""
    pre = f"WITH {CONFIG_SQL}," if with_cfg else "WITH"
    return f"""
{pre} t AS (
  SELECT repo_name, pr_number, CAST(sum(additions) AS BIGINT) AS total_additions,
         CAST(sum(deletions) AS BIGINT) AS total_deletions, CAST(count(*) AS BIGINT) AS total_files
  FROM fx_pr_file GROUP BY repo_name, pr_number),
s AS (
  SELECT p.repo_name, p.pr_number, coalesce(t.total_additions, 0) + coalesce(t.total_deletions, 0) AS total_lines,
         coalesce(t.total_additions, 0) AS total_additions, coalesce(t.total_deletions, 0) AS total_deletions,
         coalesce(t.total_files, 0) AS total_files, {lim[0]} AS max_lines, {lim[1]} AS max_files
  FROM fx_pr p LEFT JOIN t ON t.repo_name = p.repo_name AND t.pr_number = p.pr_number {join}),
w AS (
  SELECT *, CASE WHEN total_lines > max_lines THEN 'This PR changes **' || CAST(total_lines AS VARCHAR) ||
         ' lines** (recommended max: ' || CAST(max_lines AS VARCHAR) || '). Large PRs are harder to review thoroughly — '
         || 'consider splitting into smaller, focused PRs (one feature/fix per PR).' END AS w1,
         CASE WHEN total_files > max_files THEN 'This PR touches **' || CAST(total_files AS VARCHAR) ||
         ' files** (recommended max: ' || CAST(max_files AS VARCHAR) || '). Wide-reaching changes increase the risk of '
         || 'unintended side effects.' END AS w2
  FROM s)
"""


def _size_cols(sizes):
    return sizes.select(
        "repo_name", "pr_number", "total_lines", "total_additions", "total_deletions", "total_files",
        "max_lines", "max_files", "is_oversized", F.size("warnings").cast("bigint").alias("n_warnings"),
        F.array_join("warnings", "\n").alias("warnings"))


SIZE_SELECT = """
SELECT repo_name, pr_number, total_lines, total_additions, total_deletions, total_files, max_lines, max_files,
       (w1 IS NOT NULL OR w2 IS NOT NULL) AS is_oversized,
       CAST((w1 IS NOT NULL)::INT + (w2 IS NOT NULL)::INT AS BIGINT) AS n_warnings, concat_ws(chr(10), w1, w2) AS warnings
FROM w"""


@register("pr_size_check", _size_sql(False) + SIZE_SELECT)
def q_pr_size_check(spark, d):
    return _size_cols(size.pr_size_check(fx.fx_pr(spark, d), fx.fx_pr_file(spark, d)))


@register("pr_size_check_config", _size_sql(True) + SIZE_SELECT)
def q_pr_size_check_config(spark, d):
    cfg = resolved_config(spark, d)
    return _size_cols(size.pr_size_check(fx.fx_pr(spark, d), fx.fx_pr_file(spark, d), cfg))


@register("pr_size_comment", _size_sql(False) + """
SELECT repo_name, pr_number, concat_ws(chr(10), '## ⚠️ PR Size Warning' || chr(10),
  CASE WHEN w1 IS NOT NULL THEN '- ' || w1 END, CASE WHEN w2 IS NOT NULL THEN '- ' || w2 END,
  chr(10) || '**Stats:** +' || CAST(total_additions AS VARCHAR) || ' additions, -' || CAST(total_deletions AS VARCHAR)
  || ' deletions, ' || CAST(total_files AS VARCHAR) || ' files changed',
  chr(10) || '> The full AI review will still run, but review quality decreases with PR size.') AS body
FROM w WHERE w1 IS NOT NULL OR w2 IS NOT NULL
""")
def q_pr_size_comment(spark, d):
    return size.pr_size_comment(size.pr_size_check(fx.fx_pr(spark, d), fx.fx_pr_file(spark, d)))


KEPT_SQL = f"""kept AS (
  SELECT f.* FROM fx_pr_file f JOIN cfg c ON c.repo_name = f.repo_name
  WHERE NOT coalesce(len(list_filter(c.ignore, lambda p: regexp_full_match(f.filename, {GLOB_RX_SQL.format(p='p')}))) > 0, false)
)"""


def kept_files(spark, d):
    return filters.ignore_filter(fx.fx_pr_file(spark, d), resolved_config(spark, d))


KEPT_PATCH_SQL = """kept_patch AS (
  SELECT x.* FROM fx_patch x JOIN kept k ON k.repo_name = x.repo_name AND k.pr_number = x.pr_number AND k.file_pos = x.file_pos)"""


def kept_patches(spark, d):
    """The patches that reviews look at: files the repo ignores are left out."""
    return filters.ignore_filter(fx.fx_patch(spark, d), resolved_config(spark, d))


@register("ignore_filter", f"""
WITH {CONFIG_SQL}, {KEPT_SQL}
SELECT repo_name, pr_number, CAST(file_pos AS BIGINT) AS file_pos, filename FROM kept
""")
def q_ignore_filter(spark, d):
    k = kept_files(spark, d)
    return k.select("repo_name", "pr_number", F.col("file_pos").cast("bigint").alias("file_pos"), "filename")


ROUTE_SQL = """routed AS (
  SELECT p.repo_name, p.pr_number, t.tool, t.tool_pos
  FROM fx_pr p LEFT JOIN (SELECT repo_name, pr_number, bool_or(filename LIKE '%.py') AS has_python,
        bool_or(filename LIKE '%.js' OR filename LIKE '%.ts' OR filename LIKE '%.jsx' OR filename LIKE '%.tsx'
                OR filename LIKE '%.mjs' OR filename LIKE '%.cjs') AS has_js
      FROM kept GROUP BY repo_name, pr_number) k ON k.repo_name = p.repo_name AND k.pr_number = p.pr_number
  JOIN (VALUES ('bandit', 0, 'py'), ('ruff', 1, 'py'), ('radon', 2, 'py'), ('eslint', 3, 'js'),
               ('detect-secrets', 4, 'all'), ('pip-audit', 5, 'all')) AS t(tool, tool_pos, lang)
    ON t.lang = 'all' OR (t.lang = 'py' AND coalesce(k.has_python, false)) OR (t.lang = 'js' AND coalesce(k.has_js, false))
)"""


@register("route_tools", f"""
WITH {CONFIG_SQL}, {KEPT_SQL}, {ROUTE_SQL}
SELECT repo_name, pr_number, tool, CAST(tool_pos AS BIGINT) AS tool_pos FROM routed
""")
def q_route_tools(spark, d):
    r = filters.route_tools(fx.fx_pr(spark, d), kept_files(spark, d))
    return r.select("repo_name", "pr_number", "tool", F.col("tool_pos").cast("bigint").alias("tool_pos"))


@register("language_files", f"""
WITH {CONFIG_SQL}, {KEPT_SQL}
SELECT repo_name, pr_number, t.tool, CAST(file_pos AS BIGINT) AS file_pos, filename
FROM kept JOIN (VALUES ('bandit'), ('ruff'), ('radon')) AS t(tool) ON filename LIKE '%.py'
UNION ALL
SELECT repo_name, pr_number, 'eslint', CAST(file_pos AS BIGINT), filename FROM kept
WHERE filename LIKE '%.js' OR filename LIKE '%.ts' OR filename LIKE '%.jsx' OR filename LIKE '%.tsx'
   OR filename LIKE '%.mjs' OR filename LIKE '%.cjs'
""")
def q_language_files(spark, d):
    lf = filters.language_files(kept_files(spark, d))
    return lf.select("repo_name", "pr_number", "tool", F.col("file_pos").cast("bigint").alias("file_pos"), "filename")


@register("cap_changed_files", """
SELECT repo_name, pr_number, CAST(file_pos AS BIGINT) AS file_pos, filename FROM fx_pr_file WHERE file_pos <= 10
""")
def q_cap_changed_files(spark, d):
    c = filters.cap_changed_files(fx.fx_pr_file(spark, d), 10)
    return c.select("repo_name", "pr_number", F.col("file_pos").cast("bigint").alias("file_pos"), "filename")


@register("existing_targets", """
SELECT f.repo_name, f.pr_number, CAST(f.file_pos AS BIGINT) AS file_pos, f.filename FROM fx_pr_file f
WHERE EXISTS (SELECT 1 FROM fx_commit c WHERE c.repo_name = f.repo_name AND c.path = f.filename)
""")
def q_existing_targets(spark, d):
    e = filters.existing_targets(fx.fx_pr_file(spark, d), fx.fx_commit(spark, d))
    return e.select("repo_name", "pr_number", F.col("file_pos").cast("bigint").alias("file_pos"), "filename")


@register("agent_toggle", f"""
WITH {CONFIG_SQL}
SELECT p.repo_name, p.pr_number, a.agent, CAST(a.agent_pos AS BIGINT) AS agent_pos,
       {agent_sql('x').replace("agents_o['x']", 'agents_o[a.agent]')} AS enabled,
       CASE WHEN {agent_sql('x').replace("agents_o['x']", 'agents_o[a.agent]')} THEN '' ELSE 'SKIPPED' END AS initial_review
FROM fx_pr p JOIN cfg c ON c.repo_name = p.repo_name CROSS JOIN fx_agent a
""")
def q_agent_toggle(spark, d):
    t = filters.agent_toggle(fx.fx_pr(spark, d), resolved_config(spark, d), [(a, p) for a, p, _ in fx.AGENTS])
    return t.withColumn("agent_pos", F.col("agent_pos").cast("bigint"))
