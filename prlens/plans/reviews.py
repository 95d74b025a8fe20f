"""Registered queries: prompts, agent outputs, verdicts, scores, evaluation
(P1-P15, A15-A17, E1-E4, R3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prlens.operators import breaking as bk, evaluation as ev, filters, findings as fd, reviews as rv
from prlens.plans.changes import BREAKING_SQL, breaking
from prlens.plans.findings import ALL_SQL, _results, q
from prlens.plans.history import MEMCTX_TAIL, REVIEWER_TEXT_SQL, REVIEWERS_SQL, memory_context, reviewers
from prlens.plans.intake import CONFIG_SQL, KEPT_SQL, resolved_config
from prlens.plans.registry import register
from prlens.plans.retrieval import INDEX_SQL, index
from prlens.operators import history as hs, retrieval as rt
from prlens.session import written
from prlens.sources import fixtures as fx, prs

A = rv.AGENT_ORDER
AGENTS_VALUES = "(VALUES " + ", ".join(f"('{a}', {i})" for i, a in enumerate(A)) + ") AS ag(agent, agent_pos)"
STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
RANK_SQL = "(CASE upper({x}) WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 0 END)"


def _i(c):
    return F.col(c).cast("bigint").alias(c)


# ---- P1, P2, R3 ----

TEXTS_SQL = """texts AS (
  SELECT s.repo_name, s.pr_number, s.tool,
    CASE WHEN NOT s.success THEN '[' || s.tool || '] Not available: ' || s.error
         WHEN s.n_findings = 0 THEN '[' || s.tool || '] No issues found.'
         ELSE '[' || s.tool || '] ' || CAST(s.n_findings AS VARCHAR) || ' issue(s):' || chr(10) || l.txt END AS text
  FROM status s LEFT JOIN (
    SELECT repo_name, pr_number, tool, string_agg('  - [' || severity || '] ' || file || ':' || CAST(line AS VARCHAR) || ' — '
           || message || CASE WHEN suggestion <> '' THEN chr(10) || '    Suggested fix: ' || suggestion ELSE '' END,
           chr(10) ORDER BY file, ord) AS txt
    FROM found GROUP BY ALL) l ON l.repo_name = s.repo_name AND l.pr_number = s.pr_number AND l.tool = s.tool),
tt AS (
  SELECT repo_name, pr_number,
    """ + ",\n    ".join(f"max(CASE WHEN tool = '{t}' THEN nullif(text, '') END) AS \"t_{t}\""
                        for t in sorted({t for ts in rv.AGENT_TOOLS.values() for t in ts})) + """
  FROM texts GROUP BY ALL),
routed_text AS (
  SELECT tt.repo_name, tt.pr_number, ag.agent, ag.agent_pos, CASE ag.agent """ + " ".join(
    f"WHEN '{a}' THEN concat_ws(chr(10), {', '.join(chr(34) + 't_' + t + chr(34) for t in ts)})"
    for a, ts in rv.AGENT_TOOLS.items() if ts) + """ ELSE '' END AS tool_text
  FROM tt CROSS JOIN """ + AGENTS_VALUES + ")"

DIFF_SQL = """diff AS (
  SELECT p.repo_name, p.pr_number, coalesce(d.diff, '[]') AS diff FROM fx_pr p LEFT JOIN (
    SELECT f.repo_name, f.pr_number, to_json(list({'filename': f.filename, 'status': x.status,
           'patch': coalesce(x.patch, 'Binary file or no changes'),
           'additions': f.additions, 'deletions': f.deletions} ORDER BY f.file_pos)) AS diff
    FROM kept f JOIN fx_patch x ON x.pr_number = f.pr_number AND x.file_pos = f.file_pos GROUP BY ALL) d
  ON d.repo_name = p.repo_name AND d.pr_number = p.pr_number)"""
KEPT_DIFF_SQL = f"{CONFIG_SQL}, {KEPT_SQL}, {DIFF_SQL}"

CONTEXT_SQL = f"""{INDEX_SQL},
qs AS (SELECT repo_name, pr_number, CAST(embedding AS DOUBLE[]) AS qv FROM fx_query_embedding WHERE embedding IS NOT NULL),
ix AS (SELECT repo_name, id, path, content, CAST(embedding AS DOUBLE[]) AS iv FROM idx WHERE embedding IS NOT NULL),
pr_hits AS (
  SELECT repo_name, pr_number, path, content, row_number() OVER (PARTITION BY repo_name, pr_number ORDER BY
         list_dot_product(qv, iv) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(iv, iv))) DESC, id) AS hit_rank
  FROM qs JOIN ix USING (repo_name) QUALIFY hit_rank <= 3),
ctx AS (SELECT repo_name, pr_number, string_agg('File: ' || path || chr(10) || substring(content, 1, 500),
               chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY hit_rank) AS context FROM pr_hits GROUP BY ALL)"""


def tool_texts(spark, d):
    return fd.tool_prompt_text(_results(spark, d))


def diff_files(spark, d):
    """The files a review sees (ignored ones left out), with the placeholder for a missing patch."""
    files = filters.ignore_filter(fx.fx_files(spark, d).drop("pk"), resolved_config(spark, d))
    return prs.load_pr_files(fx.fx_pr(spark, d).select("repo_name", "pr_number"), files)


def diffs(spark, d):
    return rv.diff_text(diff_files(spark, d), fx.fx_pr(spark, d))


def pr_context(spark, d):
    """R3 -> R1 -> R2: one query per PR, its nearest code of the repo, the prompt's context text.

    The query's id is the PR's number itself, so the context is put together where the
    prompt needs it, and only the part of a file that a context shows is joined to a hit.
    A PR without a number meets no prompt, one without an embedding has no context."""
    q_ = fx.fx_query_embedding(spark, d).filter("pr_number IS NOT NULL AND embedding IS NOT NULL").select(
        "repo_name", F.col("pr_number").alias("query_id"), "embedding")
    code = index(spark, d).withColumn("content", F.substring("content", 1, rt.CONTEXT_CHARS))
    return rt.retrieval_context(rt.similar_code(q_, code)).withColumnRenamed("query_id", "pr_number")


@register("route_tool_text", ALL_SQL + ", " + TEXTS_SQL + """
SELECT repo_name, pr_number, agent, CAST(agent_pos AS BIGINT) AS agent_pos, tool_text FROM routed_text
""")
def q_route_tool_text(spark, d):
    r = rv.route_tool_text(tool_texts(spark, d))
    return r.select("repo_name", "pr_number", "agent", _i("agent_pos"), "tool_text")


@register("query_text", "WITH " + KEPT_DIFF_SQL + "\nSELECT repo_name, pr_number, substring(diff, 1, 500) AS query FROM diff")
def q_query_text(spark, d):
    return rv.query_text(diff_files(spark, d), fx.fx_pr(spark, d))


def _prompt_sql_expr() -> str:
    every = A + rv.OPTIONAL_AGENTS
    brief = "CASE agent " + " ".join(f"WHEN '{a}' THEN {q(rv.AGENT_BRIEF[a])}" for a in every) + " END"
    fmt = "CASE agent " + " ".join(
        f"WHEN '{a}' THEN {q(rv.BLOCK_FORMAT.format(vocab=' / '.join(rv.SEVERITY_VOCAB[a])))}" for a in every) + " END"
    sent = "CASE agent " + " ".join(f"WHEN '{a}' THEN {q(rv.SENTINELS[a])}" for a in every) + " END"
    no_tool = "CASE agent " + " ".join(f"WHEN '{a}' THEN {q(t + chr(10) + chr(10))}" for a, t in rv.NO_TOOLS.items()) \
        + " ELSE '' END"
    return (f"{brief} || chr(10) || chr(10) || CASE WHEN coalesce(tool_text, '') <> '' THEN 'Static analysis results:' || chr(10) "
            f"|| tool_text || chr(10) || chr(10) ELSE {no_tool} END || CASE WHEN coalesce(memory_context, '') <> '' THEN "
            f"'Team history:' || chr(10) || memory_context || chr(10) || chr(10) ELSE '' END || "
            "CASE WHEN agent IN ('maintainability', 'style') AND coalesce(context, '') <> '' THEN "
            "'Existing code in this repository:' || chr(10) || context || chr(10) || chr(10) ELSE '' END || "
            f"'Diff:' || chr(10) || diff || chr(10) || chr(10) || {fmt} || chr(10) || "
            f"'If there is nothing to report, answer exactly: ' || {sent}")


PROMPTS_SQL = ALL_SQL + ", " + TEXTS_SQL + MEMCTX_TAIL + ", " + DIFF_SQL + ", " + CONTEXT_SQL


def _prompts_sql(routed: str) -> str:
    return PROMPTS_SQL + f"""
SELECT r.repo_name, r.pr_number, agent, CAST(agent_pos AS BIGINT) AS agent_pos, {_prompt_sql_expr()} AS prompt
FROM {routed} r JOIN diff USING (repo_name, pr_number) JOIN memctx USING (repo_name, pr_number)
LEFT JOIN ctx USING (repo_name, pr_number)
"""


def prompts(spark, d, include_style=False):
    """Everything a PR's prompts need is joined at PR grain; the agents are
    expanded last, so the diff is never copied through a join."""
    keys = ["repo_name", "pr_number"]
    per = (rv.tool_text_columns(tool_texts(spark, d)).join(diffs(spark, d), keys).join(memory_context(spark, d), keys)
           .join(pr_context(spark, d), keys, "left"))
    p = rv.build_prompts(rv.explode_agents(per, include_style))
    return p.select("repo_name", "pr_number", "agent", _i("agent_pos"), "prompt")


@register("build_prompts", _prompts_sql("routed_text"))
def q_build_prompts(spark, d):
    return prompts(spark, d)


@register("build_prompts_style", _prompts_sql(
    "(SELECT tt.repo_name, tt.pr_number, 'style' AS agent, 6 AS agent_pos, concat_ws(chr(10), \"t_ruff\") AS tool_text FROM tt)"))
def q_build_prompts_style(spark, d):
    """P2 with the optional seventh reviewer: its prompts."""
    return prompts(spark, d, include_style=True).filter(F.col("agent") == "style")


# ---- P3, P4, P5, P15 ----

WIDE_SQL = "wide AS (SELECT repo_name, pr_number, " + ", ".join(
    f"max(CASE WHEN agent = '{a}' THEN review END) AS \"{a}\"" for a in A) + " FROM fx_review GROUP BY ALL)"


@register("build_manager_prompt", "WITH " + WIDE_SQL + """
SELECT repo_name, pr_number, 'Decide whether this pull request can merge. Merge duplicate findings, drop false positives, '
  || 'rank by production impact and give a verdict: BLOCK MERGE, APPROVE WITH CHANGES or APPROVE.' || chr(10) || chr(10)
  || '== Correctness ==' || chr(10) || coalesce(correctness, '') || chr(10)
  || '== Security ==' || chr(10) || coalesce(security, '') || chr(10)
  || '== Performance ==' || chr(10) || coalesce(performance, '') || chr(10)
  || '== Maintainability ==' || chr(10) || coalesce(maintainability, '') || chr(10)
  || '== Dependencies ==' || chr(10) || coalesce(nullif(dependency, ''), 'No dependency review available.') || chr(10)
  || '== Tests ==' || chr(10) || coalesce(nullif(test, ''), 'No test review available.') || chr(10) AS prompt
FROM wide
""")
def q_build_manager_prompt(spark, d):
    return rv.build_manager_prompt(rv.wide_reviews(fx.fx_review(spark, d)))


@register("build_autofix_prompt", "WITH " + KEPT_DIFF_SQL + f"""
SELECT v.repo_name, v.pr_number, {q('Write line-level fixes for the findings below, one `### Fix: <title>` block each, '
  'with **File:**, **Line:**, the original code, a ```suggestion block and **Why:**. If none can be fixed line by line, '
  'answer `### No Auto-Fixes Available`.' + chr(10) + chr(10) + 'Review:' + chr(10))} || v.final_review || chr(10) || chr(10)
  || 'Diff:' || chr(10) || d.diff AS prompt
FROM fx_verdict v JOIN diff d ON d.repo_name = v.repo_name AND d.pr_number = v.pr_number
""")
def q_build_autofix_prompt(spark, d):
    j = fx.fx_verdict(spark, d).join(diffs(spark, d), ["repo_name", "pr_number"])
    return rv.build_autofix_prompt(j)


@register("build_score_prompt", f"""
SELECT repo_name, pr_number, {q('Rate this code review from 1 to 10 for concrete, actionable, correctly ranked findings '
  'and a sound merge decision. Answer with the number only.' + chr(10) + chr(10))} || final_review AS prompt FROM fx_verdict
""")
def q_build_score_prompt(spark, d):
    return rv.build_score_prompt(fx.fx_verdict(spark, d))


SENT_SQL = "CASE agent " + " ".join(f"WHEN '{a}' THEN {q(s)}" for a, s in rv.SENTINELS.items()) + " END"


@register("review_status", f"""
SELECT repo_name, pr_number, agent, CASE WHEN r = '' THEN 'EMPTY' WHEN r = 'SKIPPED' THEN 'SKIPPED'
  WHEN starts_with(r, 'Unable to complete') THEN 'FAILED' WHEN r = {SENT_SQL} THEN 'CLEAN' ELSE 'FINDINGS' END AS status
FROM (SELECT *, {STRIP.format(x="coalesce(review, '')")} AS r FROM fx_review) t
""")
def q_review_status(spark, d):
    return rv.review_status(fx.fx_review(spark, d))


SCORE_SQL = f"""scores AS (
  SELECT repo_name, pr_number, score, length(digits) > 1 OR digits >= '6' AS passed,
         substring('AI review score: ' || score || '/10', 1, 140) AS description
  FROM (SELECT *, CASE WHEN ltrim(score, '0') = '' THEN '0' ELSE ltrim(score, '0') END AS digits FROM (
        SELECT repo_name, pr_number, CASE WHEN regexp_full_match(s, '[0-9]+') THEN s ELSE '5' END AS score FROM (
          SELECT *, {STRIP.format(x="coalesce(raw_score, '')")} AS s FROM fx_verdict) a) b) c)"""


@register("score_gate", f"""WITH {SCORE_SQL}
SELECT repo_name, pr_number, score, CASE WHEN passed THEN 'success' ELSE 'failure' END AS state, description FROM scores""")
def q_score_gate(spark, d):
    return rv.score_gate(fx.fx_verdict(spark, d))


@register("wide_review", f"""WITH {WIDE_SQL}, {SCORE_SQL}
SELECT w.repo_name, w.pr_number, """ + ", ".join(f'w."{a}" AS {a}_review' for a in A) + """,
       v.final_review, a.autofix AS autofix_suggestions, s.score
FROM wide w LEFT JOIN fx_verdict v USING (repo_name, pr_number) LEFT JOIN fx_autofix a USING (repo_name, pr_number)
LEFT JOIN scores s USING (repo_name, pr_number)
""")
def q_wide_review(spark, d):
    return wide(spark, d)


def wide(spark, d):
    v = fx.fx_verdict(spark, d)
    return rv.wide_review(fx.fx_review(spark, d), v, fx.fx_autofix(spark, d), rv.score_gate(v))


# ---- P6, A15, A16, A17 ----

KEY_RX = "^(" + "|".join(rv.BLOCK_KEYS) + "):\\s*(.*)$"
BLOCKS_SQL = f"""rl AS (
  SELECT repo_name, pr_number, agent, generate_subscripts(string_split(coalesce(review, ''), chr(10)), 1) - 1 AS ln,
         unnest(string_split(coalesce(review, ''), chr(10))) AS line FROM fx_review),
kv0 AS (SELECT *, regexp_extract(t, {q(KEY_RX)}, 1) AS k, {STRIP.format(x=f"regexp_extract(t, {q(KEY_RX)}, 2)")} AS v
        FROM (SELECT *, {STRIP.format(x='line')} AS t FROM rl) a),
kv1 AS (SELECT *, CASE WHEN k = 'DIMENSION' OR (k = 'ISSUE' AND coalesce(lag(k) OVER (PARTITION BY repo_name, pr_number, agent
                  ORDER BY ln), '') <> 'DIMENSION') THEN 1 ELSE 0 END AS st FROM kv0),
kv2 AS (SELECT *, sum(st) OVER (PARTITION BY repo_name, pr_number, agent ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        AS block_no FROM kv1),
blocks AS (
  SELECT repo_name, pr_number, agent, block_no,
    arg_min(v, ln) FILTER (WHERE k = 'DIMENSION') AS dimension, arg_min(v, ln) FILTER (WHERE k = 'ISSUE') AS issue,
    arg_min(v, ln) FILTER (WHERE k = 'LINE') AS line_ref, upper(arg_min(v, ln) FILTER (WHERE k = 'SEVERITY')) AS severity,
    arg_min(v, ln) FILTER (WHERE k = 'FIX') AS fix,
    arg_min(v, ln) FILTER (WHERE k IN ({', '.join(q(k) for k in rv.DETAIL_KEYS)})) AS detail
  FROM kv2 WHERE block_no > 0 AND k <> '' GROUP BY ALL)"""

VOCAB_SQL = "CASE agent " + " ".join(
    f"WHEN '{a}' THEN severity IN ({', '.join(q(s) for s in v)})" for a, v in rv.SEVERITY_VOCAB.items()) + " ELSE false END"


def blocks(spark, d):
    return rv.parse_issue_blocks(fx.fx_review(spark, d))


@register("parse_issue_blocks", f"""WITH {BLOCKS_SQL}
SELECT repo_name, pr_number, agent, CAST(block_no AS BIGINT) AS block_no, dimension, issue, line_ref, severity, fix, detail,
       coalesce({VOCAB_SQL}, false) AS severity_valid FROM blocks""")
def q_parse_issue_blocks(spark, d):
    return blocks(spark, d).select("repo_name", "pr_number", "agent", _i("block_no"), "dimension", "issue",
                                   "line_ref", "severity", "fix", "detail", "severity_valid")


DEDUP_SQL = f"""dd AS (
  SELECT repo_name, pr_number, file, line, issue_key, max({RANK_SQL.format(x='severity')}) AS sev_rank,
         list_sort(list_distinct(list(agent))) AS agents
  FROM (SELECT repo_name, pr_number, agent, severity,
               nullif(regexp_extract(coalesce(line_ref, ''), '^([^:\\s]+)', 1), '') AS file,
               TRY_CAST(nullif(regexp_extract(coalesce(line_ref, ''), ':([0-9]+)', 1), '') AS BIGINT) AS line,
               lower({STRIP.format(x="regexp_replace(coalesce(issue, ''), '\\s+', ' ', 'g')")}) AS issue_key FROM blocks) b
  GROUP BY ALL),
ranked AS (SELECT *, CASE sev_rank WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'CRITICAL' END AS severity,
  len(agents) AS n_agents, row_number() OVER (PARTITION BY repo_name, pr_number ORDER BY sev_rank DESC, len(agents) DESC,
  file ASC NULLS LAST, line ASC NULLS LAST, issue_key ASC NULLS LAST) AS rank FROM dd)"""


def deduped(spark, d):
    return rv.dedupe_findings(blocks(spark, d))


@register("dedupe_findings", f"""WITH {BLOCKS_SQL}, {DEDUP_SQL}
SELECT repo_name, pr_number, file, line, issue_key, severity, array_to_string(agents, ',') AS agents,
       CAST(n_agents AS BIGINT) AS n_agents FROM ranked""")
def q_dedupe_findings(spark, d):
    x = deduped(spark, d)
    return x.select("repo_name", "pr_number", "file", "line", "issue_key", "severity",
                    F.array_join("agents", ",").alias("agents"), "n_agents")


@register("rank_findings", f"""WITH {BLOCKS_SQL}, {DEDUP_SQL}
SELECT repo_name, pr_number, CAST(rank AS BIGINT) AS rank, file, line, issue_key, severity FROM ranked""")
def q_rank_findings(spark, d):
    r = rv.rank_findings(deduped(spark, d))
    return r.select("repo_name", "pr_number", _i("rank"), "file", "line", "issue_key", "severity")


@register("merge_decision", "WITH " + BREAKING_SQL + f""", {BLOCKS_SQL},
flags AS (SELECT p.repo_name, p.pr_number, count(b.finding_pos) > 0 AS has_breaking
          FROM fx_pr p LEFT JOIN breaking b ON b.repo_name = p.repo_name AND b.pr_number = p.pr_number GROUP BY ALL),
agg AS (SELECT repo_name, pr_number,
          count(*) FILTER (WHERE agent IN ('correctness', 'security', 'dependency') AND {RANK_SQL.format(x='severity')} >= 3) AS nb,
          count(*) FILTER (WHERE (agent IN ('performance', 'test') AND {RANK_SQL.format(x='severity')} >= 2)
                              OR (agent IN ('correctness', 'security') AND {RANK_SQL.format(x='severity')} = 2)) AS nc
        FROM blocks GROUP BY ALL)
SELECT f.repo_name, f.pr_number,
  CASE WHEN coalesce(a.nb, 0) > 0 OR f.has_breaking THEN 'BLOCK MERGE' WHEN coalesce(a.nc, 0) > 0 THEN 'APPROVE WITH CHANGES'
       ELSE 'APPROVE' END AS decision,
  CAST(coalesce(a.nb, 0) AS BIGINT) AS n_blocking, CAST(coalesce(a.nc, 0) AS BIGINT) AS n_changes, f.has_breaking
FROM flags f LEFT JOIN agg a USING (repo_name, pr_number)
""")
def q_merge_decision(spark, d):
    flags = bk.breaking_flags(fx.fx_pr(spark, d), breaking(spark, d))
    return rv.merge_decision(blocks(spark, d), flags).select(
        "repo_name", "pr_number", "decision", "n_blocking", "n_changes", "has_breaking")


# ---- P7-P14 ----

@register("parse_verdict", f"""
SELECT repo_name, pr_number, nullif(regexp_extract(final_review, {q(rv.VERDICTS_RX)}, 1), '') AS verdict,
       regexp_extract(final_review, '(?m)^>\\s*(.*)$', 1) AS reason FROM fx_verdict
""")
def q_parse_verdict(spark, d):
    return rv.parse_verdict(fx.fx_verdict(spark, d))


SECT_CASE = "CASE " + " ".join(f"WHEN contains(t, {q(n)}) THEN {q(s)}" for n, s in rv.SECTIONS) + " ELSE 'other' END"


@register("parse_review_sections", f"""
WITH l AS (SELECT repo_name, pr_number, generate_subscripts(string_split(final_review, chr(10)), 1) AS ln,
                  {STRIP.format(x='unnest(string_split(final_review, chr(10)))')} AS t FROM fx_verdict),
s AS (SELECT *, last_value(CASE WHEN starts_with(t, '### ') THEN {SECT_CASE} END IGNORE NULLS) OVER
        (PARTITION BY repo_name, pr_number ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM l)
SELECT repo_name, pr_number, section, CAST(row_number() OVER (PARTITION BY repo_name, pr_number, section ORDER BY ln) AS BIGINT)
       AS item_pos, regexp_extract(t, {q(rv.BULLET_RX)}, 1) AS title, regexp_extract(t, {q(rv.BULLET_RX)}, 2) AS location,
       regexp_extract(t, {q(rv.BULLET_RX)}, 3) AS text
FROM s WHERE section IN ('must_fix', 'should_fix', 'consider') AND starts_with(t, '- **')
""")
def q_parse_review_sections(spark, d):
    s = rv.parse_review_sections(fx.fx_verdict(spark, d))
    return s.select("repo_name", "pr_number", "section", _i("item_pos"), "title", "location", "text")


FALLBACK_SQL = f"""fb AS (SELECT repo_name, pr_number, coalesce(final_review, {q(rv.MANAGER_FALLBACK)}) AS final_review FROM fx_manager)"""


@register("manager_fallback", f"WITH {FALLBACK_SQL}\nSELECT repo_name, pr_number, final_review FROM fb")
def q_manager_fallback(spark, d):
    return rv.manager_fallback(fx.fx_manager(spark, d)).select("repo_name", "pr_number", "final_review")


@register("parse_summary_table", f"""
WITH {FALLBACK_SQL},
l AS (SELECT repo_name, pr_number, generate_subscripts(string_split(final_review, chr(10)), 1) AS ln,
             {STRIP.format(x='unnest(string_split(final_review, chr(10)))')} AS t FROM fb),
r AS (SELECT *, string_split(regexp_replace(t, '^\\||\\|$', '', 'g'), '|') AS c FROM l
      WHERE starts_with(t, '|') AND NOT regexp_matches(t, '^\\|\\s*-') AND NOT regexp_matches(t, '^\\|\\s*Dimension\\s*\\|'))
SELECT repo_name, pr_number, CAST(row_number() OVER (PARTITION BY repo_name, pr_number ORDER BY ln) AS BIGINT) AS row_pos,
       {STRIP.format(x='c[1]')} AS dimension, {STRIP.format(x='c[2]')} AS status, {STRIP.format(x='c[3]')} AS key_finding FROM r
""")
def q_parse_summary_table(spark, d):
    s = rv.parse_summary_table(rv.manager_fallback(fx.fx_manager(spark, d)))
    return s.select("repo_name", "pr_number", _i("row_pos"), "dimension", "status", "key_finding")


@register("parse_autofixes", f"""
WITH b AS (SELECT repo_name, pr_number, generate_subscripts(string_split(autofix, '### Fix:'), 1) - 1 AS fix_pos,
                  unnest(string_split(autofix, '### Fix:')) AS b FROM fx_autofix WHERE NOT contains(autofix, 'No Auto-Fixes Available'))
SELECT repo_name, pr_number, CAST(fix_pos AS BIGINT) AS fix_pos, {STRIP.format(x="regexp_extract(b, '^([^\\n]*)', 1)")} AS title,
       regexp_extract(b, {q(rv.FIX_FILE_RX)}, 1) AS file,
       TRY_CAST(nullif(regexp_extract(b, {q(rv.FIX_LINE_RX)}, 1), '') AS BIGINT) AS line,
       regexp_extract(b, {q(rv.FIX_ORIG_RX)}, 1) AS original, regexp_extract(b, {q(rv.FIX_SUGG_RX)}, 1) AS suggestion,
       regexp_extract(b, {q(rv.FIX_WHY_RX)}, 1) AS why
FROM b WHERE fix_pos >= 1
""")
def q_parse_autofixes(spark, d):
    a = rv.parse_autofixes(fx.fx_autofix(spark, d))
    return a.select("repo_name", "pr_number", _i("fix_pos"), "title", "file", "line", "original", "suggestion", "why")


@register("full_comment", f"""WITH {REVIEWERS_SQL}, {REVIEWER_TEXT_SQL}
SELECT v.repo_name, v.pr_number, coalesce(v.final_review, '')
  || CASE WHEN coalesce(a.autofix, '') <> '' AND NOT contains(a.autofix, 'No Auto-Fixes Available')
          THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## 🔧 Auto-Fix Suggestions' || chr(10) || chr(10) || a.autofix
          ELSE '' END
  || CASE WHEN coalesce(r.reviewer_text, '') <> '' THEN chr(10) || chr(10) || '---' || chr(10) || r.reviewer_text ELSE '' END AS body
FROM fx_verdict v LEFT JOIN fx_autofix a USING (repo_name, pr_number) LEFT JOIN rev_text r USING (repo_name, pr_number)
""")
def q_full_comment(spark, d):
    return full_comments(spark, d)


def full_comments(spark, d):
    # The reviewers' histories are most of what this shuffles: their texts are written, and the shuffles
    # gone, before the other parts of a comment begin.
    people = written(hs.reviewer_comment(reviewers(spark, d)), "reviewer-text")
    return rv.full_comment(fx.fx_verdict(spark, d), fx.fx_autofix(spark, d), people)


# ---- E1-E4 ----

CHECKS_SQL = "(VALUES " + ", ".join(
    f"({i + 1}, {q(c)}, {q(issue)}, [{', '.join(q(k.lower()) for k in kws)}])"
    for i, (c, issue, kws) in enumerate(ev.CHECKS)) + ") AS ck(check_pos, category, issue, keywords)"

WIDE_FULL_SQL = f"""{WIDE_SQL}, {SCORE_SQL},
wr AS (SELECT w.repo_name, w.pr_number, """ + ", ".join(f'w."{a}" AS {a}_review' for a in A) + """,
       v.final_review FROM wide w LEFT JOIN fx_verdict v USING (repo_name, pr_number)),
hits AS (SELECT repo_name, pr_number, check_pos, category, issue,
                len(list_filter(keywords, lambda k: contains(txt, k))) > 0 AS detected
         FROM (SELECT repo_name, pr_number, lower(coalesce(final_review, '') || coalesce(correctness_review, '')
               || coalesce(security_review, '') || coalesce(performance_review, '') || coalesce(maintainability_review, '')) AS txt
               FROM wr) t CROSS JOIN """ + CHECKS_SQL + ")"


def hits(spark, d):
    """Recall inputs: the five searched fields only (no autofix/score joins)."""
    w = rv.wide_reviews(fx.fx_review(spark, d))
    for a in A:
        w = w.withColumnRenamed(a, f"{a}_review")
    w = w.join(fx.fx_verdict(spark, d).select("repo_name", "pr_number", "final_review"), ["repo_name", "pr_number"], "left")
    return ev.keyword_recall(w)


@register("keyword_recall", f"""WITH {WIDE_FULL_SQL}
SELECT repo_name, pr_number, CAST(check_pos AS BIGINT) AS check_pos, category, issue, detected FROM hits""")
def q_keyword_recall(spark, d):
    return hits(spark, d).select("repo_name", "pr_number", _i("check_pos"), "category", "issue", "detected")


@register("recall_summary", f"""WITH {WIDE_FULL_SQL}
SELECT repo_name, pr_number, CAST(count(*) FILTER (WHERE detected) AS BIGINT) AS detected,
       CAST(count(*) FILTER (WHERE NOT detected) AS BIGINT) AS missed, CAST(count(*) AS BIGINT) AS checks FROM hits GROUP BY ALL""")
def q_recall_summary(spark, d):
    return ev.recall_summary(hits(spark, d))


@register("recall_by_category", f"""WITH {WIDE_FULL_SQL}
SELECT repo_name, pr_number, category, CAST(count(*) FILTER (WHERE detected) AS BIGINT) AS detected,
       CAST(count(*) FILTER (WHERE NOT detected) AS BIGINT) AS missed FROM hits GROUP BY ALL""")
def q_recall_by_category(spark, d):
    return ev.recall_by_category(hits(spark, d))


@register("expected_issue_report", f"""WITH {WIDE_FULL_SQL}
SELECT CAST(check_pos AS BIGINT) AS check_pos, category, issue, CAST(count(*) AS BIGINT) AS n_prs,
       CAST(count(*) FILTER (WHERE detected) AS BIGINT) AS n_detected,
       round(count(*) FILTER (WHERE detected) / count(*), 6) AS detected_share FROM hits GROUP BY ALL""")
def q_expected_issue_report(spark, d):
    return ev.expected_issue_report(hits(spark, d)).select(_i("check_pos"), "category", "issue", "n_prs",
                                                           "n_detected", "detected_share")


@register("review_preview", """
WITH long AS (SELECT repo_name, pr_number, agent AS section, review AS txt FROM fx_review
              UNION ALL SELECT repo_name, pr_number, 'final', final_review FROM fx_verdict
              UNION ALL SELECT repo_name, pr_number, 'autofix', autofix FROM fx_autofix)
SELECT repo_name, pr_number, section,
       CASE WHEN length(coalesce(txt, '')) = 0 THEN '(empty)' ELSE substring(txt, 1, 2000) END
       || CASE WHEN length(coalesce(txt, '')) > 2000 THEN chr(10) || chr(10) || '  ... (' || CAST(length(txt) - 2000 AS VARCHAR)
          || ' more chars)' ELSE '' END AS preview FROM long
""")
def q_review_preview(spark, d):
    long = fx.fx_review(spark, d).select("repo_name", "pr_number", F.col("agent").alias("section"), "review").unionByName(
        fx.fx_verdict(spark, d).select("repo_name", "pr_number", F.lit("final").alias("section"),
                                       F.col("final_review").alias("review"))).unionByName(
        fx.fx_autofix(spark, d).select("repo_name", "pr_number", F.lit("autofix").alias("section"),
                                       F.col("autofix").alias("review")))
    return ev.review_preview(long)
