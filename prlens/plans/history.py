"""Registered queries: history mining and review memory (H1-H4, M1-M7, S7, W4 batch twin)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prlens.operators import history as hs, memory as mm
from prlens.plans.changes import BREAKING_TAIL, KEPT_LINES_SQL, breaking
from prlens.plans.intake import AS_OF, AS_OF_SQL, SINCE_SQL
from prlens.plans.registry import register
from prlens.sources import fixtures as fx

FIX_SQL = " OR ".join(f"contains(lower(message), '{w}')" for w in hs.FIX_WORDS)

#: Hotspots of paths at one fixed moment, and those of PR files at that moment.
PATHS_SQL = f"""hotp AS (
  SELECT repo_name, path, CAST(count(*) AS BIGINT) AS total_commits,
         CAST(count(*) FILTER (WHERE {FIX_SQL}) AS BIGINT) AS fix_commits
  FROM fx_commit WHERE ts >= {SINCE_SQL} AND ts <= {AS_OF_SQL} GROUP BY ALL
  HAVING count(*) >= 5 OR count(*) FILTER (WHERE {FIX_SQL}) >= 2)"""

#: Hotspots of PR files when the PR was created.
HOT_SQL = f"""hot AS (
  SELECT f.repo_name, f.pr_number, f.file_pos, f.filename, CAST(count(*) AS BIGINT) AS total_commits,
         CAST(count(*) FILTER (WHERE {FIX_SQL}) AS BIGINT) AS fix_commits,
         CASE WHEN count(*) FILTER (WHERE {FIX_SQL}) >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS risk
  FROM fx_pr_file f JOIN fx_pr p ON p.repo_name = f.repo_name AND p.pr_number = f.pr_number
  JOIN fx_commit c ON c.repo_name = f.repo_name AND c.path = f.filename
   AND c.ts <= p.created_at AND c.ts >= p.created_at - INTERVAL 90 DAY
  WHERE f.file_pos <= 10 GROUP BY f.repo_name, f.pr_number, f.file_pos, f.filename
  HAVING count(*) >= 5 OR count(*) FILTER (WHERE {FIX_SQL}) >= 2),
hot_text AS (
  SELECT repo_name, pr_number, 'HOTSPOT FILES (frequently changed/fixed — review with extra scrutiny):' || chr(10) ||
         string_agg('  - ' || filename || ': ' || CAST(total_commits AS VARCHAR) || ' commits, ' || CAST(fix_commits AS VARCHAR)
                    || ' bug-fix commits in last 3 months (' || risk || ' risk)', chr(10) ORDER BY file_pos) AS hotspot_text
  FROM hot GROUP BY ALL)"""

#: The newest 20 commits of each PR file when the PR was created; whatever the PR, for the queries "latest".
SEEN_SQL = """recent AS (
  SELECT f.repo_name, f.pr_number, f.file_pos, f.filename, c.author, row_number() OVER (
           PARTITION BY f.repo_name, f.pr_number, f.file_pos ORDER BY c.ts DESC, c.sha DESC) AS commit_rank
  FROM fx_pr_file f JOIN fx_pr p ON p.repo_name = f.repo_name AND p.pr_number = f.pr_number
  JOIN fx_commit c ON c.repo_name = f.repo_name AND c.path = f.filename AND c.ts <= p.created_at
  WHERE f.file_pos <= 10 QUALIFY commit_rank <= 20),
tch AS (
  SELECT r.repo_name, r.pr_number, r.file_pos, r.filename, r.commit_rank, r.author AS login
  FROM recent r JOIN fx_pr p ON p.pr_number = r.pr_number AND p.repo_name = r.repo_name
  WHERE r.author <> '' AND r.author IS DISTINCT FROM p.author),
"""
LATEST_SQL = """recent AS (
  SELECT repo_name, path, author, row_number() OVER (PARTITION BY repo_name, path ORDER BY ts DESC, sha DESC) AS commit_rank
  FROM fx_commit QUALIFY commit_rank <= 20),
tch AS (
  SELECT f.repo_name, f.pr_number, f.file_pos, f.filename, r.commit_rank, r.author AS login
  FROM fx_pr_file f JOIN recent r ON r.repo_name = f.repo_name AND r.path = f.filename
  JOIN fx_pr p ON p.pr_number = f.pr_number AND p.repo_name = f.repo_name
  WHERE f.file_pos <= 10 AND r.author <> '' AND r.author IS DISTINCT FROM p.author),
"""

REVIEWERS_TAIL = """per AS (SELECT repo_name, pr_number, login, count(*) AS file_touches, min([file_pos, commit_rank]) AS first_seen
        FROM tch GROUP BY ALL),
kf AS (SELECT repo_name, pr_number, login, list(filename ORDER BY file_pos)[1:5] AS knows_files
       FROM (SELECT DISTINCT repo_name, pr_number, login, file_pos, filename FROM tch) d GROUP BY ALL),
rev AS (
  SELECT p.repo_name, p.pr_number, row_number() OVER (PARTITION BY p.repo_name, p.pr_number ORDER BY file_touches DESC, first_seen)
         AS rank, p.login, p.file_touches, k.knows_files
  FROM per p JOIN kf k USING (repo_name, pr_number, login) QUALIFY rank <= 3)"""
REVIEWERS_SQL = SEEN_SQL + REVIEWERS_TAIL

TAGS_SQL = """list_filter([
  CASE WHEN contains({t}, 'SQL') OR contains(lower({t}), 'injection') THEN 'sql_injection' END,
  CASE WHEN contains(lower({t}), 'password') OR contains(lower({t}), 'secret') THEN 'hardcoded_secret' END,
  CASE WHEN contains(lower({t}), 'loop') AND contains(lower({t}), 'query') THEN 'n_plus_1_query' END,
  CASE WHEN contains(lower({t}), 'performance') THEN 'performance' END,
  CASE WHEN contains(lower({t}), 'style') OR contains(lower({t}), 'naming') THEN 'style' END,
  CASE WHEN contains(lower({t}), 'authentication') OR contains(lower({t}), 'auth') THEN 'auth' END],
  lambda x: x IS NOT NULL)"""

MEM_SQL = f"""mem AS (
  SELECT repo_name, pr_number, substring(final_review, 1, 500) AS review_summary,
         {TAGS_SQL.format(t='final_review')} AS issue_types, created_at FROM fx_verdict),
top100 AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, pr_number DESC) AS rank FROM mem
           ORDER BY created_at DESC, pr_number DESC LIMIT 100),
past AS (SELECT repo_name, list_sort(list_distinct(flatten(list(issue_types)))) AS past_issues FROM (
           SELECT * FROM mem QUALIFY row_number() OVER (PARTITION BY repo_name ORDER BY created_at DESC, pr_number DESC) <= 10) t
         GROUP BY ALL)"""

#: Past issues of each PR: the ten newest reviews stored before it was created.
PAST_SQL = """past_at AS (
  SELECT repo_name, pr_number, list_sort(list_distinct(flatten(list(issue_types)))) AS past_issues FROM (
    SELECT p.repo_name, p.pr_number, m.issue_types FROM fx_pr p
    JOIN mem m ON m.repo_name = p.repo_name AND m.created_at < p.created_at
    QUALIFY row_number() OVER (PARTITION BY p.repo_name, p.pr_number ORDER BY m.created_at DESC, m.pr_number DESC) <= 10) t
  GROUP BY ALL)"""


def _i(c):
    return F.col(c).cast("bigint").alias(c)


def memory(spark, d):
    return mm.memory_rows(fx.fx_verdict(spark, d))


HOT_COLS = ["total_commits", "fix_commits", "risk"]


def hotspots(spark, d):
    return hs.hotspots_at_creation(fx.fx_commit(spark, d), fx.fx_pr(spark, d), fx.fx_pr_file(spark, d))


@register("hotspots", f"""
WITH {HOT_SQL}
SELECT repo_name, pr_number, CAST(file_pos AS BIGINT) AS file_pos, filename, total_commits, fix_commits, risk FROM hot
""")
def q_hotspots(spark, d):
    """H1 when each PR was created."""
    return hotspots(spark, d).select("repo_name", "pr_number", _i("file_pos"), "filename", *HOT_COLS)


@register("hotspots_as_of", f"""
WITH {PATHS_SQL}
SELECT f.repo_name, f.pr_number, CAST(f.file_pos AS BIGINT) AS file_pos, f.filename, h.total_commits, h.fix_commits,
       CASE WHEN h.fix_commits >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS risk
FROM fx_pr_file f JOIN hotp h ON h.repo_name = f.repo_name AND h.path = f.filename WHERE f.file_pos <= 10
""")
def q_hotspots_as_of(spark, d):
    """H1 with one fixed moment for all PRs."""
    h = hs.hotspots(fx.fx_commit(spark, d), AS_OF, fx.fx_pr_file(spark, d))
    return h.select("repo_name", "pr_number", _i("file_pos"), "filename", *HOT_COLS)


@register("path_hotspots", f"""
WITH {PATHS_SQL}
SELECT repo_name, path, total_commits, fix_commits, CASE WHEN fix_commits >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM hotp
""")
def q_path_hotspots(spark, d):
    return hs.path_hotspots(fx.fx_commit(spark, d), AS_OF)


@register("hotspot_prompt", f"WITH {HOT_SQL}\nSELECT repo_name, pr_number, hotspot_text FROM hot_text")
def q_hotspot_prompt(spark, d):
    return hs.hotspot_prompt(hotspots(spark, d))


def reviewers(spark, d, at_creation=True):
    return hs.suggest_reviewers(fx.fx_pr(spark, d), fx.fx_pr_file(spark, d), fx.fx_commit(spark, d),
                                at_creation=at_creation)


@register("suggest_reviewers", f"""
WITH {REVIEWERS_SQL}
SELECT repo_name, pr_number, CAST(rank AS BIGINT) AS rank, login, CAST(file_touches AS BIGINT) AS file_touches,
       array_to_string(knows_files, ', ') AS knows_files FROM rev
""")
def q_suggest_reviewers(spark, d):
    """H3 when each PR was created."""
    return _reviewer_rows(reviewers(spark, d))


@register("suggest_reviewers_latest", f"""
WITH {LATEST_SQL}{REVIEWERS_TAIL}
SELECT repo_name, pr_number, CAST(rank AS BIGINT) AS rank, login, CAST(file_touches AS BIGINT) AS file_touches,
       array_to_string(knows_files, ', ') AS knows_files FROM rev
""")
def q_suggest_reviewers_latest(spark, d):
    """H3 from the newest commits there are, whatever the PR's age."""
    return _reviewer_rows(reviewers(spark, d, at_creation=False))


def _reviewer_rows(r):
    return r.select("repo_name", "pr_number", _i("rank"), "login", _i("file_touches"),
                    F.array_join("knows_files", ", ").alias("knows_files"))


REVIEWER_TEXT_SQL = """rev_text AS (
  SELECT repo_name, pr_number, chr(10) || '### 👥 Suggested Reviewers' || chr(10) || 'Based on git history — who knows this code best:'
         || chr(10) || chr(10) || string_agg('- **@' || login || '** — ' || CAST(file_touches AS VARCHAR) || ' commits touching: '
         || array_to_string(list_transform(knows_files[1:3], lambda f: '`' || f || '`'), ', '), chr(10) ORDER BY rank) AS reviewer_text
  FROM rev GROUP BY ALL)"""


@register("reviewer_comment", f"WITH {REVIEWERS_SQL}, {REVIEWER_TEXT_SQL}\nSELECT repo_name, pr_number, reviewer_text FROM rev_text")
def q_reviewer_comment(spark, d):
    return hs.reviewer_comment(reviewers(spark, d))


@register("issue_tags", f"""
SELECT repo_name, pr_number, array_to_string({TAGS_SQL.format(t='final_review')}, ',') AS issue_types FROM fx_verdict
""")
def q_issue_tags(spark, d):
    v = fx.fx_verdict(spark, d)
    return v.select("repo_name", "pr_number", F.array_join(mm.issue_tags("final_review"), ",").alias("issue_types"))


@register("store_review", f"""
WITH {MEM_SQL}
SELECT repo_name, pr_number, review_summary, array_to_string(issue_types, ',') AS issue_types,
       CAST(created_at AS VARCHAR) AS created_at FROM mem
""")
def q_store_review(spark, d):
    m = memory(spark, d)
    return m.select("repo_name", "pr_number", "review_summary", F.array_join("issue_types", ",").alias("issue_types"),
                    F.col("created_at").cast("string").alias("created_at"))


@register("past_issues", f"WITH {MEM_SQL}\nSELECT repo_name, array_to_string(past_issues, ', ') AS past_issues FROM past")
def q_past_issues(spark, d):
    p = mm.past_issues(memory(spark, d))
    return p.select("repo_name", F.array_join("past_issues", ", ").alias("past_issues"))


def past_at_creation(spark, d):
    return mm.past_issues_at_creation(memory(spark, d), fx.fx_pr(spark, d))


@register("past_issues_at_creation", f"""WITH {MEM_SQL}, {PAST_SQL}
SELECT repo_name, pr_number, array_to_string(past_issues, ', ') AS past_issues FROM past_at WHERE len(past_issues) > 0""")
def q_past_issues_at_creation(spark, d):
    """M2 when each PR was created."""
    return past_at_creation(spark, d).select("repo_name", "pr_number", F.array_join("past_issues", ", ").alias("past_issues"))


@register("dashboard_totals", f"WITH {MEM_SQL}\nSELECT CAST(count(*) AS BIGINT) AS total_reviews FROM top100")
def q_dashboard_totals(spark, d):
    return mm.dashboard_totals(memory(spark, d))


@register("dashboard_repos", f"""
WITH {MEM_SQL}
SELECT coalesce(repo_name, 'unknown') AS name, CAST(count(*) AS BIGINT) AS count,
       CAST(row_number() OVER (ORDER BY count(*) DESC, min(rank)) AS BIGINT) AS pos
FROM top100 GROUP BY coalesce(repo_name, 'unknown')
""")
def q_dashboard_repos(spark, d):
    return mm.dashboard_repos(memory(spark, d)).select("name", "count", _i("pos"))


@register("dashboard_issues", f"""
WITH {MEM_SQL}
SELECT type, CAST(count(*) AS BIGINT) AS count, CAST(row_number() OVER (ORDER BY count(*) DESC, min([rank, tp])) AS BIGINT) AS pos
FROM (SELECT rank, unnest(issue_types) AS type, generate_subscripts(issue_types, 1) - 1 AS tp FROM top100) t GROUP BY type
""")
def q_dashboard_issues(spark, d):
    return mm.dashboard_issues(memory(spark, d)).select("type", "count", _i("pos"))


@register("dashboard_recent", f"""
WITH {MEM_SQL}
SELECT CAST(rank AS BIGINT) AS pos, repo_name AS repo, pr_number AS pr, CAST(created_at AS VARCHAR) AS date,
       array_to_string(issue_types, ',') AS issues FROM top100 WHERE rank <= 15
""")
def q_dashboard_recent(spark, d):
    r = mm.dashboard_recent(memory(spark, d))
    return r.select(_i("pos"), "repo", "pr", F.col("date").cast("string").alias("date"),
                    F.array_join("issues", ",").alias("issues"))


@register("issue_counts", f"""
WITH {MEM_SQL}
SELECT type, CAST(count(*) AS BIGINT) AS count FROM (SELECT unnest(issue_types) AS type FROM mem) t GROUP BY type
""")
def q_issue_counts(spark, d):
    return mm.issue_counts(memory(spark, d))


MEMCTX_TAIL = f"""{BREAKING_TAIL}, {HOT_SQL}, {MEM_SQL}, {PAST_SQL},
blist AS (SELECT repo_name, pr_number, 'BREAKING CHANGES DETECTED:' || chr(10) || string_agg('  - ' || message, chr(10)
          ORDER BY finding_pos) AS btext FROM breaking GROUP BY ALL),
memctx AS (
  SELECT p.repo_name, p.pr_number, concat_ws(chr(10) || chr(10),
         CASE WHEN len(pa.past_issues) > 0 THEN 'Past issues in this repo: ' || array_to_string(pa.past_issues, ', ') END,
         CASE WHEN h.hotspot_text <> '' THEN h.hotspot_text END, b.btext) AS memory_context
  FROM fx_pr p LEFT JOIN past_at pa ON pa.repo_name = p.repo_name AND pa.pr_number = p.pr_number
  LEFT JOIN hot_text h ON h.repo_name = p.repo_name AND h.pr_number = p.pr_number
  LEFT JOIN blist b ON b.repo_name = p.repo_name AND b.pr_number = p.pr_number)"""
MEMCTX_SQL = KEPT_LINES_SQL + MEMCTX_TAIL


def memory_context(spark, d):
    return mm.memory_context(fx.fx_pr(spark, d), past_at_creation(spark, d), hs.hotspot_prompt(hotspots(spark, d)),
                             breaking(spark, d))


@register("memory_context", f"WITH {MEMCTX_SQL}\nSELECT repo_name, pr_number, memory_context FROM memctx")
def q_memory_context(spark, d):
    return memory_context(spark, d)


@register("memory_context_manual", f"""
WITH {MEM_SQL}, {PAST_SQL}
SELECT p.repo_name, p.pr_number, CASE WHEN len(a.past_issues) > 0 THEN 'Past issues: ' || array_to_string(a.past_issues, ', ')
       ELSE '' END AS memory_context
FROM fx_pr p LEFT JOIN past_at a ON a.repo_name = p.repo_name AND a.pr_number = p.pr_number""")
def q_memory_context_manual(spark, d):
    """M7, manual review: past issues only."""
    return mm.manual_context(fx.fx_pr(spark, d), past_at_creation(spark, d))
