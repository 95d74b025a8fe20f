"""The adapter views as DuckDB SQL, for the oracle side of the correctness gate.

``with_fixtures(sql)`` finds every ``fx_*`` name used in ``sql`` (and, in
turn, in the views it needs) and prepends them as CTEs in dependency order.
The bodies mirror ``prlens.sources.fixtures`` one for one.
"""

from __future__ import annotations

import re

from prlens.sources.fixtures import (
    AGENTS, PATCHES, REPORT_FILES, REPORTS, REVIEWS, RUFF_CODES, SCORES, TABLE, VERDICTS, VERSION_ENDS, WEBHOOK_SECRET,
    hmac_pads,
)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(texts) -> str:
    return "[" + ", ".join(map(_q, texts)) + "]"


def _places(text: str, places: dict[str, str]) -> str:
    for place, value in places.items():
        text = f"replace({text}, {_q(place)}, {value})"
    return text


_REPORT_PLACES = {
    "{f}": "filename", "{a}": "CAST(additions AS STRING)", "{d}": "CAST(deletions AS STRING)",
    "{n}": "CAST(additions % 30 AS STRING)", "{s}": "CAST(1 + pk % 2 AS STRING)",
    "{h}": "CASE pk % 2 WHEN 0 THEN 'HIGH' ELSE 'MEDIUM' END", "{c}": f"{_list(RUFF_CODES)}[pk % 4 + 1]",
    **{f"{{{n}}}": f"CAST(pk % {n} AS STRING)" for n in (3, 4, 5, 9)},
}
_REPORT = " UNION ALL ".join(
    f"SELECT repo_name, pr_number, '{tool}' AS tool, " + _places(
        "CASE " + " ".join(f"WHEN pk % {by} = {k} THEN {_q(x)}" for k, x in odd.items()) + f" ELSE {_q(text)} END",
        _REPORT_PLACES) + f" AS report FROM fx_pr_file WHERE filename LIKE '{REPORT_FILES[tool]}'"
    for tool, (by, odd, text) in REPORTS.items())

_PATH = (
    "CASE l_partkey % 6 WHEN 0 THEN 'src/mod_' || CAST(l_partkey % 40 AS STRING) || '.py' "
    "WHEN 1 THEN 'web/app_' || CAST(l_partkey % 40 AS STRING) || '.ts' "
    "WHEN 2 THEN 'docs/page_' || CAST(l_partkey % 40 AS STRING) || '.md' "
    "WHEN 3 THEN 'tests/test_mod_' || CAST(l_partkey % 40 AS STRING) || '.py' "
    "WHEN 4 THEN 'src/pkg/mod_' || CAST(l_partkey % 40 AS STRING) || '.py' ELSE 'requirements.txt' END"
)

_FILE = f"CASE WHEN l_partkey % 31 = 0 THEN 'src/new_' || CAST(l_partkey % 40 AS STRING) || '.py' ELSE {_PATH} END"

_IPAD, _OPAD = hmac_pads(WEBHOOK_SECRET)

VIEWS: dict[str, str] = {
    "fx_pr": (
        "SELECT 'org/repo' || CAST(o_custkey % 20 AS STRING) AS repo_name, o_orderkey AS pr_number, "
        "'dev' || CAST(o_custkey % 25 AS STRING) AS author, o_orderdate AS created_at, "
        "md5('head-' || CAST(o_orderkey AS STRING)) AS head_sha FROM orders"
    ),
    "fx_pr_file": (
        "SELECT repo_name, pr_number, CAST(row_number() OVER (PARTITION BY pr_number ORDER BY filename) AS INT) AS file_pos, "
        "filename, additions, deletions, pk FROM (SELECT p.repo_name, p.pr_number, l.filename, "
        "sum(CAST(l.l_quantity AS BIGINT)) * 4 AS additions, sum(CAST(l.l_linenumber AS BIGINT)) * 9 AS deletions, "
        f"min(l.l_partkey) AS pk FROM (SELECT *, {_FILE} AS filename FROM lineitem) l "
        "JOIN fx_pr p ON p.pr_number = l.l_orderkey GROUP BY p.repo_name, p.pr_number, l.filename) g"
    ),
    "fx_commit": (
        "SELECT p.repo_name, l.path, CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) || '-' || "
        "CAST(l.l_partkey AS STRING) || '-' || CAST(l.l_suppkey AS STRING) AS sha, "
        "CASE WHEN l.l_suppkey % 17 = 0 THEN NULL ELSE 'dev' || CAST(l.l_suppkey % 25 AS STRING) END AS author, "
        "CASE WHEN l.l_returnflag = 'R' THEN 'Fix broken import' WHEN l.l_partkey % 11 = 0 THEN 'add prefix option' "
        f"ELSE 'add feature' END AS message, l.l_shipdate AS ts FROM (SELECT *, {_PATH} AS path FROM lineitem) l "
        "JOIN fx_pr p ON p.pr_number = l.l_orderkey"
    ),
    "fx_patch": (
        "SELECT repo_name, pr_number, file_pos, filename, ['modified', 'added', 'removed'][pk % 3 + 1] AS status, "
        "CASE WHEN pk % 13 = 0 THEN NULL ELSE '@@ -1,3 +1,3 @@' || chr(10) || "
        f"replace({_list(PATCHES)}[CAST(additions % {len(PATCHES)} AS BIGINT) + 1], '{{k}}', CAST(pk % 50 AS STRING)) END AS patch "
        "FROM fx_pr_file"
    ),
    "fx_tool_report": _REPORT,
    "fx_agent": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {p}, '{s}')" for a, p, s in AGENTS)
    + ") AS t(agent, agent_pos, sentinel)",
    "fx_review": (
        "SELECT p.repo_name, p.pr_number, a.agent, a.agent_pos, p.created_at, " + _places(
            f"{_list(REVIEWS)}[CASE WHEN p.pr_number % 9 = 0 THEN 0 ELSE (p.pr_number + a.agent_pos) % {len(REVIEWS)} END + 1]",
            {"{sentinel}": "a.sentinel", "{agent}": "a.agent", "{90}": "CAST(p.pr_number % 90 AS STRING)",
             "{7}": "CAST(p.pr_number % 7 AS STRING)"}) + " AS review FROM fx_pr p CROSS JOIN fx_agent a"
    ),
    "fx_requirement": (
        "SELECT 'org/repo' || CAST(p_partkey % 20 AS STRING) AS repo_name, p_partkey AS line_no, replace(p_name, ' ', '-') || "
        "CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '>=1.' || CAST(p_size AS STRING) ELSE '==2.' || CAST(p_size AS STRING) || "
        f"{_list(VERSION_ENDS)}[p_partkey % {len(VERSION_ENDS)} + 1] END AS line FROM part"
    ),
    "fx_code_file": (
        "SELECT 'org/repo' || CAST(d.doc_id % 20 AS STRING) AS repo_name, 'src/doc_' || CAST(d.doc_id AS STRING) || '.py' AS path, "
        "d.text AS content, e.embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"
    ),
    "fx_webhook_body": (
        "SELECT event_id AS delivery_id, ts, '{\"action\":\"' || CASE event_type WHEN 'signup' THEN 'opened' WHEN 'purchase' "
        "THEN 'synchronize' WHEN 'error' THEN 'closed' ELSE event_type END || '\",\"pull_request\":{\"number\":' || "
        "CAST(event_id AS STRING) || '},\"repository\":{\"full_name\":\"org/repo' || CAST(user_id % 20 AS STRING) || '\"}}' "
        "AS body FROM events"
    ),
    "fx_webhook": (
        "SELECT delivery_id, ts, body, CASE delivery_id % 5 WHEN 0 THEN NULL "
        "WHEN 1 THEN 'sha1=' || sha1(encode(body)) WHEN 2 THEN 'sha256=' || repeat('0', 64) "
        f"ELSE 'sha256=' || sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(body)))) END AS signature "
        "FROM fx_webhook_body"
    ),
    "fx_verdict": (
        "SELECT repo_name, pr_number, created_at, '## Review' || chr(10) || '### Verdict: ' || "
        f"{_list(VERDICTS)}[pr_number % 3 + 1] || CASE WHEN pr_number % 5 <> 0 THEN chr(10) || '> Because of finding ' || "
        "CAST(pr_number % 9 AS STRING) ELSE '' END || chr(10) || '### Must Fix Before Merge' || chr(10) "
        "|| CASE pr_number % 3 WHEN 0 THEN '- **SQL injection** (src/mod_1.py:3): auth bypass' ELSE 'None' END || chr(10) || "
        "'### Should Fix' || chr(10) || CASE WHEN pr_number % 4 = 0 THEN '- **Slow loop** (src/mod_2.py:9): query in loop, "
        "performance' ELSE 'None.' END || CASE WHEN pr_number % 4 = 1 THEN chr(10) || '### Consider Improving' || chr(10) || "
        "'- **Naming**: style' || chr(10) || '- **Docs** (README.md)' ELSE '' END || CASE WHEN pr_number % 2 = 0 THEN "
        f"replace(replace({_q(TABLE)}, '{{n}}', CAST(pr_number % 11 AS STRING)), '{{k}}', CAST(pr_number % 8 AS STRING)) "
        f"ELSE '' END AS final_review, {_list(SCORES)}[pr_number % 6 + 1] AS raw_score FROM fx_pr"
    ),
    "fx_query_embedding": (
        "SELECT p.repo_name, p.pr_number, e.embedding FROM fx_pr p JOIN embeddings e ON e.vec_id = p.pr_number % 1000"
    ),
    "fx_manager": (
        "SELECT repo_name, pr_number, created_at, CASE WHEN pr_number % 7 = 0 THEN NULL ELSE final_review END AS final_review, "
        "raw_score FROM fx_verdict"
    ),
    "fx_config_override": (
        "SELECT repo_name, o.file_name, o.parse_ok, o.agents, o.severity_threshold, o.ignore, o.pr_size FROM ("
        "SELECT repo_name, unnest(CASE CAST(substring(repo_name, 9, 10) AS INT) % 5 "
        "WHEN 1 THEN [{'file_name': '.ai-reviewer.yml', 'parse_ok': true, 'agents': MAP {'autofix': false, 'test': false}, "
        "'severity_threshold': 'MEDIUM', 'ignore': ['docs/*', '*.md'], 'pr_size': MAP {'max_lines': 800::BIGINT}}] "
        "WHEN 2 THEN [{'file_name': '.ai-reviewer.yml', 'parse_ok': true, 'agents': NULL::MAP(VARCHAR, BOOLEAN), "
        "'severity_threshold': NULL::VARCHAR, 'ignore': ['tests/*'], 'pr_size': MAP {'max_files': 5::BIGINT}}, "
        "{'file_name': '.ai-reviewer.yaml', 'parse_ok': true, 'agents': NULL::MAP(VARCHAR, BOOLEAN), 'severity_threshold': 'HIGH', "
        "'ignore': NULL::VARCHAR[], 'pr_size': NULL::MAP(VARCHAR, BIGINT)}] "
        "WHEN 3 THEN [{'file_name': '.ai-reviewer.yaml', 'parse_ok': true, 'agents': MAP {'security': false}, "
        "'severity_threshold': NULL::VARCHAR, 'ignore': ['web/app_1?.ts', 'src/mod_[0-4].py', 'src/pkg/*'], "
        "'pr_size': NULL::MAP(VARCHAR, BIGINT)}] "
        "WHEN 4 THEN [{'file_name': '.ai-reviewer.yml', 'parse_ok': false, 'agents': MAP {}::MAP(VARCHAR, BOOLEAN), "
        "'severity_threshold': NULL::VARCHAR, 'ignore': NULL::VARCHAR[], 'pr_size': MAP {}::MAP(VARCHAR, BIGINT)}] "
        "END) AS o FROM (SELECT DISTINCT repo_name FROM fx_pr) r) x"
    ),
    "fx_autofix": (
        "SELECT p.repo_name, p.pr_number, coalesce(f.fixes, '### No Auto-Fixes Available' || chr(10) || "
        "'All identified issues require design-level changes that cannot be expressed as line-level patches.') AS autofix "
        "FROM fx_pr p LEFT JOIN (SELECT repo_name, pr_number, string_agg('### Fix: Move secret out of code' || chr(10) || "
        "'**File:** `' || filename || '`  |  **Line:** ' || CAST(pos + 1 AS VARCHAR) || chr(10) || chr(10) || 'Original code:' "
        "|| chr(10) || '```' || chr(10) || substring(line, 2) || chr(10) || '```' || chr(10) || chr(10) || 'Suggested fix:' || "
        "chr(10) || '```suggestion' || chr(10) || 'DB_PASSWORD = os.environ[\"DB_PASSWORD\"]' || chr(10) || '```' || chr(10) || "
        "chr(10) || '**Why:** a literal password in source leaks with the repository.' || chr(10) || chr(10) || '---', "
        "chr(10) || chr(10) ORDER BY file_pos, pos) AS fixes FROM (SELECT repo_name, pr_number, file_pos, filename, "
        "generate_subscripts(string_split(patch, chr(10)), 1) - 1 AS pos, unnest(string_split(patch, chr(10))) AS line "
        "FROM fx_patch) t WHERE starts_with(line, '+DB_PASSWORD') GROUP BY repo_name, pr_number) f "
        "ON f.repo_name = p.repo_name AND f.pr_number = p.pr_number"
    ),
}

_NAME = re.compile(r"\bfx_[a-z_]+\b")


def _deps(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(_NAME.findall(sql)) if n in VIEWS]


def with_fixtures(sql: str) -> str:
    order: list[str] = []

    def visit(name: str, stack: tuple = ()) -> None:
        if name in order:
            return
        for dep in _deps(VIEWS[name]):
            if dep != name and dep not in stack:
                visit(dep, stack + (name,))
        order.append(name)

    for n in _deps(sql):
        visit(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
