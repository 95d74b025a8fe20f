"""Shared folders named by a URI, odd globs, Unicode names, missing authors,
fixed tables by literal examples, and fixtures that reach every branch."""

import fnmatch
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from prlens import session
from prlens.functions import fill, glob_to_regex
from prlens.operators import breaking as bk, evaluation as ev, history as hs, reviews as rv, scans
from prlens.plans import catalog

from conftest import SF_SMALL

QUERIES = {k: v for k, v in entry.queries().items() if k in catalog.QUERIES}


def test_checkpoint_folder_may_be_a_uri(spark, tmp_path, monkeypatch):
    from prlens.sources import fixtures as fx

    from prlens.plans import streams
    from prlens.streaming import webhooks

    monkeypatch.setattr(fx, "_STORED", {})
    for module in (session, fx, streams, webhooks):
        monkeypatch.setattr(module, "checkpoint_dir", lambda spark: tmp_path.as_uri())
    for name in ("pr_size_check", "unified_findings", "stream_issue_counts"):
        assert QUERIES[name](spark, SF_SMALL).count() > 0
    assert list(tmp_path.glob("fixtures/*/*/fx_tool_report")) and list(tmp_path.glob("memory-*"))


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_derived_tables_follow_the_data(spark, tmp_path):
    from prlens.sources import fixtures as fx

    def write(n):
        spark.range(n).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text").coalesce(1).write.mode(
            "overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.range(1).selectExpr("id AS vec_id", "array(CAST(1 AS FLOAT)) AS embedding").write.mode(
            "overwrite").parquet(f"{tmp_path}/embeddings.parquet")

    for n in (3, 5):
        write(n)
        assert fx.fx_code_file(spark, str(tmp_path)).count() == n


ODD = ["src/[abc", "[z-a]*", "a[[]b", "[]]", "[!]]", "[]", "[!]", "[!a", "[a-]", "[-a]", "[a-c-e]", "[^a]", "[a&&b]", "[\\]",
       "[\\d]", "a{2}", "(a|b)", "a+b.c", "[!z-a]", "*", "**/x", "?", "[a\n]", "é?", "$^", "[a-c]]", "[[:alpha:]]"]


def test_globs_equal_fnmatch(spark):
    rng = random.Random(8)
    patterns = ODD + ["".join(rng.choice("ab-*?[]!^\\&.z/") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    names = ["", "a", "b", "]", "[", "a[b", "src/[abc", "z", "-", "^", "&", "\\", "a\n", "a-b", "x/x", "ab.c", "é1", "[]", "!"]
    names += ["".join(rng.choice("ab-[]!^\\&.z/") for _ in range(rng.randrange(1, 6))) for _ in range(25)]
    pairs = [(p, n) for p in patterns for n in names]
    got = spark.createDataFrame(pairs, "p string, n string").select(
        "p", "n", F.regexp_like("n", glob_to_regex("p")).alias("hit")).collect()
    wrong = [(r.p, r.n, r.hit) for r in got if r.hit != fnmatch.fnmatchcase(r.n, r.p)]
    assert wrong == []


def test_fill(spark):
    row = spark.range(1).select(fill("a {x} b {id}!", x=F.lit(5)).alias("t")).first()
    assert row.t == "a 5 b 0!"


def test_names_may_be_unicode(spark):
    patch = "-def größe(a):\n-class Über:\n-export const naïve = 1\n-@añadir.get(\"/x\")"
    f = spark.createDataFrame([("r", 1, 1, "a.py", patch)],
                              "repo_name string, pr_number bigint, file_pos int, filename string, patch string")
    got = {(r.kind, r.name) for r in bk.patch_definitions(f).collect()}
    assert got == {("function", "größe"), ("class", "Über"), ("export", "naïve"), ("endpoint", None)}
    code = spark.createDataFrame([("r", "b.py", "x = größe(1)")], "repo_name string, path string, content string")
    assert {r.token for r in bk.code_tokens(code).collect()} == {"x", "größe", "1"}


def test_reviewers_without_a_pr_author_or_login(spark):
    prs = spark.createDataFrame([("r", 1, None), ("r", 2, "ann")], "repo_name string, pr_number bigint, author string")
    files = spark.createDataFrame([("r", 1, 1, "f"), ("r", 2, 1, "f")],
                                  "repo_name string, pr_number bigint, file_pos int, filename string")
    commits = spark.createDataFrame([("r", "f", str(i), a, "m", i) for i, a in enumerate(["ann", "bob", "", None])],
                                    "repo_name string, path string, sha string, author string, message string, ts bigint")
    got = {(r.pr_number, r.login) for r in hs.suggest_reviewers(prs, files, commits).collect()}
    assert got == {(1, "ann"), (1, "bob"), (2, "bob")}


def test_limits_can_be_lifted(spark):
    prs = spark.createDataFrame([("r", 1, "x")], "repo_name string, pr_number bigint, author string")
    files = spark.createDataFrame([("r", 1, i, f"f{i}") for i in range(1, 31)],
                                  "repo_name string, pr_number bigint, file_pos int, filename string")
    commits = spark.createDataFrame([("r", f"f{1 + i % 30}", str(i), f"p{i % 9}", "m", i) for i in range(900)],
                                    "repo_name string, path string, sha string, author string, message string, ts bigint")
    r = hs.suggest_reviewers(prs, files, commits, max_files=None, max_commits=None, people=None, known=None).collect()
    assert sum(x.file_touches for x in r) == 900 and len(r) == 9


# Literal examples of every fixed rule: one line it must report, one it must not.
RULES = {
    "hardcoded-credential": ('api_key = "abcdef1"', 'api_key = "abc"'),
    "private-key-header": ("-----BEGIN EC PRIVATE KEY-----", "-----BEGIN PUBLIC KEY-----"),
    "sk-api-key": ("sk-" + "a1" * 10, "sk-" + "a1" * 9),
    "aws-access-key": ("AKIA" + "Z9" * 8, "AKIA" + "z9" * 8),
    "github-token": ("gho_" + "a" * 36, "ghx_" + "a" * 36),
    "sql-string-build": ('q = f"select {x}"', 'q = "select 1"'),
    "eval-call": ("eval (x)", "evaluate(x)"),
    "weak-hash": ("SHA1(x)", "sha256(x)"),
    "fstring-html": ('f"<p>{x}"', '"<p>{x}"'),
    "bare-except": ("except :", "except ValueError:"),
    "uninformative-error-log": ('print("Failed")', 'print("Failed", e)'),
    "http-without-timeout": ("requests.put(u)", "requests.put(u, timeout = 1)"),
    "todo-without-ticket": ("# FIXME later", "# FIXME AB-1 later"),
    "vague-name": ("tmp = 1", "tmp == 1"),
    "and-in-function-name": ("def load_and_save(x):", "def loadandsave(x):"),
    "AGPL": ("GNU Affero General Public License", "General Public"),
    "GPL": ("GNU General Public License", "GNU licence"),
    "noncommercial": ("cc by-nc 4.0", "cc by 4.0"),
    "permissive": ("Apache License", "Apache server"),
}


def test_fixed_rules_by_literal_examples(spark):
    tables = [scans.SECRET_RULES, scans.SECURITY_RULES, scans.FAILURE_RULES, scans.MAINTAINABILITY_RULES, scans.LICENSE_RULES]
    assert {r.rule_id for t in tables for r in t} == set(RULES)
    for rules in tables:
        rows = [(r.rule_id, k, RULES[r.rule_id][k]) for r in rules for k in (0, 1)]
        df = spark.createDataFrame(rows, "rule string, k int, t string")
        hits = {(r.rule, r.k) for r in df.select("rule", "k", F.explode(scans.rule_matches(F.col("t"), rules)).alias("m"))
                .filter("m.rule_id = rule").collect()}
        assert hits == {(r.rule_id, 0) for r in rules}


def test_fixed_texts_by_literal_value():
    assert hs.FIX_WORDS == ["fix", "bug", "hotfix", "patch", "resolve", "crash", "error", "broken"]
    assert rv.SENTINELS["security"] == "NO SECURITY VULNERABILITIES FOUND" and len(rv.SENTINELS) == 7
    assert rv.AGENT_ORDER == ["correctness", "security", "performance", "maintainability", "dependency", "test"]
    assert rv.AGENT_TOOLS["security"] == ["bandit", "detect-secrets"] and rv.AGENT_TOOLS["maintainability"] == ["ruff", "eslint"]
    assert rv.SEVERITY_VOCAB["dependency"] == ["HIGH", "MEDIUM", "LOW"]
    assert len(ev.CHECKS) == 19


def values(spark, name, column):
    return {r[0] for r in QUERIES[name](spark, SF_SMALL).select(column).distinct().collect()}


BRANCHES = {
    ("extract_definitions", "kind"): {"function", "class", "export", "endpoint"},
    ("breaking_changes", "kind"): {"function", "class", "endpoint", "signature"},
    ("secret_scan", "rule_id"): {r.rule_id for r in scans.SECRET_RULES},
    ("security_pattern_scan", "rule_id"): {r.rule_id for r in scans.SECURITY_RULES},
    ("failure_pattern_scan", "rule_id"): {r.rule_id for r in scans.FAILURE_RULES},
    ("maintainability_scan", "rule_id"): {r.rule_id for r in scans.MAINTAINABILITY_RULES},
    ("performance_pattern_scan", "rule_id"): {"query-in-loop", "nested-loop", "select-star", "unbounded-cache"},
    ("function_length", "severity"): {None, "MEDIUM", "HIGH"},
    ("review_status", "status"): {"CLEAN", "FAILED", "SKIPPED", "EMPTY", "FINDINGS"},
    ("parse_review_sections", "section"): {"must_fix", "should_fix", "consider"},
    ("tool_status", "success"): {True, False},
    ("load_tool_reports", "root"): {"array", "object", "invalid"},
    ("load_tool_reports", "parse_ok"): {True, False},
    ("comment_outbox", "kind"): {"size_warning", "inline", "summary", "status", "error"},
    ("comment_outbox", "state"): {None, "pending", "success", "failure"},
    ("merge_decision", "decision"): {"BLOCK MERGE", "APPROVE WITH CHANGES", "APPROVE"},
}


@pytest.mark.parametrize(("name", "column"), sorted(BRANCHES))
def test_fixtures_reach_every_branch(spark, name, column):
    assert values(spark, name, column) >= BRANCHES[name, column]


def test_fixtures_reach_more_branches(spark):
    q = lambda n: QUERIES[n](spark, SF_SMALL)
    assert q("parse_issue_blocks").filter("dimension IS NOT NULL").count() > 0
    assert q("parse_issue_blocks").filter("NOT severity_valid").count() > 0
    assert len(values(spark, "parse_verdict", "reason")) > 3
    assert len(values(spark, "parse_summary_table", "key_finding")) > 3
    assert q("existing_targets").count() < q("load_pr_files").count()
    assert q("norm_ruff").filter("suggestion <> ''").count() > 0
    assert q("norm_eslint").filter("message LIKE '[unknown]%'").count() > 0
    assert q("finding_totals").filter("tools_failed > 0").count() > 0
    assert q("tool_prompt_text").filter("text LIKE '%Not available%'").count() > 0
    assert q("tool_status").filter("summary LIKE 'Changed files%'").count() > 0
    assert q("build_prompts").filter("prompt LIKE '%Existing code in this repository%'").count() > 0


def test_query_text_equals_the_diff_prefix(spark):
    files = spark.createDataFrame(
        [("r", p, i, f"f{i}", "modified", "x" * (i * 37 % 900) if i % 4 else None, 1, i) for p in range(4)
         for i in range(1, 3 + p * 20)],
        "repo_name string, pr_number bigint, file_pos int, filename string, status string, patch string, "
        "additions bigint, deletions bigint")
    full = {r.pr_number: r.diff[:500] for r in rv.diff_text(files).collect()}
    assert {r.pr_number: r.query for r in rv.query_text(files).collect()} == full
