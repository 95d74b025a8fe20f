"""Semantic traps from SURVEY's defect table (Q-rows) and text rules,
each checked on a tiny literal frame."""

import datetime as dt
import fnmatch
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from prlens.functions import glob_to_regex
from prlens.operators import breaking as bk, evaluation as ev, filters, findings as fd, history as hs
from prlens.operators import memory as mm, reviews as rv
from prlens.sources import config
from prlens.sources.fixtures import hmac_sha256_hex
from prlens.streaming import webhooks as wh

FILE_SCHEMA = "repo_name string, pr_number bigint, file_pos int, filename string, patch string"


def files(spark, *patches):
    return spark.createDataFrame([("r", 1, i + 1, name, p) for i, (name, p) in enumerate(patches)], FILE_SCHEMA)


def test_q5_readded_unchanged_function_still_removed(spark):
    f = files(spark, ("a.py", "-def foo(a):\n+def foo(a):"))
    assert [r["name"] for r in bk.removed_functions(bk.annotate_definitions(bk.patch_definitions(f))).collect()] == ["foo"]
    strict = bk.breaking_changes(f, strict=True)
    assert strict.count() == 0


def test_q5_changed_signature_suppresses_removal_in_other_files(spark):
    f = files(spark, ("a.py", "-def foo(a):\n+def foo(a, b):"), ("b.py", "-def foo(x):"))
    kinds = sorted(r["kind"] for r in bk.breaking_changes(f).collect())
    assert kinds == ["signature"]


def test_q6_unanchored_route(spark):
    f = files(spark, ("a.py", "-    v = d.get('val')"))
    eps = bk.breaking_changes(f).collect()
    assert [(r["kind"], r["message"]) for r in eps] == [
        ("endpoint", "API endpoint `GET val` removed from `a.py` — clients will get 404s")]
    assert bk.breaking_changes(f, strict=True).count() == 0


def test_private_def_falls_through(spark):
    f = files(spark, ("a.py", "-def _helper(a): return x.get('/p')"))
    r = bk.breaking_changes(f).collect()
    assert [x["kind"] for x in r] == ["endpoint"]


def test_duplicate_names_last_signature_wins(spark):
    f = files(spark, ("a.py", "-def f(a):\n-def f(b):\n+def f(c):"))
    c = bk.changed_signatures(bk.annotate_definitions(bk.patch_definitions(f))).collect()
    assert [(r["old"], r["new"], r["line_no"]) for r in c] == [("def f(b)", "def f(c)", 0)]


def test_sign_stripping(spark):
    f = files(spark, ("a.py", "--- a/x\n+++ b/x\n-  -def g(a):  \n++x"))
    r = bk.patch_lines(f).collect()
    assert [(x["side"], x["code"]) for x in r] == [("removed", "-def g(a):"), ("added", "x")]  # lstrip stops at the space


FINDING_SCHEMA = "repo_name string, pr_number bigint, tool string, tool_pos int, ord bigint, file string, line bigint, " \
                 "severity string, message string, tagged_message string, suggestion string"


def test_q7_first_25_then_drop_line_0(spark):
    rows = [("r", 1, "pip-audit" if i < 5 else "ruff", 5 if i < 5 else 1, i, "f.py", 0 if i < 5 else i, "HIGH", "m",
             "[t] m", "") for i in range(30)]
    f = spark.createDataFrame(rows, FINDING_SCHEMA)
    c = fd.inline_comments(f).collect()
    # ruff (tool 1) comes first: 25 ruff findings fill the slots; pip-audit ones never get in
    assert len(c) == 25
    rows2 = [("r", 1, "bandit", 0, i, "f.py", 0 if i < 5 else i, None, "m", "[t] m", "fix" if i == 6 else "")
             for i in range(30)]
    c2 = fd.inline_comments(spark.createDataFrame(rows2, FINDING_SCHEMA)).collect()
    assert len(c2) == 20  # five line-0 findings used up slots
    b = [r["body"] for r in c2 if r["line"] == 6][0]
    assert b == "**INFO**: [t] m\n\n**Suggested fix**: fix"


REPORT_SCHEMA = "repo_name string, pr_number bigint, tool string, report string"


def test_q10_ruff_null_code_fails_tool_and_eslint_rules(spark):
    reports = spark.createDataFrame([
        ("r", 1, "ruff", '[{"code": null, "message": "x", "filename": "a.py", "location": {"row": 1}}]'),
        ("r", 1, "eslint", '[{"filePath": "a.ts", "messages": [{"ruleId": null, "line": 2, "message": "bad"}, '
                           '{"line": 3, "message": "parse"}]}]'),
        ("r", 1, "bandit", "not json"),
    ], REPORT_SCHEMA)
    fails = {r["tool"]: r["error"] for r in fd.report_failures(reports).collect()}
    assert fails == {"ruff": "'NoneType' object has no attribute 'startswith'", "bandit": "report is not valid JSON"}
    e = [(r["message"], r["severity"]) for r in fd.norm_eslint(reports).collect()]
    assert e == [("[None] bad", "MEDIUM"), ("[unknown] parse", "MEDIUM")]


def test_reports_of_the_wrong_shape_fail_their_tool(spark):
    """The errors the tools' own readers would raise (w4)."""
    cases = [
        ("bandit", '{"results": [{"filename": "a.py", "line_number": 1}]}', "'issue_text'"),
        ("bandit", '{"results": [{"line_number": 1, "issue_text": "t"}]}', "'filename'"),
        ("bandit", '{"results": null}', "'NoneType' object is not iterable"),
        ("bandit", '[]', "'list' object has no attribute 'get'"),
        ("bandit", '{}', None),
        ("ruff", '[{"code": "E501"}]', "'filename'"),
        ("ruff", '{"a": 1}', "'str' object has no attribute 'get'"),
        ("ruff", '[{"filename": "a.py"}]', None),
        ("radon", '{"a.py": {"error": "x"}}', "'str' object has no attribute 'get'"),
        ("radon", '[]', "'list' object has no attribute 'items'"),
        ("radon", '{"a.py": []}', None),
        ("eslint", '[{"messages": null}]', "'NoneType' object is not iterable"),
        ("eslint", '[{"filePath": "a.ts"}]', None),
        ("pip-audit", '{"dependencies": [{"vulns": [{"id": "x"}]}]}', "'name'"),
        ("pip-audit", '{"dependencies": [{"vulns": []}]}', None),
        ("pip-audit", '[{"name": "x", "vulns": [{}]}]', None),
    ]
    reports = spark.createDataFrame([("r", i, t, rep) for i, (t, rep, _) in enumerate(cases)], REPORT_SCHEMA)
    got = {r["pr_number"]: r["error"] for r in fd.report_failures(reports).collect()}
    assert [got.get(i) for i in range(len(cases))] == [e for *_, e in cases]


def test_a_failed_report_drops_the_whole_tool(spark):
    ok = '[{"code": "F821", "message": "m", "filename": "a.py", "location": {"row": 3}}]'
    reports = spark.createDataFrame([("r", 1, "ruff", ok), ("r", 1, "ruff", "oops"), ("r", 2, "ruff", ok)], REPORT_SCHEMA)
    routes = spark.createDataFrame([("r", 1, "ruff", 1), ("r", 2, "ruff", 1)],
                                   "repo_name string, pr_number bigint, tool string, tool_pos int")
    u = fd.unified_findings(routes, fd.all_tool_findings(reports)).collect()
    assert [r["pr_number"] for r in u] == [2]
    st = {r["pr_number"]: (r["success"], r["n_findings"], r["summary"]) for r in
          fd.tool_status(fd.tool_results(routes, reports)).collect()}
    assert st == {1: (False, 0, ""), 2: (True, 1, "Found 1 linting issues.")}


def test_tool_prompt_text(spark):
    routes = spark.createDataFrame([("r", 1, "ruff", 1), ("r", 1, "bandit", 0), ("r", 1, "radon", 2)],
                                   "repo_name string, pr_number bigint, tool string, tool_pos int")
    reports = spark.createDataFrame([
        ("r", 1, "ruff", '[{"code": "F821", "message": "undefined", "filename": "a.py", "location": {"row": 3},'
                         ' "fix": {"message": "define it"}}]'),
        ("r", 1, "bandit", "{oops"),
    ], REPORT_SCHEMA)
    t = {r["tool"]: r["text"] for r in fd.tool_prompt_text(fd.tool_results(routes, reports)).collect()}
    assert t["ruff"] == "[ruff] 1 issue(s):\n  - [HIGH] a.py:3 — [F821] undefined\n    Suggested fix: define it"
    assert t["bandit"] == "[bandit] Not available: report is not valid JSON"
    assert t["radon"] == "[radon] No issues found."


def test_q3_severity_filter(spark):
    f = spark.createDataFrame([("r", "LOW"), ("r", "MEDIUM"), ("r", "CRITICAL"), ("s", "LOW")],
                              "repo_name string, severity string")
    cfg = spark.createDataFrame([("r", "MEDIUM"), ("s", "LOW")], "repo_name string, severity_threshold string")
    kept = sorted((r["repo_name"], r["severity"]) for r in fd.severity_filter(f, cfg).collect())
    assert kept == [("r", "CRITICAL"), ("r", "MEDIUM"), ("s", "LOW")]


def test_q4_agent_toggle_and_q2_config(spark):
    repos = spark.createDataFrame([("a",), ("b",), ("c",)], "repo_name string")
    ov = spark.createDataFrame([
        ("a", ".ai-reviewer.yml", True, {"security": False}, None, ["docs/*"], {"max_files": 2}),
        ("a", ".ai-reviewer.yaml", True, {"test": False}, "HIGH", None, None),
        ("b", ".ai-reviewer.yml", False, {}, "HIGH", None, {}),
        ("b", ".ai-reviewer.yaml", True, {"test": False}, "HIGH", None, None),
    ], "repo_name string, file_name string, parse_ok boolean, agents map<string,boolean>, severity_threshold string, "
       "ignore array<string>, pr_size map<string,bigint>")
    cfg = {r["repo_name"]: r for r in config.resolve_config(repos, ov).collect()}
    assert cfg["a"]["agents"]["security"] is False and cfg["a"]["agents"]["test"] is True  # .yml wins
    assert (cfg["a"]["max_files"], cfg["a"]["max_lines"], cfg["a"]["severity_threshold"]) == (2, 500, "LOW")
    assert cfg["b"]["severity_threshold"] == "LOW"  # unparsable .yml -> defaults, .yaml ignored
    assert cfg["c"]["config_file"] is None and list(cfg["c"]["ignore"]) == []
    prs = spark.createDataFrame([("a", 1)], "repo_name string, pr_number bigint")
    t = {r["agent"]: r["initial_review"] for r in filters.agent_toggle(
        prs, config.resolve_config(repos, ov), [("correctness", 0), ("security", 1)]).collect()}
    assert t == {"correctness": "", "security": "SKIPPED"}


@pytest.mark.parametrize("pattern", ["*.md", "docs/*", "src/mod_[0-4].py", "web/app_1?.ts", "[!a-m]*", "a.b*",
                                     "*(x)*", "x+y?", "*", "src/*/mod.py", "[a-c]x$"])
def test_glob_matches_fnmatch(spark, pattern):
    names = ["README.md", "docs/a/b.md", "src/mod_3.py", "src/mod_7.py", "web/app_12.ts", "web/app_1.ts", "zeta",
             "a.bc", "axbc", "f(x)g", "x+yz", "xxyz", "src/pkg/mod.py", "src/mod.py", "bx$", "dx$", "line\nbreak.md"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"] for r in df.filter(F.regexp_like("n", glob_to_regex(F.lit(pattern)))).collect()}
    assert got == {n for n in names if fnmatch.fnmatchcase(n, pattern)}


def test_hmac_matches_python(spark):
    bodies = ['{"a":1}', "", "héllo wörld ✓", "x" * 500]
    for secret in ["s3cret", "k" * 100]:
        df = spark.createDataFrame([(b,) for b in bodies], "body string")
        got = [r[0] for r in df.select(hmac_sha256_hex(F.col("body"), secret)).collect()]
        want = [hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest() for b in bodies]
        assert got == want


def test_verify_signature_fail_closed(spark):
    body = '{"action":"opened","pull_request":{"number":5},"repository":{"full_name":"o/r"}}'
    good = "sha256=" + hmac.new(b"k", body.encode(), hashlib.sha256).hexdigest()
    ev_ = spark.createDataFrame([(1, body, None), (2, body, "sha1=ab"), (3, body, "sha256=00"), (4, body, good)],
                                "delivery_id bigint, body string, signature string")
    r = {x["delivery_id"]: x["reason"] for x in wh.verify_signature(ev_, "k").collect()}
    assert r == {1: wh.MISSING_HEADER, 2: wh.MALFORMED_HEADER, 3: wh.MISMATCH, 4: None}
    assert {x["reason"] for x in wh.verify_signature(ev_, "").collect()} == {wh.NO_SECRET}
    req = wh.review_requests(ev_, "k").collect()
    assert [(x["repo_name"], x["pr_number"], x["action"]) for x in req] == [("o/r", 5, "opened")]


@pytest.mark.parametrize("raw,score,state", [("8", "8", "success"), ("10", "10", "success"), (" 7 ", "7", "success"),
                                             ("8/10", "5", "failure"), ("3", "3", "failure"), ("", "5", "failure"),
                                             ("006", "006", "success"), ("²", "5", "failure"),
                                             ("99999999999999999999999", "99999999999999999999999", "success")])
def test_score_gate(spark, raw, score, state):
    df = spark.createDataFrame([("r", 1, raw)], "repo_name string, pr_number bigint, raw_score string")
    r = rv.score_gate(df).collect()[0]
    assert (r["score"], r["state"], r["description"]) == (score, state, f"AI review score: {score}/10")


def test_q9_substring_rules(spark):
    df = spark.createDataFrame([("Reviewed by the author; SQL fine",), ("query in a loop hurts performance",)], "t string")
    tags = [list(r[0]) for r in df.select(mm.issue_tags("t")).collect()]
    assert tags == [["sql_injection", "auth"], ["n_plus_1_query", "performance"]]
    commits = spark.createDataFrame(
        [("r", "a.py", "add prefix option", dt.datetime(2001, 7, 1))] * 2,
        "repo_name string, path string, message string, ts timestamp_ntz")
    h = hs.path_hotspots(commits, dt.datetime(2001, 8, 1)).collect()
    assert [(x["fix_commits"], x["risk"]) for x in h] == [(2, "MEDIUM")]


def test_reviewers_ties_and_self_exclusion(spark):
    prs = spark.createDataFrame([("r", 1, "me")], "repo_name string, pr_number bigint, author string")
    fl = spark.createDataFrame([("r", 1, 1, "a.py"), ("r", 1, 2, "b.py")],
                               "repo_name string, pr_number bigint, file_pos int, filename string")
    t0 = dt.datetime(2001, 1, 1)
    commits = spark.createDataFrame([
        ("r", "a.py", "s1", "bob", t0 + dt.timedelta(days=3)), ("r", "a.py", "s2", "me", t0 + dt.timedelta(days=2)),
        ("r", "a.py", "s3", "cy", t0 + dt.timedelta(days=1)), ("r", "b.py", "s4", "cy", t0),
        ("r", "b.py", "s5", "bob", t0 - dt.timedelta(days=1)), ("r", "b.py", "s6", None, t0 - dt.timedelta(days=2)),
    ], "repo_name string, path string, sha string, author string, ts timestamp_ntz")
    r = hs.suggest_reviewers(prs, fl, commits).orderBy("rank").collect()
    assert [(x["login"], x["file_touches"], list(x["knows_files"])) for x in r] == [
        ("bob", 2, ["a.py", "b.py"]), ("cy", 2, ["a.py", "b.py"])]
    txt = hs.reviewer_comment(hs.suggest_reviewers(prs, fl, commits)).collect()[0]["reviewer_text"]
    assert txt.startswith("\n### 👥 Suggested Reviewers\nBased on git history — who knows this code best:\n\n- **@bob**")


def test_q11_keyword_recall_fields(spark):
    wide = spark.createDataFrame([("r", 1, "", "", "", "", "", "pin your versions", "")],
                                 "repo_name string, pr_number bigint, final_review string, correctness_review string, "
                                 "security_review string, performance_review string, maintainability_review string, "
                                 "dependency_review string, test_review string")
    def hit(include_all):
        return {r["issue"]: r["detected"] for r in ev.keyword_recall(wide, include_all).collect()}["Unpinned versions"]
    assert hit(False) is False and hit(True) is True


def test_parse_issue_blocks(spark):
    text = ("DIMENSION: Correctness\nISSUE: off by one\nLINE: a.py:3\nSEVERITY: high\nFIX: use <=\n\n"
            "ISSUE: second\nLINE: b.py\nSEVERITY: LOW\nFIX: x")
    df = spark.createDataFrame([("r", 1, "correctness", text)], "repo_name string, pr_number bigint, agent string, review string")
    b = rv.parse_issue_blocks(df).orderBy("block_no").collect()
    assert [(x["dimension"], x["issue"], x["line_ref"], x["severity"], x["severity_valid"]) for x in b] == [
        ("Correctness", "off by one", "a.py:3", "HIGH", True), (None, "second", "b.py", "LOW", False)]


def test_manager_fallback_table(spark):
    df = spark.createDataFrame([("r", 1, None)], "repo_name string, pr_number bigint, final_review string")
    t = rv.parse_summary_table(rv.manager_fallback(df)).collect()
    assert len(t) == 6 and t[0]["dimension"] == "Correctness" and t[5]["dimension"] == "Test Coverage"
    v = rv.parse_verdict(rv.manager_fallback(df)).collect()[0]
    assert v["verdict"] == "APPROVE WITH CHANGES"


def test_similar_code_blocks_equal_single_block(spark):
    import random

    from prlens.operators import retrieval as rt
    rnd = random.Random(7)
    rows = [(f"r{i % 2}", f"p{i}", "text", [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(40)]
    files = spark.createDataFrame(rows, "repo_name string, path string, content string, embedding array<float>")
    index = rt.index_rows(files)
    queries = files.select("repo_name", F.col("path").alias("query_id"), "embedding")
    def top(block):
        return sorted((r["query_id"], r["hit_rank"], r["id"]) for r in
                      rt.similar_code(queries, index, k=3, block_rows=block).collect())
    small = top(4)
    assert small == top(10_000) and len(small) == 40 * 3


def test_index_versions(spark, tmp_path):
    from prlens.operators import retrieval as rt
    files = spark.createDataFrame([("r", "a.py", "x"), ("r", "b.py", "")], "repo_name string, path string, content string")
    base = str(tmp_path / "index")
    rt.publish_index(rt.index_rows(files), base, 1)
    newer = spark.createDataFrame([("r", "a.py", "y"), ("s", "c.py", "z")], "repo_name string, path string, content string")
    rt.publish_index(rt.index_upsert(rt.read_index(spark, base), newer), base, 2)
    cur = {(r["path"], r["content"]) for r in rt.read_index(spark, base).collect()}
    assert cur == {("a.py", "y"), ("c.py", "z")}
    assert {r["repo_name"] for r in rt.index_clear(rt.read_index(spark, base), "s").collect()} == {"r"}


def test_function_length_and_nested_loops(spark):
    from prlens.operators import scans
    body = ["+def big(a):"] + [f"+    x{i} = {i}" for i in range(35)] + ["+def small():", "+    return 1"]
    loops = ["+def f(rows):", "+    for r in rows:", "+        for c in r:", "+            db.execute(c)"]
    f = files(spark, ("a.py", "\n".join(body)), ("b.py", "\n".join(loops)))
    fl = {(r["filename"], r["name"]): (r["length"], r["severity"]) for r in scans.function_length(f).collect()}
    assert fl[("a.py", "big")] == (36, "MEDIUM") and fl[("a.py", "small")] == (2, None)
    hits = {(r["line_no"], r["rule_id"]) for r in scans.performance_pattern_scan(f).collect() if r["filename"] == "b.py"}
    assert hits == {(2, "nested-loop"), (3, "query-in-loop")}


def test_pr_dump_intake(spark, tmp_path):
    import json

    from prlens.sources import prs
    dump = [{"repo_name": "o/r", "pr_number": 7, "title": "t", "body": None, "author": "ann", "head_sha": "abc",
             "total_additions": 3, "total_deletions": 1,
             "files": [{"filename": "a.py", "patch": "+x", "additions": 1, "deletions": 0, "status": "modified"},
                       {"filename": "img.png", "patch": None, "additions": 0, "deletions": 0, "status": "added"}]}]
    p = tmp_path / "prs.json"
    p.write_text("\n".join(json.dumps(d) for d in dump))
    rows = prs.load_pr_files(prs.read_pr_dump(spark, str(p))).orderBy("file_pos").collect()
    assert [(r["file_pos"], r["filename"], r["patch"], r["body"]) for r in rows] == [
        (1, "a.py", "+x", ""), (2, "img.png", prs.NO_PATCH, "")]


def test_tool_report_intake(spark):
    from prlens.sources import prs
    df = spark.createDataFrame([("r", 1, "ruff", ""), ("r", 1, "bandit", None), ("r", 1, "pip-audit", " {\"dependencies\": []} "),
                                ("r", 1, "eslint", "oops")], "repo_name string, pr_number bigint, tool string, report string")
    got = {r["tool"]: (r["report"], r["root"], r["parse_ok"]) for r in prs.load_tool_reports(df).collect()}
    assert got == {"ruff": ("[]", "array", True), "bandit": ("{}", "object", True),
                   "pip-audit": ('{"dependencies": []}', "object", True), "eslint": ("oops", "invalid", False)}


def test_optional_style_agent_prompt(spark):
    texts = spark.createDataFrame([("r", 1, "ruff", "[ruff] No issues found."), ("r", 1, "bandit", "")],
                                  "repo_name string, pr_number bigint, tool string, text string")
    routed = rv.route_tool_text(texts, include_style=True)
    got = {r["agent"]: r["tool_text"] for r in routed.collect()}
    assert len(got) == 7 and got["style"] == "[ruff] No issues found." and got["security"] == ""
    ctx = routed.withColumn("diff", F.lit("[]")).withColumn("memory_context", F.lit("")).withColumn("context", F.lit("x = 1"))
    p = {r["agent"]: r["prompt"] for r in rv.build_prompts(ctx).collect()}
    assert p["style"].endswith("answer exactly: NO STYLE ISSUES FOUND") and "Existing code in this repository:\nx = 1" in p["style"]
    assert p["security"].startswith(rv.AGENT_BRIEF["security"] + "\n\nNo automated scan available.")


def test_sinks_append_partitioned(spark, tmp_path):
    from prlens.operators import memory as mm2, report
    rev = spark.createDataFrame([("o/r", 1, "SQL injection here " + "x" * 600, dt.datetime(2024, 1, 1))],
                                "repo_name string, pr_number bigint, final_review string, created_at timestamp_ntz")
    rows = mm2.memory_rows(rev)
    base = str(tmp_path / "memory")
    mm2.store_review(rows, base)
    mm2.store_review(rows, base)
    back = spark.read.parquet(base).collect()
    assert len(back) == 2 and len(back[0]["review_summary"]) == 500 and list(back[0]["issue_types"]) == ["sql_injection"]
    ob = spark.createDataFrame([("o/r", 1, "summary", None, None, "body")],
                               "repo_name string, pr_number bigint, kind string, path string, line bigint, body string")
    out = str(tmp_path / "outbox")
    report.write_outbox(ob, out)
    assert spark.read.parquet(out).filter("kind = 'summary'").count() == 1
