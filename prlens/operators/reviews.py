"""Prompts, agent outputs, verdicts and scores.

The review texts themselves come from a model (not rebuilt here); these
operators build the prompt tables that feed it and parse what comes back.
Per-PR text assembly collects only one PR's rows (a bounded group).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prlens.functions import py_strip, severity_name, severity_rank

KEYS = ["repo_name", "pr_number"]

# Specialist agents in order, each one's "nothing found"
# sentinel and severity vocabulary; the optional style agent comes last.
AGENT_ORDER = ["correctness", "security", "performance", "maintainability", "dependency", "test"]
SENTINELS = {
    "correctness": "NO CRITICAL ISSUES FOUND",
    "security": "NO SECURITY VULNERABILITIES FOUND",
    "performance": "NO PERFORMANCE ISSUES FOUND",
    "maintainability": "CODE IS WELL-STRUCTURED",
    "dependency": "NO DEPENDENCY ISSUES FOUND",
    "test": "TEST COVERAGE LOOKS GOOD",
    "style": "NO STYLE ISSUES FOUND",
}
SEVERITY_VOCAB = {
    "correctness": ["CRITICAL", "HIGH", "MEDIUM"],
    "security": ["CRITICAL", "HIGH", "MEDIUM"],
    "performance": ["CRITICAL", "HIGH", "MEDIUM"],
    "maintainability": ["HIGH", "MEDIUM", "LOW"],
    "dependency": ["HIGH", "MEDIUM", "LOW"],
    "test": ["CRITICAL", "HIGH", "MEDIUM"],
    "style": ["HIGH", "MEDIUM", "LOW"],
}
FAILED_PREFIX = "Unable to complete"
SKIPPED = "SKIPPED"
# Which tool outputs each agent sees, in join order.
AGENT_TOOLS = {
    "correctness": [],
    "security": ["bandit", "detect-secrets"],
    "performance": ["radon"],
    "maintainability": ["ruff", "eslint"],
    "dependency": ["pip-audit"],
    "test": [],
    "style": ["ruff"],
}
# The optional seventh reviewer (style) is not part of the default fan-out.
OPTIONAL_AGENTS = ["style"]
BLOCK_KEYS = ["DIMENSION", "ISSUE", "ATTACK", "SCALE", "LINE", "SEVERITY", "IMPACT", "FIX", "PACKAGE", "UNTESTED CODE"]
DETAIL_KEYS = ["ATTACK", "SCALE", "IMPACT", "PACKAGE", "UNTESTED CODE"]
VERDICTS_RX = r"Verdict:\s*(BLOCK MERGE|APPROVE WITH CHANGES|APPROVE)"
NO_AUTOFIX = "No Auto-Fixes Available"
AUTOFIX_HEADER = "\n\n---\n\n## 🔧 Auto-Fix Suggestions\n\n"
REVIEWER_SEP = "\n\n---\n"
ERROR_PREFIX = "⚠️ Automated review failed: "
STATUS_DESCRIPTION = "AI review score: {score}/10"
STATUS_CHARS = 140
PASS_SCORE = 6
DEFAULT_SCORE = "5"
BLOCK_AGENTS = ["correctness", "security", "dependency"]
CHANGE_AGENTS = ["performance", "test"]
MEDIUM_BLOCKERS = ["correctness", "security"]
DECISIONS = ["BLOCK MERGE", "APPROVE WITH CHANGES", "APPROVE"]

# Our own text: the review that stands in when the manager's model call fails
# (sections and table as P7-P9 read them; the verdict asks for a human look).
FALLBACK_DIMENSIONS = ["Correctness", "Security", "Performance", "Maintainability", "Dependencies", "Test Coverage"]
MANAGER_FALLBACK = "\n".join([
    "## Review without a merge decision",
    "",
    "### Verdict: APPROVE WITH CHANGES",
    "> The deciding model could not be reached, so nobody has weighed the findings below yet.",
    "",
    "### Must Fix Before Merge",
    "Not decided.",
    "",
    "### Should Fix",
    "Read each specialist's findings and settle them by hand.",
    "",
    "### Consider Improving",
    "Not decided.",
    "",
    "### Review Summary",
    "| Dimension | Status | Key Finding |",
    "|---|---|---|",
    *[f"| {d} | open | see the specialist's review |" for d in FALLBACK_DIMENSIONS],
])

# Our own prompt templates (the reference's prompt wording is not reused).
AGENT_BRIEF = {
    "correctness": "Review the diff for logic errors, unhandled failures, races, broken compatibility and missing logging.",
    "security": "Review the diff for exploitable vulnerabilities: injection, secrets, unsafe evaluation, weak crypto, XSS.",
    "performance": "Review the diff for work that grows badly with data: queries in loops, quadratic scans, unbounded memory.",
    "maintainability": "Review the diff for unclear names, oversized functions, duplication and missing tickets on TODOs.",
    "dependency": "Review the dependency changes for unpinned, vulnerable, deprecated or look-alike packages and licences.",
    "test": "Review whether the new and changed code paths are covered by tests.",
    "style": "Review naming, formatting and consistency with the existing code of this repository.",
}
BLOCK_FORMAT = "Report each finding as lines `ISSUE:`, `LINE:`, `SEVERITY:` ({vocab}) and `FIX:`."
NO_TOOLS = {"security": "No automated scan available.", "dependency": "No automated scan available."}


def tool_text_columns(texts: DataFrame) -> DataFrame:
    """P1, per PR: one column per tool (``t_<tool>``), empty texts as null."""
    tools = sorted({t for ts in AGENT_TOOLS.values() for t in ts})
    return texts.groupBy(*KEYS).agg(*[
        F.max(F.when(F.col("tool") == t, F.nullif(F.col("text"), F.lit("")))).alias(f"t_{t}") for t in tools])


def explode_agents(per: DataFrame, include_style: bool = False) -> DataFrame:
    """P1, per (PR, agent): the tool texts that agent sees, newline-joined,
    empties dropped; every other column of the PR is carried along."""
    rows = []
    for pos, agent in enumerate(AGENT_ORDER + (OPTIONAL_AGENTS if include_style else [])):
        cols = [F.col(f"`t_{t}`") for t in AGENT_TOOLS[agent]]
        txt = F.concat_ws("\n", *cols) if cols else F.lit("")
        rows.append(F.struct(F.lit(agent).alias("agent"), F.lit(pos).alias("agent_pos"), txt.alias("tool_text")))
    keep = [c for c in per.columns if not c.startswith("t_")]
    return per.select(*keep, F.explode(F.array(*rows)).alias("r")).select(*keep, "r.*")


def route_tool_text(texts: DataFrame, include_style: bool = False) -> DataFrame:
    """Per (PR, agent) the tool texts that agent sees.

    One aggregate per PR (a column per tool), then a fixed per-agent projection
    -- no join against a mapping table.  The optional style reviewer (a seventh
    row per PR) sees the ruff output.
    """
    return explode_agents(tool_text_columns(texts), include_style)


DIFF_FIELDS = ["filename", "status", "patch", "additions", "deletions"]


def diff_text(files: DataFrame, prs: DataFrame | None = None) -> DataFrame:
    """The diff each prompt embeds: JSON array of the PR's (kept) files in list
    order; with ``prs``, a PR without any file reads ``[]``."""
    g = files.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("file_pos", F.struct(*DIFF_FIELDS).alias("f"))))
                                 .alias("fs"))
    d = g.select(*KEYS, F.to_json(F.transform("fs", lambda x: x["f"])).alias("diff"))
    if prs is None:
        return d
    return prs.select(*KEYS).join(d, KEYS, "left").select(*KEYS, F.coalesce("diff", F.lit("[]")).alias("diff"))


QUERY_CHARS = 500
#: No file takes fewer characters of a diff than `{}` and a comma: null fields are left out of the text.
FILE_CHARS = 3


def query_text(files: DataFrame, prs: DataFrame | None = None, n: int | None = QUERY_CHARS) -> DataFrame:
    """The retrieval query is the first ``n`` characters of the diff text
    (``None``: all).  Only the PR's first files can reach into them, each with at
    most ``n`` characters of a patch, so only those are put together."""
    if n is not None:
        w = Window.partitionBy(*KEYS).orderBy("file_pos")
        files = (files.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n // FILE_CHARS + 1).drop("_n")
                 .withColumn("patch", F.substring("patch", 1, n)))
    d = diff_text(files, prs)
    return d.select(*KEYS, (F.col("diff") if n is None else F.substring("diff", 1, n)).alias("query"))


def build_prompts(ctx: DataFrame) -> DataFrame:
    """One prompt per (PR, agent) from our templates.

    ``ctx`` has one row per (PR, agent) with ``diff``, ``tool_text``,
    ``memory_context`` and ``context``; optional sections appear only when
    their input is non-empty.
    """
    def sec(cond: Column, *parts) -> Column:
        return F.when(cond, F.concat(*parts)).otherwise(F.lit(""))

    brief = F.lit("")
    fmt = F.lit("")
    sentinel = F.lit("")
    no_tool = F.lit("")
    for a in AGENT_ORDER + OPTIONAL_AGENTS:
        brief = F.when(F.col("agent") == a, F.lit(AGENT_BRIEF[a])).otherwise(brief)
        fmt = F.when(F.col("agent") == a, F.lit(BLOCK_FORMAT.format(vocab=" / ".join(SEVERITY_VOCAB[a])))).otherwise(fmt)
        sentinel = F.when(F.col("agent") == a, F.lit(SENTINELS[a])).otherwise(sentinel)
        if a in NO_TOOLS:
            no_tool = F.when(F.col("agent") == a, F.lit(NO_TOOLS[a] + "\n\n")).otherwise(no_tool)
    has_tool = F.coalesce(F.col("tool_text"), F.lit("")) != ""
    prompt = F.concat(
        brief, F.lit("\n\n"),
        F.when(has_tool, F.concat(F.lit("Static analysis results:\n"), F.col("tool_text"), F.lit("\n\n"))).otherwise(no_tool),
        sec(F.coalesce(F.col("memory_context"), F.lit("")) != "",
            F.lit("Team history:\n"), F.col("memory_context"), F.lit("\n\n")),
        sec(F.col("agent").isin("maintainability", "style") & (F.coalesce(F.col("context"), F.lit("")) != ""),
            F.lit("Existing code in this repository:\n"), F.col("context"), F.lit("\n\n")),
        F.lit("Diff:\n"), F.col("diff"), F.lit("\n\n"), fmt,
        F.lit("\nIf there is nothing to report, answer exactly: "), sentinel,
    )
    return ctx.select(*KEYS, "agent", "agent_pos", prompt.alias("prompt"))


def wide_reviews(reviews: DataFrame) -> DataFrame:
    """P3/P15 helper: one row per PR, one column per specialist (explicit pivot values)."""
    return reviews.groupBy(*KEYS).pivot("agent", AGENT_ORDER).agg(F.first("review"))


def build_manager_prompt(wide: DataFrame) -> DataFrame:
    """The manager prompt: six reviews in fixed order; an empty dependency
    or test review reads "No ... review available."."""
    def part(agent: str, title: str, fallback: str | None) -> Column:
        body = F.coalesce(F.col(agent), F.lit(""))
        if fallback:
            body = F.coalesce(F.nullif(F.col(agent), F.lit("")), F.lit(fallback))
        return F.concat(F.lit(f"== {title} ==\n"), body, F.lit("\n"))

    prompt = F.concat(
        F.lit("Decide whether this pull request can merge. Merge duplicate findings, drop false positives, "
              "rank by production impact and give a verdict: BLOCK MERGE, APPROVE WITH CHANGES or APPROVE.\n\n"),
        part("correctness", "Correctness", None), part("security", "Security", None),
        part("performance", "Performance", None), part("maintainability", "Maintainability", None),
        part("dependency", "Dependencies", "No dependency review available."),
        part("test", "Tests", "No test review available."),
    )
    return wide.select(*KEYS, prompt.alias("prompt"))


def build_autofix_prompt(df: DataFrame) -> DataFrame:
    """Autofix prompt from (diff, final review)."""
    p = F.concat(F.lit("Write line-level fixes for the findings below, one `### Fix: <title>` block each, "
                       "with **File:**, **Line:**, the original code, a ```suggestion block and **Why:**. "
                       f"If none can be fixed line by line, answer `### {NO_AUTOFIX}`.\n\nReview:\n"),
                 F.col("final_review"), F.lit("\n\nDiff:\n"), F.col("diff"))
    return df.select(*KEYS, p.alias("prompt"))


def build_score_prompt(df: DataFrame) -> DataFrame:
    """Judge prompt: rate the review 1-10, answer with the number only."""
    p = F.concat(F.lit("Rate this code review from 1 to 10 for concrete, actionable, correctly ranked findings "
                       "and a sound merge decision. Answer with the number only.\n\n"), F.col("final_review"))
    return df.select(*KEYS, p.alias("prompt"))


def sentinel_of(agent: Column) -> Column:
    args = []
    for a, s in SENTINELS.items():
        args += [F.lit(a), F.lit(s)]
    return F.try_element_at(F.create_map(*args), agent)


def review_status(reviews: DataFrame) -> DataFrame:
    """P5: CLEAN (the agent's sentinel), FAILED, SKIPPED, EMPTY or FINDINGS."""
    r = py_strip(F.coalesce(F.col("review"), F.lit("")))
    st = (F.when(r == "", F.lit("EMPTY")).when(r == SKIPPED, F.lit("SKIPPED"))
          .when(r.startswith(FAILED_PREFIX), F.lit("FAILED"))
          .when(r == sentinel_of(F.col("agent")), F.lit("CLEAN")).otherwise(F.lit("FINDINGS")))
    return reviews.select(*KEYS, "agent", st.alias("status"))


_WS = r"[ \t\x0B\f\r]"
_MARK = "\u0001"
# A block starts at a DIMENSION: line, or at an ISSUE: line whose previous
# line is not a DIMENSION: line.  Both kinds of line start are marked first;
# a second forward pass removes the mark of an ISSUE: line that directly
# follows a DIMENSION: line (no look-behind, linear in the text).
_MARK_ALL_RX = r"(?md)^(?=" + _WS + r"*(?:DIMENSION|ISSUE):)"
_UNMARK_RX = r"(?md)(^" + _MARK + _WS + r"*DIMENSION:[^\n]*\n)" + _MARK + r"(?=" + _WS + r"*ISSUE:)"


def parse_issue_blocks(reviews: DataFrame) -> DataFrame:
    """Split each review into finding blocks and read their ``KEY: value`` lines.

    A block starts at a ``DIMENSION:`` line, or at an ``ISSUE:`` line not
    directly under a ``DIMENSION:`` line; within a block the first value of
    each key wins.  Two forward ``regexp_replace`` passes mark block starts; a
    block's ``KEY: value`` lines are extracted once and folded into a map (first
    key wins), from which every field is looked up.  A pure map over reviews: no
    shuffle, no window.
    """
    text = F.coalesce("review", F.lit(""))
    marked = F.regexp_replace(F.regexp_replace(text, _MARK_ALL_RX, _MARK), _UNMARK_RX, "$1")
    b = reviews.filter(text.contains("ISSUE:") | text.contains("DIMENSION:")).select(
        *KEYS, "agent", F.posexplode(F.split(marked, _MARK, -1)).alias("block_no", "blk"))
    b = b.filter(F.col("block_no") >= 1)
    kv_rx = r"(?md)^" + _WS + r"*((?:" + "|".join(BLOCK_KEYS) + r"):" + _WS + r"*.*?)" + _WS + r"*$"
    lines = F.regexp_extract_all("blk", F.lit(kv_rx), F.lit(1))
    pairs = F.transform(lines, lambda x: F.struct(
        F.substring_index(x, ":", 1).alias("k"),
        F.regexp_replace(F.substr(x, F.char_length(F.substring_index(x, ":", 1)) + 2), "^" + _WS + "+", "").alias("v")))
    # map_from_entries keeps the last value of a key, so the lines go in backwards.
    b = b.select(*KEYS, "agent", "block_no", F.map_from_entries(F.reverse(pairs)).alias("m"),
                 F.transform(pairs, lambda p: p["k"]).alias("ks"))
    detail_key = F.get(F.filter("ks", lambda k: k.isin(DETAIL_KEYS)), F.lit(0))
    b = b.select("*", F.upper(F.col("m")["SEVERITY"]).alias("severity"))
    vocab = F.create_map(*[x for a, vs in SEVERITY_VOCAB.items() for x in (F.lit(a), F.array(*map(F.lit, vs)))])
    field = lambda key: F.col("m")[key]
    return b.select(*KEYS, "agent", "block_no", field("DIMENSION").alias("dimension"), field("ISSUE").alias("issue"),
                    field("LINE").alias("line_ref"), "severity", field("FIX").alias("fix"),
                    F.col("m")[detail_key].alias("detail"),
                    F.coalesce(F.array_contains(vocab[F.col("agent")], F.col("severity")), F.lit(False))
                    .alias("severity_valid"))


def dedupe_findings(blocks: DataFrame) -> DataFrame:
    """One row per (PR, file, line, normalised issue); highest severity,
    the agents that reported it (sorted)."""
    b = blocks.select(
        *KEYS, "agent", "severity",
        F.nullif(F.regexp_extract(F.coalesce("line_ref", F.lit("")), r"^([^:\s]+)", 1), F.lit("")).alias("file"),
        F.nullif(F.regexp_extract(F.coalesce("line_ref", F.lit("")), r":([0-9]+)", 1), F.lit("")).try_cast("bigint")
        .alias("line"),
        F.lower(py_strip(F.regexp_replace(F.coalesce("issue", F.lit("")), r"\s+", " "))).alias("issue_key"),
    )
    g = b.groupBy(*KEYS, "file", "line", "issue_key").agg(
        F.max(severity_rank("severity")).alias("sev_rank"), F.array_sort(F.collect_set("agent")).alias("agents"))
    return g.select(*KEYS, "file", "line", "issue_key", severity_name("sev_rank").alias("severity"), "sev_rank",
                    "agents", F.size("agents").cast("bigint").alias("n_agents"))


def rank_findings(deduped: DataFrame) -> DataFrame:
    """Rank per PR by severity, number of agents, file, line."""
    w = Window.partitionBy(*KEYS).orderBy(F.col("sev_rank").desc(), F.col("n_agents").desc(),
                                          F.col("file").asc_nulls_last(), F.col("line").asc_nulls_last(),
                                          F.col("issue_key").asc_nulls_last())
    return deduped.withColumn("rank", F.row_number().over(w))


def merge_decision(blocks: DataFrame, flags: DataFrame) -> DataFrame:
    """BLOCK MERGE / APPROVE WITH CHANGES / APPROVE per PR (our rule).

    Conditional aggregates over the parsed findings, then a left join of the
    per-PR breaking flag; both sides are one row per PR.
    """
    rank = severity_rank("severity")
    a = F.col("agent")
    agg = blocks.groupBy(*KEYS).agg(
        F.count_if(a.isin(BLOCK_AGENTS) & (rank >= 3)).cast("bigint").alias("n_blocking"),
        F.count_if((a.isin(CHANGE_AGENTS) & (rank >= 2)) | (a.isin(MEDIUM_BLOCKERS) & (rank == 2)))
        .cast("bigint").alias("n_changes"),
    )
    carry = [c for c in ("n_breaking",) if c in flags.columns]
    j = flags.select(*KEYS, "has_breaking", *carry).join(agg, KEYS, "left").fillna(0, ["n_blocking", "n_changes"])
    dec = (F.when((F.col("n_blocking") > 0) | F.col("has_breaking"), F.lit(DECISIONS[0]))
           .when(F.col("n_changes") > 0, F.lit(DECISIONS[1])).otherwise(F.lit(DECISIONS[2])))
    return j.select(*KEYS, dec.alias("decision"), "n_blocking", "n_changes", "has_breaking", *carry)


def parse_verdict(reviews: DataFrame, col: str = "final_review") -> DataFrame:
    """The verdict (longest alternative first) and the reason line (``> ...``)."""
    v = F.nullif(F.regexp_extract(F.coalesce(col, F.lit("")), VERDICTS_RX, 1), F.lit(""))
    reason = F.regexp_extract(F.coalesce(col, F.lit("")), r"(?m)^>\s*(.*)$", 1)
    return reviews.select(*KEYS, v.alias("verdict"), reason.alias("reason"))


SECTIONS = [("Must Fix", "must_fix"), ("Should Fix", "should_fix"), ("Consider", "consider")]
BULLET_RX = r"^- \*\*(.+?)\*\*(?: \(([^)]*)\))?:?\s*(.*)$"


def parse_review_sections(reviews: DataFrame, col: str = "final_review") -> DataFrame:
    """Must-fix / should-fix / consider bullets: title, location, text.

    The review is cut at its ``### `` headers (linear in the text); each part
    belongs to the section its header names.  Parts of one section are numbered
    through: the bullets of earlier parts with the same name come first.
    """
    lines = F.transform(F.split(F.coalesce(col, F.lit("")), "\n", -1), lambda l: py_strip(l))
    parts = F.split(F.concat(F.lit("\n"), F.array_join(lines, "\n")), "\n### ", -1)

    def section(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        name = F.lit("other")
        for needle, n in reversed(SECTIONS):
            name = F.when(head.contains(needle), F.lit(n)).otherwise(name)
        return F.struct(name.alias("section"), F.filter(F.split(p, "\n", -1), lambda x: x.startswith("- **")).alias("bl"))

    cut = reviews.select(*KEYS, F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), section).alias("ps"))

    def bullets(name: str) -> Column:
        own = F.filter("ps", lambda p: p["section"] == name)
        return F.struct(F.lit(name).alias("section"), F.flatten(F.transform(own, lambda p: p["bl"])).alias("bl"))

    rows = cut.select(*KEYS, F.inline(F.array(*[bullets(n) for _, n in SECTIONS]))).select(*KEYS, "section", F.posexplode("bl").alias("p", "t"))
    return rows.select(*KEYS, "section", (F.col("p") + 1).alias("item_pos"),
                       F.regexp_extract("t", BULLET_RX, 1).alias("title"),
                       F.regexp_extract("t", BULLET_RX, 2).alias("location"),
                       F.regexp_extract("t", BULLET_RX, 3).alias("text"))


def parse_summary_table(reviews: DataFrame, col: str = "final_review") -> DataFrame:
    """The six dimension rows of the summary table (status, key finding)."""
    t = F.transform(F.split(F.coalesce(col, F.lit("")), "\n", -1), lambda l: py_strip(l))
    rows = F.filter(t, lambda x: x.startswith("|") & ~x.rlike(r"^\|\s*-") & ~x.rlike(r"^\|\s*Dimension\s*\|"))
    df = reviews.select(*KEYS, F.posexplode(rows).alias("p", "line"))
    cells = F.split(F.regexp_replace(F.col("line"), r"^\||\|$", ""), r"\|", -1)
    return df.select(*KEYS, (F.col("p") + 1).alias("row_pos"), cells.alias("c")).select(
        *KEYS, "row_pos", py_strip(F.col("c")[0]).alias("dimension"), py_strip(F.col("c")[1]).alias("status"),
        py_strip(F.col("c")[2]).alias("key_finding"))


def manager_fallback(reviews: DataFrame, col: str = "final_review") -> DataFrame:
    """P10: a failed manager call (NULL review) becomes our fallback review."""
    return reviews.withColumn(col, F.coalesce(F.col(col), F.lit(MANAGER_FALLBACK)))


FIX_FILE_RX = r"\*\*File:\*\*\s*`([^`]*)`"
FIX_LINE_RX = r"\*\*Line:\*\*\s*([0-9]+)"
FIX_ORIG_RX = r"(?s)Original code:\s*```[^\n]*\n(.*?)\n```"
FIX_SUGG_RX = r"(?s)```suggestion\n(.*?)\n```"
FIX_WHY_RX = r"\*\*Why:\*\*\s*([^\n]*)"


def parse_autofixes(df: DataFrame, col: str = "autofix") -> DataFrame:
    """``### Fix: title`` blocks -> title, file, line, original, suggestion, why.
    The no-fix sentinel yields no rows."""
    txt = F.coalesce(F.col(col), F.lit(""))
    d = df.filter(~txt.contains(NO_AUTOFIX)).select(*KEYS, F.posexplode(F.split(txt, "### Fix:", -1)).alias("fix_pos", "b"))
    d = d.filter(F.col("fix_pos") >= 1)
    b = F.col("b")
    return d.select(*KEYS, "fix_pos", py_strip(F.regexp_extract(b, r"^([^\n]*)", 1)).alias("title"),
                    F.regexp_extract(b, FIX_FILE_RX, 1).alias("file"),
                    F.nullif(F.regexp_extract(b, FIX_LINE_RX, 1), F.lit("")).try_cast("bigint").alias("line"),
                    F.regexp_extract(b, FIX_ORIG_RX, 1).alias("original"),
                    F.regexp_extract(b, FIX_SUGG_RX, 1).alias("suggestion"),
                    F.regexp_extract(b, FIX_WHY_RX, 1).alias("why"))


def score_gate(df: DataFrame, col: str = "raw_score") -> DataFrame:
    """Strip; all digits -> score, else "5"; score >= 6 passes; status
    description capped at 140 characters."""
    s = py_strip(F.coalesce(F.col(col), F.lit("")))
    score = F.when(s.rlike(r"^[0-9]+$"), s).otherwise(F.lit(DEFAULT_SCORE))
    digits = F.regexp_replace(score, r"^0+(?=[0-9])", "")  # no leading zeros, so length orders values
    passed = (F.length(digits) > 1) | (digits >= F.lit(str(PASS_SCORE)))
    pre, post = STATUS_DESCRIPTION.split("{score}")
    desc = F.substring(F.concat(F.lit(pre), score, F.lit(post)), 1, STATUS_CHARS)
    return df.select(*KEYS, score.alias("score"),
                     F.when(passed, F.lit("success")).otherwise(F.lit("failure")).alias("state"),
                     desc.alias("description"))


def full_comment(final: DataFrame, autofix: DataFrame | None = None, reviewer_text: DataFrame | None = None,
                 col: str = "final_review") -> DataFrame:
    """Final review + autofix section (unless none available) + reviewer section."""
    out = final.select(*KEYS, col)
    parts = [F.coalesce(F.col(col), F.lit(""))]
    if autofix is not None:
        out = out.join(autofix.select(*KEYS, "autofix"), KEYS, "left")
        a = F.coalesce(F.col("autofix"), F.lit(""))
        parts.append(F.when((a != "") & ~a.contains(NO_AUTOFIX), F.concat(F.lit(AUTOFIX_HEADER), a)).otherwise(F.lit("")))
    if reviewer_text is not None:
        out = out.join(reviewer_text.select(*KEYS, "reviewer_text"), KEYS, "left")
        r = F.coalesce(F.col("reviewer_text"), F.lit(""))
        parts.append(F.when(r != "", F.concat(F.lit(REVIEWER_SEP), r)).otherwise(F.lit("")))
    return out.select(*KEYS, F.concat(*parts).alias("body"))


def error_comment(status: DataFrame) -> DataFrame:
    """One error comment for each PR whose processing failed."""
    return status.filter(F.col("error").isNotNull()).select(
        *KEYS, F.concat(F.lit(ERROR_PREFIX), F.col("error")).alias("body"))


def wide_review(reviews: DataFrame, final: DataFrame, autofix: DataFrame, scores: DataFrame) -> DataFrame:
    """The nine-field response record per PR."""
    w = wide_reviews(reviews)
    for a in AGENT_ORDER:
        w = w.withColumnRenamed(a, f"{a}_review")
    j = w.join(final.select(*KEYS, "final_review"), KEYS, "left").join(
        autofix.select(*KEYS, F.col("autofix").alias("autofix_suggestions")), KEYS, "left").join(
        scores.select(*KEYS, "score"), KEYS, "left")
    return j.select(*KEYS, *[f"{a}_review" for a in AGENT_ORDER], "final_review", "autofix_suggestions", "score")
