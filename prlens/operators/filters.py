"""File selection and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prlens.functions import glob_to_regex
from prlens.session import written

# Tools in their run/report order, and the language suffixes.
TOOLS = ["bandit", "ruff", "radon", "eslint", "detect-secrets", "pip-audit"]
PY_SUFFIXES = [".py"]
JS_SUFFIXES = [".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs"]
PY_TOOLS = ["bandit", "ruff", "radon"]
JS_TOOLS = ["eslint"]
ALWAYS_TOOLS = ["detect-secrets", "pip-audit"]


def tool_pos(tool: str) -> int:
    return TOOLS.index(tool)


def ends_with_any(c, suffixes) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    out = None
    for s in suffixes:
        out = c.endswith(s) if out is None else (out | c.endswith(s))
    return out


def ignore_filter(files: DataFrame, cfg: DataFrame, name_col: str = "filename") -> DataFrame:
    """drop files whose full name matches any of the repo's ignore globs.

    Globs are sorted once per repo, on the config side: those without a wildcard are
    looked up, a text before or after one ``*`` is compared, and all others become one
    regex for the repo, tried only where nothing else hit.  A task compiles it
    when the repo changes from one row to the next, not for each row and glob.
    The globs are written, so that their size is known before the join: a small
    config is broadcast, and the files are not moved to a task for each repo.
    """
    c = cfg.select(F.col("repo_name").alias("_repo"), *[x.alias(n) for n, x in glob_sets(F.col("ignore")).items()])
    c = written(c.filter("size(_exact) + size(_starts) + size(_ends) > 0 OR _regex IS NOT NULL"), "globs")
    name = F.col(name_col)
    hit = (F.array_contains("_exact", name) | F.exists("_starts", name.startswith) | F.exists("_ends", name.endswith)
           | F.coalesce(F.regexp_like(name, F.col("_regex")), F.lit(False)))
    j = files.join(c, F.col("repo_name") == F.col("_repo"), "left")
    return j.filter(~F.coalesce(hit, F.lit(False))).drop("_repo", "_exact", "_starts", "_ends", "_regex")


def glob_sets(globs: Column) -> dict[str, Column]:
    """An array of globs as exact names, text before a last ``*``, text after a first ``*``, and
    one regex for all others (null if there are none)."""
    globs = F.coalesce(globs, F.array().cast("array<string>"))
    head = F.filter(globs, lambda g: g.rlike(r"(?s)^[^*?\[]*\*\z"))
    tail = F.filter(globs, lambda g: g.rlike(r"(?s)^\*[^*?\[]+\z"))
    others = F.filter(globs, lambda g: g.rlike(r"(?s)[*?\[]") & ~g.rlike(r"(?s)^[^*?\[]*\*\z|^\*[^*?\[]+\z"))
    return {"_exact": F.filter(globs, lambda g: ~g.rlike(r"(?s)[*?\[]")),
            "_starts": F.transform(head, lambda g: F.substr(g, F.lit(1), F.char_length(g) - 1)),
            "_ends": F.transform(tail, lambda g: F.substr(g, F.lit(2))),
            "_regex": F.when(F.size(others) > 0, F.array_join(F.transform(others, glob_to_regex), "|"))}


def route_tools(prs: DataFrame, files: DataFrame) -> DataFrame:
    """which tools run for each PR (files already ignore-filtered).

    Python files route bandit, ruff and radon; any JS/TS suffix routes eslint;
    detect-secrets and pip-audit always run, even for a PR with no files left.
    """
    flags = files.groupBy("repo_name", "pr_number").agg(
        F.bool_or(ends_with_any("filename", PY_SUFFIXES)).alias("has_python"),
        F.bool_or(ends_with_any("filename", JS_SUFFIXES)).alias("has_js"),
    )
    j = prs.select("repo_name", "pr_number").join(flags, ["repo_name", "pr_number"], "left")
    chosen = []
    for t in TOOLS:
        if t in PY_TOOLS:
            cond = F.coalesce("has_python", F.lit(False))
        elif t in JS_TOOLS:
            cond = F.coalesce("has_js", F.lit(False))
        else:
            assert t in ALWAYS_TOOLS
            cond = F.lit(True)
        chosen.append(F.when(cond, F.struct(F.lit(t).alias("tool"), F.lit(tool_pos(t)).alias("tool_pos"))))
    return j.select("repo_name", "pr_number", F.explode(F.array_compact(F.array(*chosen))).alias("t")).select(
        "repo_name", "pr_number", "t.tool", "t.tool_pos")


def language_files(files: DataFrame) -> DataFrame:
    """each linter's file subset by suffix, one row per (PR, tool, file)."""
    py = files.filter(ends_with_any("filename", PY_SUFFIXES))
    py_rows = py.select("*", F.explode(F.array(*[F.lit(t) for t in PY_TOOLS])).alias("tool"))
    js_rows = files.filter(ends_with_any("filename", JS_SUFFIXES)).withColumn("tool", F.lit("eslint"))
    return py_rows.unionByName(js_rows)


def cap_changed_files(files: DataFrame, n: int | None = 10) -> DataFrame:
    """F8: history analyses look at the first ``n`` files of the unfiltered list (``None``: all)."""
    return files if n is None else files.filter(F.col("file_pos") <= n)


def existing_targets(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """keep changed files present in the head snapshot (deleted files drop out)."""
    snap = snapshot.select("repo_name", F.col("path").alias("filename")).distinct()
    return files.join(snap, ["repo_name", "filename"], "left_semi")


def agent_toggle(prs: DataFrame, cfg: DataFrame, agents: list[tuple[str, int]]) -> DataFrame:
    """per (PR, agent) whether the agent runs; a disabled one starts as ``SKIPPED``.

    ``agents`` is the fixed (name, position) list; each PR row is expanded
    in place with ``explode`` (no join).
    """
    j = prs.select("repo_name", "pr_number").join(cfg.select("repo_name", "agents"), "repo_name", "left")
    fixed = F.array(*[F.struct(F.lit(a).alias("agent"), F.lit(p).alias("agent_pos")) for a, p in agents])
    j = j.select("*", F.explode(fixed).alias("_a")).select("*", "_a.agent", "_a.agent_pos").drop("_a")
    enabled = F.coalesce(F.try_element_at(F.col("agents"), F.col("agent")), F.lit(True))
    return j.select(
        "repo_name", "pr_number", "agent", "agent_pos", enabled.alias("enabled"),
        F.when(enabled, F.lit("")).otherwise(F.lit("SKIPPED")).alias("initial_review"),
    )
