"""Static-analysis findings: normalisation per tool, status, prompt text.

Reports are JSON text, parsed once to a VARIANT, which keeps "key absent" and
"key null" apart; one ``CASE tool`` turns each report into an array of findings
with their place in it (``ord``), so every later "first N" is defined, or into
the error its tool would have failed with (of several, the first in report
order; of a map of files, the first by path).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prlens.functions import fill, severity_rank
from prlens.operators.filters import TOOLS

KEYS = ["repo_name", "pr_number"]
FINDING_COLS = ["file", "line", "severity", "message", "tool", "rule_id", "suggestion"]

# Complexity threshold and the per-tool texts.
COMPLEXITY_THRESHOLD = 10
COMPLEXITY_HIGH = 20
AUDIT_FILE = "requirements.txt"
AUDIT_CHARS = 200
SUMMARY = {
    "bandit": "Scanned {n_targets} files, found {n} security issues.",
    "ruff": "Found {n} linting issues.",
    "radon": "Found {n} high-complexity blocks.",
    "eslint": "Found {n} JS/TS issues.",
    "pip-audit": "Scanned dependencies, found {n} vulnerabilities.",
    "detect-secrets": "Found {n} potential secrets.",
}
NO_TARGETS = "Changed files not found in workspace."
INLINE_LIMIT = 25

# The errors of reports that do not have the shape their tool writes.
INVALID_REPORT = "report is not valid JSON"
NULL_STARTSWITH = "'NoneType' object has no attribute 'startswith'"
NULL_GET = "'NoneType' object has no attribute 'get'"
LIST_GET = "'list' object has no attribute 'get'"
LIST_ITEMS = "'list' object has no attribute 'items'"
STR_GET = "'str' object has no attribute 'get'"
NULL_ITERATE = "'NoneType' object is not iterable"
NULL_SUBSCRIPT = "'NoneType' object is not subscriptable"

ITEM = ("struct<ord:struct<a:int,b:int>,file:string,line:bigint,severity:string,message:string,rule_id:string,"
        "suggestion:string,bad:string>")


def relativize_paths(df: DataFrame, root: str | Column | None, col: str = "file") -> DataFrame:
    """Strip the workspace prefix from absolute paths (others unchanged)."""
    if root is None:
        return df
    r = F.lit(root) if isinstance(root, str) else root
    c = F.col(col)
    return df.withColumn(col, F.when(c.startswith(r), F.substr(c, F.length(r) + 1)).otherwise(c))


# ---- reading JSON values without losing "absent" and "null": a report is one VARIANT, parsed once


def _part(v: Column, key: str) -> Column:
    """The value under a key; null where it is absent (a JSON null is a value)."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def _get(v: Column, key: str, default: str | None = None) -> Column:
    """The value as text, the default where the key is absent or null."""
    text = F.try_variant_get(v, f"$.{key}", "string")
    return text if default is None else F.coalesce(text, F.lit(default))


def _text(v: Column) -> Column:
    """A value as text; null for a JSON null."""
    return F.try_variant_get(v, "$", "string")


def _has(v: Column, key: str) -> Column:
    return _part(v, key).isNotNull()


def _is_null(v: Column, key: str) -> Column:
    return F.is_variant_null(_part(v, key))


def _list(v: Column) -> Column:
    """The elements of an array; null for any other value."""
    return F.try_variant_get(v, "$", "array<variant>")


def _object(v: Column) -> Column:
    """The entries of an object (by key); null for any other value."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _is_object(v: Column) -> Column:
    """Whether a value is an object, without reading its entries."""
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def _let(value: Column, then) -> Column:
    """``then(value)``, the value computed once however often it is named."""
    return F.transform(F.array(value), then)[0]


def _of(elements: Column, read, one) -> Column:
    """``one`` of each element's fields; ``read`` takes each field from the JSON once."""
    return F.transform(F.transform(elements, lambda m, i: F.struct(
        i.alias("i"), *[c.alias(k) for k, c in read(m).items()])), one)


def _item(a, b, file, line, severity, message, rule_id, suggestion, bad=None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")).alias("ord"), file.alias("file"),
        F.coalesce(line.try_cast("bigint"), F.lit(0).cast("bigint")).alias("line"), severity.alias("severity"),
        message.alias("message"), F.coalesce(rule_id, F.lit("")).alias("rule_id"),
        F.coalesce(suggestion, F.lit("")).alias("suggestion"), (none if bad is None else bad).alias("bad"))


def _failed(error: str | Column) -> Column:
    """What a part of the wrong shape becomes: one item that only carries the error."""
    none, zero = F.lit(None).cast("string"), F.lit(0)
    return F.array(_item(zero, zero, none, zero, none, none, none, none, F.lit(error) if isinstance(error, str) else error))


def _none() -> Column:
    return F.from_json(F.lit("[]"), f"array<{ITEM}>")


def _bandit(top: Column) -> Column:
    """Severity passthrough (default MEDIUM), ``text (CWE-id)``."""
    def read(m):
        return {"ok": _is_object(m), "filename": _part(m, "filename"), "at": _part(m, "line_number"),
                "text": _part(m, "issue_text"), "severity": _get(m, "issue_severity", "MEDIUM"),
                "cwe": _part(m, "issue_cwe.id"), "test": _get(m, "test_id")}

    def one(r):
        cwe = F.when(r["cwe"].isNotNull(), F.coalesce(_text(r["cwe"]), F.lit("None"))).otherwise(F.lit("N/A"))
        missing = F.when(~r["ok"], F.lit(STR_GET))
        for key, v in (("filename", "filename"), ("line_number", "at"), ("issue_text", "text")):  # the first missing key is named
            missing = missing.when(r[v].isNull(), F.lit(f"'{key}'"))
        return _item(F.lit(0), r["i"], _text(r["filename"]), _text(r["at"]), r["severity"],
                     F.concat(F.coalesce(_text(r["text"]), F.lit("None")), F.lit(" (CWE-"), cwe, F.lit(")")),
                     r["test"], F.lit(""), missing)

    def found(results):
        return (F.when(~_is_object(top), _failed(LIST_GET)).when(results.isNull(), _none())
                .when(F.is_variant_null(results), _failed(NULL_ITERATE))
                .otherwise(_let(_list(results), lambda xs: F.when(xs.isNull(), _failed(STR_GET)).otherwise(
                    _of(xs, read, one)))))

    return _let(_part(top, "results"), found)


def ruff_severity(code: Column) -> Column:
    return (F.when(code.startswith("E9") | code.startswith("F8") | code.startswith("F6"), F.lit("HIGH"))
            .when(code.startswith("E") | code.startswith("W"), F.lit("MEDIUM")).otherwise(F.lit("LOW")))


def _ruff(top: Column) -> Column:
    """E9/F8/F6 HIGH, other E/W MEDIUM, else LOW; ``[code] msg``."""
    def read(m):
        return {"ok": _is_object(m), "code": _get(m, "code", ""), "no_code": _is_null(m, "code"),
                "filename": _part(m, "filename"), "no_location": _is_null(m, "location"), "row": _get(m, "location.row"),
                "message": _get(m, "message", ""), "fix": _get(m, "fix.message")}

    def one(r):
        bad = (F.when(~r["ok"], F.lit(STR_GET)).when(r["no_code"], F.lit(NULL_STARTSWITH))
               .when(r["filename"].isNull(), F.lit("'filename'")).when(r["no_location"], F.lit(NULL_GET)))
        return _item(F.lit(0), r["i"], _text(r["filename"]), r["row"], ruff_severity(r["code"]),
                     F.concat(F.lit("["), r["code"], F.lit("] "), r["message"]), r["code"], r["fix"], bad)

    return _let(_list(top), lambda items: F.when(F.size(_object(top)) == 0, _none()).when(
        items.isNull(), _failed(STR_GET)).otherwise(_of(items, read, one)))


def _radon(top: Column) -> Column:
    """Blocks with complexity >= 10; >= 20 HIGH else MEDIUM; rule ``CC<n>``."""
    def read(m):
        return {"ok": _is_object(m), "cx": F.coalesce(_get(m, "complexity").try_cast("bigint"), F.lit(0).cast("bigint")),
                "lineno": _get(m, "lineno"), "name": _get(m, "name", "?"), "rank": _get(m, "rank", "?")}

    def block(path, i):
        def one(r):
            cx = r["cx"]
            text = cx.cast("string")
            found = F.when(cx >= COMPLEXITY_THRESHOLD, _item(
                i, r["i"], path, r["lineno"], F.when(cx >= COMPLEXITY_HIGH, F.lit("HIGH")).otherwise(F.lit("MEDIUM")),
                F.concat(F.lit("'"), r["name"], F.lit("' has cyclomatic complexity "), text,
                         F.lit(" (rank "), r["rank"], F.lit(")")),
                F.concat(F.lit("CC"), text),
                F.concat(F.lit("Break into smaller functions — complexity "), text,
                         F.lit(f" exceeds threshold {COMPLEXITY_THRESHOLD}"))))
            return F.when(r["ok"], found).otherwise(_failed(STR_GET)[0])
        return one

    def file(e, i):
        return _let(_list(e["value"]), lambda blocks: F.when(F.is_variant_null(e["value"]), _failed(NULL_ITERATE)).when(
            blocks.isNotNull(), F.array_compact(_of(blocks, read, block(e["key"], i)))).when(
            _text(e["value"]).isin("{}", ""), _none()).otherwise(_failed(STR_GET)))

    return _let(_object(top), lambda files: F.when(files.isNull(), _failed(LIST_ITEMS)).otherwise(
        F.flatten(F.transform(F.map_entries(files), file))))


def _eslint(top: Column) -> Column:
    """Severity >= 2 HIGH (missing -> 1) else MEDIUM; ``[rule] msg``; a
    missing ``ruleId`` reads ``unknown``, a null one ``None``."""
    def read(m):
        return {"ok": _is_object(m), "id": _part(m, "ruleId"), "severity": _get(m, "severity"), "line": _get(m, "line"),
                "message": _get(m, "message", ""), "fix": _get(m, "fix.text")}

    def file(f):
        def one(r):
            level = F.coalesce(r["severity"].try_cast("bigint"), F.lit(1))
            rule = F.when(r["id"].isNotNull(), F.coalesce(_text(r["id"]), F.lit("None"))).otherwise(F.lit("unknown"))
            return _let(rule, lambda x: _item(
                f["i"], r["i"], f["path"], r["line"], F.when(level >= 2, F.lit("HIGH")).otherwise(F.lit("MEDIUM")),
                F.concat(F.lit("["), x, F.lit("] "), r["message"]), x, r["fix"], F.when(~r["ok"], F.lit(STR_GET))))

        return (F.when(~f["ok"], _failed(STR_GET)).when(f["messages"].isNull(), _none())
                .when(F.is_variant_null(f["messages"]), _failed(NULL_ITERATE))
                .otherwise(_let(_list(f["messages"]), lambda xs: F.when(xs.isNull(), _failed(STR_GET)).otherwise(
                    _of(xs, read, one)))))

    def fields(f):
        return {"ok": _is_object(f), "path": _get(f, "filePath", ""), "messages": _part(f, "messages")}

    return _let(_list(top), lambda files: F.when(F.size(_object(top)) == 0, _none()).when(
        files.isNull(), _failed(STR_GET)).otherwise(F.flatten(_of(files, fields, file))))


def _audit(top: Column, chars: int | None = AUDIT_CHARS) -> Column:
    """The root is an array of deps or an object with ``dependencies``."""
    def read(v):
        return {"ok": _is_object(v), "id": _get(v, "id"), "description": _get(v, "description", ""),
                "no_description": _is_null(v, "description"), "fixes": F.coalesce(
                    F.try_variant_get(v, "$.fix_versions", "array<string>"), F.array().cast("array<string>"))}

    def dep(d):
        def one(r):
            bad = (F.when(~r["ok"], F.lit(STR_GET)).when(r["no_description"], F.lit(NULL_SUBSCRIPT))
                   .when(d["name"].isNull(), F.lit("'name'")))
            desc = r["description"]
            return _item(d["i"], r["i"], F.lit(AUDIT_FILE), F.lit(0), F.lit("HIGH"), F.concat(
                F.coalesce(_text(d["name"]), F.lit("None")), F.lit("=="), d["version"], F.lit(": "),
                F.coalesce(r["id"], F.lit("Unknown CVE")), F.lit(" — "),
                desc if chars is None else F.substring(desc, 1, chars)),
                r["id"], F.when(F.size(r["fixes"]) > 0, F.concat(F.lit("Upgrade to "), F.array_join(r["fixes"], ", ")))
                .otherwise(F.lit("No fix available yet")), bad)

        return (F.when(~d["ok"], _failed(STR_GET)).when(d["vulns"].isNull(), _none())
                .when(F.is_variant_null(d["vulns"]), _failed(NULL_ITERATE))
                .otherwise(_let(_list(d["vulns"]), lambda xs: F.when(xs.isNull(), _failed(STR_GET)).otherwise(
                    _of(xs, read, one)))))

    def fields(d):
        return {"ok": _is_object(d), "name": _part(d, "name"), "version": _get(d, "version", "?"), "vulns": _part(d, "vulns")}

    deps = F.when(_is_object(top), _list(_part(top, "dependencies"))).otherwise(_list(top))
    return _let(deps, lambda xs: F.when(xs.isNotNull(), F.flatten(_of(xs, fields, dep)))
                .when(_is_object(top) & ~_has(top, "dependencies"), _none())
                .when(_is_null(top, "dependencies"), _failed(NULL_ITERATE)).otherwise(_failed(STR_GET)))


READERS = {"bandit": _bandit, "ruff": _ruff, "radon": _radon, "eslint": _eslint, "pip-audit": _audit}


def _once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with a column that is computed once a row: a generator, so that no
    filter or projection above can repeat the expression or move it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


@functools.cache
def _items(application: str, tools: tuple[str, ...]) -> Column:
    """The findings of the column ``json`` by ``tool``: a large expression, built once an application."""
    items = _none()
    for tool in reversed(tools):
        items = F.when(F.col("tool") == tool, READERS[tool](F.col("json"))).otherwise(items)
    return F.when(F.col("json").isNotNull(), items).otherwise(_failed(INVALID_REPORT))


def read_reports(reports: DataFrame, tools: list[str] | None = None) -> DataFrame:
    """N1-N5 in one pass: per report the findings array and the error, if any.

    A report is parsed once, to a VARIANT, and one ``CASE tool`` reads it.  One
    that is not JSON, or lacks what its tool always writes, has an error and
    no findings.
    """
    r = reports if tools is None else reports.filter(F.col("tool").isin(tools))
    text = F.ltrim(F.col("report"))
    whole = F.when(text.startswith("[") | text.startswith("{"), F.try_parse_json(text))
    items = _items(reports.sparkSession.sparkContext.applicationId, tuple(tools or READERS))
    r = _once(r.select(*KEYS, "tool", "report"), whole, "json")
    r = _once(r.select(*KEYS, "tool", "json"), items, "items")
    error = F.get(F.filter(F.transform("items", lambda x: x["bad"]), lambda e: e.isNotNull()), F.lit(0))
    r = _once(r.drop("json"), error, "error")
    return r.withColumn("items", F.when(F.col("error").isNull(), F.col("items")).otherwise(_none()))


def _rows(read: DataFrame) -> DataFrame:
    return read.select(*KEYS, "tool", F.explode("items").alias("x")).select(
        *KEYS, "x.ord", *[F.col("tool") if c == "tool" else F.col(f"x.{c}") for c in FINDING_COLS])


def _normaliser(tool: str):
    def norm(reports: DataFrame, root: str | None = None) -> DataFrame:
        return relativize_paths(_rows(read_reports(reports, [tool])), root)

    norm.__doc__ = READERS[tool].__doc__
    return norm


norm_bandit = _normaliser("bandit")
norm_ruff = _normaliser("ruff")
norm_radon = _normaliser("radon")
norm_eslint = _normaliser("eslint")
norm_dependency_audit = _normaliser("pip-audit")


def report_failures(reports: DataFrame) -> DataFrame:
    """Per (PR, tool): the first error (by text) among its reports, if any."""
    return read_reports(reports).filter(F.col("error").isNotNull()).groupBy(*KEYS, "tool").agg(
        F.min("error").alias("error"))


def _tool_pos() -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TOOLS]), F.col("tool")).cast("int") - 1


def all_tool_findings(reports: DataFrame, secrets: DataFrame | None = None, root: str | None = None) -> DataFrame:
    """Findings of every tool whose reports all read well, with the tool
    ordinal: one scan of the reports, one window that drops a failed tool."""
    read = read_reports(reports)
    failed = F.max(F.col("error").isNotNull()).over(Window.partitionBy(*KEYS, "tool"))
    out = relativize_paths(_rows(read.withColumn("_failed", failed).filter(~F.col("_failed"))), root)
    if secrets is not None:
        out = out.unionByName(secrets.select(*KEYS, "ord", *FINDING_COLS))
    return out.withColumn("tool_pos", _tool_pos())


def tool_results(routes: DataFrame, reports: DataFrame, secrets: DataFrame | None = None) -> DataFrame:
    """One row per routed (PR, tool): error (null when it succeeded) and all its
    findings in report order, from one scan of the reports."""
    read = read_reports(reports).select(*KEYS, "tool", "error", F.transform("items", lambda x: x.dropFields("bad"))
                                        .alias("items"))
    if secrets is not None:
        s = secrets.groupBy(*KEYS, "tool").agg(F.collect_list(F.struct(
            "ord", *[F.coalesce(F.col(c), F.lit(0).cast("bigint") if c == "line" else F.lit("")).alias(c)
                     for c in FINDING_COLS if c != "tool"])).alias("items"))
        read = read.unionByName(s.withColumn("error", F.lit(None).cast("string")))
    per = read.groupBy(*KEYS, "tool").agg(F.min("error").alias("error"), F.flatten(F.collect_list("items")).alias("items"))
    j = routes.join(per, [*KEYS, "tool"], "left")
    empty = F.from_json(F.lit("[]"), per.schema["items"].dataType)
    return j.select(*KEYS, "tool", "tool_pos", "error", F.when(F.col("error").isNull(), F.coalesce("items", empty))
                    .otherwise(empty).alias("items"))


def tool_status(results: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Per routed (PR, tool): success, finding count (0 when failed), summary, error.

    ``targets`` (optional) counts scanned files per (PR, tool) for bandit's
    summary; it is aggregated before the join, so rows never multiply.
    """
    j = results.select(*KEYS, "tool", "tool_pos", "error", F.size("items").cast("bigint").alias("n"))
    if targets is not None:
        t = targets.groupBy(*KEYS, "tool").agg(F.count(F.lit(1)).alias("n_targets"))
        j = j.join(t, [*KEYS, "tool"], "left")
    else:
        j = j.withColumn("n_targets", F.lit(None).cast("bigint"))
    summary = F.lit("")
    for tool, text in SUMMARY.items():
        summary = F.when(F.col("tool") == tool, fill(
            text, n=F.col("n"), n_targets=F.coalesce("n_targets", F.lit(0)))).otherwise(summary)
    if targets is not None:
        none = (F.col("tool") == "bandit") & F.col("n_targets").isNull()
        summary = F.when(none, F.lit(NO_TARGETS)).otherwise(summary)
    ok = F.col("error").isNull()
    return j.select(*KEYS, "tool", "tool_pos", ok.alias("success"), F.col("n").alias("n_findings"),
                    F.when(ok, summary).otherwise(F.lit("")).alias("summary"),
                    F.coalesce("error", F.lit("")).alias("error"))


def unified_findings(routes: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings (of successful tools, see ``all_tool_findings``) of the
    routed tools; the comment text carries a ``[tool]`` prefix."""
    u = findings.join(routes.select(*KEYS, "tool"), [*KEYS, "tool"], "left_semi")
    return u.withColumn("tagged_message", F.concat(F.lit("["), F.col("tool"), F.lit("] "), F.col("message")))


def tool_prompt_text(results: DataFrame) -> DataFrame:
    """The text block each tool contributes to the agent prompts; lines
    ordered by file, then position in the report."""
    def line(x):
        return F.concat(F.lit("  - ["), x["severity"], F.lit("] "), x["file"], F.lit(":"), x["line"].cast("string"),
                        F.lit(" — "), x["message"], F.when(x["suggestion"] != "", F.concat(
                            F.lit("\n    Suggested fix: "), x["suggestion"])).otherwise(F.lit("")))

    ordered = F.array_sort(F.transform("items", lambda x: F.struct(x["file"].alias("file"), x["ord"].alias("ord"),
                                                                   line(x).alias("t"))))
    head = F.concat(F.lit("["), F.col("tool"), F.lit("] "))
    text = (F.when(F.col("error").isNotNull(), F.concat(head, F.lit("Not available: "), F.col("error")))
            .when(F.size("items") == 0, F.concat(head, F.lit("No issues found.")))
            .otherwise(F.concat(head, F.size("items").cast("string"), F.lit(" issue(s):\n"),
                                F.array_join(F.transform(ordered, lambda x: x["t"]), "\n"))))
    return results.select(*KEYS, "tool", "tool_pos", text.alias("text"))


def finding_totals(status: DataFrame) -> DataFrame:
    """Per PR: findings over successful tools, tools ok / failed."""
    return status.groupBy(*KEYS).agg(
        F.sum("n_findings").cast("bigint").alias("total_findings"),
        F.count_if(F.col("success")).cast("bigint").alias("tools_ok"),
        F.count_if(~F.col("success")).cast("bigint").alias("tools_failed"),
    )


def severity_filter(findings: DataFrame, cfg: DataFrame) -> DataFrame:
    """keep findings at or above the repo's threshold (LOW keeps everything)."""
    c = cfg.select("repo_name", F.col("severity_threshold").alias("_thr"))
    j = findings.join(c, "repo_name", "left")
    thr = severity_rank(F.coalesce("_thr", F.lit("LOW")))
    return j.filter((thr <= 1) | (severity_rank("severity") >= thr)).drop("_thr")


def inline_comments(findings: DataFrame, limit: int | None = INLINE_LIMIT) -> DataFrame:
    """the first ``limit`` findings per PR in tool order (``None``: all), *then* drop line < 1.

    Within a tool, findings are ordered by file, then position in the report.
    ``row_number() <= limit`` is planned as a window group limit, which keeps
    only the top rows per PR on the map side before the shuffle.
    """
    w = Window.partitionBy(*KEYS).orderBy("tool_pos", "file", "ord")
    top = findings.withColumn("comment_pos", F.row_number().over(w))
    if limit is not None:
        top = top.filter(F.col("comment_pos") <= limit)
    body = F.concat(F.lit("**"), F.coalesce("severity", F.lit("INFO")), F.lit("**: "), F.col("tagged_message"),
                    F.when(F.coalesce(F.col("suggestion"), F.lit("")) != "",
                           F.concat(F.lit("\n\n**Suggested fix**: "), F.col("suggestion"))).otherwise(F.lit("")))
    return top.filter(F.col("line") >= 1).select(*KEYS, "comment_pos", F.col("file").alias("path"), "line",
                                                 body.alias("body"))
