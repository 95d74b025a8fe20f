"""Breaking-change detection over patches (B1-B7) and caller lookup.

A patch is split once into line rows (B1) and definitions are recognised per
line with an ordered CASE of anchored regexes (B2), all in compiled stages;
everything after that is one shuffle keyed by (repo, PR, name) and window
aggregates over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prlens.functions import contains_any, fill, py_strip
from prlens.session import written

KEYS = ["repo_name", "pr_number"]

# Definition patterns, tried in this order; the first match wins.
# ``(?U)``: names may hold any letter or digit, not only ASCII ones.
DEF_RX = r"(?U)^def\s+(\w+)\s*\(([^)]*)\)"
CLASS_RX = r"(?U)^class\s+(\w+)"
EXPORT_RX = r"(?U)^export\s+(?:default\s+)?(?:function|const|class|let|var)\s+(\w+)"
DECORATOR_RX = r"""(?U)@\w+\.(get|post|put|delete|patch)\s*\(\s*["']([^"']+)"""
ROUTE_RX = r"""(?U)\.(get|post|put|delete|patch)\s*\(\s*["']([^"']+)"""
# Stricter variant (strict=True): the route path must start with "/".
STRICT_ROUTE_RX = r"""(?U)\.(get|post|put|delete|patch)\s*\(\s*["'](/[^"']*)"""

#: What a definition's line starts with, but for a route.
WORDS = ["def", "class", "export"]
METHODS = ["get", "post", "put", "delete", "patch"]

# Finding texts per kind, in report order.
MSG_FUNCTION = "Public function `{name}` removed from `{file}` — existing callers will break"
MSG_CLASS = "Class `{name}` removed from `{file}` — any code importing it will break"
MSG_ENDPOINT = "API endpoint `{method} {path}` removed from `{file}` — clients will get 404s"
MSG_SIGNATURE = "Function signature changed in `{file}`: `{old}` → `{new}` — existing callers may break"
KIND_ORDER = ["function", "class", "endpoint", "signature"]


def stripped_code(line: Column) -> Column:
    """``code`` of a changed line: its sign (or two equal ones) removed, stripped."""
    twice = line.startswith("--") | line.startswith("++")
    return py_strip(F.when(twice, F.substr(line, F.lit(3))).otherwise(F.substr(line, F.lit(2))))


def _side(line: Column) -> Column:
    return F.when(line.startswith("-") & ~line.startswith("---"), F.lit("removed")).when(
        line.startswith("+") & ~line.startswith("+++"), F.lit("added"))


def signed_lines(text: Column, sign: str) -> Column:
    """Array of (line_no, line) of a patch text's added (``+``) or removed (``-``) lines,
    for operators that read neighbouring lines by position."""
    numbered = F.transform(F.split(text, "\n", -1), lambda l, i: F.struct(i.alias("line_no"), l.alias("line")))
    return F.filter(numbered, lambda r: r["line"].startswith(sign) & ~r["line"].startswith(sign * 3))


def computed(df: DataFrame, cols: list[str], record: Column) -> DataFrame:
    """``cols`` and a struct's fields, computed once a row: a generator, so that no
    filter or projection above can repeat its expressions or move them."""
    return df.select(*cols, F.inline(F.array(record)))


def patch_lines(files: DataFrame, keep_context: bool = False, where=None) -> DataFrame:
    """B1: one row per changed patch line with its 0-based position.

    ``side`` is ``removed`` for ``-`` lines (not ``---``) and ``added`` for
    ``+`` lines (not ``+++``); ``code`` is the line stripped, with all leading
    sign characters removed, stripped again.  ``raw`` keeps the text after
    the sign with its indentation.  Files without a patch yield no rows.

    The lines are rows before anything is computed of them, so all of it is compiled.
    ``where(text)`` (fixed texts that a line must hold) leaves out patches, then lines, that the
    caller has no use for, before anything is computed of them.
    """
    cols = [c for c in files.columns if c != "patch"]
    files = files.filter(F.col("patch").isNotNull())
    if where is not None:
        files = files.filter(where(F.col("patch")))
    lines = files.select(*cols, F.posexplode(F.split(F.col("patch"), "\n", -1)).alias("line_no", "_line"))
    line = F.col("_line")
    if where is not None:
        lines = lines.filter(where(line))
    if not keep_context:
        lines = lines.filter(_side(line).isNotNull())
    return computed(lines, cols, F.struct(
        "line_no", _side(line).alias("side"), F.when(_side(line).isNotNull(), stripped_code(line)).alias("code"),
        F.substr(line, F.lit(2)).alias("raw")))


def extract_definitions(lines: DataFrame, strict: bool = False) -> DataFrame:
    """B2 on a line table: classify each changed line; rows that define nothing are dropped.

    kind: ``function`` (public ``def``, carries ``sig``), ``export`` (JS/TS
    export; counts as a function, no signature), ``class``, ``endpoint``
    (decorator route first, then any ``.get/post/...("...")`` call).
    A private ``def`` falls through to the later patterns.

    A pattern is tried only on lines that hold its fixed text, and its match is
    computed once a line.
    """
    route_rx = STRICT_ROUTE_RX if strict else ROUTE_RX
    cols = [c for c in lines.columns if c not in ("line_no", "side", "code", "raw")]
    code = F.col("code")
    word = {k: code.startswith(k) for k in WORDS}
    route = contains_any(code, [f".{m}" for m in METHODS])
    found = lines.filter(word["def"] | word["class"] | word["export"] | route)

    def part(given: Column, rx: str, i: int) -> Column:
        return F.when(given, F.regexp_extract(code, rx, i)).otherwise(F.lit(""))

    found = computed(found, [*cols, "line_no", "side", "code"], F.struct(
        part(word["def"], DEF_RX, 1).alias("dname"), part(word["class"], CLASS_RX, 1).alias("cname"),
        part(word["export"], EXPORT_RX, 1).alias("ename"),
        part(route & code.contains("@"), DECORATOR_RX, 1).alias("deco"), part(route, route_rx, 1).alias("route")))
    is_def = (F.col("dname") != "") & ~F.col("dname").startswith("_")
    is_class, is_export = F.col("cname") != "", F.col("ename") != ""
    deco, routed = F.col("deco") != "", F.col("route") != ""
    found = found.filter(is_def | is_class | is_export | deco | routed)
    is_ep = ~is_def & ~is_class & ~is_export
    return computed(found, [*cols, "line_no", "side", "code"], F.struct(
        F.when(is_def, F.lit("function")).when(is_class, F.lit("class")).when(is_export, F.lit("export"))
        .otherwise(F.lit("endpoint")).alias("kind"),
        F.when(is_def, F.col("dname")).when(is_class, F.col("cname")).when(is_export, F.col("ename")).alias("name"),
        F.when(is_def, F.concat(F.lit("def "), "dname", F.lit("("), F.regexp_extract(code, DEF_RX, 2), F.lit(")")))
        .alias("sig"),
        F.when(is_ep & deco, F.upper("deco")).when(is_ep, F.upper("route")).alias("method"),
        F.when(is_ep & deco, F.regexp_extract(code, DECORATOR_RX, 2)).when(
            is_ep, F.regexp_extract(code, route_rx, 2)).alias("path")))


def _may_define(text: Column) -> Column:
    return contains_any(text, [*WORDS, *[f".{m}" for m in METHODS]])


def patch_definitions(files: DataFrame, strict: bool = False) -> DataFrame:
    """B1 + B2: definitions straight from the patches."""
    return extract_definitions(patch_lines(files, where=_may_define), strict)


def annotate_definitions(defs: DataFrame) -> DataFrame:
    """Per-definition facts for B3-B7, computed in one shuffle.

    The rows are hash-partitioned once on (repo, PR, name); the per-file
    window (last removed / last added signature of a name in a file) and the
    per-name window (was the name's signature changed in any file of the PR)
    are both satisfied by that partitioning, so no branch re-reads the
    patches, and a PR with a huge share of the definitions is spread over
    its names.
    """
    d = defs.repartition(*KEYS, "name")
    fn = F.col("kind") == "function"
    rem = F.col("side") == "removed"
    add = F.col("side") == "added"
    w_file = Window.partitionBy(*KEYS, "name", "filename")
    w_pr = Window.partitionBy(*KEYS, "name")
    d = d.select(
        "*",
        F.max_by(F.when(fn & rem, F.col("sig")), F.when(fn & rem, F.col("line_no"))).over(w_file).alias("old"),
        F.max_by(F.when(fn & add, F.col("sig")), F.when(fn & add, F.col("line_no"))).over(w_file).alias("new"),
        F.min(F.when(fn & rem, F.col("line_no"))).over(w_file).alias("first_removed"),
    )
    changed_file = F.coalesce(F.col("old") != F.col("new"), F.lit(False))
    d = d.withColumn("changed_file", changed_file)
    d = d.withColumn("changed_in_pr", F.bool_or("changed_file").over(w_pr))
    return d.withColumn("is_signature_row", fn & rem & F.col("changed_file") & (F.col("line_no") == F.col("first_removed")))


def changed_signatures(ann: DataFrame) -> DataFrame:
    """Per file, a public def removed and added with a different signature.

    Duplicate names within a side: the last line wins (dict assignment); the
    row sits at the name's first removed line (dict insertion order).
    """
    return ann.filter("is_signature_row").select(*KEYS, "file_pos", "filename", "name", "old", "new", "line_no")


def removed_functions(ann: DataFrame, strict: bool = False) -> DataFrame:
    """Removed defs/exports whose name is not a changed signature anywhere in the PR.

    ``strict=True`` also drops a function re-added (any signature) in the same file.
    """
    cond = (F.col("side") == "removed") & F.col("kind").isin("function", "export") & ~F.col("changed_in_pr")
    if strict:
        w_file = Window.partitionBy(*KEYS, "name", "filename")
        readded = F.bool_or((F.col("side") == "added") & F.col("kind").isin("function", "export")).over(w_file)
        ann = ann.withColumn("_readded", readded)
        cond = cond & ~F.col("_readded")
    return ann.filter(cond).select(*KEYS, "file_pos", "filename", "line_no", "name")


def removed_classes(defs: DataFrame) -> DataFrame:
    """Every removed class line (a filter on the definitions, no shuffle)."""
    return defs.filter((F.col("side") == "removed") & (F.col("kind") == "class")).select(
        *KEYS, "file_pos", "filename", "line_no", "name")


def removed_endpoints(defs: DataFrame) -> DataFrame:
    """Every removed route, method upper-cased (a filter, no shuffle)."""
    return defs.filter((F.col("side") == "removed") & (F.col("kind") == "endpoint")).select(
        *KEYS, "file_pos", "filename", "line_no", "method", "path")


def breaking_changes(files: DataFrame, strict: bool = False) -> DataFrame:
    """All breaking findings of each PR, in the reference's report order
    (functions, classes, endpoints, signatures; then file and line order).

    Each annotated definition yields at most one finding, so the four kinds
    are a single CASE over one pass, not a union of four re-reads.  Of what is
    added only functions (their signatures) are looked at, and exports with ``strict``.
    """
    rem = F.col("side") == "removed"
    k = F.col("kind")
    ann = annotate_definitions(patch_definitions(files, strict).filter(
        rem | k.isin("function", *(["export"] if strict else []))))
    fn_cond = rem & k.isin("function", "export") & ~F.col("changed_in_pr")
    if strict:
        w_file = Window.partitionBy(*KEYS, "name", "filename")
        ann = ann.withColumn("_readded", F.bool_or((F.col("side") == "added") & k.isin("function", "export")).over(w_file))
        fn_cond = fn_cond & ~F.col("_readded")
    kind_pos = (F.when(fn_cond, F.lit(0)).when(rem & (k == "class"), F.lit(1)).when(rem & (k == "endpoint"), F.lit(2))
                .when(F.col("is_signature_row"), F.lit(3)))
    out = ann.withColumn("kind_pos", kind_pos).filter(F.col("kind_pos").isNotNull())
    kp = F.col("kind_pos")
    message = (F.when(kp == 0, fill(MSG_FUNCTION, file=F.col("filename"))).when(kp == 1, fill(MSG_CLASS, file=F.col("filename")))
               .when(kp == 2, fill(MSG_ENDPOINT, file=F.col("filename"))).otherwise(fill(MSG_SIGNATURE, file=F.col("filename"))))
    out = out.select(*KEYS, "kind_pos", F.element_at(F.array(*[F.lit(x) for x in KIND_ORDER]), kp + 1).alias("kind"),
                     "file_pos", "filename", "line_no", F.when(kp != 2, F.col("name")).alias("name"),
                     message.alias("message"))
    # Numbering needs the PR's findings together: a second, small exchange of
    # findings only (the definition lines themselves stay spread by name).
    # A PR's findings are sorted in one task, on disk where they do not fit.
    w = Window.partitionBy(*KEYS).orderBy("kind_pos", "file_pos", "line_no")
    return out.withColumn("finding_pos", F.row_number().over(w))


def breaking_flags(prs: DataFrame, breaking: DataFrame) -> DataFrame:
    """Per PR: has_breaking and the number of breaking findings (0 when none)."""
    n = breaking.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_breaking"))
    j = prs.select(*KEYS).join(n, KEYS, "left").fillna(0, ["n_breaking"])
    return j.withColumn("has_breaking", F.col("n_breaking") > 0)


def code_tokens(code: DataFrame, content_col: str = "content") -> DataFrame:
    """Identifier tokens per text, each once a text -- whole texts, all tokens
    (a path with several texts may repeat a token)."""
    words = F.array_distinct(F.split(F.col(content_col), r"[^\p{L}\p{N}_]+"))
    t = code.select("repo_name", "path", F.explode(words).alias("token"))
    return t.filter(F.col("token") != "")


def backward_compat_report(breaking: DataFrame, tokens: DataFrame) -> DataFrame:
    """For each broken function/class, how many *other* files of the repo
    mention its name.

    No finding-by-file pairs are formed: caller files are counted once per
    (repo, name) with a hash aggregate (after a semi-join keeps only the
    names that broke), and the finding's own file is subtracted with one
    equi-join lookup.  A name mentioned in millions of files costs one
    counter, not millions of joined rows.

    The broken names are written, so that their size is known before they meet the
    tokens: a few are broadcast, and no token that names nothing broken is moved.  What is left
    is written for its two readers.
    """
    b = breaking.filter(F.col("name").isNotNull()).select(*KEYS, "finding_pos", "kind", "name", "filename")
    names = written(b.select("repo_name", F.col("name").alias("token")).distinct(), "names")
    # Only tokens that name something broken go on; what is left is made distinct.
    t = written(tokens.join(names, ["repo_name", "token"], "left_semi").distinct(), "callers")
    counts = t.groupBy("repo_name", "token").agg(F.count(F.lit(1)).alias("n_files"))
    own = t.select("repo_name", F.col("path").alias("filename"), F.col("token").alias("name"),
                   F.lit(1).alias("own"))
    j = (b.join(counts.withColumnRenamed("token", "name"), ["repo_name", "name"], "left")
         .join(own, ["repo_name", "filename", "name"], "left"))
    n = F.coalesce(F.col("n_files"), F.lit(0)) - F.coalesce(F.col("own"), F.lit(0))
    return j.select(*KEYS, "finding_pos", "kind", "name", "filename", n.cast("bigint").alias("n_caller_files"))
