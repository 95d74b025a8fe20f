"""Rule-based scans over changed lines and texts.

The reference asks its security/correctness/performance/maintainability
reviewers to look for these patterns; here each is a fixed regex rule (our
rules, labelled re-aimed in SURVEY §2.10).  A rule table is applied as an
array of ``CASE WHEN code RLIKE <literal>`` expressions -- every pattern is a
literal, compiled once per task, and no join against a rule table is needed.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prlens.functions import contains_any, py_strip
from prlens.operators.components import components
from prlens.session import written

KEYS = ["repo_name", "pr_number"]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    pattern: str
    severity: str
    message: str
    unless: str | None = None
    #: Texts that every match holds, one of each tuple: the regex is tried only on such lines.
    needs: tuple[tuple[str, ...], ...] = ()


QUOTE = ('"', "'")


# Fixed values (our rules): secrets in added lines and documents.
SECRET_RULES = [
    Rule("hardcoded-credential",
         r"""(?i)(password|passwd|pwd|secret|token|api_?key)\w*\s*[:=]\s*["'][^"'\s]{6,}["']""",
         "HIGH", "Possible hardcoded credential", needs=(QUOTE, ("=", ":"))),
    Rule("private-key-header", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "HIGH", "Private key material",
         needs=(("-----BEGIN ",),)),
    Rule("sk-api-key", r"\bsk-[A-Za-z0-9]{20,}", "HIGH", "Possible API secret key", needs=(("sk-",),)),
    Rule("aws-access-key", r"\bAKIA[0-9A-Z]{16}\b", "HIGH", "Possible AWS access key id", needs=(("AKIA",),)),
    Rule("github-token", r"\bgh[pousr]_[A-Za-z0-9]{36}\b", "HIGH", "Possible GitHub token",
         needs=(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),)),
]
SECRET_SUGGESTION = "Move the value to an environment variable or a secret store"

# Fixed values (our rules): security patterns in added lines.
SECURITY_RULES = [
    Rule("sql-string-build",
         r"""(?i)(\bf["'][^"']*\b(select|insert|update|delete)\b[^"']*\{)|(["']\s*(select|insert|update|delete)\b[^"']*["']\s*(\+|%))""",
         "HIGH", "SQL assembled from strings (injection risk)", needs=(QUOTE, ("{", "+", "%"))),
    Rule("eval-call", r"\beval\s*\(", "HIGH", "eval() on dynamic input", needs=(("eval",),)),
    Rule("weak-hash", r"(?i)\b(md5|sha1)\s*\(", "MEDIUM", "Weak hash function (md5/sha1)", needs=(("(",),)),
    Rule("fstring-html", r"""\bf["'][^"']*<[A-Za-z][^"']*\{""", "MEDIUM", "HTML built with an f-string (XSS risk)",
         needs=(("<",), ("{",))),
]

# Fixed values (our rules): failure-handling patterns in added lines.
FAILURE_RULES = [
    Rule("bare-except", r"^except\s*:", "MEDIUM", "Bare except swallows every error", needs=(("except",),)),
    Rule("uninformative-error-log", r"""(?i)print\s*\(\s*["'](error|failed|something went wrong)[^"']*["']\s*\)""",
         "LOW", "Error message without context", needs=(QUOTE, ("(",))),
    Rule("http-without-timeout", r"\brequests\.(get|post|put|delete|patch|head)\s*\(", "MEDIUM",
         "HTTP call without timeout", unless=r"timeout\s*=", needs=(("requests.",),)),
]

# Fixed values (our rules): maintainability patterns in added lines.
MAINTAINABILITY_RULES = [
    Rule("todo-without-ticket", r"\b(TODO|FIXME|HACK)\b", "LOW", "TODO without a ticket reference",
         unless=r"([A-Z][A-Z0-9]+-[0-9]+|#[0-9]+)", needs=(("TODO", "FIXME", "HACK"),)),
    Rule("vague-name", r"^(d|x|tmp|temp)\s*=[^=]", "LOW", "Vague variable name", needs=(("=",),)),
    Rule("and-in-function-name", r"^def\s+\w*_and_\w*\s*\(", "MEDIUM", "Function name joins two responsibilities",
         needs=(("_and_",),)),
]

# Fixed values (our rules): licence classes, tried in order.
LICENSE_RULES = [
    Rule("AGPL", r"(?i)\b(AGPL|Affero General Public License)", "HIGH", "copyleft"),
    Rule("GPL", r"(?i)\b(LGPL|GPL|GNU General Public License)", "MEDIUM", "copyleft"),
    Rule("noncommercial", r"(?i)\bCC BY-NC", "MEDIUM", "noncommercial"),
    Rule("permissive", r"(?i)\b(MIT License|Apache License|BSD License|BSD-[23]-Clause|ISC License)", "LOW",
         "permissive"),
]

# Fixed values (our rules): performance patterns.
LOOP_RX = r"^(async\s+)?for\s"
CALL_RX = r"(\.execute\s*\(|\.query\s*\(|\.objects\.(get|filter)\s*\(|\brequests\.(get|post|put|delete|patch)\s*\()"
SELECT_STAR_RX = r"(?i)\bselect\s+\*"
CACHE_RX = r"(?i)^\w*cache\w*\s*=\s*(\{\s*\}|dict\(\s*\))\s*$"
LOOKBACK = 5
FUNC_MEDIUM = 30
FUNC_HIGH = 50


# Fixed values (ours): quoted tokens of at least 20 characters whose characters are spread too evenly
# (bits a character) for a word or name; digests of known length and UUIDs are names.
TOKEN_CHARS = 20
TOKEN_RX = rf"""["']([A-Za-z0-9+/=_-]{{{TOKEN_CHARS},}})["']"""
HEX_RX = r"^[0-9a-fA-F]+$"
DIGEST_RX = (r"^([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
             r"|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$")
MIN_BITS, MIN_HEX_BITS = 4.5, 3.0


def shannon_entropy(text: Column) -> Column:
    """Bits a character of a text, from the histogram of its characters (0 for an empty one)."""
    n = F.char_length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: n - F.char_length(F.replace(text, c, F.lit(""))))
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * F.log2(c))
    return F.when(text == "", F.lit(0.0)).otherwise(F.log2(n) - total / n)


def entropy_scan(lines: DataFrame) -> DataFrame:
    """A1, for secrets of no known form: quoted tokens of added lines by their entropy."""
    code = F.col("code")
    quoted = added_lines(lines).filter((F.length(code) >= TOKEN_CHARS + 2) & contains_any(code, QUOTE))
    added = quoted.select(*KEYS, "file_pos", "filename", "line_no", F.posexplode(
        F.regexp_extract_all("code", F.lit(TOKEN_RX), F.lit(1))).alias("token_pos", "token"))
    added = added.filter(~F.col("token").rlike(DIGEST_RX))
    # A generator: the filter below would compute the entropy once more.
    added = added.select("*", F.explode(F.array(shannon_entropy(F.col("token")))).alias("entropy"))
    least = F.when(F.col("token").rlike(HEX_RX), MIN_HEX_BITS).otherwise(MIN_BITS)
    return added.filter(F.col("entropy") >= least).select(
        *KEYS, "file_pos", "filename", "line_no", "token_pos", F.length("token").alias("token_chars"),
        F.round("entropy", 6).alias("entropy"))


def _matches(text: F.Column, rule: Rule) -> F.Column:
    """Whether the rule's pattern matches (and its ``unless`` does not); null where there is no text."""
    cond = text.rlike(rule.pattern)
    for words in reversed(rule.needs):
        cond = contains_any(text, words) & cond
    return cond & ~text.rlike(rule.unless) if rule.unless else cond


def may_match(text: F.Column, rules: list[Rule]) -> F.Column:
    """Whether a text holds the fixed texts of any of the rules (which a match in one of its lines needs)."""
    return functools.reduce(operator.or_, [functools.reduce(
        operator.and_, [contains_any(text, words) for words in r.needs], F.lit(True)) for r in rules])


def may_hold_secret(text: F.Column) -> F.Column:
    return may_match(text, SECRET_RULES)


def rule_matches(text: F.Column, rules: list[Rule]) -> F.Column:
    """Array of the rules whose pattern matches (and whose ``unless`` does not)."""
    hits = [F.when(_matches(text, r), F.struct(
        F.lit(pos).alias("rule_pos"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"),
        F.lit(r.message).alias("message"))) for pos, r in enumerate(rules)]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def scan_lines(lines: DataFrame, rules: list[Rule], text_col: str = "code", first_only: bool = False) -> DataFrame:
    """Apply a rule table to a line table; one output row per (line, matching rule).

    A compiled filter finds the lines with any match; only they get the array of their rules."""
    text = F.col(text_col)
    m = rule_matches(text, rules)
    if first_only:
        m = F.slice(m, 1, 1)
    keep = [c for c in lines.columns]
    some = lines.filter(functools.reduce(operator.or_, [_matches(text, r) for r in rules]))
    return some.select(*keep, F.explode(m).alias("_r")).select(*keep, "_r.*")


def added_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("side") == "added")


def secret_scan(lines: DataFrame) -> DataFrame:
    """A1: secrets in added lines, as detect-secrets findings."""
    s = scan_lines(added_lines(lines), SECRET_RULES)
    return s.select(*KEYS, "file_pos", "filename", "line_no", "rule_pos", "rule_id", "severity", "message")


def secret_findings(lines: DataFrame) -> DataFrame:
    """A1 in the common finding layout (tool ``detect-secrets``)."""
    s = secret_scan(lines)
    return s.select(*KEYS, F.struct(F.col("line_no").cast("int").alias("a"), F.col("rule_pos").cast("int").alias("b")).alias("ord"),
                    F.col("filename").alias("file"), F.col("line_no").cast("bigint").alias("line"), "severity",
                    "message", F.lit("detect-secrets").alias("tool"), "rule_id",
                    F.lit(SECRET_SUGGESTION).alias("suggestion"))


def text_lines(docs: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """Whole texts split into lines (1-based ``line_no``), every line kept."""
    return docs.select(*keys, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line")).select(
        *keys, (F.col("pos") + 1).alias("line_no"), "line")


def secret_scan_texts(docs: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """A1 over documents / repository files: one row per (text, line, rule)."""
    s = scan_lines(text_lines(docs, text_col, keys), SECRET_RULES, text_col="line")
    return s.select(*keys, "line_no", "rule_id", "severity", "message")


def security_pattern_scan(lines: DataFrame) -> DataFrame:
    """A2: string-built SQL, eval, weak hashes, f-string HTML in added lines."""
    s = scan_lines(added_lines(lines), SECURITY_RULES)
    return s.select(*KEYS, "filename", "line_no", "rule_id", "severity", "message")


def failure_pattern_scan(lines: DataFrame) -> DataFrame:
    """A3: bare except, context-free error prints, HTTP calls without a timeout."""
    s = scan_lines(added_lines(lines), FAILURE_RULES)
    return s.select(*KEYS, "filename", "line_no", "rule_id", "severity", "message")


def maintainability_scan(lines: DataFrame) -> DataFrame:
    """A5: TODO without a ticket, vague names, ``_and_`` in a function name."""
    s = scan_lines(added_lines(lines), MAINTAINABILITY_RULES)
    return s.select(*KEYS, "filename", "line_no", "rule_id", "severity", "message")


def _indent(line: Column) -> Column:
    """How far the code of a changed line is indented, behind its sign."""
    raw = F.substr(line, F.lit(2))
    return F.length(raw) - F.length(F.ltrim(raw, F.lit(" \t")))


def _added_code(files: DataFrame) -> DataFrame:
    """Per file: the array of its added lines (line_no, code), parsed once from the
    patch (no explode, no shuffle)."""
    from prlens.operators.breaking import signed_lines, stripped_code

    aug = F.transform(signed_lines(F.col("patch"), "+"), lambda r: F.struct(
        r["line_no"].alias("line_no"), stripped_code(r["line"]).alias("code")))
    # A generator, as every place that reads the array would parse the patch once more.
    return files.filter(F.col("patch").isNotNull()).select(*KEYS, "filename", F.explode(F.array(aug)).alias("a"))


def performance_pattern_scan(files: DataFrame) -> DataFrame:
    """A4: query/HTTP call or a ``for`` within 5 added lines below a
    shallower ``for``; ``SELECT *``; a module-level ``cache = {}``.

    The look-back knows the places (among the patch's added lines) and indents of the
    patch's loops, found once a patch, so it needs neither a window nor a
    shuffle of the lines; a line looks at the loops among its five neighbours.

    Patches, and then lines, that lack the fixed texts of every rule are not parsed.
    """
    from prlens.operators.breaking import computed, signed_lines, stripped_code

    def place(r, k):
        return F.when(r["line"].contains("for") & stripped_code(r["line"]).rlike(LOOP_RX),
                      F.struct(k.alias("k"), _indent(r["line"]).alias("indent")))

    def alone(text):
        """Holds the fixed text of a rule that needs no loop."""
        return text.contains("*") | F.lower(text).contains("cache")

    # Generators: what reads a column above would compute it once more.
    patch = F.col("patch")
    a = files.filter(patch.contains("for") | alone(patch)).select(
        *KEYS, "filename", F.explode(F.array(signed_lines(patch, "+"))).alias("a"))
    loops = F.when(F.exists("a", lambda r: r["line"].contains("for")),
                   F.filter(F.transform("a", place), lambda p: p.isNotNull()))
    a = a.select("*", F.explode(F.array(loops)).alias("loops"))
    rows = a.select(*KEYS, "filename", "loops", F.posexplode("a").alias("k", "r"))
    line, near = F.col("r.line"), F.filter("loops", lambda p: p["k"].between(F.col("k") - LOOKBACK, F.col("k") - 1))
    rows = rows.filter(((F.size("loops") > 0) & (line.contains("(") | line.contains("for"))) | alone(line))
    rows = computed(rows, [*KEYS, "filename"], F.struct(
        F.col("r.line_no").alias("line_no"), stripped_code(line).alias("code"), _indent(line).alias("indent"),
        F.coalesce(F.exists("loops", lambda p: p["k"] == F.col("k")), F.lit(False)).alias("is_for"),
        F.when(F.size("loops") > 0, F.array_min(F.transform(near, lambda p: p["indent"]))).alias("loop_indent")))
    code, in_loop = F.col("code"), F.coalesce(F.col("loop_indent") < F.col("indent"), F.lit(False))
    rules = [
        (in_loop & code.contains("(") & code.rlike(CALL_RX), "query-in-loop", "HIGH",
         "Query or HTTP call inside a loop (N+1)"),
        (in_loop & F.col("is_for"), "nested-loop", "MEDIUM", "Nested loop (quadratic)"),
        (code.contains("*") & code.rlike(SELECT_STAR_RX), "select-star", "LOW", "SELECT * loads every column"),
        ((F.col("indent") == 0) & code.contains("=") & code.rlike(CACHE_RX), "unbounded-cache", "MEDIUM",
         "Module-level cache without a bound"),
    ]
    hits = F.filter(F.array(*[F.when(cond, F.struct(
        F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(message).alias("message")))
        for cond, rule_id, severity, message in rules]), lambda x: x.isNotNull())
    some = rows.filter(functools.reduce(operator.or_, [cond for cond, *_ in rules]))
    return some.select(*KEYS, "filename", "line_no", F.explode(hits).alias("_r")).select(
        *KEYS, "filename", "line_no", "_r.*")


def function_length(files: DataFrame) -> DataFrame:
    """Length of each added ``def``: added lines up to the next added
    ``def`` or the end of the file's added lines; >30 MEDIUM, >50 HIGH.
    Computed on the patch's own line array (positions of the defs), no shuffle."""
    a = _added_code(files)
    arr = F.col("a")
    pos = F.filter(F.transform(arr, lambda x, i: F.when(
        x["code"].startswith("def") & x["code"].rlike(r"^def\s+\w+"), i)), lambda i: i.isNotNull())
    a = a.select(*KEYS, "filename", "a", pos.alias("p"))
    pc = F.col("p")
    defs = F.transform(pc, lambda i, k: F.struct(
        F.element_at(arr, i + 1)["line_no"].alias("line_no"),
        F.regexp_extract(F.element_at(arr, i + 1)["code"], r"^def\s+(\w+)", 1).alias("name"),
        (F.coalesce(F.try_element_at(pc, k + 2), F.size(arr)) - i).cast("bigint").alias("length")))
    d = a.select(*KEYS, "filename", F.inline(defs))
    sev = F.when(F.col("length") > FUNC_HIGH, F.lit("HIGH")).when(F.col("length") > FUNC_MEDIUM, F.lit("MEDIUM"))
    return d.select(*KEYS, "filename", "line_no", "name", "length", sev.alias("severity"))


def duplicate_blocks(code: DataFrame, n: int = 5, content_col: str = "content") -> DataFrame:
    """Identical ``n``-line shingles (stripped, non-blank lines) that occur
    in at least two places of a repo.

    Shingles are cut from each text's own line array (``slice`` by
    position), so the lines are never shuffled to rebuild their order; they
    are keyed by md5 of their text and counted per (repo, shingle) with a
    partial + final hash aggregate, so a shingle repeated in a third of all
    files is combined map-side before the shuffle.
    """
    lines = F.filter(F.transform(F.split(F.col(content_col), "\n", -1), lambda l: py_strip(l)), lambda t: t != "")
    d = code.select("repo_name", "path", lines.alias("t"))
    t = F.col("t")
    sh = F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)),
                                            lambda i: F.md5(F.array_join(F.slice(t, i, n), "\n"))))
    ids = d.select("repo_name", "path", F.explode(sh).alias("shingle_id"))
    return ids.groupBy("repo_name", "shingle_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_places"),
        F.countDistinct("path").cast("bigint").alias("n_files"),
    ).filter(F.col("n_places") >= 2)


def license_flags(docs: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """Licence lines classified copyleft (AGPL, GPL), noncommercial or
    permissive; the first matching class per line."""
    s = scan_lines(text_lines(docs, text_col, keys), LICENSE_RULES, text_col="line", first_only=True)
    return s.select(*keys, "line_no", F.col("rule_id").alias("license"), F.col("message").alias("license_class"))


# Fixed values (ours): near duplicates share four fifths of their five-word shingles.
NEAR_SHINGLE_WORDS = 5
NEAR_THRESHOLD = (80, 100)


def shingle_hashes(code: DataFrame, content_col: str = "content", n: int = NEAR_SHINGLE_WORDS) -> DataFrame:
    """(repo, path, hs): the distinct word shingles of whole texts as 64-bit hashes in ascending
    order; a shorter text is one shingle.  The hash holds the repo, so repos share none."""
    text = py_strip(F.coalesce(F.col(content_col), F.lit("")))
    # Generators, as a column that is read twice would be computed twice.
    words = code.select("repo_name", "path", F.explode(F.array(F.split(text, r"\s+"))).alias("w")).filter(F.col("w")[0] != "")
    hashed = words.select("repo_name", "path", F.xxhash64("repo_name").alias("r"),
                          F.explode(F.array(F.transform("w", lambda w: F.xxhash64(w)))).alias("v"))
    shingles = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("v") - n)),
                           lambda i: F.xxhash64("r", *[F.get("v", i + k) for k in range(n)]))
    return hashed.select("repo_name", "path", F.sort_array(F.array_distinct(shingles)).alias("hs"))


def _file_sets(code: DataFrame, content_col: str) -> DataFrame:
    """``shingle_hashes`` with one row a path: the sets of its rows (mostly one) are united; rows
    without a repo or path are left out."""
    keys = ["repo_name", "path"]
    # Written, as its size, mostly nothing, decides whether the sets are moved to be joined with it.
    again = written(code.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(*keys), "again")
    union = (shingle_hashes(code.join(again, keys, "left_semi"), content_col).select(*keys, F.explode("hs").alias("h"))
             .groupBy(*keys).agg(F.sort_array(F.collect_set("h")).alias("hs")))
    return shingle_hashes(code.dropna(subset=keys), content_col).join(again, keys, "left_anti").unionByName(union)


def _sieved(texts: DataFrame) -> DataFrame:
    """The ids of the files that may be near another set, from the first three tenths of their hashes.

    Two sets X and Y that reach the threshold share at least ``num / den`` of the larger.  So at most
    ``n - ceil(n * num / den)`` hashes of a set come before or between its first m shared ones and
    are not shared: X and Y hold their first m shared hashes among that many and m hashes more.
    With m = 1 + n // 10, growing with n, and Y no smaller than ``num / den`` of X, X has at
    least the m of that size.  Hashes deal evenly, so boilerplate below a tenth is sieved as well."""
    num, den = NEAR_THRESHOLD
    n, m = F.col("n"), lambda size: 1 + F.floor(size / 10)
    head = n - F.ceil(n * num / den) + m(n)
    rows = texts.select("id", "n", "p0", F.explode(F.slice("hs", F.lit(1), head.cast("int"))).alias("h"))
    shared = rows.groupBy("h").agg(F.min("p0").alias("lo"), F.max("p0").alias("hi")).filter("lo != hi").select("h")
    return (rows.join(shared, "h", "left_semi").groupBy("id", "n").agg(F.count(F.lit(1)).alias("k"))
            .filter(F.col("k") >= m(F.ceil(n * num / den))).select("id"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (repo, a, b) whose whole sets reach the threshold: two equi-joins that bring each file's
    set as one array."""
    num, den = NEAR_THRESHOLD
    one, two = (sets.select(F.col("repo_name").alias("_repo"), F.col("path").alias(c), F.col("hs").alias(f"h{c}"))
                for c in ("a", "b"))
    met = pairs.select("repo_name", "a", "b").distinct()
    for side, c in ((one, "a"), (two, "b")):
        met = met.join(side.hint("shuffle_merge"), (F.col("repo_name") == F.col("_repo")) & (met[c] == side[c])).drop(
            "_repo", side[c])
    both = F.size(F.array_intersect("ha", "hb"))
    return met.filter(den * both >= num * (F.size("ha") + F.size("hb") - both)).select("repo_name", "a", "b")


def _nodes(links: DataFrame) -> DataFrame:
    """(repo, path, first) of every linked file: the smallest path it is linked with, directly or not."""
    at = lambda c: F.struct("repo_name", F.col(c).alias("path"))
    return components(links.select(at("a").alias("a"), at("b").alias("b"))).select(
        "node.repo_name", "node.path", F.col("component.path").alias("first"))


def near_duplicate_files(code: DataFrame, content_col: str = "content") -> DataFrame:
    """A7 (near): one row for each file of a repo: ``first_path``, the smallest path among
    the files it is linked with, directly or through others (itself if none), and
    ``n_docs``, how many files that group has.  Files are linked when their shingle sets
    have a Jaccard similarity of 0.8 or more; every link is found, none is guessed.

    1. Files with equal sets are one class (fingerprints of the whole set).
    2. Most files are near none: those whose smallest hashes say so go no further.
    3. Shingles are ranked, rare first, within a file.  Two sets that reach the
       threshold share a shingle among the first ninth of the smaller and the first fifth
       of the larger: only these prefixes meet, in buckets of one shingle.  Shingles that
       no other file has come first in any case; they are counted and not moved.
    4. Each file is compared with the smallest of its buckets; confirmed links are closed
       to groups.  A family of copies so costs one link for each member.
    5. What a bucket then still holds of different groups is compared pair by pair, as far
       as sizes and places allow a link at all, and the groups are closed for good.

    Files without words are alone.  Null content counts as empty."""
    num, den = NEAR_THRESHOLD
    prints = [F.xxhash64(F.lit(i), "hs").alias(f"p{i}") for i in range(3)]
    texts = written(_file_sets(code, content_col).select("*", F.size("hs").alias("n"), *prints,
                                                         F.monotonically_increasing_id().alias("id")), "sets")
    files = texts.drop("hs")
    same = ["repo_name", "n", "p0", "p1", "p2"]
    classes = written(files.join(files.groupBy(*same).agg(F.min("path").alias("rep")), same)
                      .select("id", "repo_name", "path", "rep"), "classes")
    some = written(classes.filter("path = rep").select("id").join(_sieved(texts), "id"), "sieved")
    arrays = written(texts.join(some, "id", "left_semi").select("repo_name", "path", "n", "hs"), "arrays")
    sets = arrays.select("repo_name", "path", "n", F.explode("hs").alias("h"))
    common = sets.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    file = Window.partitionBy("repo_name", "path")
    # Behind the shingles of its own a file has its k shared ones; links need most of a file's.
    own = F.col("n") - F.count(F.lit(1)).over(file)
    ranked = sets.join(common, "h").select("*", own.alias("own"), F.row_number().over(file.orderBy("c", "h")).alias("i"))
    kept = lambda least: F.col("n") - F.ceil(least) + 1
    prefix = written(
        ranked.withColumn("pos", F.col("own") + F.col("i"))
        .filter((F.col("own") < kept(F.col("n") * num / den)) & (F.col("pos") <= kept(F.col("n") * num / den)))
        .withColumn("index", F.col("pos") <= kept(F.col("n") * (2 * num) / (num + den))).drop("c", "own", "i"), "prefixes")

    centre = prefix.groupBy("repo_name", "h").agg(F.min(F.struct("n", "path")).alias("m"))
    star = written(
        prefix.join(centre, ["repo_name", "h"]).filter((F.col("path") != F.col("m.path"))
                                                       & (den * F.col("m.n") >= num * F.col("n")))
        .select("repo_name", F.col("m.path").alias("a"), F.col("path").alias("b")).distinct(), "stars")
    links = written(_verified(star, arrays), "near-links")

    first = written(_nodes(links), "groups")
    g = prefix.join(first, ["repo_name", "path"], "left").withColumn("first", F.coalesce("first", "path"))
    mixed = g.groupBy("repo_name", "h").agg(F.min("first").alias("lo"), F.max("first").alias("hi")).filter("lo != hi")
    g = written(g.join(mixed.select("repo_name", "h"), ["repo_name", "h"], "left_semi"), "mixed")
    x, y = g.filter("index").alias("x"), g.alias("y")
    # Overlap needed at least, and what is left of both sets after the shared shingle.
    least = F.ceil((F.col("x.n") + F.col("y.n")) * num / (num + den))
    left = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) + 1
    met = x.join(y.hint("shuffle_merge"), (F.col("x.repo_name") == F.col("y.repo_name")) & (F.col("x.h") == F.col("y.h"))
                 & (F.struct("x.n", "x.path") < F.struct("y.n", "y.path")) & (F.col("x.first") != F.col("y.first"))
                 & (den * F.col("x.n") >= num * F.col("y.n")))
    # A pair's first shared shingle decides by its place; later ones say nothing more.
    pairs = (met.groupBy(F.col("x.repo_name").alias("repo_name"), F.col("x.path").alias("a"), F.col("y.path").alias("b"))
             .agg(F.max(left - least).alias("room")).filter("room >= 0")
             .join(star, ["repo_name", "a", "b"], "left_anti"))
    more = _verified(pairs, arrays)
    group = _nodes(links.unionByName(more))
    firsts = classes.join(group.select("repo_name", F.col("path").alias("rep"), "first"), ["repo_name", "rep"], "left")
    found = firsts.select("repo_name", "path", F.coalesce("first", "rep").alias("first_path"))
    every = code.select("repo_name", "path").distinct().join(found, ["repo_name", "path"], "left")
    every = written(every.withColumn("first_path", F.coalesce("first_path", "path")), "near-files")
    sizes = every.groupBy("repo_name", "first_path").agg(F.count(F.lit(1)).cast("bigint").alias("n_docs"))
    return every.join(sizes, ["repo_name", "first_path"])


def near_duplicate_groups(code: DataFrame, content_col: str = "content") -> DataFrame:
    """A7 (near): every group of two files or more, once: its first file and how many files it has."""
    return near_duplicate_files(code, content_col).groupBy("repo_name", "first_path").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_docs")).filter("n_docs > 1")
