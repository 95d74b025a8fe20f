"""Column-expression helpers shared by the operators.

All helpers return native Spark ``Column`` expressions; none of them runs
Python per row.  Scalar helpers compile into whole-stage code; those built on
array lambdas (``transform``, ``filter``, ``exists``) are evaluated by Spark's
interpreter inside the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity order used by the severity filter, the ranking and the
# merge decision (LOW < MEDIUM < HIGH < CRITICAL; anything else ranks 0).
SEVERITY_ORDER = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: str | Column) -> Column:
    """Python ``str.strip()``: trims all leading/trailing whitespace, not only spaces.

    A native trim; only a text that ends in one of the three line ends that ``$``
    looks past goes through the regex."""
    c = col_(c)
    odd = c.endswith("\u0085") | c.endswith("\u2028") | c.endswith("\u2029")
    return F.when(odd, F.regexp_replace(c, r"^\s+|\s+$", "")).otherwise(F.btrim(c, F.lit(" \t\n\x0b\f\r")))


def severity_rank(c: str | Column) -> Column:
    c = F.upper(col_(c))
    expr = F.when(c == SEVERITY_ORDER[0], F.lit(1))
    for i, name in enumerate(SEVERITY_ORDER[1:], start=2):
        expr = expr.when(c == name, F.lit(i))
    return expr.otherwise(F.lit(0))


def severity_name(rank: str | Column) -> Column:
    r = col_(rank)
    expr = F.when(r == 1, F.lit(SEVERITY_ORDER[0]))
    for i, name in enumerate(SEVERITY_ORDER[1:], start=2):
        expr = expr.when(r == i, F.lit(name))
    return expr


def contains_any(c: str | Column, words: Iterable[str]) -> Column:
    """Substring test against a fixed word list (no regex, no LIKE escaping)."""
    c = col_(c)
    out = None
    for w in words:
        cond = c.contains(w)
        out = cond if out is None else (out | cond)
    return out if out is not None else F.lit(False)


def fill(template: str, **values: Column) -> Column:
    """A fixed text with ``{name}`` places filled from columns (as strings)."""
    parts, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        key, rest = rest.split("}", 1)
        parts += [F.lit(before), values[key].cast("string") if key in values else F.col(key).cast("string")]
    return F.concat(*parts, F.lit(rest))


def _escaped(c: Column) -> Column:
    """Regex text for literal characters (ASCII punctuation is escaped)."""
    return F.regexp_replace(c, r"([\x00-/:-@\[-`{-\x7f])", r"\\$1")


def _class(token: Column) -> Column:
    """Regex for one ``[...]`` of a glob: ranges in order only, everything else literal."""
    negated = token.startswith("[!")
    start = F.when(negated, F.lit(3)).otherwise(F.lit(2))
    body = F.substr(token, start, F.char_length(token) - start)
    items = F.regexp_extract_all(body, F.lit("(?s).-.|."), F.lit(0))
    first, last = lambda t: F.substring(t, 1, 1), lambda t: F.substring(t, 3, 1)
    items = F.filter(items, lambda t: (F.char_length(t) == 1) | (first(t) <= last(t)))
    text = F.array_join(F.transform(items, lambda t: F.when(F.char_length(t) == 1, _escaped(t)).otherwise(
        F.concat(_escaped(first(t)), F.lit("-"), _escaped(last(t))))), "")
    return (F.when(text != "", F.concat(F.when(negated, F.lit("[^")).otherwise(F.lit("[")), text, F.lit("]")))
            .when(negated, F.lit(".")).otherwise(F.lit("(?!)")))


def glob_to_regex(pattern: str | Column) -> Column:
    """Translate a shell glob (fnmatch rules) into an anchored Java regex.

    ``*`` crosses ``/``; ``?`` is any one character; ``[..]`` / ``[!..]`` are
    character classes (a ``]`` right after the opening is literal, a reversed
    range matches nothing, an unclosed ``[`` is literal); every other character
    stands for itself.  Any text is a valid pattern, so one odd glob cannot fail
    a job.  ``(?s)`` makes ``.`` match a newline as fnmatch does.
    """
    tokens = F.regexp_extract_all(col_(pattern), F.lit(r"(?s)\[!?\]?[^\]]*\]|."), F.lit(0))
    parts = F.transform(tokens, lambda t: (
        F.when(t == "*", F.lit(".*")).when(t == "?", F.lit("."))
        .when((F.char_length(t) > 1) & ~t.isin("[]", "[!]"), _class(t)).otherwise(_escaped(t))))
    return F.concat(F.lit("(?s)^"), F.array_join(parts, ""), F.lit("\\z"))
