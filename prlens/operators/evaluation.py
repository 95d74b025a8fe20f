"""Review evaluation: keyword recall against planted issues.

The 19 checks are a fixed table; each PR row is expanded over them with a
literal array (no join), and a check is hit when any of its lower-cased
keywords occurs in the lower-cased review text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prlens.functions import contains_any

KEYS = ["repo_name", "pr_number"]

# The planted-issue checklist (category, issue, keywords).
CHECKS = [
    ("Security", "SQL injection", ["SQL", "injection", "sql_injection"]),
    ("Security", "Hardcoded secrets", ["hardcoded", "secret", "API_KEY", "DB_PASSWORD"]),
    ("Security", "eval() with user input", ["eval"]),
    ("Security", "MD5 for passwords", ["MD5", "md5", "hash"]),
    ("Security", "XSS in search_users", ["XSS", "xss", "unsanitized", "search"]),
    ("Correctness", "Off-by-one pagination", ["off-by-one", "offset", "page", "pagination"]),
    ("Correctness", "Race condition transfer", ["race", "transaction", "concurrent", "transfer"]),
    ("Correctness", "Bare except: pass", ["bare except", "swallow", "silent"]),
    ("Correctness", "Missing null check", ["None", "null", "fetchone", "NoneType"]),
    ("Performance", "N+1 query in orders", ["N+1", "n+1", "loop", "query"]),
    ("Performance", "O(n²) find_duplicates", ["O(n", "quadratic", "nested loop", "n²"]),
    ("Performance", "Full table load", ["SELECT *", "fetchall", "entire", "memory"]),
    ("Performance", "Unbounded cache", ["cache", "unbounded", "memory leak"]),
    ("Maintainability", "Bad variable names", ["naming", "d,", "tmp", "variable name"]),
    ("Maintainability", "process_data too complex", ["single responsibility", "too many", "process_data"]),
    ("Backward compat", "get_user signature change", ["signature", "breaking", "get_user", "callers"]),
    ("Dependencies", "Unpinned versions", ["unpin", "version", "pin"]),
    ("Dependencies", "Vulnerable jinja2/urllib3", ["jinja2", "urllib3", "CVE", "vulnerable"]),
    ("Testing", "No tests at all", ["no test", "missing test", "coverage", "zero test"]),
]
# The reference searches these five fields (dependency and test reviews are
# left out); include_all=True adds them.
SEARCHED = ["final_review", "correctness_review", "security_review", "performance_review", "maintainability_review"]
EXTRA = ["dependency_review", "test_review"]
PREVIEW_CHARS = 2000
EMPTY_PREVIEW = "(empty)"


def keyword_recall(wide: DataFrame, include_all: bool = False) -> DataFrame:
    """Per (PR, check): detected when any keyword is in the searched text.

    The lower-cased text is built once per PR; each check is a disjunction of
    literal ``contains`` tests (generated code), and the 19 results are
    exploded in place (no join against the check table).
    """
    fields = SEARCHED + (EXTRA if include_all else [])
    text = F.lower(F.concat(*[F.coalesce(F.col(f), F.lit("")) for f in fields]))
    t = wide.select(*KEYS, text.alias("_text"))
    checks = F.array(*[
        F.struct(F.lit(i + 1).alias("check_pos"), F.lit(c).alias("category"), F.lit(issue).alias("issue"),
                 contains_any(F.col("_text"), [k.lower() for k in kws]).alias("detected"))
        for i, (c, issue, kws) in enumerate(CHECKS)])
    return t.select(*KEYS, F.inline(checks))


def recall_summary(hits: DataFrame) -> DataFrame:
    """Detected / missed per PR."""
    return hits.groupBy(*KEYS).agg(
        F.count_if("detected").cast("bigint").alias("detected"),
        F.count_if(~F.col("detected")).cast("bigint").alias("missed"),
        F.count(F.lit(1)).cast("bigint").alias("checks"),
    )


def recall_by_category(hits: DataFrame) -> DataFrame:
    """E2 (per category): detected / missed per (PR, category)."""
    return hits.groupBy(*KEYS, "category").agg(
        F.count_if("detected").cast("bigint").alias("detected"),
        F.count_if(~F.col("detected")).cast("bigint").alias("missed"),
    )


def review_preview(long: DataFrame, col: str = "review") -> DataFrame:
    """The first 2000 characters, "(empty)" for no text, and a
    "... (n more chars)" tail for longer texts."""
    c = F.coalesce(F.col(col), F.lit(""))
    n = F.length(c)
    head = F.when(n == 0, F.lit(EMPTY_PREVIEW)).otherwise(F.substring(c, 1, PREVIEW_CHARS))
    tail = F.when(n > PREVIEW_CHARS, F.concat(F.lit("\n\n  ... ("), (n - PREVIEW_CHARS).cast("string"),
                                             F.lit(" more chars)"))).otherwise(F.lit(""))
    return long.select(*[c_ for c_ in long.columns if c_ != col], F.concat(head, tail).alias("preview"))


def expected_issue_report(hits: DataFrame) -> DataFrame:
    """Per planted issue, how many PR reviews detected it."""
    return hits.groupBy("check_pos", "category", "issue").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_prs"),
        F.count_if("detected").cast("bigint").alias("n_detected"),
    ).withColumn("detected_share", F.round(F.col("n_detected") / F.col("n_prs"), 6))
