"""PR, changed-file, commit and tool-report intake."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prlens.functions import py_strip

# Placeholders the intake substitutes for missing fields.
NO_PATCH = "Binary file or no changes"

FILE_STRUCT = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("patch", T.StringType()),
    T.StructField("additions", T.LongType()),
    T.StructField("deletions", T.LongType()),
    T.StructField("status", T.StringType()),
])

PR_DUMP_SCHEMA = T.StructType([
    T.StructField("repo_name", T.StringType()),
    T.StructField("pr_number", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("head_sha", T.StringType()),
    T.StructField("total_additions", T.LongType()),
    T.StructField("total_deletions", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("files", T.ArrayType(FILE_STRUCT)),
])


def read_pr_dump(spark, path: str, fmt: str = "json") -> DataFrame:
    """Read a PR dump (one PR per record, files nested) with an explicit schema."""
    return spark.read.format(fmt).schema(PR_DUMP_SCHEMA).load(path)


def load_pr_files(prs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row per changed file with the PR's header fields.

    ``prs`` either carries the nested ``files`` array (a dump) or ``files`` is
    given as a flat table keyed by (repo_name, pr_number).  A missing patch
    becomes the fixed placeholder, a missing body the empty string; the
    file's list position is kept as ``file_pos`` (1-based) because later
    caps ("first 10 files") depend on it.
    """
    if files is None:
        head = [c for c in prs.columns if c != "files"]
        flat = prs.select(*head, F.posexplode("files").alias("pos", "f")).select(
            *head, (F.col("pos") + 1).cast("int").alias("file_pos"), "f.*"
        )
    else:
        flat = files.join(prs, ["repo_name", "pr_number"])
    out = flat.withColumn("patch", F.coalesce(F.col("patch"), F.lit(NO_PATCH)))
    if "body" in out.columns:
        out = out.withColumn("body", F.coalesce(F.col("body"), F.lit("")))
    return out


def load_commits(commits: DataFrame, since: dt.datetime | None = None,
                 until: dt.datetime | None = None) -> DataFrame:
    """Commit history per path, optionally restricted to ``[since, until]``.

    The bounds are plain column predicates, so they reach the parquet scan as
    pushed filters (and prune date partitions when the table is partitioned).
    """
    out = commits
    if since is not None:
        out = out.filter(F.col("ts") >= F.lit(since))
    if until is not None:
        out = out.filter(F.col("ts") <= F.lit(until))
    return out


# What an empty report means for each tool (its stdout default).
EMPTY_REPORT = {"bandit": "{}", "ruff": "[]", "radon": "{}", "eslint": "[]", "pip-audit": "[]"}


def load_tool_reports(reports: DataFrame) -> DataFrame:
    """S3: normalise raw JSON reports keyed by (repo, PR, tool).

    Empty output becomes the tool's empty document; ``root`` tells whether the
    document is an array or an object (pip-audit emits either); ``parse_ok``
    is false when the text is not JSON at all.
    """
    empty = F.lit(None).cast("string")
    for tool, doc in EMPTY_REPORT.items():
        empty = F.when(F.col("tool") == tool, F.lit(doc)).otherwise(empty)
    rep = F.coalesce(F.nullif(py_strip("report"), F.lit("")), empty, F.lit("{}"))
    out = reports.withColumn("report", rep)
    root = F.when(F.col("report").startswith("["), F.lit("array")).when(
        F.col("report").startswith("{"), F.lit("object")).otherwise(F.lit("invalid"))
    return out.withColumn("root", root).withColumn("parse_ok", json_ok(F.col("report")))


def json_ok(rep) -> F.Column:
    """True when the text parses as a JSON array or object."""
    return (F.when(F.ltrim(rep).startswith("["), F.from_json(rep, "array<string>").isNotNull())
            .when(F.ltrim(rep).startswith("{"), F.from_json(rep, "map<string,string>").isNotNull())
            .otherwise(F.lit(False)))
