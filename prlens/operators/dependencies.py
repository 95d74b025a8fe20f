"""Dependency manifest checks (A8-A11, A13) and test gaps.

Popular names and advisories are tables of any size (the fixed lists here are
the default): both meet the *distinct* packages or versions by equi-joins, and only
their results go back to the requirements, so a package that a third of all
repositories require is compared once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prlens.functions import py_strip

KEYS = ["repo_name", "pr_number"]

REQ_RX = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(\[[^\]]*\])?\s*(===|==|>=|<=|~=|!=|>|<)?\s*([^;\s,]*)"

# Fixed values (ours): popular package names typosquats imitate.
POPULAR = [
    "requests", "numpy", "pandas", "flask", "django", "jinja2", "urllib3", "pyyaml", "boto3", "setuptools",
    "red-widgets", "blue-anvyl", "small-rings", "hot-gears", "cold-plates", "large-rods", "old-bolts",
    "new-gizmos",
]
MAX_EDITS = 2

# Fixed values (ours): advisories (package, first affected or none, first fixed or none, id);
# a package may have several ranges.
ADVISORIES = [
    ("red-widget", "2.30", None, "ADV-2007"),
    ("green-bolt", None, "2.25rc1", "ADV-2008"),
    ("red-widget", "2.0.0", "2.20.0", "ADV-2001"),
    ("blue-bolt", "2.10.0", "2.30.0", "ADV-2002"),
    ("hot-plate", "2.0.0", "2.5.0", "ADV-2003"),
    ("small-gear", "2.25.0", "2.50.0", "ADV-2004"),
    ("jinja2", "2.0.0", "3.1.3", "ADV-2005"),
    ("urllib3", "1.0.0", "1.26.18", "ADV-2006"),
]

# Fixed values (ours): deprecated packages.
DEPRECATED = ["hot-gizmo", "old-rod", "cold-anvil", "nose", "pycrypto"]

TEST_PATH_RX = r"(^|/)(tests?/|test_[^/]*$|[^/]*_test\.py$)"


def norm_name(c) -> F.Column:
    return F.lower(F.regexp_replace(c, r"[-_.]+", "-"))


def parse_requirements(lines: DataFrame, keys: list[str], text_col: str = "line") -> DataFrame:
    """Requirement line -> package (normalised), operator, version; comments and blanks dropped."""
    t = py_strip(F.regexp_replace(F.col(text_col), r"#.*$", ""))
    r = lines.select(*keys, t.alias("_t")).filter(F.col("_t") != "")
    return r.select(*keys, norm_name(F.regexp_extract("_t", REQ_RX, 1)).alias("package"),
                    F.regexp_extract("_t", REQ_RX, 3).alias("op"), F.regexp_extract("_t", REQ_RX, 4).alias("version")
                    ).filter(F.col("package") != "")


def unpinned_dependencies(reqs: DataFrame) -> DataFrame:
    """No operator, or any operator but an exact ``==`` pin."""
    return reqs.filter(F.col("op") != "==")


def _without_one(name: Column) -> Column:
    """Every text that is ``name`` without one character."""
    n = F.char_length(name)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1)))


def deletions(name: Column) -> Column:
    """``name`` and what it leaves with one or two (MAX_EDITS) characters less, each once."""
    rest = F.array(name)
    for _ in range(MAX_EDITS):
        rest = F.array_distinct(F.concat(rest, F.flatten(F.transform(rest, _without_one))))
    return rest


def popular_frame(spark: SparkSession, names: list[str] = POPULAR) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "popular string")


def typosquats(reqs: DataFrame, popular: DataFrame | list[str] = POPULAR) -> DataFrame:
    """A10: names within 1-2 edits of a popular name (and not equal to it).

    Two names within two edits leave a common text when up to two characters of
    each are deleted.  The distinct packages and the popular table (``popular``)
    are indexed by these texts and meet by equi-join on them; what meets is
    confirmed by ``levenshtein``.  No package is compared with all names."""
    if not isinstance(popular, DataFrame):
        popular = popular_frame(reqs.sparkSession, popular)
    names = popular.select("popular").filter("popular IS NOT NULL").distinct()
    used = reqs.select(F.col("package").alias("name")).filter("name IS NOT NULL").distinct()
    near = (used.select("name", F.explode(deletions(F.col("name"))).alias("rest"))
            .join(names.select("popular", F.explode(deletions(F.col("popular"))).alias("rest")), "rest")
            .select("name", "popular").distinct()
            .withColumn("distance", F.levenshtein("name", "popular", MAX_EDITS).cast("bigint"))
            .filter(F.col("distance").between(1, MAX_EDITS)))
    return reqs.join(near, reqs["package"] == near["name"]).drop("name")


# Fixed value: the form of a version by the packaging rules (epoch, release, pre, post, dev, local).
VERSION_RX = (r"(?i)^v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?([0-9]*))?"
              r"((?:-[0-9]+)|(?:[-_.]?(?:post|rev|r)[-_.]?[0-9]*))?([-_.]?dev[-_.]?[0-9]*)?"
              r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?$")
LAST = (1 << 63) - 1


def version_key(version: Column) -> Column:
    """A struct that orders versions by the packaging rules; null for other texts.

    Epoch, release without trailing zeros, then developmental before pre-releases
    (a, b, rc) before the release before post-releases; a local label is later
    than none, its numbers are later than its words."""
    part = lambda i: F.regexp_extract(version, VERSION_RX, i)
    number = lambda t: F.coalesce(F.regexp_extract(t, "([0-9]+)$", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    release = F.transform(F.split(F.regexp_replace(part(2), r"(\.0+)+$", ""), r"\."), lambda x: x.try_cast("bigint"))
    pre, post, dev = F.lower(part(3)), part(5), part(6)
    rank = (F.when(pre.isin("a", "alpha"), 1).when(pre.isin("b", "beta"), 2).when(pre != "", 3)
            .when((dev != "") & (post == ""), 0).otherwise(4))
    local = F.transform(F.split(F.lower(part(7)), "[-_.]"), lambda x: F.struct(
        F.coalesce(x.try_cast("bigint"), F.lit(-1)).alias("n"),
        F.when(x.try_cast("bigint").isNull(), x).otherwise("").alias("t")))
    key = F.struct(
        number(part(1)).alias("epoch"), release.alias("release"), rank.alias("phase"), number(part(4)).alias("pre"),
        F.when(post == "", F.lit(-1).cast("bigint")).otherwise(number(post)).alias("post"),
        F.when(dev == "", F.lit(LAST)).otherwise(number(dev)).alias("dev"), (part(7) != "").alias("has_local"),
        local.alias("local"))
    return F.when(version.rlike(VERSION_RX) & F.forall(release, lambda x: x.isNotNull()), key)


def advisories_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ADVISORIES, "package string, introduced string, fixed string, advisory_id string")


def vulnerable_dependencies(reqs: DataFrame, adv: DataFrame) -> DataFrame:
    """Exact pins inside a range [introduced, fixed) of an advisory of the package.

    A package may have any number of ranges; no ``introduced`` means from the
    first version, no ``fixed`` that none is.  A text that is no version by the packaging rules is in no
    range.  Ranges meet each distinct (package, version) once, by package."""
    a = adv.select(norm_name(F.col("package")).alias("_package"), "introduced", "fixed", "advisory_id",
                   version_key(F.col("introduced")).alias("_from"), version_key(F.col("fixed")).alias("_to"))
    pins = reqs.filter(F.col("op") == "==")
    used = pins.select("package", "version").distinct().withColumn("_v", version_key(F.col("version")))
    inside = ((F.col("introduced").isNull() | (F.col("_v") >= F.col("_from")))
              & (F.col("fixed").isNull() | (F.col("_v") < F.col("_to"))))
    hits = used.join(a, (F.col("package") == F.col("_package")) & F.col("_v").isNotNull() & inside).select(
        "package", "version", "introduced", "fixed", "advisory_id")
    return pins.join(hits, ["package", "version"])


def deprecated_dependencies(reqs: DataFrame, deprecated: list[str] = DEPRECATED) -> DataFrame:
    """Requirements naming a deprecated package."""
    return reqs.filter(F.col("package").isin(deprecated))


def test_gaps(defs: DataFrame, lines: DataFrame) -> DataFrame:
    """Public functions added outside test paths that no added line in a
    test path of the same PR mentions (token match; names may be Unicode)."""
    added = defs.filter((F.col("side") == "added") & (F.col("kind") == "function")
                        & ~F.col("filename").rlike(TEST_PATH_RX))
    test_lines = lines.filter((F.col("side") == "added") & F.col("filename").rlike(TEST_PATH_RX))
    tokens = test_lines.select(*KEYS, F.explode(F.split("code", r"[^\p{L}\p{N}_]+")).alias("name")).filter(
        F.col("name") != "").distinct()
    # Merged, never broadcast: the tokens of all test lines are many more bytes than the files they are read from.
    gaps = added.join(tokens.hint("merge"), [*KEYS, "name"], "left_anti")
    return gaps.select(*KEYS, "file_pos", "filename", "line_no", "name")
